import pytest

from tests.llm.test_pii import corpus, learnt
from tideline.llm import pii, pii_sample


def found(det, t):
    return [(k, t[a:b]) for k, a, b, _ in det.find([t])[0]]


def test_names_that_no_list_holds():
    det = learnt([t for t, _ in corpus()])
    assert "Quillan" not in pii_sample.GIVEN and "quillan" in det.known
    assert found(det, "Reporter: Brunhild Weber; the crowd at Elkstoton Quay was calm.") == [("name", "Brunhild Weber")]
    # Introduced elsewhere in the corpus, so known without a title and in lower case.
    assert found(det, "Later Quillan Weber closed the door; i saw quillan weber too") == [("name", "Quillan Weber"), ("name", "quillan weber")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Please ask Maria Gonzalez or John Smith at the desk.", [("name", "Maria Gonzalez"), ("name", "John Smith")]),
        ("Write to anna.keller@gmail.com or call 020 7123 4567.", [("email", "anna.keller@gmail.com"), ("phone", "020 7123 4567")]),
        ("National insurance AB 12 34 56 C was on the slip.", [("id_number", "AB 12 34 56 C")]),
        ("my number is one two three four six seven eight two", [("phone", "one two three four six seven eight two")]),
        ("DNI 12345678Z y móvil +34 612 345 678.", [("id_number", "12345678Z"), ("phone", "+34 612 345 678")]),
        ("She lives at 221B Baker Street, London and left.", [("address", "221B Baker Street, London")]),
        ("Order 123456789 ships with version 10.244.1203 on 2025-03-04.", []),
        ("The crowd at Victoria Station saw 40 people on the street.", []),
    ],
)
def test_without_any_corpus(text, want):
    got = found(pii.Detector(), text)
    assert [(k, s) for k, s in got if k != "address"] == [(k, s) for k, s in want if k != "address"]
    assert [s[:17] for k, s in got if k == "address"] == [s[:17] for k, s in want if k == "address"]


def test_counts_are_of_all_documents(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(300, 5))] + [(1000 + i, f"Witness Brunhild Weber{x} lives at 7 Galmoby Road and left.") for i, x in enumerate("abcdefgh")]
    det = pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "Brunhild" in det.given and "brunhild" in det.known
    assert det.known == learnt([t for _, t in rows]).known


def test_sample_is_the_same_each_time_and_has_every_kind():
    a = pii_sample.rows(2)
    assert a == pii_sample.rows(2) and {k for _, m in a for k, _ in m} == set(pii.KINDS)
    for t, marks in a:
        assert all(t[at].isalnum() or t[at] in "+(" for _, at in marks)
