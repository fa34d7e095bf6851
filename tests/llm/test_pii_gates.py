import pytest

from tideline.llm import pii, pii_sample

NAMES = pii.names_regex(tuple(pii_sample.GIVEN))


@pytest.mark.parametrize(
    "kind, text",
    [
        ("phone", "one two eight six seven nine four"),
        ("phone", "eins zwei drei vier sechs sieben"),
        ("phone", "ocho nueve uno dos tres seis"),
        ("phone", "Zero two eight six seven nine"),
        ("address", "Hauptstraße\u00a012"),
        ("address", "Gartenweg\u202f7"),
        ("email", "liv[at ]postbox.example"),
        ("email", "liv(\u00a0AT\u00a0)postbox.example"),
        ("email", "liv at\u00a0postbox.example"),
        ("email", "liv at postbox . example"),
    ],
)
def test_whatever_an_expression_takes_is_proposed(kind, text):
    for around in (text, f"Say {text}, then wait."):
        assert text in [around[a:b] for k, a, b, _ in pii.spans(around, NAMES) if k == kind]
