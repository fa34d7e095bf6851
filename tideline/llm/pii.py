"""Problem 7: mail addresses, phone numbers, identity numbers, street addresses and names of persons in free text.

Generators with high recall propose spans, which may overlap; a span is described by its format and its context; boosted
trees, one model per kind, give each span a calibrated probability; spans above the kind's threshold are kept, of overlapping
ones the most probable (of equally probable ones, to a tenth, the longest). Redaction replaces each by a placeholder of its kind and leaves the rest of the text as it is.

The trees are fitted to a labelled sample written by hand (:mod:`tideline.llm.pii_sample`, ``TIMES`` fillings of each of its
sentences), never to the corpus, and see formats (public numbering plans, shapes of identity documents, street words) and kinds of words around,
not the words themselves. From the corpus come two counts over all documents and whole texts: given names, taken where they
follow a title or label three times or more, and lower-case words so common that they are no names. Names without a title are so found
if the given name is common in public lists or has been introduced somewhere in the corpus.

Null and blank texts hold nothing; rows with a null id are dropped; repeated texts are reported under each id. An empty table
gives no rows. Offsets count Unicode characters from 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import pii_sample
from tideline.llm.boosting import Trees

KINDS = ("email", "phone", "id_number", "address", "name")
#: How often each line of the labelled sample is filled: about 3,300 mentions and as many spans that are none.
TIMES = 24

# Words that end or open street names.
STREETS = "road|rd|street|st|avenue|ave|lane|ln|close|crescent|cres|drive|dr|way|court|ct|place|pl|square|boulevard|blvd|terrace|row|walk|gardens|mews|hill"
_STRASSEN = "straße|strasse|str\\.|weg|allee|gasse|platz|ring|damm|ufer"
_CALLES = "Calle|C/|Avda\\.?|Avenida|Plaza|Paseo|Camino|Ronda|Carrera"
_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"

_S = "[    ]"
_NUMBER = re.compile(
    r"(?<![\w@#/:+.,\-‑])(?!\d{4}-\d\d-\d\d(?!\d))(?:[A-Z]{1,2}[ \-]?|\+)?(?:\(\d{1,5}\)" + _S + r"?)?\d(?:(?:[    .\-‑–/]|" + _S + r"?\(0\)" + _S + r"?|\)" + _S + r"?)?\d){5,14}(?:[ \-]?[A-Z](?!\w))?(?:,?" + _S + r"(?:ext|x|Durchw|App)\.?" + _S + r"?\d{1,5})?(?!\w|[:/@]\d|[.\-]\d)"
)
_SPOKEN = re.compile(rf"\b(?:(?:{_DIGIT})[ \-]){{5,}}(?:{_DIGIT})\b")
_DIGIT_WORDS = frozenset(_DIGIT.split("|"))
_SIGN = r"(?:" + _S + r"?[@＠]" + _S + r"?|" + _S + r"?[\[({]" + _S + r"?(?:at|AT|@)" + _S + r"?[\])}]" + _S + r"?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DOTS = r"(?:\.|" + _S + r"\." + _S + r"|" + _S + r"?[\[({]" + _S + r"?(?:dot|DOT)" + _S + r"?[\])}]" + _S + r"?|" + _S + r"(?:dot|DOT)" + _S + r")"
_HOST = r"(?:" + _LABEL + r"(?:" + _DOTS + _LABEL + r")*?" + _DOTS + r"[A-Za-z]{2,12})(?![A-Za-z0-9]|-[A-Za-z0-9])(?!" + _DOTS + r"[A-Za-z]{2,12}(?![A-Za-z0-9]))"
_DOMAIN = re.compile(_SIGN + _HOST)
_SAID = re.compile(_S + r"(?:at|AT)" + _S + _HOST)
#: What every match of _DOMAIN holds.
_AT = re.compile(r"[@＠]|[\[({]" + _S + r"?(?:at|AT)")
_LOCAL = re.compile(r"(?<![\w.+%\-])[\w](?:[\w.+%\-]*[\w])?(?:" + _S + r"(?:dot|DOT|underscore|UNDERSCORE|dash|plus)" + _S + r"[\w](?:[\w.+%\-]*[\w])?){0,4}$")
_ENGLISH = re.compile(rf"\d(?<![\w:.,\-/‑].)\d{{0,3}}[A-Za-z]?(?:{_S}?[\-–]{_S}?\d{{1,4}}[A-Za-z]?)?{_S}(?:[^\W\d_][\w'’\-]*{_S}){{1,3}}?(?:{STREETS})\b\.?", re.I)
_GERMAN = re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ][\w\-]*?(?:{_STRASSEN})|[A-ZÄÖÜ][\w\-]+[ \-](?:Straße|Weg|Allee|Platz)){_S}\d{{1,4}}{_S}?(?:[a-z](?!\w))?(?!\d)")
_SPANISH = re.compile(rf"(?<!\w)(?:{_CALLES}){_S}(?:(?:de|del|de la){_S})?[^\W\d_][\w\-]*(?:{_S}[A-Z][\w\-]*){{0,2}},?{_S}(?:n\.?{_S}?[º°o]\.?{_S}?)?\d{{1,4}}(?!\d)")
#: Parts of which a text must hold one before the expression is tried; each match of it has one (German ones in lower case).
_STREET_ENDS = re.compile(rf"(?:{_STRASSEN}){_S}\d")
_SPANISH_WORDS = ("Calle", "C/", "Avda", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Carrera")
_REST = re.compile(
    rf"(?:,?{_S}(?:Flat|Apt\.?|Apartment|Unit|Suite|#){_S}?#?\d{{1,4}}[A-Za-z]?)?(?:,{_S}(?:Hinterhaus|Vorderhaus|bajo{_S}[A-Z]|\d\.º{_S}\w+))?(?:,{_S}\d{{5}}{_S}[A-ZÄÖÜ][\w\-]+|(?:,{_S}|\n)(?!(?:he|she|they|the|a|an)\b)[^\W\d_]{{4,}}(?=,?{_S}[A-Z]{{1,2}}\d|{_S}\d{{5}}|[\".,;]|$|\n))?(?:,?{_S}[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}|{_S}\d{{5}}(?!\d))?",
    re.I,
)
_UP = "A-ZÀ-ÖØ-Þ"
#: An initial and a family name (group 1), or a family name in capitals and a given name.
_OTHER_NAMES = re.compile(
    rf"(?<!\w)(?:((?<!\.)[{_UP}]\.{_S}[{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)?(?![\w@]))|[{_UP}]{{3,}}(?:-[{_UP}]{{2,}})?,{_S}[{_UP}][^\W\d_]+(?!\w))"
)
# Titles, and labels and verbs that names of persons follow.
_TITLES = "Mr|Ms|Mrs|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora"
_CUE = rf"(?:\b(?:{_TITLES})\.?{_S}|\b(?:Name|Reporter|Witness|Firmado|Unterschrift|Signed|Contact|Attn|Author|Patient):?{_S}|\b(?:[Cc]all|[Ss](?:ent|igned) by|[Rr]eported by|[Ee]scalated by|[Gg]emeldet von){_S})"
_CUES = re.compile(rf"(?=[MDPHFSNRWUCAaceghrs])(?:{_CUE})([{_UP}][^\W\d_]{{1,14}}){_S}(?:[{_UP}]\.{_S})?([{_UP}][^\W\d_]{{2,}})")
_LED = re.compile(rf"{_CUE}$")
#: Any two words in title case or capitals, perhaps with an initial between; matches may overlap.
_PAIR = re.compile(rf"[{_UP}](?<![\w@.\-+/].)(?=([^\W\d_]+(?:-[{_UP}][^\W\d_]+)?(?:{_S}[{_UP}]\.)?{_S}[{_UP}][^\W\d_]{{2,}}(?:-[^\W\d_]{{3,}})?)(?![\w@＠]|[._+][\w]))")


def names_regex(given: tuple[str, ...]) -> re.Pattern:
    """A given name in title case, capitals or lower case, then perhaps an initial, then a family name."""
    g = sorted({x for n in given for x in (n, n.upper(), n.lower())}, key=lambda x: (-len(x), x))
    heads = defaultdict(list)
    for x in g:
        heads[x[0]].append(x[1:])
    alt = "|".join(f"{h}(?:{'|'.join(map(re.escape, t))})" for h, t in sorted(heads.items()))
    return re.compile(rf"(?<![\w@.\-+/])(?:{alt})(?:{_S}[{_UP}]\.)?{_S}(?!(?:dot|DOT|underscore|UNDERSCORE|dash|plus|at|AT)\b)[^\W\d_]{{3,}}(?:-[^\W\d_]{{3,}})?(?![\w@＠]|[._+][\w])")


def _hosts(text: str) -> Iterator[re.Match]:
    """Signs with the host behind them. A match of _DOMAIN begins where _AT stands or at the blank before."""
    end = 0
    for at in _AT.finditer(text):
        for a in (at.start() - 1, at.start()):
            if a >= end and (m := _DOMAIN.match(text, a)):
                end = m.end()
                yield m
                break
    yield from _SAID.finditer(text)


def _mailbox(text: str, host: re.Match) -> tuple[str, int, int, int] | None:
    # A local part has 64 characters at most (RFC 5321), spelt-out dots and dashes some more.
    left = _LOCAL.search(text, max(0, host.start() - 90), host.start())
    return ("email", left.start(), host.end(), 0 if "@" in host.group() or "＠" in host.group() else 1) if left else None


def spans(text: str, names: re.Pattern) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, generator) of everything that may be a mention."""
    out = []
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        out.append(("phone", a, b, 0))
        out.append(("id_number", a, b, 0))
    # In lower case, letter by letter where that changes the length.
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    # Of the six words of a spoken number or more the first and last may have signs on them; the others stand between blanks and hyphens.
    if sum(map(_DIGIT_WORDS.__contains__, low.replace("-", " ").split())) >= 4:
        out += [("phone", *m.span(), 1) for m in _SPOKEN.finditer(low)]
    out += [x for m in _hosts(text) if (x := _mailbox(text, m))]
    german = _STREET_ENDS.search(low)
    for k, rx in enumerate((_ENGLISH, german and _GERMAN, any(w in text for w in _SPANISH_WORDS) and _SPANISH)):
        for m in rx.finditer(text) if rx else ():
            rest = _REST.match(text, m.end())
            out.append(("address", m.start(), rest.end() if rest else m.end(), k))
    known = {m.span() for m in names.finditer(text)}
    out += [("name", *m, 0) for m in sorted(known)]
    out += [("name", m.start(), m.end(1), 3) for m in _PAIR.finditer(text) if (m.start(), m.end(1)) not in known]
    out += [("name", *m.span(), 1 if m[1] else 2) for m in _OTHER_NAMES.finditer(text)]
    return out


_SEPARATOR, _GROUP = re.compile(r"[\s,.]+"), re.compile(r"\d+")
_LOWER = re.compile(r"\b[a-zà-öø-ÿ]{2,}\b")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_]+|\d+|[^\w\s]")
#: The last so many characters before and the first so many after a span are its context.
CONTEXT = 48
#: Words that say what stands near them, by kind.
CUES = {
    "phone": "tel telephone phone mobile cell fax call calls called callback ring dial text reach reached telefon handy mobil rufnummer erreichbar ruf anrufen teléfono telefono móvil movil llame llamar contacto 电话 手机 致电 请致电",
    "id": "ssn social security insurance passport licence license id nino nie dni nif documento pasaporte ausweis ausweisnummer personalausweis reisepass steuernummer führerschein carné 证件号 护照 身份证 身份证号码",
    "other": "order orders ticket tickets invoice roll rolls crate batch lot version versions build builds release frames frame pages page bitrate counter serial tracking case room bestellung rechnung pedido factura 订单 sum points part model isbn sku hash checksum prefix from",
    "address": "lives live resident address deliver delivery parcel label moved met wohnt lieferung paket vive entrega paquete",
    "place": "at near outside from in of north south am an aus bei en de cerca see camera crowd feed",
}
_KIND_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
#: Shapes of numbers by public numbering plans and documents, as expressions.
FORMATS = [
    re.compile(x)
    for x in (
        r"(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-\u00a0])\d{3}[ .\-\u00a0]\d{4}(?:,? (?:ext|x)\.? ?\d+)?$",
        r"\d{3}[\-.\u00a0 ]\d{4}$",
        r"(?:\+|00)\d",
        r"0\d",
        r"0\d(?:[ .\-]\d\d){4}$",
        r"\d{3}[ \-]\d{2}[ \-]\d{4}$",
        r"\d{9}$",
        r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]$",
        r"[XYZ]-?\d{7}-?[A-Z]$|\d{8}-?[A-Z]$",
        r"[A-Z]{1,2}\d{7,8}$",
        r"\d{1,3}\.\d{3}\.\d{3}-[\dA-Z]$",
        r"\d{1,3}(?:\.\d+)+$",
        r"\d{4}-\d{4}$",
        r"\d{10,11}$",
        r"\d{6,8}$",
        r"\+1\d{10}$",
    )
]
_PLACE_WORDS = frozenset(f"{STREETS}|harbour|market|canal|station|pier|quay|bridge|tunnel|yard|depot|arcade|stadium|campus|park|mall|museum|terrace|company|bank|university|herald|times|bahnhof|markt|brücke|hafen|plaza|puerto|estación".split("|"))
_UNITS = re.compile(r"\b(?:seconds?|minutes?|hours?|days?|weeks?|years?|frames?|clips?|people|persons|cars?|items?|met(?:re|er)s?|miles?|km|percent|of|the|after|in|on|down|from|by|near|to|and)\b", re.I)
_TITLE = re.compile(rf"^(?:{_TITLES})$")


def _led(text: str, a: int) -> bool:
    """Whether a title or label that names go with stands right before."""
    return bool(_LED.search(text, max(0, a - 24), a))


_NEAR = {k: i for i, k in enumerate(CUES)}


def _near(text: str, a: int) -> tuple[list[float], str]:
    """Which kinds of words are the nearest and the others among the last few before a place in its line, and the last word."""
    words = _WORD.findall(text[max(0, a - CONTEXT) : a].rsplit("\n", 1)[-1].lower())
    out, first = [0.0] * (2 * len(CUES)), True
    for k, w in enumerate(reversed(words[-6:])):
        if k and w in ";|":
            break
        at = _NEAR.get(_KIND_OF.get(w))
        if at is not None:
            out[len(CUES) + at] = 1.0
            if first:
                out[at], first = 1.0, False
    return out, words[-1] if words else ""


def describe(text: str, kind: str, a: int, b: int, gen: int, given: frozenset[str], common: frozenset[str]) -> list[float]:
    """What the trees see of a span: its format, its parts, the kinds of words around. Names ask whether the given name is known
    and whether the parts are common words."""
    s = text[a:b]
    near, p1 = _near(text, a)
    if kind in ("phone", "id_number"):
        groups = _GROUP.findall(s)
        out = [b - a, sum(map(len, groups)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, sum(map(str.isupper, s)), s[0] == "+", "(" in s, gen, *[bool(f.match(s)) for f in FORMATS]]
    elif kind == "email":
        tail = _SEPARATOR.split(s.strip(". "))
        local = re.split(r"[@＠\[({]|\s(?:at|AT)\s", s)[0]
        out = [b - a, gen, "@" in s or "＠" in s, "." in s, len(tail), len(local), local.count(" "), s.count("."), len(tail[-1]), s[0].isdigit(), any(w in common for w in local.lower().split())]
    elif kind == "address":
        core = re.split(r",|#|\n", s)[0]
        out = [b - a, gen, len(core.split()), bool(_UNITS.search(core)), sum(map(str.isupper, core)), len(s) - len(core), bool(re.match(r"\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?\s", s)), core == core.lower(), any(w in common for w in core.lower().split()[1:-1])]
    else:
        tail = [w for w in _SEPARATOR.split(s.strip(". ")) if w]
        first, last = (tail[-1], tail[0]) if gen == 2 else (tail[0], tail[-1])
        f, l = first.lower(), last.lower()
        before = text[a - 2 : a].strip()
        after = text[b : b + 12].split()[:1]
        out = [gen, f in given, _led(text, a), f in common, l in common, l.split("-")[0] in common, l in _PLACE_WORDS, after[0].strip(".,;").lower() in _PLACE_WORDS if after else False, bool(_TITLE.match(first)), s.isupper(), last[0].islower(), len(tail), len(first), len(last), p1[:1].isalpha(), p1 in common, before[-1:] in (",", ";", ":", "(", '"'), a == 0 or text[a - 1] == "\n"]
    return [float(x) for x in out] + near


def cue_counts(texts: list[str]) -> dict[str, int]:
    """g + given name: how often it follows a title or label; t: how often any does; c + word: documents with the lower-case word."""
    n: dict[str, int] = defaultdict(int)
    words: Counter = Counter()
    for t in texts:
        for m in _CUES.finditer(t):
            if m[2].lower() not in _PLACE_WORDS:
                n["g" + m[1].title()] += 1
                n["t"] += 1
        words.update(set(_LOWER.findall(t)))
    return n | {"c" + w: c for w, c in words.items()}


_models: dict[tuple, tuple] = {}


def _fitted(times: int, seed: int = 1) -> tuple[dict[str, Trees], frozenset[str]]:
    """Trees per kind from the labelled sample, two thirds of its texts for the trees and one for calibration and thresholds. Once per process."""
    if (times, seed) not in _models:
        sample = pii_sample.rows(times, seed)
        given = frozenset(map(str.lower, pii_sample.GIVEN))
        counts = cue_counts([t for t, _ in sample])
        # A word in a hundred of the sentences is common here.
        common = frozenset(k[1:] for k, c in counts.items() if k[0] == "c" and c > len(sample) // 100) - given
        names = names_regex(tuple(pii_sample.GIVEN))
        x: dict[str, list] = {k: [] for k in KINDS}
        for k, (t, marks) in enumerate(sample):
            starts = set(marks)
            for kind, a, b, gen in spans(t, names):
                x[kind].append((describe(t, kind, a, b, gen, given, common), (kind, a) in starts, k % 3 == 2))
        trees = {}
        for kind, r in x.items():
            f, y, held = np.array([v[0] for v in r]), np.array([v[1] for v in r], float), np.array([v[2] for v in r])
            trees[kind] = Trees().fit(f[~held], y[~held]).calibrate(f[held], y[held])
        _models[times, seed] = trees, common
    return _models[times, seed]


class Detector:
    """Fitted models and what was counted in the corpus; plain values only, so it is small to send."""

    def __init__(self, times: int = TIMES) -> None:
        self.trees, self.common = _fitted(times)
        self.given = tuple(pii_sample.GIVEN)
        #: In lower case: all given names, those introduced in the corpus too.
        self.known: frozenset[str] = frozenset(map(str.lower, self.given))
        self._names: re.Pattern | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_names": None}

    @property
    def names(self) -> re.Pattern:
        if self._names is None:
            self._names = names_regex(self.given)
        return self._names

    def learn(self, counts: dict[str, int]) -> "Detector":
        """Given names and common words from counts as of :func:`cue_counts`."""
        found = {k[1:]: c for k, c in counts.items() if k[0] == "g"}
        # The expression takes given names of at least one in 2000 cues; others stand in `known` and are met as pairs of words.
        bar = max(3, counts.get("t", 0) // 2000)
        self.given = tuple(dict.fromkeys([*self.given, *sorted(x for x, c in found.items() if c >= bar)]))
        self.known = frozenset(x.lower() for x in (*self.given, *found))
        self.common = (self.common | frozenset(k[1:] for k in counts if k[0] == "c")) - self.known
        self._names = None
        return self

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Per text the mentions (kind, start, end, probability) in order, none overlapping."""
        cand: dict[str, list] = {k: [] for k in KINDS}
        keep: list[list] = [[] for _ in texts]
        for n, t in enumerate(texts):
            if t:
                for kind, a, b, gen in spans(t, self.names):
                    cand[kind].append((n, a, b, describe(t, kind, a, b, gen, self.known, self.common)))
        for kind, c in cand.items():
            if c:
                p = self.trees[kind].probability(np.array([x[3] for x in c]))
                for (n, a, b, _), q in zip(c, p.tolist()):
                    if q >= self.trees[kind].threshold:
                        keep[n].append((kind, a, b, q))
        out = []
        for k in keep:
            chosen: list[tuple[str, int, int, float]] = []
            for s in sorted(k, key=lambda s: (-round(s[3], 1), s[1] - s[2], s[1])):
                if all(s[2] <= o[1] or s[1] >= o[2] for o in chosen):
                    chosen.append(s)
            out.append(sorted(chosen, key=lambda s: s[1]))
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    for b in batches:
        for at in range(0, b.num_rows, 2000):
            for k, c in cue_counts(b.column("text").slice(at, 2000).to_pylist()).items():
                total[k] += c
            if len(total) > 200_000:
                yield out()
                total.clear()
    yield out()


def fit(documents: DataFrame, times: int = TIMES) -> Detector:
    """The models, with given names and common words counted over all documents; only counts that are large enough reach the driver:
    names introduced three times, lower-case words of more than a hundredth of the documents."""
    d = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    rows = d.select("text").mapInArrow(_counts, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    bar = F.when(F.col("k").startswith("g"), 3).when(F.col("k") == "t", 0).otherwise(d.count() // 100 + 1)
    return Detector(times).learn({r.k: r.n for r in rows.filter(F.col("n") >= bar).collect()})


def _mentions(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        det: Detector = broadcast.value
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                rows = [(i, kind, a, e, q, t[a:e]) for i, t, found in zip(ids, texts, det.find(texts)) for kind, a, e, q in found]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()), pa.array(c[5])], names=["doc_id", "kind", "start_pos", "end_pos", "probability", "mention"])

    return run


def _redacted(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        det: Detector = broadcast.value
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                texts, out, n = b.column("text").to_pylist(), [], []
                for t, found in zip(texts, det.find(texts)):
                    parts, last = [], 0
                    for kind, a, e, _ in found:
                        parts += [t[last:a], f"[{kind.upper()}]"]
                        last = e
                    out.append(None if t is None else "".join([*parts, t[last:]]))
                    n.append(len(found))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "n_redacted"])

    return run


def mentions(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, kind, start_pos, end_pos, probability, mention: one row per mention."""
    det = detector or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(det)
    d = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return d.mapInArrow(_mentions(shared), "doc_id bigint, kind string, start_pos bigint, end_pos bigint, probability double, mention string")


def redact(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, text (with placeholders), n_redacted: one row per document; null texts stay null."""
    det = detector or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(det)
    return documents.select("doc_id", "text").filter("doc_id is not null").mapInArrow(_redacted(shared), "doc_id bigint, text string, n_redacted int")
