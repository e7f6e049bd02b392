"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and check hold, whatever their score. Added kinds
(iban, ssn, secret) are reported from ``ADDED_SCORE`` on: a checksum or a context word has to speak for them.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Characters before and after a span in which context words count, and what a span needs if it is of an added kind.
CONTEXT, ADDED_SCORE = 40, 0.6
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.4, "ssn": 0.3, "secret": 0.3}
CONFIRMED = {"card": 0.4, "iban": 0.5}
WORDS = {
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip address host server login addr",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "secret": "token key secret password passwd api",
}
WORD_SETS = {kind: frozenset(words.split()) for kind, words in WORDS.items()}
AGAINST = frozenset("version example sample invoice isbn page".split())

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A start inside a run of digits fails just as the run's first digit does, so only first digits are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_LENGTHS = {country: int(n) for n, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU").split()) for country in countries.split(",")}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])")
NOT_DIGIT, CONTEXT_WORD = re.compile(r"[^0-9]+"), re.compile(r"[^\W\d_][^\W\d_-]*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: a run of local characters can only end there, so every character is seen once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            end = found.end()
            at = text.find("@", end)
        else:
            end = max(end, at)
            at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans that pass mod-97. A pattern's match may run on into words and numbers behind: the end that the country's
    length gives goes first, then the whole match; of an unknown country all ends of tokens, the longest first."""
    found = IBAN.search(text)
    while found:
        start, at = found.span()
        ends = [at, *(start + k for k in range(len(found[0]) - 1, 0, -1) if found[0][k] == " ")]
        if (length := IBAN_LENGTHS.get(found[0][:2])) is not None:
            ends = [e for e in ends if e - start - text.count(" ", start, e) == length] + ends[:1]
        at = start + 1
        for end in ends:
            if 15 <= len(plain := text[start:end].replace(" ", "")) <= 34 and mod97(plain):
                yield start, end
                at = end
                break
        found = IBAN.search(text, at)


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end and whether a checksum has confirmed it, of spans that pass their kind's check."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, False
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span(), False
    for start, end in ibans(text):
        yield "iban", start, end, True
    for kind, pattern in (("ssn", SSN), ("secret", SECRET)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = {w.lower() for w in CONTEXT_WORD.findall(text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT])}
    value = SCORES[kind] + CONFIRMED.get(kind, 0) * confirmed + 0.35 * bool(near & WORD_SETS[kind]) - 0.2 * bool(near & AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str | None) -> list[Span]:
    """Spans of a text by kind as listed, then start; offsets are code points. Null and empty texts have none."""
    if not text:
        return []
    found = (Span(kind, start, end, score(text, kind, start, end, sure)) for kind, start, end, sure in proposals(text))
    return sorted((s for s in found if s.kind in BASE or s.score >= ADDED_SCORE), key=lambda s: (KINDS.index(s.kind), s.start))


def pii_spans(text: Column) -> Column:
    """Array column of a text column's spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @arrow_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[s._asdict() for s in find_spans(t.as_py())] for t in texts], type=kind)

    return spans(text)


def redact(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by the kind of the first in angle brackets; null stays null."""
    groups: list[list] = []
    for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end, KINDS.index(s.kind))):
        if groups and s.start < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], s.end)
        else:
            groups.append([s.start, s.end, s.kind])
    if not groups:
        return text
    out, at = [], 0
    for start, end, kind in groups:
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """A text column with personal data replaced, see ``redact``."""

    @arrow_udf("string")
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redact(t.as_py()) for t in texts], type=pa.string())

    return replaced(text)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans`` of every row: kind, start, end and score, by kind as listed, then start.

    Null and empty texts have an empty list, rows with equal ids are searched one by one, a null id stays null, other columns
    are not looked at and an empty table gives an empty table. Patterns are linear in the length of a text.
    """
    return docs.select(F.col(id_col).alias(id_col), pii_spans(F.col(text_col)).alias("spans"))
