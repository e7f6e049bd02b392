"""Spans against the plain regular expressions of the base kinds."""
import hashlib
import random
import re
import time

from conftest_llm import key

from tideline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(int(d) * 2, 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m[0])]


def base_spans(text):
    return [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x", ".com", ".", "-", " ", "+", "+1", "(", ")", "4", "11", "255", "256", "0", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", ".5", "é", "٣", "x@y.z", "%", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert base_spans(text) == slow_spans(text), text


def test_query_on_edge_table(spark, docs, rows, tmp_path):
    from tideline.llm.queries import QUERIES

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_pii"](spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        spans = slow_spans(r[1])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append(key(r[0], *(sum(s[0] == kind for s in spans) for kind in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(key(*r[:6]) for r in got) == sorted(want)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda text: [s.kind for s in pii.find_spans(text)]
    assert kinds("Konto GB82 WEST 1234 5698 7654 32 bitte") == ["iban"] and "iban" not in kinds("GB82 WEST 1234 5698 7654 33")
    assert kinds("her ssn is 078-05-1120.") == ["ssn"] and kinds("part 078-05-1120.") == []
    assert kinds('token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"') == ["secret"] and kinds("b44e15e09fd311c3cf3163b66d5a9875b883d8ce") == []
    near, far = pii.find_spans("call me: +1 (017) 555-7713")[0], pii.find_spans("x +1 (017) 555-7713")[0]
    assert near.score > far.score


def test_redaction():
    assert pii.redact("mail a@b.co or 1.2.3.4!") == "mail <email> or <ip>!"
    assert pii.redact("x 1.2.3.4@a.bc x") == "x <email> x"
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("plain") == "plain"
    assert pii.find_spans(pii.redact("a@b.co, 4111 1111 1111 1111, +49 170 1234567 and 10.0.0.1")) == []


def test_long_texts_take_linear_time():
    started = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "a." * 200_000 + "@", "@" * 200_000, "+1 (" * 100_000, "A1" * 200_000, "1." * 200_000):
        assert isinstance(pii.find_spans(text), list)
    assert time.time() - started < 20


def test_empty_table(no_docs):
    assert pii.find_pii(no_docs).count() == 0


def test_ibans_followed_by_capitals_and_numbers():
    found = lambda text: [text[s.start:s.end] for s in pii.find_spans(text) if s.kind == "iban"]
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for behind in ("", " EUR 500", " BIC COBADEFF", " 2024", " BIC", ", BIC X", " und mehr", " A B C D E F G H"):
            assert found(f"pay {iban}{behind}") == [iban], behind
    assert found("DE89370400440532013000 GB82WEST12345698765432") == ["DE89370400440532013000", "GB82WEST12345698765432"]
    assert found("AB12 ABCDEFGHIJKLMN DE89370400440532013000 EUR") == ["DE89370400440532013000"]
    assert found("DE89370400440532013001 EUR 500") == []
    assert pii.redact("IBAN DE89370400440532013000 EUR 500") == "IBAN <iban> EUR 500"


def test_many_iban_starts_take_linear_time():
    started = time.time()
    assert pii.find_spans("AB12 " * 80_000) is not None
    assert time.time() - started < 20
