"""Base spans against Python's re, and the weak-supervision model."""

import hashlib
import re

from quillspark.llm import pii

TEXTS = [
    None, "", "mail a@b.c%d@e.f end", "x.y+z@mail7.example.com.", "user@host no dot", "a@b..c", "@@a@b.cc@d.ee", "1.2.3.4.5 and 256.1.1.1 0001.02.3.4",
    "card 4539 1488 0343 6467, 4539-1488-0343-6467 4845168114407329", "12345678901234567890123", "+1 (487) 555-7209 next +12 34", "++49 30 1234567-",
    "é\U0001f600 +33 1 23 45 67 89 a@b.co 10.0.0.1", "7" * 20000, "a" * 50000 + "@", "5" * 9 + "." + "1.1.1", "1.1.1.1.1.1.1.1",
    'set token = "908038b7daaf91e730d2f64001c52934d43d9336" now', "+" + " " * 300 + "1",
]


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def by_hand(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if "@" in text and len(text) < 40000 else ():
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def check(rows, text):
    for r in rows:
        want = by_hand(text[r.doc_id])
        spelled = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest(), (r.doc_id, spelled, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in pii.KINDS]
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))


def test_base_spans(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(pii.op9_pii(spark, str(tmp_path)).collect(), dict(enumerate(TEXTS)))


def test_whole_table_and_secrets(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op9_pii(spark, sf).collect()
    check(rows, text)
    secrets = {(r.doc_id, m.start(1), m.end(1)) for r in rows for m in re.finditer(r'(?i:token) = "([0-9a-fA-F]{40})"', text[r.doc_id])}
    added = {(r.doc_id, *map(int, s.split(":")[1:])) for r in rows for s in r.spans.split(",") if s.startswith("secret")}
    assert secrets and added == secrets


def test_em_finds_reliabilities():
    code = lambda **v: int("".join(str(v.get(k, 0) + 1) for k in pii.LABELERS), 3)
    counts = {code(hex=1, mixed=1, context=1, quoted=1): 40, code(hex=1, mixed=1): 15, code(digits_only=1 - 2): 300, code(digits_only=-1, few_characters=-1): 60, code(quoted=1, digits_only=-1): 20}
    model = pii.fit(counts)
    assert model.accepts(code(hex=1, mixed=1)) and not model.accepts(code(digits_only=-1)) and not model.accepts(code(quoted=1, digits_only=-1))
    assert model.reliability["hex"][0] > 0.8 > 0.2 > model.reliability["hex"][1]
    assert pii.fit({}) is None


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, base string")
    assert pii.train(docs) is None and pii.find(docs, None).count() == 0


PLANTED = [
    ("my ssn is ", "123-45-6789", ", thanks"), ("as 219-09-9999 says: ", "078-05-1120", " too"), ("passport number: ", "X1234567", "."), ("passport ", "C01X00T47", " was shown"),
    ("account = ", "4471902", "; and"), ("account number is ", "12-345-678", " now"), ("password: ", "correcthorse", " is set"), ('password = "', "s!lent&River", '" end'), ("pwd=", "hunter2", "\nnext"),
    ("pay to ", "DE89 3704 0044 0532 0130 00", " soon"), ("iban ", "GB82 WEST 1234 5698 7654 32", "."),
]


def test_short_and_grouped_secrets(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    kept = [(10**6 + k, "so then " + a + m + z) for k, (a, m, z) in enumerate(PLANTED)]
    clean = [(2 * 10**6 + k, t) for k, t in enumerate(("on 2024-01-15 we met", "the key is under the mat", "key: major", "rooms 12 34 56 are free", "a token of thanks", "DE12 3704 0044 0532 0130 00 fails its check", "call 555-7209"))]
    spark.createDataFrame(docs + kept + clean, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("secret")} for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    for k, (a, m, _) in enumerate(PLANTED):
        at = len("so then " + a)
        assert (at, at + len(m)) in got[10**6 + k], (a, m, got[10**6 + k])
    assert {t: got[d] for d, t in clean if got[d]} == {}
