"""Personal data: base patterns, and spans added by weak supervision.

Base kinds are fixed patterns with a check.  For anything else that may
identify a person or open an account, wide candidates get votes from pattern,
gazetteer and context labelers; expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting soft labels.  All per-row work is
DataFrame expressions; what reaches the driver is one count per vote pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table

KINDS = ("email", "ip", "card", "phone")
#: A kind's pattern.  Possessive, so that no run is scanned twice; an email may begin inside a run of its characters only where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Wide candidates of the method: long unbroken runs with a digit.
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}"
CONTEXT_CHARS = 24
#: Words before a span that tell of a credential or an account (fixed values).
CONTEXT_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "api", "credential", "iban", "account", "ssn", "passport")
#: Beginnings that issuers of credentials use (fixed values).
GAZETTEER = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xox", "akia", "asia", "eyj", "glpat-", "aiza")
#: Beginnings of harmless long runs (fixed values).
HARMLESS = ("http", "www", "page", "figure", "version", "chapter", "table", "isbn")
LABELERS = ("hex", "mixed", "gazetteer", "context", "quoted", "digits_only", "harmless", "few_characters")

_WORD = "(?<![A-Za-z0-9])(?:" + "|".join(CONTEXT_WORDS) + ")"
_NAMED = r"(?:[\x20_](?:number|no\.?|code|id))?"
#: A value's last character is no full stop or other mark that ends a clause.
_VALUE = r"[^\s\"'`,;]{3,63}(?<![.:?)])"
#: Short candidates: IBANs in groups of four, groups of digits, and what stands after a context word (after a space alone only with a digit in it).
SHORT = "|".join((
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_+/=.-])[0-9]{2,6}(?:(?:-[0-9]{2,6}){1,4}|(?:\x20[0-9]{2,6}){1,4})(?![A-Za-z0-9_+/=-])",
    rf"(?<=(?i:{_WORD}{_NAMED}\x20{{0,2}}[:=]\x20{{0,2}}[\"'`]?)){_VALUE}",
    rf"(?<=(?i:{_WORD}{_NAMED}\x20(?:is\x20)?[\"'`]?))(?=[^\s\"'`,;]{{0,63}}[0-9]){_VALUE}",
))
#: What a text must hold to be searched for them.
SHORT_GATE = rf"[0-9][0-9][\x20-][0-9][0-9]|[A-Z][A-Z][0-9][0-9]\x20|(?i:{_WORD}{_NAMED}\x20{{0,2}}(?:[:=]|is\x20|[^\s]*[0-9]))"
#: Pseudo-counts a short candidate, for what EM starts from.
SHORT_BELIEF = 4.0
SHORT_LABELERS = ("context", "quoted", "structure", "harmless", "plain")
NEGATIVE = ("digits_only", "harmless", "few_characters", "plain")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def worth(i: Column) -> Column:
            x = F.substring(d, n - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0

    return let(digits, total)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


_FOUND = "array<struct<start:int,end:int,m:string,before:string>>"


def found(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of ``pattern``: start, end (code points), the match, and what stands between it and the last one."""

    def joined(gaps: Column, hits: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["m"])
            one = F.struct(a.alias("start"), b.alias("end"), x["m"].alias("m"), x["gap"].alias("before"))
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one).cast(_FOUND)).alias("out"))

        return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("m")), start, step, lambda acc: acc["out"])

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: joined(gaps, hits)))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """The spans of the base kinds, by start and then in the order of KINDS."""

    def of(rank: int, kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        spans = F.transform(good, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind")))
        return F.when(GATES[kind](text), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[of(r, k) for r, k in enumerate(KINDS)]))


def _votes(m: Column, before: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 personal or secret, -1 harmless, 0 nothing."""
    low = F.lower(m)
    near = F.lower(F.right(before, F.lit(CONTEXT_CHARS)))
    kinds = F.size(F.array_distinct(F.split(low, "")))

    def vote(yes: Column, value: int) -> Column:
        return F.when(yes, value).otherwise(0)

    return {
        "hex": vote(low.rlike("^[0-9a-f]{24,}$") & low.rlike("[a-f]"), 1),
        "mixed": vote(m.rlike("[0-9].*[A-Za-z].*[0-9].*[A-Za-z].*[0-9]") & (F.length(m) >= 20), 1),
        "gazetteer": vote(reduce(lambda a, b: a | b, [low.startswith(p) for p in GAZETTEER]), 1),
        "context": vote(near.rlike(r"\b(" + "|".join(CONTEXT_WORDS) + r")\b[^\p{L}]*$"), 1),
        "quoted": vote(before.rlike("[\"'`]$"), 1),
        "digits_only": vote(m.rlike("^[0-9]+$"), -1),
        "harmless": vote(reduce(lambda a, b: a | b, [low.startswith(p) for p in HARMLESS]), -1),
        "few_characters": vote(kinds < 7, -1),
    }


def _iban(m: Column) -> Column:
    """Whether an IBAN's check digits are right (its number modulo 97 is 1)."""

    def step(acc: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    def of(x: Column) -> Column:
        turned = F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4))
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1

    return F.when(m.rlike("^[A-Z]{2}[0-9]{2}\\x20"), let(F.regexp_replace(m, " ", ""), of)).otherwise(False)


def _short_votes(m: Column, before: Column) -> dict[str, Column]:
    """What each labeler says of a short candidate."""
    near = F.lower(F.right(before, F.lit(CONTEXT_CHARS)))

    def vote(yes: Column, value: int) -> Column:
        return F.when(yes, value).otherwise(0)

    words = "|".join(CONTEXT_WORDS)
    return {
        "context": vote(near.rlike(rf"(?<![a-z0-9])({words})([\x20_](number|no\.?|code|id))?(\x20is)?[^\p{{L}}\p{{N}}]*$"), 1),
        "quoted": vote(before.rlike("[\"'`]$"), 1),
        "structure": vote(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$") | _iban(m), 1),
        "harmless": vote(reduce(lambda a, b: a | b, [F.lower(m).startswith(p) for p in HARMLESS]), -1),
        # a mere word may be a password, but no number of an account or key
        "plain": vote(m.rlike(r"^\p{L}+$") & ~near.rlike(r"(password|passwd|pwd|secret)[^\p{L}\p{N}]*$"), -1),
    }


_VOTED = "array<struct<start:int,end:int,code:long>>"


def voted(text: Column) -> Column:
    """Candidates with their votes as one number in base 3."""

    def one(x: Column) -> Column:
        code = F.lit(0).cast("long")
        for v in _votes(x["m"], x["before"]).values():
            code = code * 3 + (v + 1)
        return F.struct(x["start"], x["end"], code.alias("code"))

    spans = F.transform(found(text, CANDIDATE), one).cast(_VOTED)
    return F.when(text.rlike("[0-9]"), spans).otherwise(F.array().cast(_VOTED))


def short_voted(text: Column, long: Column) -> Column:
    """Short candidates that some labeler speaks for and that overlap none of ``long``, with their votes as one number in base 3."""

    def one(x: Column) -> Column:
        code, spoken = F.lit(0).cast("long"), F.lit(False)
        for v in _short_votes(x["m"], x["before"]).values():
            code, spoken = code * 3 + (v + 1), spoken | (v > 0)
        return F.struct(x["start"], x["end"], F.when(spoken, code).alias("code"))

    def apart(x: Column) -> Column:
        return x["code"].isNotNull() & ~F.exists(long, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    spans = F.filter(F.transform(found(text, SHORT), one).cast(_VOTED), apart)
    return F.when(text.rlike(SHORT_GATE), spans).otherwise(F.array().cast(_VOTED))


def _unpack(code: int, many: int = len(LABELERS)) -> tuple[int, ...]:
    out = []
    for _ in range(many):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities found by EM, and the classifier trained on its soft labels."""

    prior: float
    reliability: dict[str, tuple[float, float]]  # how often each labeler speaks on true and on other candidates
    weights: tuple[float, ...]
    bias: float

    def accepts(self, code: int) -> bool:
        return self.bias + sum(w * v for w, v in zip(self.weights, _unpack(code, len(self.weights)), strict=True)) >= 0


@dataclass(frozen=True)
class Models:
    """One span model for long runs and one for short candidates; None where there were no candidates."""

    long: SpanModel | None
    short: SpanModel | None


def fit(counts: dict[int, int], rounds: int = 60, prior: float = 0.3, labelers: tuple[str, ...] = LABELERS, belief: float = 0.0) -> SpanModel | None:
    """The span model from the number of candidates with each vote pattern; None without candidates.

    EM starts from "a vote is right in 8 of 10 cases"; a labeler's votes are
    taken as independent given the truth, with one pseudo-count each, and
    ``belief`` more pseudo-counts per candidate for what EM starts from: short
    candidates are of unlike kinds, which EM would otherwise part from each
    other instead of from harmless ones.
    """
    if not counts:
        return None
    rows = [(_unpack(c, len(labelers)), n) for c, n in sorted(counts.items())]
    sign = [-1 if k in NEGATIVE else 1 for k in labelers]
    held, first = belief * sum(counts.values()), prior
    speak = start = [(0.6, 0.15) if s > 0 else (0.15, 0.6) for s in sign]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _n in rows:
            a, b = log(prior), log(1 - prior)
            for v, (yes, no) in zip(votes, speak, strict=True):
                a += log(yes if v else 1 - yes)
                b += log(no if v else 1 - no)
            post.append(1 / (1 + exp(min(60.0, b - a))))
        total = sum(n for _, n in rows)
        true = sum(p * n for p, (_, n) in zip(post, rows, strict=True))
        prior = min(0.95, max(0.02, (true + 1 + held * first) / (total + 2 + held)))
        new = []
        for j, s in enumerate(sign):
            yes = (sum(p * n for p, (v, n) in zip(post, rows, strict=True) if v[j]) + 1 + held * start[j][0]) / (true + 2 + held)
            no = (sum((1 - p) * n for p, (v, n) in zip(post, rows, strict=True) if v[j]) + 1 + held * start[j][1]) / (total - true + 2 + held)
            # a labeler may turn out useless, but not to mean the opposite
            new.append((max(yes, no), no) if s > 0 else (yes, max(yes, no)))
        speak = [(min(0.98, max(0.02, y)), min(0.98, max(0.02, n))) for y, n in new]
    w, bias = [0.0] * len(labelers), 0.0
    total = sum(n for _, n in rows)
    for _ in range(400):
        gw, gb = [1e-3 * x for x in w], 0.0
        for p, (votes, n) in zip(post, rows, strict=True):
            z = bias + sum(a * b for a, b in zip(w, votes, strict=True))
            e = (1 / (1 + exp(-max(-40.0, min(40.0, z)))) - p) * n / total
            gb += e
            for j, v in enumerate(votes):
                gw[j] += e * v
        w, bias = [a - 2.0 * g for a, g in zip(w, gw, strict=True)], bias - 2.0 * gb
    return SpanModel(prior, dict(zip(labelers, speak, strict=True)), tuple(w), bias)


def train(documents: DataFrame, text: str = "text") -> Models | None:
    """Fits the span models to all candidates of ``documents``, counted by vote pattern (at most 3^8 + 3^5 rows come back); None without candidates."""

    def marked(spans: Column, short: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(short).alias("short"), x["code"].alias("code")))

    t = F.coalesce(F.col(text), F.lit(""))
    both = let(voted(t), lambda long: F.concat(marked(long, False), marked(short_voted(t, long), True)))
    rows = documents.select(F.explode(both).alias("c")).groupBy(F.col("c.short").alias("short"), F.col("c.code").alias("code")).count().collect()
    if not rows:
        return None
    long, short = ({r["code"]: r["count"] for r in rows if r["short"] == k} for k in (False, True))
    return Models(fit(long), fit(short, labelers=SHORT_LABELERS, belief=SHORT_BELIEF))


def find(documents: DataFrame, model: Models | None, text: str = "text", base: str = "base_spans", added: str = "added_spans") -> DataFrame:
    """``documents`` with the arrays ``base`` and ``added`` of (start, rank, end, kind), in code points.

    Null texts count as empty.  An added span never overlaps a base span.
    Each row stands for itself; other columns stay as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = documents.withColumn(base, base_spans(t))
    if model is None:
        return out.withColumn(added, F.array().cast(_SPANS))

    def accepted(x: Column, by: SpanModel | None) -> Column:
        if by is None:
            return F.lit(False)
        score, code, n = F.lit(by.bias), x["code"], len(by.weights)
        for j, w in enumerate(by.weights):
            score = score + F.lit(float(w)) * (F.floor(code / (3 ** (n - 1 - j))) % 3 - 1)
        return score >= 0

    def free(spans: Column, by: SpanModel | None) -> Column:
        good = F.filter(spans, lambda x: accepted(x, by) & ~F.exists(F.col(base), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.transform(good, lambda x: F.struct(x["start"], F.lit(len(KINDS)).alias("rank"), x["end"], F.lit("secret").alias("kind"))).cast(_SPANS)

    return out.withColumn(added, let(voted(t), lambda long: F.array_sort(F.concat(free(long, model.long), free(short_voted(t, long), model.short)))))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, the counts of base kinds, a digest of base spans, and all spans as text.

    A null text is empty and has none; repeated rows are read one by one.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs))
    base, added = F.col("base_spans"), F.col("added_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.array_sort(F.concat(base, added))).alias("spans"))
