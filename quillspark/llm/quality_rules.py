"""Quality rules: decision lists learned by sequential covering.

The text statistics are DataFrame expressions.  The learner sees a bounded
sample of labelled rows, grows threshold conjunctions against the label 0 and
prunes them on rows it did not grow them on.  What comes out is one ordered
``CASE WHEN`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, words_of

#: Labelled rows that the learner looks at, at most (the lowest by a hash of the id).
MAX_TRAINING_ROWS = 12_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: What the rules may test: ratios, so that a rule means the same for short and long texts.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "mean_word")


def _count_of(text: Column, others: str) -> Column:
    """Characters of ``text`` that are left without the runs of ``others``."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in ``window``-word windows found at least twice.

    Windows are compared by 64-bit hashes of their words' hashes.  Texts
    without a repeated window, nearly all, never reach the sort.
    """

    def marked(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def repeats(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(again, lambda x: x["at"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(keyed, repeats), covered)

    def paired(step: int):
        return lambda h: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:  # hashes of 2, 4 and then 8 words; the last ones run over the end
        return let(let(let(h, paired(1)), paired(2)), paired(4))

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(marked(w))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    whole = let(windows(hashed), lambda w: F.slice(w, 1, F.size(w) - (window - 1)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(whole, counted))


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long, each named with ``prefix``.

    A null text has no words.  Columns of those names are replaced; all others stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    p = prefix

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    hold = f"__{p}words"
    df = df.withColumn(hold, words_of(t))
    stats = {
        f"{p}n_words": F.size(hold).cast("long"),
        f"{p}word_chars": F.length(F.array_join(hold, "")).cast("long"),
        f"{p}n_symbols": _count_of(t, f"[^{SYMBOLS}]+"),
        f"{p}n_dup_lines": let(lines, dup_lines),
        f"{p}n_repeat_words": _repeat_words(F.col(hold), WINDOW),
        f"{p}n_lines": let(lines, lambda x: F.size(x).cast("long")),
        f"{p}n_upper": _count_of(t, r"[^\p{Lu}]+"),
        f"{p}n_bang": _count_of(t, "[^!]+"),
    }
    return df.withColumns(stats).drop(hold)


def features(prefix: str = "") -> dict[str, Column]:
    """The ratios that rules test, from the columns of :func:`with_statistics`."""

    def ratio(a: str, b: str) -> Column:
        return F.col(prefix + a).cast("double") / F.greatest(F.col(prefix + b), F.lit(1)).cast("double")

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"),
        "bang_ratio": ratio("n_bang", "n_words"), "mean_word": ratio("word_chars", "n_words"),
    }


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Rule:
    """Rejects a text that meets every condition (feature, ">=" or "<=", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def expression(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & ((values[name] >= cut) if op == ">=" else (values[name] <= cut))
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{n} {o} {c:.4g}" for n, o, c in self.conditions)


def learn_rules(rows: list[tuple[list[float], int]], names: tuple[str, ...] = FEATURES, min_precision: float = 0.9, min_covered: int = 5, max_rules: int = 12, max_conditions: int = 3, cuts: int = 48) -> list[Rule]:
    """Sequential covering over ``rows`` of (feature values, label); label 0 is what rules look for.

    Row sets are integers used as bit sets.  Two thirds of the rows grow a
    rule by information gain; the rest decide how many of its conditions stay.
    A rule below ``min_precision`` on either part ends the list.
    """
    n = len(rows)
    if not n:
        return []
    bad = sum(1 << i for i, (_, y) in enumerate(rows) if y == 0)
    grow = sum(1 << i for i in range(n) if i % 3)
    hold = ((1 << n) - 1) & ~grow
    tests: list[tuple[tuple[str, str, float], int]] = []
    for j, name in enumerate(names):
        order = sorted(range(n), key=lambda i: rows[i][0][j])
        values = [rows[i][0][j] for i in order]
        lows = [k for k, i in enumerate(order) if not rows[i][1]]  # cuts among all rows, and beside rows with label 0
        at = sorted({round(k * (n - 1) / cuts) for k in range(1, cuts)} | {lows[len(lows) * k // cuts] + d for k in range(cuts) for d in (0, 1) if lows})
        below, done, before = 0, 0, None
        for k in at:
            k = min(max(k, 1), n - 1)
            if values[k] == values[k - 1]:
                while k < n and values[k] == values[k - 1]:
                    k += 1
                if k == n:
                    continue
            if k == before:
                continue
            before = k
            for i in order[done:k]:
                below |= 1 << i
            done = k
            cut = (values[k] + values[k - 1]) / 2
            tests.append(((name, "<=", cut), below))
            tests.append(((name, ">=", cut), ((1 << n) - 1) & ~below))
    from math import log2

    left, out = (1 << n) - 1, []
    while len(out) < max_rules and (left & bad).bit_count() >= min_covered:
        chosen: list[tuple[tuple[str, str, float], int]] = []
        now = left & grow
        while len(chosen) < max_conditions and now & ~bad:
            p, t = (now & bad).bit_count(), now.bit_count()
            if not p:
                break
            best, pick = 0.0, None
            for test, rows_of in tests:
                both = now & rows_of
                q = (both & bad).bit_count()
                if q >= min_covered:
                    gain = q * (log2(q / both.bit_count()) - log2(p / t))
                    if gain > best + 1e-9:
                        best, pick = gain, (test, rows_of)
            if pick is None:
                break
            chosen.append(pick)
            now &= pick[1]

        def worth(k: int) -> tuple[float, int]:
            rows_of = left & hold
            for _, x in chosen[:k]:
                rows_of &= x
            t = rows_of.bit_count()
            return (((rows_of & bad).bit_count() + 1) / (t + 2), t) if t else (0.0, 0)

        if not chosen:
            break
        size = max(range(1, len(chosen) + 1), key=lambda k: (worth(k)[0], -k))
        covered = left
        for _, x in chosen[:size]:
            covered &= x
        q, t = (covered & bad).bit_count(), covered.bit_count()
        if t < min_covered or q / t < min_precision or (worth(size)[1] and worth(size)[0] < min_precision - 0.1):
            break
        out.append(Rule(tuple(c for c, _ in chosen[:size]), q / t, t))
        left &= ~covered
    return out


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> list[Rule]:
    """The decision list for ``documents``, from at most ``max_rows`` rows of ``labels``.

    Rows with a null key or label are left out; no labels, no rules.
    """
    picked = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).where("__k is not null and __y is not null")
    picked = picked.orderBy(F.xxhash64("__k"), "__k", "__y").limit(max_rows)  # bounded, so it may be broadcast
    seen = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(picked), "__k")
    values = features()
    got = with_statistics(seen, "__t").select("__k", "__y", base_failed().alias("failed"), *[values[n].alias(n) for n in FEATURES]).collect()
    rows = sorted((r["__k"], [float(r[n]) for n in FEATURES], int(r["__y"])) for r in got if not r["failed"])
    return learn_rules([(x, y) for _, x, y in rows])


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number (from 1) of the first rule that rejects a text, else 0, as one ordered conditional expression."""
    values, out = features(prefix), None
    for i, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(rule.expression(values), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(documents: DataFrame, rules: list[Rule], text: str = "text", prefix: str = "") -> DataFrame:
    """``documents`` with the statistics, ``base_failed``, ``rule`` (0: none rejects it) and ``kept``, each named with ``prefix``.

    Null and empty texts have no words and fail the base rules.  Each row is
    judged by itself, so repeated rows get equal verdicts.
    """
    out = with_statistics(documents, text, prefix)
    out = out.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}rule": verdict(rules, prefix)})
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rule") == 0))


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that no rule rejects, all columns as they were."""
    rules = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules, prefix="__q_").where("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, its statistics, base_failed and kept.

    A null or empty text has no words and fails the base rule; repeated rows are judged one by one.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
