"""Text functions of the search engine as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The combining marks that are no part of a token.  All other marks end one.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"


def _folding() -> tuple[str, str]:
    """Letters in lower case and what they are indexed as: a Latin letter with one mark as that letter, a letter that differs from its case folding as the latter."""
    pairs = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        if not c.isalpha() or c != c.lower():
            continue
        parts, plain = unicodedata.normalize("NFD", c), c.casefold()
        base = parts[0].casefold()
        if len(parts) == 2 and base.isascii() and base.isalpha() and unicodedata.category(parts[1]) == "Mn":
            pairs[c] = base
        elif len(plain) == 1 and plain != c:
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


#: The arguments of a translation that indexes letters without marks; the marks of MARKS have no counterpart and are dropped.
ACCENTED, PLAIN = (a + b for a, b in zip(_folding(), (MARKS, ""), strict=True))
#: What tokens are made of.
TOKEN_CLASS = r"\p{L}\p{N}\p{Co}"
CJK_CLASS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"

# Words that carry no intent.
INTENT_STOP_WORDS = (
    "am", "an", "as", "at", "be", "by", "do", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we", "all",
    "and", "any", "are", "but", "can", "did", "for", "get", "has", "her", "him", "his", "how", "its", "let", "may", "not", "our", "out", "the", "too",
    "was", "who", "why", "you", "also", "does", "find", "from", "have", "into", "more", "need", "show", "some", "tell", "that", "them", "this", "want",
    "what", "when", "will", "with", "your", "about", "looking", "notes", "search", "where", "which",
)
# File endings and the language whose syntax guides chunking.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust"}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once; a lambda variable may be named as often as wanted."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(x: Column) -> Column:
    """Maximal runs of letters, digits and private characters, lower-cased, without accents."""
    return F.regexp_extract_all(folded(F.coalesce(x, F.lit(""))), F.lit(f"[{TOKEN_CLASS}]+"), F.lit(0))


def normalize_cjk(x: Column) -> Column:
    """Puts spaces around every Han, Hiragana, Katakana and Hangul character."""
    return F.regexp_replace(x, f"([{CJK_CLASS}])", " $1 ")


def contains_cjk(x: Column) -> Column:
    return x.rlike(f"[{CJK_CLASS}]")


def sanitize_term(x: Column) -> Column:
    """Letters, digits, apostrophes and underscores of a search term, in lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}'_]", ""))


def docid(hash_: Column) -> Column:
    return F.left(hash_, F.lit(6))


def normalize_docid(x: Column) -> Column:
    """Trims, takes off one pair of equal quotes, then one leading '#'."""
    t = F.trim(x)
    t = F.when(F.length(t) >= 2, F.when(t.rlike("(?s)^\".*\"$|^'.*'$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)).otherwise(t)
    return F.when(t.startswith("#"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)


def is_docid(x: Column) -> Column:
    return normalize_docid(x).rlike("^[0-9A-Fa-f]{6,}$")


def title_of(body: Column, path: Column) -> Column:
    """The title of a markdown document: its first level 1 or 2 heading (the first level 2 one if that says "Notes"), else the file's stem."""
    first = F.trim(F.regexp_extract(body, r"(?m)^##?[ \t]+([^\n]+)$", 1))
    second = F.trim(F.regexp_extract(body, r"(?m)^##[ \t]+([^\n]+)$", 1))
    found = F.when(first.isin("Notes", "📝 Notes"), F.when(second != "", second).otherwise(first)).otherwise(first)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.when(found != "", found).otherwise(stem)


def intent_terms(x: Column) -> Column:
    """Lower-cased words without marks at their ends; no stop words, none of one byte."""
    words = F.transform(F.split(F.lower(x), r"\s+", -1), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    stop = F.array(*[F.lit(w) for w in INTENT_STOP_WORDS])
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, w))


def query_terms(x: Column) -> Column:
    """White-space words of over two bytes, for choosing chunks and snippet lines."""
    return F.filter(F.split(F.lower(x), r"\s+", -1), lambda w: F.octet_length(w) > 2)


def add_line_numbers(x: Column, start: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line, i: F.concat((i + start).cast("string"), F.lit(": "), line)), "\n")


def slice_lines(x: Column, from_line: int, max_lines: int) -> Column:
    """Lines from ``from_line`` (from 1) on; an empty text past the end."""
    return F.array_join(F.slice(F.split(x, "\n", -1), from_line, max_lines), "\n")


def truncate_lines(x: Column, keep: int) -> Column:
    lines = F.split(x, "\n", -1)
    more = F.size(lines) - keep
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, keep), "\n"), F.lit("\n\n[... truncated "), more.cast("string"), F.lit(" more lines]"))).otherwise(x)


def line_at_char(x: Column, pos: Column) -> Column:
    """The number of the line that holds character ``pos`` (from 0)."""
    before = F.substring(x, F.lit(1), pos)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def snippet(body: Column, query: Column, max_lines: int = 4) -> Column:
    """The window around the first line with most query terms: struct of line, snippet, before, after, count, header."""
    lines = F.split(body, "\n", -1)

    def with_terms(terms: Column) -> Column:
        def hits(line: Column) -> Column:
            return F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t)))

        def best(ls: Column) -> Column:
            scored = F.transform(ls, lambda line, i: F.struct(hits(line).alias("n"), (-i).alias("at")))
            return let(-F.array_max(scored)["at"], lambda at: window(ls, at))

        def window(ls: Column, at: Column) -> Column:
            start = F.greatest(at - 1, F.lit(0))
            end = F.least(at + max_lines - 1, F.size(ls))
            count = end - start
            header = F.concat(F.lit("@@ -"), (start + 1).cast("string"), F.lit(","), count.cast("string"), F.lit(" @@ ("), start.cast("string"), F.lit(" before, "), (F.size(ls) - end).cast("string"), F.lit(" after)"))
            return F.struct((at + 1).alias("line"), F.array_join(F.slice(ls, start + 1, count), "\n").alias("snippet"), start.alias("before"), (F.size(ls) - end).alias("after"), count.alias("count"), header.alias("header"))

        return let(lines, best)

    terms = F.filter(F.split(F.lower(query), r"\s+", -1), lambda w: w != "")
    return let(terms, with_terms)


#: Bytes of a text around a chunk that a snippet may show, and of a snippet.
SNIPPET_MARGIN, SNIPPET_BYTES, SNIPPET_CHUNK = 100, 500, 3600
SNIPPET_INTENT = 0.3


def char_start(data: Column, at: Column) -> Column:
    """Byte ``at`` of UTF-8 ``data``, or the first byte of the character it lies inside."""
    inside = lambda p: F.hex(F.substring(data, p + 1, F.lit(1))).between("80", "BF")
    out = at - 3
    for k in (2, 1, 0):
        out = F.when(~inside(at - k), at - k).otherwise(out)
    return out


def extract_snippet(body: Column, query: Column, max_bytes: int = SNIPPET_BYTES, chunk_pos: Column | None = None, chunk_len: Column | None = None, intent: Column | None = None) -> Column:
    """The lines around the best one, under a header: struct of line, snippet, before, after and count.

    A line scores 1 for each query word and less for each intent term that it
    contains; the first of equals wins.  With ``chunk_pos`` (in bytes) only the
    chunk and a margin count; where nothing matches there, the chunk's first
    line is shown, and where that gives nothing, the whole text is tried.
    """
    terms = F.filter(F.split(F.lower(query), r"\s+", -1), lambda w: w != "")
    wishes = intent_terms(F.coalesce(intent, F.lit(""))) if intent is not None else F.array().cast("array<string>")
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    text = lambda data, a, b: F.decode(F.substring(data, a + 1, b - a), "UTF-8")

    def scored(lines: Column) -> Column:
        hits = lambda line, words: F.size(F.filter(words, lambda t: F.contains(line, t)))
        score = lambda line: hits(line, terms) + SNIPPET_INTENT * hits(line, wishes)
        return F.array_max(F.transform(lines, lambda line, i: F.struct(let(F.lower(line), score).alias("score"), (-i).alias("at"))))

    def shown(lines: Column, best: Column, offset: Column) -> Column:
        start = F.greatest(best - 1, F.lit(0))
        count = F.least(best + 3, F.size(lines)) - start
        first = offset + start + 1
        after = F.greatest(newlines(body) + 1 - (first + count - 1), F.lit(0))
        header = F.concat(F.lit("@@ -"), first.cast("string"), F.lit(","), count.cast("string"), F.lit(" @@ ("), (first - 1).cast("string"), F.lit(" before, "), after.cast("string"), F.lit(" after)\n"))
        cut = lambda t: F.when(F.octet_length(t) > max_bytes, let(F.encode(t, "UTF-8"), lambda d: F.concat(text(d, F.lit(0), char_start(d, F.lit(max(0, max_bytes - 3)))), F.lit("...")))).otherwise(t)
        plain = F.array_join(F.slice(lines, start + 1, count), "\n")
        return F.struct((offset + best + 1).cast("int").alias("line"), F.concat(header, let(plain, cut)).alias("snippet"), (first - 1).cast("int").alias("before"), after.cast("int").alias("after"), count.cast("int").alias("count"))

    whole = let(F.split(body, "\n", -1), lambda ls: let(scored(ls), lambda s: shown(ls, -s["at"], F.lit(0))))
    if chunk_pos is None:
        return whole
    pos = chunk_pos.cast("int")
    length = (F.lit(SNIPPET_CHUNK) if chunk_len is None else chunk_len).cast("int")

    def near(data: Column) -> Column:
        a = char_start(data, F.greatest(pos - SNIPPET_MARGIN, F.lit(0)))
        b = char_start(data, F.least(pos + length + SNIPPET_MARGIN, F.octet_length(body)))

        def of(at: Column) -> Column:
            anchor = newlines(text(data, at["a"], pos))
            lines = F.split(text(data, at["a"], at["b"]), "\n", -1)

            def chosen(ls: Column) -> Column:
                def result(s: Column) -> Column:
                    window = shown(ls, F.when(s["score"] > 0, -s["at"]).otherwise(anchor), newlines(text(data, F.lit(0), at["a"])))
                    empty = lambda w: w["snippet"].rlike(r"^[^\n]*\n\s*$")
                    return F.when((s["score"] <= 0) & (pos == 0), whole).otherwise(let(window, lambda w: F.when((pos > 0) & empty(w), whole).otherwise(w)))

                return let(scored(ls), result)

            return let(lines, chosen)

        return let(F.struct(a.alias("a"), b.alias("b")), of)

    return F.when(chunk_pos.isNull(), whole).otherwise(let(F.encode(body, "UTF-8"), near))
