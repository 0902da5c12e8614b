"""Parsers of the lexical query language and of structured query documents."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from .text import ACCENTED, PLAIN

_CJK = re.compile(r"[ᄀ-ᇿ぀-ヿ㄰-㆏ㇰ-ㇿ㐀-䶿一-鿿가-힯豈-﫿]")
_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


@dataclass(frozen=True)
class Item:
    """One part of a query: its index tokens, whether the last is a prefix, and whether it must be absent."""

    tokens: tuple[str, ...]
    prefix: bool
    negated: bool = False


def index_tokens(text: str) -> tuple[str, ...]:
    """Tokens as the index has them: runs of letters and digits in lower case, without accents."""
    out, run = [], []
    for c in text.lower().translate(_FOLD):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return tuple([*out, "".join(run)] if run else out)


def _kept(term: str) -> str:
    return "".join(c for c in term if unicodedata.category(c)[0] in "LN" or c in "'_").lower()


def _spaced(text: str) -> str:
    return _CJK.sub(lambda m: f" {m[0]} ", text)


def _is_hyphenated(t: str) -> bool:
    edge = lambda c: c.isascii() and c.isalnum()
    return "-" in t and edge(t[0]) and edge(t[-1]) and all(unicodedata.category(c)[0] in "LN" or c in "-_'" for c in t)


def parse_lexical(query: str) -> list[Item]:
    """The items of a query; none if it has no positive one.

    White space parts items, a leading "-" negates the next, quotes make a
    phrase.  Hyphenated words and CJK text are phrases too; all else matches
    as a prefix.  An item without tokens can match nothing and stays as such.
    """
    items: list[Item] = []
    i, n = 0, len(query)
    while i < n:
        if query[i] in " \t\n\r\f\v":
            i += 1
            continue
        negated = query[i] == "-"
        i += negated
        if i >= n:
            break
        if query[i] == '"':
            end = query.find('"', i + 1)
            end = n if end < 0 else end
            words = [_kept(w) for w in _spaced(query[i + 1 : end]).split()]
            text, phrase, i = " ".join(w for w in words if w), True, end + 1
        else:
            end = i
            while end < n and query[end] not in ' \t\n\r\f\v"':
                end += 1
            term, i = query[i:end], max(end, i + (end == i))
            if term and _is_hyphenated(term):
                text, phrase = " ".join(w for w in map(_kept, term.split("-")) if w), True
            elif _CJK.search(term):
                text, phrase = " ".join(w for w in map(_kept, _spaced(term).split()) if w), True
            else:
                text, phrase = _kept(term), False
        if text:
            items.append(Item(index_tokens(text), not phrase, negated))
    return items if any(not x.negated for x in items) else []


def validate_lexical(query: str) -> str | None:
    """What is wrong with a lexical query, if anything."""
    if "\n" in query or "\r" in query:
        return "a lexical query must be a single line"
    if query.count('"') % 2:
        return "a lexical query has an unmatched quote"
    return None


def validate_semantic(query: str) -> str | None:
    if re.search(r'(^|\s)-[\w"]', query):
        return "a semantic query cannot exclude terms"
    return None


@dataclass
class QueryDocument:
    searches: list[tuple[str, str, int]] = field(default_factory=list)  # kind, text, line
    intent: str | None = None


def parse_document(text: str, allow_expand: bool = True) -> QueryDocument | None:
    """A structured query document; None for a plain query (one line without a kind, or ``expand:``)."""
    lines = [(k, x.strip()) for k, x in enumerate(text.split("\n"), 1) if x.strip()]
    out = QueryDocument()
    kinds = ("lex", "vec", "hyde", "intent") + (("expand",) if allow_expand else ())
    for k, line in lines:
        kind, colon, rest = line.partition(":")
        kind = kind.strip().lower()
        if not colon or kind not in kinds:
            if len(lines) == 1:
                return None
            raise ValueError(f"line {k} has no lex:, vec:, hyde: or intent: in front")
        rest = rest.strip()
        if kind == "expand":
            if len(lines) > 1:
                raise ValueError("expand: must be the only line")
            return None
        if not rest:
            raise ValueError(f"line {k} ({kind}): the text is empty")
        if kind == "intent":
            if out.intent is not None:
                raise ValueError(f"line {k}: only one intent: line is allowed")
            out.intent = rest
        else:
            wrong = validate_lexical(rest) if kind == "lex" else validate_semantic(rest)
            if wrong:
                raise ValueError(f"Line {k} ({kind}): {wrong}")
            out.searches.append((kind, rest, k))
    if not lines:
        return None
    if not out.searches:
        raise ValueError("intent: needs at least one search line")
    return out


def primary_query(searches: list[tuple[str, str, int]]) -> str:
    """The first lexical search, else the first semantic one, else the first."""
    for kind in ("lex", "vec"):
        for k, text, _ in searches:
            if k == kind:
                return text
    return searches[0][1]
