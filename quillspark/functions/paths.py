"""Virtual paths, path clean-up and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.derived import SCHEME
from .text import let


def virtual_path(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), collection, F.lit("/"), path)


def parse_virtual_path(x: Column) -> Column:
    """struct(collection, path, index) of ``scheme://collection/path?index=name``, extra slashes and a missing scheme aside."""
    rest = F.regexp_replace(F.trim(x), f"^(?:{SCHEME}:/*|//+)", "")
    main = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    index = F.regexp_extract(rest, r"[?&]index=([^&]*)", 1)
    collection = F.regexp_extract(main, r"^/*([^/]*)", 1)
    path = F.regexp_replace(F.regexp_extract(main, r"(?s)^/*[^/]*/*(.*)$", 1), "/+", "/")
    return F.struct(collection.alias("collection"), path.alias("path"), F.when(index != "", F.url_decode(index)).alias("index"))


def is_virtual_path(x: Column) -> Column:
    return F.trim(x).startswith(f"{SCHEME}:") | F.trim(x).startswith("//")


def is_absolute_path(x: Column) -> Column:
    """Whether a path begins with a slash or with a drive's letter and a colon."""
    return x.rlike(r"^(?:/|[A-Za-z]:)")


def slashes(x: Column) -> Column:
    """A path with slashes for backslashes."""
    return F.replace(x, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, prefix: Column) -> Column:
    """The rest of ``path`` behind the folder ``prefix``, empty if it is the folder itself, null if it lies elsewhere or there is no prefix."""
    p, q = slashes(path), slashes(prefix)
    folder = F.when(q.endswith("/"), q).otherwise(F.concat(q, F.lit("/")))
    return F.when(q == "", None).when(p == q, "").when(p.startswith(folder), F.substring(p, F.length(folder) + 1, F.length(p)))


#: A drive, as in C:\\ or, as some shells write it, /c/; A and B are never written like the latter.
_DRIVE, _SHELL_DRIVE = r"^([A-Za-z]:)", r"^/([c-zC-Z])/"


def _placed(path: Column) -> Column:
    """struct(drive, rest) of a path with slashes; no drive is an empty one."""
    shell = F.regexp_extract(path, _SHELL_DRIVE, 1)
    own = F.regexp_extract(path, _DRIVE, 1)
    drive = F.when(own != "", own).when(shell != "", F.concat(F.upper(shell), F.lit(":"))).otherwise("")
    return F.struct(drive.alias("drive"), F.when(drive != "", F.substring(path, F.lit(3), F.length(path))).otherwise(path).alias("rest"))


def resolve_path(parts: Column, current: Column) -> Column:
    """The absolute path that an array of path parts leads to from the folder ``current``.

    An absolute part begins anew, with its drive or without one; dot segments
    are folded away, and none leads above the root.  Null for no parts.
    """
    start = let(slashes(current), lambda c: F.struct(F.regexp_extract(c, _DRIVE, 1).alias("drive"), F.regexp_replace(c, _DRIVE, "").alias("rest")))

    def add(so_far: Column, part: Column) -> Column:
        joined = F.struct(so_far["drive"].alias("drive"), F.concat(so_far["rest"], F.lit("/"), part).alias("rest"))
        return F.when(is_absolute_path(part), _placed(part)).otherwise(joined)

    def fold(segments: Column) -> Column:
        step = lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
        kept = F.filter(segments, lambda s: (s != "") & (s != "."))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/"))

    where = F.aggregate(F.transform(parts, slashes), start, add)
    whole = let(where, lambda w: F.concat(w["drive"], fold(F.split(w["rest"], "/", -1))))
    return F.when(F.size(parts) > 0, whole)


def is_collection_name(x: Column) -> Column:
    return x.rlike("^[A-Za-z0-9_-]+$")


def _clean_segment(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$", "")


def _symbols_to_hex(s: Column) -> Column:
    """Symbol characters as their code points in hex, joined by dashes inside a run."""
    if_symbol = lambda c: c.rlike(r"^[\p{So}\p{Sk}]$")
    chars = F.split(F.regexp_replace(s, r"([\p{So}\p{Sk}])\p{Mn}?(?=[\p{So}\p{Sk}])", "$1\u0001"), "")
    code = lambda c: F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""))
    plain = F.regexp_replace(F.array_join(F.transform(chars, lambda c: F.when(if_symbol(c), code(c)).when(c == "\u0001", "-").otherwise(c)), ""), "\u0001", "-")
    return F.when(s.rlike(r"[\p{So}\p{Sk}]"), plain).otherwise(s)


def handelize(path: Column) -> Column:
    """A path of letters, digits, ``$`` and dashes; null where nothing usable is left of the file's name."""
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    usable = F.regexp_replace(last, r"\.[^.]+$", "").rlike(r"[\p{L}\p{N}\p{So}\p{Sk}$]")

    def clean(segments: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            ext = F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)
            with_ext = F.concat(_clean_segment(F.left(s, F.length(s) - F.length(ext))), ext)
            return F.when((i == F.size(segments) - 1) & (ext != ""), with_ext).otherwise(_clean_segment(s))

        return F.array_join(F.filter(F.transform(segments, one), lambda s: s != ""), "/")

    out = let(F.transform(F.split(F.replace(path, F.lit("___"), F.lit("/")), "/", -1), _symbols_to_hex), clean)
    return F.when((F.trim(path) != "") & usable & (out != ""), out)


def glob_to_regex(pattern: str) -> str:
    """A glob as a regular expression for the whole text: ``*`` and ``**`` cross slashes, ``?`` is one character, ``[..]`` and ``{a,b}`` as usual."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            if i and pattern[i - 1 : i + 2] == "**/":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
