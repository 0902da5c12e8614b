"""Search hits as lines of CSV, JSON, Markdown, XML and plain files, ready for Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("docid", "score", "file", "title", "context", "line", "snippet")


def escape_csv(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.contains(",") | x.contains('"') | x.contains("\n"), quoted).otherwise(x)


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _text(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(F.format_string("%.4f", F.round(c, 4)) if name == "score" else c.cast("string"), F.lit(""))


def csv_line() -> Column:
    return F.concat_ws(",", *[escape_csv(_text(n)) for n in FIELDS])


def files_line() -> Column:
    return F.concat(F.lit("#"), F.col("docid"), F.lit(","), F.format_string("%.2f", F.round("score", 2)), F.lit(","), F.col("file"), F.when(_text("context") != "", F.concat(F.lit(',"'), _text("context"), F.lit('"'))).otherwise(""))


def markdown() -> Column:
    return F.concat(F.lit("---\n# "), _text("title"), F.lit("\n\n**docid:** `#"), F.col("docid"), F.lit("`\n"), F.when(_text("context") != "", F.concat(F.lit("**context:** "), _text("context"), F.lit("\n"))).otherwise(""), F.lit("\n"), _text("snippet"), F.lit("\n"))


def xml() -> Column:
    return F.concat(F.lit('<file docid="#'), F.col("docid"), F.lit('" name="'), escape_xml(F.col("file")), F.lit('" title="'), escape_xml(_text("title")), F.lit('">\n'), escape_xml(_text("snippet")), F.lit("\n</file>"))


def json_line() -> Column:
    return F.to_json(F.struct(*[F.col(n) for n in FIELDS]))


FORMATS = {"csv": csv_line, "files": files_line, "md": markdown, "xml": xml, "json": json_line}


def write(hits: DataFrame, form: str, path: str) -> None:
    """Writes hits in one of FORMATS with Spark's text writer."""
    hits.select(FORMATS[form]().alias("value")).write.text(path)
