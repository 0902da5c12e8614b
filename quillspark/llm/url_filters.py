"""URL filters: explicit host and path rules, and a path-template tree for the rest.

Urls become templates by writing variable segments as wildcards.  From there
on all work is on counts by (host, template): a tree is built level by level,
branches whose labels do not differ by a pairwise test merge into one, and a
template is rejected if its labelled purity, smoothed towards its parent's, is
low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, staged

#: (host, start of the path, verdict) of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Segments that carry an identifier: what they become.
VARIABLE = (
    (r"^[0-9]+$", "*"),
    (r"^[0-9]+(\.[A-Za-z0-9]{1,8})$", "*$1"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$", "*"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "*"),
    (r"^.*[0-9]{4,}[^/.]*(\.[A-Za-z0-9]{1,8})?$", "*$1"),
)
#: Two branches are alike if their rates of good labels differ by fewer standard errors.
ALIKE_Z = 1.96
PRIOR_WEIGHT = 4.0
MIN_PURITY = 0.5
#: How often the members of a branch are tested against the rest of it.
BRANCH_PASSES = 3


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without "://"."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    rest = F.when(F.instr(F.coalesce(url, F.lit("")), "://") > 0, rest).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that fits and is longest (host and path together), as a struct of its text and verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""

    def general(s: Column) -> Column:
        out = s
        for pattern, form in reversed(VARIABLE):
            out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, form)).otherwise(out)
        return out

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _apart(g: Column, n: Column, g2: Column, n2: Column) -> Column:
    """The two-proportion test of g good of n against g2 of n2, in standard errors; null if either has none."""
    pooled = (g + g2 + 0.5) / (n + n2 + 1)
    return F.when((n > 0) & (n2 > 0), F.abs(F.try_divide(g, n) - F.try_divide(g2, n2)) / F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), n2))))


def merged_branches(children: DataFrame, alike_z: float = ALIKE_Z) -> DataFrame:
    """``children`` (host, node, segment, n, g) with the branch each belongs to, and that branch's counts.

    A segment that cannot be told from all its siblings together goes to
    branch 0.  The others, in the order of their rates of good labels, begin
    a new branch where neighbours can be told apart; then, a few times over,
    whoever can be told from the rest of its branch leaves it and is one of
    its own, so no chain of neighbours joins rates that differ.  Only labelled
    segments come here, so a host's rows are bounded by its labels.
    """
    level = Window.partitionBy("host", "node")
    out = children.withColumns({"all_n": F.sum("n").over(level), "all_g": F.sum("g").over(level)})
    out = out.withColumn("own", F.coalesce(_apart(F.col("g"), F.col("n"), F.col("all_g") - F.col("g"), F.col("all_n") - F.col("n")) >= alike_z, F.lit(False)))
    by = Window.partitionBy("host", "node", "own").orderBy("rate", "segment")
    out = out.withColumn("rate", (F.col("g") + 0.5) / (F.col("n") + 1)).withColumns({"n0": F.lag("n").over(by), "g0": F.lag("g").over(by)})
    starts = F.col("n0").isNull() | (_apart(F.col("g"), F.col("n"), F.col("g0"), F.col("n0")) >= alike_z)
    out = out.withColumn("branch", F.when(F.col("own"), F.sum(starts.cast("int")).over(by)).otherwise(0))
    same = Window.partitionBy("host", "node", "branch", "alone")
    out = out.withColumn("alone", F.lit(""))
    for _ in range(BRANCH_PASSES):
        out = out.withColumns({"n1": F.sum("n").over(same) - F.col("n"), "g1": F.sum("g").over(same) - F.col("g")})
        leaves = F.col("own") & (_apart(F.col("g"), F.col("n"), F.col("g1"), F.col("n1")) >= alike_z)
        out = out.withColumn("alone", F.when(leaves, F.col("segment")).otherwise(F.col("alone"))).drop("n1", "g1")
    out = out.withColumns({"branch_n": F.sum("n").over(same), "branch_g": F.sum("g").over(same), "members": F.count("*").over(same)})
    return out.drop("rate", "n0", "g0", "own", "all_g", "alone")


def branching_levels(counts: DataFrame) -> list[int]:
    """The levels (from 1) at which the labelled templates of some host have two segments or more; at all others no node has a choice."""
    each = counts.where("labelled > 0").select("host", F.posexplode("template").alias("level", "segment"))
    found = each.groupBy("host", "level").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a <> b").select("level").distinct()
    # a template may end where others go on: its node has no such choice either
    return sorted(r["level"] + 1 for r in found.collect())


def template_verdicts(counts: DataFrame, prior_weight: float = PRIOR_WEIGHT, min_purity: float = MIN_PURITY, alike_z: float = ALIKE_Z) -> DataFrame:
    """host, template, node, purity and rejected for each row of ``counts`` (host, template, pages, labelled, good).

    Purity is smoothed from the root down: at each level a branch has the
    counts of all its merged segments plus ``prior_weight`` pages of its
    parent's purity.  A branch with all labels of its parent says nothing new
    and keeps its purity, so only levels at which labelled templates of a host
    differ are worked on; segments without labels keep their parent's purity.
    """
    overall = counts.agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("overall"))
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g")).crossJoin(F.broadcast(overall))  # one row
    hosts = hosts.select("host", ((F.col("g") + prior_weight * F.coalesce("overall", F.lit(0.5))) / (F.col("n") + prior_weight)).alias("purity"))
    frame = counts.join(hosts, "host").withColumns({"node": F.lit(""), "done": F.lit(0)})
    for level in branching_levels(counts):
        # the segments of the levels between, which are the same for all labelled templates, go into the node's name
        between = F.concat_ws("/", F.slice("template", F.col("done") + 1, F.greatest(F.lit(0), F.lit(level - 1) - F.col("done"))))
        frame = frame.withColumns({"node": F.concat("node", F.lit("/"), between), "segment": F.get("template", F.lit(level - 1)), "done": F.lit(level)})
        children = frame.where("segment is not null and labelled > 0").groupBy("host", "node", "segment").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"), F.first("purity").alias("above"))
        merged = merged_branches(children, alike_z)
        name = F.when(F.col("members") > 1, F.concat(F.lit("*"), F.col("branch"))).otherwise(F.col("segment"))
        purity = F.when(F.col("branch_n") == F.col("all_n"), F.col("above")).otherwise((F.col("branch_g") + prior_weight * F.col("above")) / (F.col("branch_n") + prior_weight))
        frame = frame.join(merged.select("host", "node", "segment", name.alias("name"), purity.alias("next")), ["host", "node", "segment"], "left")
        frame = frame.withColumn("purity", F.coalesce("next", "purity"))
        frame = frame.withColumn("node", F.when(F.col("segment").isNotNull(), F.concat("node", F.lit("/"), F.coalesce("name", F.lit("?")))).otherwise(F.concat("node", F.lit("$")))).drop("name", "next", "segment")
        frame = staged(frame, f"url-tree-{level}")
    return frame.select("host", "template", "node", "purity", (F.col("purity") < min_purity).alias("rejected"))


def judge(urls: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, **tree) -> DataFrame:
    """``urls`` with host, path, rule and verdict ("allow" or "block").

    ``labelled`` has the columns url and good (0 or 1; null rows count for
    nothing).  Null urls, and those without "://", have an empty host and path
    and the verdict of that host's template.  Repeated rows are judged alike;
    columns named host, path, rule or verdict are replaced.
    """
    host, path = parts(F.col(url))
    seen = urls.withColumns({"host": host, "path": path})
    fixed = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"__rule": fixed, "__template": template(F.col("path"))})
    lhost, lpath = parts(F.col("url"))
    marks = labelled.where("url is not null and good is not null").select(lhost.alias("host"), template(lpath).alias("template"), F.lit(0).cast("long").alias("pages"), F.lit(1).cast("long").alias("labelled"), F.col("good").cast("long").alias("good"))
    pages = seen.select("host", F.col("__template").alias("template"), F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("good"))
    counts = pages.unionByName(marks).groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
    bad = template_verdicts(staged(counts, "url-counts"), **tree).where("rejected").select(F.col("host").alias("__h"), F.col("template").alias("__t"))
    out = seen.join(bad, (F.col("host") == F.col("__h")) & (F.col("__template") == F.col("__t")), "left")
    learned = F.when(F.col("__h").isNotNull(), "block").otherwise("allow")
    out = out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), learned)})
    return out.drop("__rule", "__template", "__h", "__t")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with the quality label of the document whose id ends their path (``.../825.html`` is document 825)."""
    _, path = parts(F.col("url"))
    ids = pages.select("url", F.try_to_number(F.regexp_extract(path, r"([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1), F.lit("9" * 18)).cast("long").alias("id"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return ids.join(marks, F.col("id") == F.col("doc_id")).select("url", "good")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict.

    A null url, or one without "://", has an empty host and path and is judged by the tree of that
    host.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, labelled_urls(pages, read_table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")
