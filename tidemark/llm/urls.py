"""URL filter by a path-template tree.

Every path is a list of segments whose digit runs stand for any number. Per host, level by level, to the paths' full depth,
a segment with few labelled pages of its own becomes a wildcard, however many siblings it has; branches whose labelled
rates don't differ significantly from their siblings' merge; a template is rejected when its smoothed labelled purity is
under a threshold, or lies significantly under the purity of all labelled pages. Explicit rules come first.

Null urls and urls without "://" have an empty host and path, fit no rule, and get the verdict of the empty template.
Repeated rows are judged alike, one result each. An empty table gives an empty result. Columns of df but the id and the
url are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY, REST = "*", "**"


@dataclass(frozen=True)
class Settings:
    support: int = 4  # labelled pages that keep a segment literal, whatever its siblings
    z: float = 1.96  # two branches differ from here on
    weight: float = 4.0  # labelled pages that the prior counts for
    threshold: float = 0.5  # smoothed purity under it: rejected
    reject_z: float = 2.58  # or so many standard errors, of as many pages as the template's labels and weight, under the overall purity


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path start, verdict) that fits, as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(shapes: DataFrame, s: Settings) -> DataFrame:
    """shapes: host, segments (array), good, bad, pages; adds template (string), its smoothed purity and whether it is rejected."""
    tree = written(shapes.withColumn("template", F.lit("")))  # each level reads it three times
    deepest, depth, node = tree.agg(F.max(F.size("segments"))).first()[0] or 0, 0, ["host", "template"]
    while depth < deepest:
        here = F.try_element_at("segments", F.lit(depth + 1))
        tree = tree.withColumn("segment", here)
        children = tree.where("segment is not null").groupBy(*node, "segment").agg(F.sum(F.col("good") + F.col("bad")).alias("labelled"))
        # A node without the labels for one child has none for anything below it: what is left of its paths is one wildcard.
        whole = children.groupBy(*node).agg(F.sum("labelled").alias("of")).where(F.col("of") >= s.support).select(*node, F.lit(True).alias("open"))
        literal = children.where(F.col("labelled") >= s.support).select(*node, "segment", F.lit(True).alias("literal"))
        tree = tree.join(whole, node, "left").join(literal, [*node, "segment"], "left")
        step = F.when(F.col("literal"), F.col("segment")).when(F.col("open"), F.lit(ANY)).otherwise(F.lit(REST))
        over = F.col("segment").isNull() | F.col("template").endswith(f"/{REST}")
        tree = tree.withColumn("template", F.when(over, F.col("template")).otherwise(F.concat("template", F.lit("/"), step))).drop("literal", "open", "segment")
        tree, depth = written(tree), depth + 1
        if not tree.where((F.size("segments") > depth) & ~F.col("template").endswith(f"/{REST}")).limit(1).count():
            break
    leaves = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("merged", F.col("template"))
    for level in range(depth):
        parts = F.split("merged", "/")
        opened = F.when(F.size(parts) > level + 1, F.array_join(F.transform(parts, lambda x, i: F.when(i == level + 1, F.lit(ANY)).otherwise(x)), "/")).otherwise(F.col("merged"))
        branch = leaves.groupBy("host", "merged").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).withColumn("opened", opened)
        group = branch.groupBy("host", "opened").agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"), F.count("*").alias("branches"))
        n, rest = F.col("g") + F.col("b"), F.col("all_g") + F.col("all_b") - F.col("g") - F.col("b")
        p = F.try_divide(F.col("all_b"), n + rest)
        spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
        z = F.try_divide(F.abs(F.try_divide(F.col("b"), n) - F.try_divide(F.col("all_b") - F.col("b"), rest)), spread)
        similar = (F.col("branches") > 1) & (F.coalesce(z, F.lit(0.0)) < s.z)
        branch = branch.join(group, ["host", "opened"]).select("host", "merged", F.when(similar, F.col("opened")).otherwise(F.col("merged")).alias("to"))
        leaves = leaves.join(branch, ["host", "merged"]).withColumn("merged", F.col("to")).drop("to")
        leaves = written(leaves)
    pooled = leaves.groupBy("host", "merged").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    total = pooled.agg(F.sum("good").alias("g0"), F.sum("bad").alias("b0"))
    host = pooled.groupBy("host").agg(F.sum("good").alias("g1"), F.sum("bad").alias("b1"))
    smooth = lambda g, b, prior: (F.col(g) + s.weight * prior) / (F.col(g) + F.col(b) + s.weight)
    row = total.first()  # one row
    prior = (row.g0 + 1.0) / (row.g0 + row.b0 + 2.0) if row and row.g0 is not None else 0.5
    pooled = pooled.join(host, "host").withColumn("purity", smooth("good", "bad", smooth("g1", "b1", F.lit(prior))))
    error = F.sqrt(F.lit(prior * (1 - prior)) / (F.col("good") + F.col("bad") + s.weight))
    pooled = pooled.withColumn("rejected", (F.col("purity") < s.threshold) | (F.col("purity") < prior - s.reject_z * error))
    pooled = pooled.select("host", "merged", "purity", "rejected", F.col("good").alias("template_good"), F.col("bad").alias("template_bad"))
    leaves = leaves.select("host", "template", "merged").join(pooled, ["host", "merged"])
    return tree.select("host", "segments", "template").join(leaves, ["host", "template"])


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", s: Settings = Settings()) -> DataFrame:
    """Rows: page_id, host, path, rule, verdict, template, purity.

    labels: (page_id, good 0/1), at most one row a page; without them, the rules' own verdicts label their pages.
    """
    host, path = split_url(F.col(url_col))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    pages = pages.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "{n}"))
    pages = pages.withColumn("segments", segments)
    if labels is None:
        marked = pages.withColumn("good", F.when(F.col("fit.verdict") == "allow", 1).when(F.col("fit.verdict") == "block", 0))
    else:
        marked = pages.join(labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("good").alias("good")), "page_id", "left")
    shapes = marked.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    judged = templates(shapes, s)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return pages.join(judged, ["host", "segments"], "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("merged").alias("template"), "purity")
