"""URL filters: explicit rules, and a path-template tree judged by smoothed labelled purity.

Native: DataFrame functions only. The tree is built over distinct (host, template) rows, not over
pages: variable parts of a path become wildcards, the rare children of a node with many children
become one, siblings at any level with similar shares of blocked labels are pooled, and a template is
rejected if the smoothed share of blocked labels in its pool is high enough. A template without labels
is judged by the shares of its nearest siblings, each one observation. Labels are the verdicts of the rules, unless a
table of labels is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import ascii_lower
from citeforge.llm.scratch import apart, written

# Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass(frozen=True)
class Tree:
    """``depth``: levels of the tree; what is deeper is one more segment, with all its text. ``children``: a node with
    more keeps only those with ``support`` pages, the others are one wildcard. ``z``: how many
    standard errors a sibling may be from its siblings' pooled share. ``weight``, ``prior``:
    the smoothing. ``purity``, ``labelled``: least smoothed share and labels to reject."""

    depth: int = 16
    children: int = 20
    support: int = 50
    z: float = 2.0
    weight: float = 4.0
    prior: float = 0.5
    purity: float = 0.8
    labelled: int = 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules`` is a short list of
    the caller's: one condition each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def template(path: Column, depth: int) -> Column:
    """Segments with variable parts generalised: long hex ids, then runs of digits."""
    part = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(part, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F-]{16,}", "{h}"), "[0-9]+", "{n}"))
    return F.when(F.size(plain) > depth, F.concat(F.slice(plain, 1, depth), F.array(F.array_join(F.slice(plain, F.lit(depth + 1), F.size(plain)), "/")))).otherwise(plain)


def judged_templates(counts: DataFrame, tree: Tree) -> DataFrame:
    """(host, parts, purity, labelled) of rows host, parts, n, bad, good."""
    rows = counts.withColumn("node", F.array().cast("array<string>"))
    for level in range(1, tree.depth + 2):
        if not rows.filter(F.size("parts") >= level).limit(1).count():
            break
        part = F.try_element_at("parts", F.lit(level))
        kids = rows.filter(F.size("parts") >= level).groupBy("host", "node", part.alias("part")).agg(F.sum("n").alias("n"))
        fan = kids.groupBy("host", "node").agg(F.count(F.lit(1)).alias("fan")).filter(F.col("fan") > tree.children)
        rare = kids.filter(F.col("n") < tree.support).join(apart(fan), ["host", "node"], "left_semi").select("host", "node", "part", F.lit(True).alias("rare"))
        rows = rows.withColumn("part", part).join(apart(rare), ["host", "node", "part"], "left").withColumn(
            "node", F.when(F.col("part").isNull(), F.col("node")).otherwise(F.concat("node", F.array(F.when(F.col("rare"), F.lit("*")).otherwise(F.col("part")))))
        ).drop("part", "rare")
        rows = written(rows, "url_nodes")  # else the plan would treble with each level

    # Siblings, at every level: leaves of a host that differ in one segment only. Of each such pool
    # the labelled leaves whose share is near the pool's count.
    leaves = written(rows.groupBy("host", "node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("m", F.col("bad") + F.col("good")), "url_leaves")
    shape = lambda l: F.concat(F.slice("node", F.lit(1), l - 1), F.array(F.lit("*")), F.slice("node", l + 1, F.size("node")))
    levels = F.when(F.size("node") > 0, F.sequence(F.lit(1), F.size("node")))
    each = leaves.select("*", F.explode(levels).alias("level")).withColumn("shape", shape(F.col("level")))
    shares = each.filter("m > 0").groupBy("host", "level", "shape").agg((F.sum("bad") / F.sum("m")).alias("share"))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("m"))
    near = F.abs(F.col("bad") / F.col("m") - F.col("share")) <= tree.z * error + 0.5 / F.col("m")
    each = written(each.join(apart(shares), ["host", "level", "shape"]).withColumn("near", F.col("m").eqNullSafe(0) | near), "url_siblings")
    own = F.col("bad") / F.col("m")
    pools = each.filter("m > 0 and near").groupBy("host", "level", "shape").agg(F.sum("bad").alias("b"), F.sum("m").alias("labelled"), F.sum(own).alias("shares"), F.count(F.lit(1)).alias("branches"))
    # A leaf takes the deepest pool that has another labelled leaf. One without labels of its own
    # counts each leaf there as one observation, however many labels it has, since what one branch
    # shows says little of another.
    fits = each.filter("near").join(apart(pools), ["host", "level", "shape"]).filter((F.col("m") == 0) | (F.col("branches") > 1))
    fits = fits.groupBy("host", "node").agg(*(F.max_by(c, "level").alias(c) for c in ("b", "labelled", "shares", "branches")))
    smooth = lambda b, n: (b + tree.weight * tree.prior) / (n + tree.weight)
    purity = F.when(F.col("m") > 0, smooth(F.coalesce("b", "bad"), F.coalesce("labelled", "m"))).otherwise(smooth(F.coalesce("shares", F.lit(0.0)), F.coalesce("branches", F.lit(0))))
    judged = leaves.join(apart(fits), ["host", "node"], "left").select("host", "node", F.coalesce("labelled", "m").alias("labelled"), purity.alias("purity"))
    return rows.select("host", "parts", "node").join(apart(judged), ["host", "node"]).select("host", "parts", "node", "purity", "labelled")


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple = RULES,
    tree: Tree | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    ``labels``: (page_id, bad boolean), instead of the rules' verdicts. Null URLs and those
    without ``://`` have an empty host and path and are judged as such. Templates without enough
    labels are allowed. Repeated rows are each judged, and count each. Pages are counted in the
    tasks before the shuffle, so a host with a third of all pages makes few rows, and templates
    come back to pages by a join that AQE may split.
    """
    tree = tree or Tree()
    url = pages[url_col].cast("string")
    host, path = host_and_path(url)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "parts": template(F.col("path"), tree.depth)})
    bad, good = F.col("ruled") == "block", F.col("ruled") == "allow"
    seen = rows
    if labels is not None:
        known = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
        seen = rows.join(apart(known), "page_id", "left")
        bad, good = F.col("bad"), ~F.col("bad")
    one = lambda c: F.count(F.when(c, F.lit(1)))
    counts = written(seen.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), one(bad).alias("bad"), one(good).alias("good")), "url_templates")
    judged = written(judged_templates(counts, tree), "judged_templates")
    reject = (F.col("purity") >= tree.purity) & (F.col("labelled") >= tree.labelled)
    return rows.join(judged, ["host", "parts"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("node", "/")).alias("template"), "purity",
    )


__all__ = ["RULES", "Tree", "host_and_path", "matched_rule", "template", "url_filter"]
