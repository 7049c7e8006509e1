"""URL verdicts from rules and from a path-template tree learned per host.

Rules decide first: a rule fits its host and all its subdomains where the path starts with
the rule's path, and the longest fitting rule wins. URLs that no rule decides are judged by
the tree, whose labels are the URLs that rules did decide:

* digit runs of a path become ``#``, and equal (host, shape) pairs are counted;
* level by level, a position with at most VARIABLE distinct segments under its parent keeps
  them all literal, whatever the host's size; with more, a segment stays literal only if it
  holds enough of the parent's URLs, so a parent keeps at most VARIABLE or 1 / SHARE literal
  branches;
* all other segments are variable: those without labels become ``*``, those with labels one
  wildcard per blocked share, so labelled and unlabelled segments never meet in a template;
* literal siblings with labels are ordered by their blocked share, and neighbours with equal
  shares, or with SUPPORT labels each and shares that do not differ significantly, are merged
  into one branch;
* a template's purity is the blocked share of its own labelled URLs, smoothed towards the
  prior, and a purity of one half or more rejects. Evidence stays with its template: a host
  whose French pages are blocked keeps its others.

All counting is by ``groupBy`` with partial sums; what is joined back to the rows is the
counted shapes. Segments beyond DEPTH count as one ``**`` without labels, and as one per
blocked share with labels. ``template_purity`` without ``variable`` builds the plain tree: one
``*`` for all segments that lack support.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule
and is judged as the host ""; repeated rows are judged alike; without any labels every
undecided URL gets the prior's verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

DEPTH, SUPPORT, SHARE, VARIABLE, PRIOR, STRENGTH, Z = 5, 20, 0.02, 50, 0.2, 4.0, 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path of a URL; both empty where there is no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is ``host/path`` text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, slash, under = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + under)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _rate() -> Column:
    """Blocked share of the labelled URLs; null without labels."""
    return F.try_divide(F.col("blocked"), F.col("labelled"))


def _branches(level: DataFrame, support: int, share: float, z: float, variable: int | None) -> DataFrame:
    """Segments of every (host, prefix) that are not plain ``*``, with the name of their branch."""
    counted = level.groupBy("host", "prefix", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    parents = counted.groupBy(F.col("host").alias("of_host"), F.col("prefix").alias("of_prefix")).agg(
        F.sum("n").alias("parent_n"), F.count("seg").alias("distinct"))
    children = counted.where("seg is not null").join(parents, (F.col("host") == F.col("of_host")) & (F.col("prefix") == F.col("of_prefix")))
    enough = F.col("n") >= F.greatest(F.lit(support), F.ceil(F.col("parent_n") * share))
    if variable is not None:
        enough = enough | (F.col("distinct") <= variable)
    literal = children.where(enough).drop("of_host", "of_prefix")
    # At most 1 / share siblings in a window, or ``variable`` where that is more.
    order = W.partitionBy("host", "prefix", F.col("labelled") > 0).orderBy("rate", "seg")
    literal = literal.withColumn("rate", F.coalesce(_rate(), F.lit(-1.0)))
    l0, b0 = F.lag("labelled").over(order), F.lag("blocked").over(order)
    pooled = (b0 + F.col("blocked")) / (l0 + F.col("labelled"))
    gap = F.abs(F.col("rate") - b0 / l0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / l0 + 1 / F.col("labelled")))
    differ = gap > z * error
    if variable is not None:
        differ = (gap > 0) & (differ | (F.least(l0, F.col("labelled")) < support))
    literal = literal.withColumn("apart", F.when((F.col("labelled") == 0) | l0.isNull(), 1).otherwise(differ.cast("int")))
    literal = literal.withColumn("run", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = literal.groupBy("host", "prefix", F.col("labelled") > 0, "run").agg(F.sort_array(F.collect_list("seg")).alias("segs"))
    runs = runs.withColumn("branch", F.when(F.size("segs") > 1, F.concat(F.lit("{"), F.array_join("segs", "|"), F.lit("}"))).otherwise(F.col("segs")[0]))
    names = runs.select(F.col("host").alias("in_host"), F.col("prefix").alias("in_prefix"), F.explode("segs").alias("in_seg"), "branch")
    if variable is None:
        return names
    # Shapes hold no digits, so no segment reads like a rate.
    return names.unionByName(children.where(~enough & (F.col("labelled") > 0)).select(
        F.col("host").alias("in_host"), F.col("prefix").alias("in_prefix"), F.col("seg").alias("in_seg"),
        F.concat(F.lit("*"), _rate().cast("string")).alias("branch")))


def template_purity(shapes: DataFrame, depth: int = DEPTH, support: int = SUPPORT, share: float = SHARE, prior: float = PRIOR,
                    strength: float = STRENGTH, z: float = Z, variable: int | None = None) -> DataFrame:
    """``host``, ``shape``, ``template`` and ``purity`` from counted (host, shape, n, labelled, blocked)."""
    parts = F.split("shape", "/")
    # A path starts with "/": what stands before it is no segment.
    segs = F.slice(parts, 2, 2_000_000)
    beyond = F.lit("**") if variable is None else F.concat(F.lit("**"), F.coalesce(_rate().cast("string"), F.lit("")))
    kept = F.when(F.size(segs) > depth, F.concat(F.slice(segs, 1, depth), F.array(beyond))).otherwise(segs)
    level = shapes.withColumn("segs", kept).withColumn("prefix", F.lit(""))
    for at in range(1, depth + 2):
        level = level.withColumn("seg", F.get("segs", F.lit(at - 1)))
        names = _branches(level, support, share, z, variable)
        named = level.join(names, (F.col("host") == F.col("in_host")) & (F.col("prefix") == F.col("in_prefix")) & (F.col("seg") == F.col("in_seg")), "left")
        step = F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.coalesce("branch", F.lit("*"))))
        level = checkpointed(named.withColumn("prefix", step).drop("in_host", "in_prefix", "in_seg", "branch", "seg"))
    leaves = level.groupBy(F.col("host").alias("leaf_host"), F.col("prefix").alias("template")).agg(
        ((F.sum("blocked") + strength * prior) / (F.sum("labelled") + strength)).alias("purity"))
    return level.join(leaves, (F.col("host") == F.col("leaf_host")) & (F.col("prefix") == F.col("template"))).select(
        "host", "shape", "template", "purity")


def judged(pages: DataFrame, rules: list[tuple[str, str]], **options) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    shapes = checkpointed(rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("says").alias("labelled"), F.count_if(F.col("says") == "block").alias("blocked")))
    tree = template_purity(shapes, **{"variable": VARIABLE} | options).select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity")
    out = rows.join(tree, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape")), "left")
    own = F.when(F.col("purity") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", own).alias("verdict"), "template", "purity")
