"""Merkle manifest of a dataset, with one inclusion proof per row.

1. Every row is a leaf. Leaves are numbered inside their source by a range sort, so a source
   that holds a third of all rows is numbered by many tasks.
2. Levels are built bottom-up, sixteen nodes to a run, and stored as parent-linked node rows:
   a node's id, the digests of its children as one text, its parent's id and its place there.
   The roots of the sources are the leaves of one more tree.
3. A recursive query ascends from every leaf at once. Each step joins the run that holds the
   node, folds the leaf's (tampered) digest with the run's other digests and appends the run
   and the place to the path, until a node has no parent.
4. Proofs put the siblings' digests of the path together. Rows of one run share their path
   above it, so that part is read once per run.

Paths hold references, not digests: fifteen digests a step, carried through all later steps,
would write several times the table. A node near the root is met by all rows in one step; it
is stored in copies, one per ``COPY_LEAVES`` leaves below it, and rows are dealt over them.

Defined results: null values hash as ``-``; a null id sorts first and is never tampered with;
rows with one id sort by their digest and each has a leaf; a null source is a source of its
own and comes first, the empty source is another; a dataset of one row has it as its root and
an empty proof; no rows, no rows; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

FAN_OUT, COPY_LEAVES, HEX = 16, 4096, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """Digest of typed fields: ``-`` for null, else byte count, colon and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``pos`` of every row inside its group, from 0, without a task per group.

    Rows are range-sorted; a row's number is its place in its partition plus the rows of its
    group in earlier partitions.
    """
    marked = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("at"), 33)
    held = marked.groupBy(*[F.col(g).alias(f"h_{g}") for g in group], part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(
        W.partitionBy(*[f"h_{g}" for g in group]).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    on = part == F.col("part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"h_{g}"))
    return marked.join(before, on).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before", *[f"h_{g}" for g in group])


@contextmanager
def _unlimited_rows(spark: SparkSession):
    """Recursive queries stop at a million rows unless told otherwise; the setting is read when they run."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _copies(leaves: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(leaves) / COPY_LEAVES)).cast("long")


def _level(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linked nodes, finished trees' top nodes and the next level's nodes.

    Nodes have ``tree, pos, n`` (nodes of the tree on this level)``, node, hash, leaves, children``
    and ``own``, a leaf's payload.
    """
    run = F.floor(F.col("pos") / FAN_OUT).cast("long")
    placed = nodes.withColumn("run", run).withColumn("parent_leaves", F.sum("leaves").over(W.partitionBy("tree", "run")))
    # A level holds a sixteenth of the rows below it, so it needs a sixteenth of the files.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = checkpointed(placed.coalesce(max(1, parts // FAN_OUT ** level)))
    parent = F.concat_ws("/", F.col("tree").cast("string"), F.lit(str(level + 1)), F.col("run").cast("string"))
    open_ = here.where("n > 1")
    linked = open_.select("node", "hash", "leaves", "children", "own", parent.alias("parent"), F.pmod("pos", F.lit(FAN_OUT)).cast("int").alias("place"),
                          _copies("parent_leaves").alias("parent_copies"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    above = open_.groupBy("tree", "run").agg(F.array_join(ordered, "").alias("children"), F.sum("leaves").alias("leaves"), F.max("n").alias("n")).select(
        "tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"),
        F.concat_ws("/", F.col("tree").cast("string"), F.lit(str(level + 1)), F.col("run").cast("string")).alias("node"),
        F.sha2("children", 256).alias("hash"), "leaves", "children", F.lit(None).cast(nodes.schema["own"].dataType).alias("own"))
    return linked, here.where("n = 1"), above


def _grown(nodes: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """All linked nodes and the top nodes of trees whose largest has ``largest`` leaves."""
    linked, tops, level = None, None, 0
    while True:
        links, done, above = _level(nodes, level)
        linked = links if linked is None else linked.unionByName(links)
        tops = done if tops is None else tops.unionByName(done)
        if largest <= 1:
            return linked, tops
        nodes, level, largest = above, level + 1, -(-largest // FAN_OUT)


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame, str] | None:
    """Leaves, runs and the root; None without rows.

    Leaves: ``row``, ``doc_id``, ``folded`` (the tampered digest), ``leaf`` and the link ``parent``,
    ``place``, ``parent_copies``. Runs, in copies: ``node``, ``copy``, ``children``, ``upper`` and
    the same link. The root's link is null.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = checkpointed(docs.select("doc_id", "source", digest(*fields).alias("leaf"), F.when(tampered, digest(*fields[:-1], lowered)).alias("changed")))
    rows = checkpointed(_numbered(hashed.withColumn("row", F.monotonically_increasing_id()), ["source"], [
        F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    trees = checkpointed(_numbered(sizes, [], [F.col("source").asc_nulls_first()]).select(
        F.col("source").alias("t_source"), F.col("pos").alias("tree"), "n"))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return None
    leaves = rows.join(trees, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "tree", "pos", "n", F.concat(F.lit("leaf "), F.col("row").cast("string")).alias("node"), F.col("leaf").alias("hash"),
        F.lit(1).cast("long").alias("leaves"), F.lit(None).cast("string").alias("children"),
        F.struct("row", "doc_id", "leaf", F.unhex(F.coalesce("changed", "leaf")).alias("folded")).alias("own"))
    lower, subroots = _grown(leaves, largest)
    subroots = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"),
                               "node", "hash", "leaves", "children", "own")
    upper, top = _grown(subroots, count)
    top = top.select("node", "hash", "leaves", "children", "own", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("place"),
                     F.lit(1).cast("long").alias("parent_copies"))
    nodes = lower.unionByName(upper).unionByName(top)
    start = nodes.where("own is not null").select("own.*", "node", "parent", "place", "parent_copies")
    runs = nodes.where("children is not null").select(
        "node", "children", "parent", "place", "parent_copies", F.col("node").startswith("-1/").alias("upper"),
        F.explode(F.sequence(F.lit(0).cast("long"), _copies("leaves") - 1)).alias("copy"))
    return start, checkpointed(runs.coalesce(parts)), top.first()["hash"]


# One step up: the run that holds the node, its other digests around the folded one.
CLIMB = f"""
with recursive climb as (
  select row, parent, place, parent_copies, folded, cast(null as string) as subroot,
         cast(array() as array<struct<run: string, place: int, copies: bigint>>) as path
  from {{leaves}}
  union all
  select c.row, r.parent, r.place, r.parent_copies,
         unhex(sha2(concat(substring(r.children, 1, {HEX} * c.place), lower(hex(c.folded)), substring(r.children, {HEX} * (c.place + 1) + 1)), 256)),
         coalesce(c.subroot, case when r.upper then substring(r.children, {HEX} * c.place + 1, {HEX}) end),
         array_append(c.path, named_struct('run', c.parent, 'place', c.place, 'copies', c.parent_copies))
  from climb c join {{runs}} r on c.parent = r.node and pmod(xxhash64(c.row), c.parent_copies) = r.copy)
select row, folded, subroot, path from climb where parent is null"""


def _siblings(children: Column, place: Column) -> Column:
    """The run's digests without the one at ``place``."""
    return F.concat(F.substring(children, F.lit(1), place * HEX), F.substring(children, (place + 1) * HEX + 1, F.length(children)))


def proofs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (the siblings' digests, leaf to root),
    ``folded_root`` and ``verified`` of every row."""
    spark = docs.sparkSession
    built = build(docs)
    if built is None:
        return docs.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof", "folded_root")], F.lit(True).alias("verified"))
    leaves, runs, root = built
    with _unlimited_rows(spark):
        climbed = checkpointed(spark.sql(CLIMB, leaves=leaves, runs=runs))
    rows = leaves.select("row", "doc_id", "leaf").join(climbed.select(
        F.col("row").alias("c_row"), "folded", "subroot", F.get("path", F.lit(0)).alias("first")),
        F.col("row") == F.col("c_row"))
    heads = climbed.where("size(path) > 0").groupBy(F.col("path")[0]["run"].alias("head")).agg(F.first(F.slice("path", F.lit(2), F.size("path"))).alias("rest"))
    steps = heads.select("head", F.posexplode("rest").alias("i", "step"))
    met = steps.join(runs.select("node", "copy", "children"), (F.col("step.run") == F.col("node")) & (F.pmod(F.xxhash64("head"), F.col("step.copies")) == F.col("copy")))
    above = met.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("i", _siblings(F.col("children"), F.col("step.place")).alias("s")))).alias("found")).select(
        F.col("head").alias("a_head"), F.array_join(F.transform("found", lambda x: x["s"]), "").alias("above"))
    # The long texts meet the rows in the last join only, a run's once for its leaves.
    texts = runs.where("copy = 0").select("node", "children").join(above, F.col("node") == F.col("a_head"), "left")
    out = rows.join(texts, F.col("first.run") == F.col("node"), "left")
    folded = F.lower(F.hex("folded"))
    proof = F.concat(_siblings(F.col("children"), F.col("first.place")), F.coalesce("above", F.lit("")))
    return out.select("doc_id", "leaf", F.coalesce("subroot", F.lit(root)).alias("subroot"), F.lit(root).alias("root"), F.coalesce(proof, F.lit("")).alias("proof"),
                      folded.alias("folded_root"), (folded == root).alias("verified"))
