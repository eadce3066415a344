"""Merkle manifest of a dataset: per level, lag and lead columns give siblings and hash the parents.

Rows of a group (a source) are leaves in the order of their identifier; while a group has several
nodes, every ``ARITY`` consecutive ones become one. The groups' roots are the leaves of a last tree.
Windows run over aligned blocks of a few runs, never over a whole group, so a group with most of all
rows is many small windows; positions come from range-partitioned sorts and partition offsets. Upper
levels shrink by the arity and are written tables; the leaves' siblings are made twice instead of kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.llm import common

#: Children of a node.
ARITY = 16
#: Runs of siblings in a window.
BLOCK_RUNS = 16
#: Rows of a task that sorts leaves, about.
TASK_ROWS = 500_000

_STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 over all values: ``-`` for a null, else the UTF-8 length, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``pos`` (from 0) in the group ``grp`` and ``n``, the rows of the group.

    ``order`` must be a total order. Ranges of all groups together are sorted; a row's position is its
    place in the range plus the rows of its group in earlier ranges.
    """
    spark = rows.sparkSession
    tasks = common.tasks(spark, rows.count(), TASK_ROWS)
    keys = [F.col("grp").asc(), *order]
    ranged = common.write_table(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn(
        "at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("grp", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("grp")  # at most as many rows a group as there are ranges
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that the join below is dealt by both keys and not by the group alone.
    shifts = common.write_table(sizes.select("grp", "range", "first", F.sum("rows").over(whole).alias("n"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")))
    return ranged.join(shifts, ["grp", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop(
        "range", "at", "first", "before")


def _siblings(nodes: DataFrame) -> DataFrame:
    """Add ``left`` and ``right``: the digests of the run before and after each node, joined."""
    slot = F.col("pos") % ARITY
    length = F.least(F.lit(ARITY), F.col("n") - (F.col("pos") - slot))
    blocks = nodes.withColumn("block", F.expr(f"pos div {ARITY * BLOCK_RUNS}"))
    w = Window.partitionBy("grp", "block").orderBy("pos")
    lags = {f"_b{i}": F.when(slot >= i, F.lag("digest", i).over(w)) for i in range(ARITY - 1, 0, -1)}
    leads = {f"_a{i}": F.when(slot + i < length, F.lead("digest", i).over(w)) for i in range(1, ARITY)}
    return blocks.select("*", *[c.alias(k) for k, c in {**lags, **leads}.items()]).select(
        *nodes.columns, "block", F.concat_ws("", *lags).alias("left"), F.concat_ws("", *leads).alias("right"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The tables (grp, pos, n, digest) of all levels. A group ends at the level where it has one node."""
    out = [leaves]
    widest = leaves.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        first = _siblings(out[-1].where("n > 1").select("grp", "pos", "n", "digest")).where(F.col("pos") % ARITY == 0)
        out.append(common.write_table(first.select(
            "grp", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"))))
        widest = -(-widest // ARITY)
    return out


def tops(tables: list[DataFrame]) -> DataFrame:
    """(grp, digest): what remains of each group."""
    out = None
    for t in tables:
        own = t.where("n = 1").select("grp", "digest")
        out = own if out is None else out.unionByName(own)
    return out


def with_paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves with ``steps``, the siblings to the left and right on each level up to the root.

    ``above`` has grp, the steps that follow a group's own, and further columns, which are carried down.
    """
    carried = [c for c in above.columns if c not in ("grp", "steps")]
    over: DataFrame | None = None
    for k in range(len(tables) - 1, -1, -1):
        own = tables[k]
        paths = own.where("n = 1").join(above, "grp").select(*own.columns, *carried, "steps")
        if over is not None:
            runs = _siblings(own.where("n > 1")).withColumn("up", F.expr(f"pos div {ARITY}"))
            parents = over.select("grp", F.col("pos").alias("up"), F.expr(f"pos div {BLOCK_RUNS}").alias("block"),
                                  F.col("steps").alias("_later"), *carried)
            paths = paths.unionByName(runs.join(parents, ["grp", "block", "up"]).select(
                *own.columns, *carried, F.concat(F.array(F.struct("left", "right")), "_later").alias("steps")))
        over = common.write_table(paths) if k else paths
    return over


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(steps: Column) -> Column:
    """SHA-256 over all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"]))), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, steps, proof_sha256, folded_root, verified of every row.

    Leaves are doc_id, source, lang, n_chars and text; a null in any of them, also in source, is a value of
    its own (the null source comes first, a null doc_id before all others of its source). Rows with equal
    doc_id are ordered by their leaf; equal rows are leaves of their own. Where ``tampered`` holds, the
    folded root starts from the leaf with ``tampered_text``. An empty table gives an empty result; other
    columns are ignored.
    """
    def leaf(text: Column) -> Column:
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    # "" is the null source, so that plain joins and the plain order serve.
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(tampered_text))
    rows = common.write_table(docs.select(
        grp.alias("grp"), "doc_id", F.monotonically_increasing_id().alias("row"), leaf(F.col("text")).alias("digest"),
        changed.alias("changed")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    documents = levels(common.write_table(placed(rows, order).drop("row")))
    subroots = common.write_table(tops(documents).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"))
    sources = levels(common.write_table(placed(subroots, [F.col("name").asc()])))
    root = tops(sources).select("grp", F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"))
    above = common.write_table(with_paths(sources, root).select(
        F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "steps"))
    out = with_paths(documents, above).withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("steps")))
    return out.select(
        "doc_id", F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("source"), F.col("digest").alias("leaf"),
        "subroot", "root", "steps", proof(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
