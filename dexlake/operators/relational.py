"""Relational building blocks that the artifact operators share.

Order is data here: every function takes the columns that order its input, none relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_matches(hits: DataFrame, by: Sequence[str], first: str, match: Column, separator: str = "; ") -> DataFrame:
    """Hits of one caller as one row: its least ``first`` and its distinct matches (structs sort by their leading fields, the text is ``label``)."""
    texts = F.transform(F.array_sort(F.collect_set(match)), lambda m: m["label"])
    return hits.groupBy(*by).agg(F.min(first).alias(first), texts.alias("matched")).withColumn("matched_text", F.array_join("matched", separator))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key, by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def limit_with_total(df: DataFrame, limit: int, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows (of each ``by``), each with the total and whether rows were left out.

    Without ``by`` the rows come from a top-k and the total from a count, so no task gets all rows.
    """
    if by:
        w = Window.partitionBy(*by)
        kept = df.withColumn("ordinal", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w)).where(F.col("ordinal") <= limit)
    else:
        top = df.orderBy(*order).limit(limit)
        kept = top.withColumn("ordinal", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    return kept.withColumn("truncated", F.col("total") > limit)


def budget_prefix(df: DataFrame, charge: str, budget: int, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows before the first one at which the running charge is over the budget; nothing behind that comes back."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(charge).over(w)).withColumn("_over", F.max((F.col("spent") > budget).cast("int")).over(w)).where("_over = 0").drop("_over")


def skipping_budget(df: DataFrame, charge: str, budget: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Which rows of each ``by`` fit a budget if a row that doesn't fit is skipped and later ones may fit: adds ``admitted``.

    Whether a row fits depends on all before it, so the rows of a key go through one task, in order; they are streamed and never gathered.
    A null charge is 0.
    """
    import pyarrow as pa

    columns = [*by, *order, charge]
    sorted_ = df.select(*columns).repartition(*by).sortWithinPartitions(*by, *order)
    keys = len(by)

    def run(batches):
        current, spent = None, 0
        for batch in batches:
            admitted = []
            for *key, cost in zip(*(batch.column(i).to_pylist() for i in [*range(keys), len(columns) - 1]), strict=True):
                if key != current:
                    current, spent = key, 0
                fits = spent + (cost or 0) <= budget
                spent += (cost or 0) if fits else 0
                admitted.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_())], names=[*columns, "admitted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema)
    return sorted_.mapInArrow(run, f"{schema}, admitted boolean")


def entropy(df: DataFrame, key: Sequence[str], symbols: Column) -> DataFrame:
    """Shannon entropy of an array of symbols for each key, in bits, rounded to three places; null where there are none."""
    counts = df.select(*key, F.explode(symbols).alias("_s")).groupBy(*key, "_s").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*key))
    p = F.col("_n") / F.col("_t")
    return counts.withColumn("_t", total).groupBy(*key).agg(F.round(-F.sum(p * F.log2(p)), 3).alias("entropy"))


def pooled(df: DataFrame, by: Sequence[str], value: str, order: str, separator: str = ",") -> DataFrame:
    """Distinct values of each ``by`` in the order in which they first came."""
    firsts = df.groupBy(*by, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("pool")).withColumn("pool_text", F.array_join("pool", separator))


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], header: Column, name: str) -> DataFrame:
    """The last header at or before each row; ``header`` is null where the row has none (a struct can carry a null on)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def expand_runs(df: DataFrame, count: str, name: str = "step") -> DataFrame:
    """One row for each of ``count`` repeats; rows with a count below one vanish."""
    return df.where(F.col(count) >= 1).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, tie: str) -> DataFrame:
    """For every left row the value of the latest right row of its key at or before its time; of equal times the greatest ``tie``.

    Both sides are laid in one order and the last right row is carried on: a sort for each key and no pairs.
    """
    sides = left.columns
    mine = left.select(*sides, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    other = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in sides], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(tie).alias("_tie"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = mine.unionByName(other).withColumn("_m", F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w))
    return met.where("_side = 1").select(*sides, F.col("_m._v").alias(value))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, count: str, by: Sequence[str] = (), width: int = 64) -> DataFrame:
    """Points joined with the ranges [start, start + count) that hold them, by equal cells of ``width``."""
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    r = ranges.where(F.col(count) > 0).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(count) - 1) / width))))
    return p.join(r, [*by, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(count))).drop("_cell")


def coverage(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str] = ("covered", "missing", "uncovered")) -> DataFrame:
    """Full outer comparison of two sets of keys: in both, only on the left, only on the right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), names[0]).when(F.col("_r").isNull(), names[1]).otherwise(names[2]).alias("status"))


def hierarchy(seeds: DataFrame, edges: DataFrame, first_edges: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth, via): everything below ``seeds`` (node), each once at its least depth, with its least parent there.

    ``edges`` are (child, parent); the first step goes over ``first_edges`` where given.  Breadth first, one join a level; nodes that were met are
    anti-joined away, so cycles end.
    """
    from dexlake.plans.lineage import folder

    spark, path = seeds.sparkSession, folder(seeds.sparkSession)
    kind = seeds.schema["node"].dataType.simpleString()
    schema = f"node {kind}, via {kind}, depth int"
    seeds.select("node", F.lit(None).cast(kind).alias("via")).distinct().write.parquet(f"{path}/depth=0")
    depth = 0
    while max_depth is None or depth < max_depth:
        # each level is written once, beside the earlier ones; all that was met is the folder
        met = spark.read.schema(schema).parquet(path)
        frontier = met.where(F.col("depth") == depth).select(F.col("node").alias("_at"))
        depth += 1
        used = first_edges if depth == 1 and first_edges is not None else edges
        step = used.join(frontier, used["parent"] == F.col("_at")).groupBy("child").agg(F.min("parent").alias("via"))
        step.join(met.select("node"), step["child"] == met["node"], "left_anti").select(F.col("child").alias("node"), "via").write.parquet(f"{path}/depth={depth}")
        if spark.read.schema(f"node {kind}, via {kind}").parquet(f"{path}/depth={depth}").isEmpty():
            break
    return spark.read.schema(schema).parquet(path).where("depth > 0").select("node", "depth", "via")


def call_tree(roots: DataFrame, edges: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """(depth, path, caller, callee, sites) of calls below ``roots`` (node); edges are (caller, callee, ord, sites).

    Nodes aren't merged: a callee is expanded wherever it is called, also in a cycle, down to ``max_depth``.  ``path`` holds the ordinals from the
    root on; depth and path are the order of a breadth-first walk, which ``max_nodes`` cuts.
    """
    from dexlake.plans.lineage import cut

    level = roots.select(F.array().cast("array<long>").alias("path"), F.col("node").alias("at"))
    found = None
    left = max_nodes
    for depth in range(1, max_depth + 1):
        step = level.join(edges, level["at"] == edges["caller"]).select(F.lit(depth).alias("depth"), F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"), "caller", "callee", "sites")
        if left is not None:
            step = step.orderBy("path").limit(left)
        step = cut(step)
        n = step.count()
        if n == 0:
            break
        found = step if found is None else found.unionByName(step)
        if left is not None:
            left -= n
            if left <= 0:
                break
        level = step.select("path", F.col("callee").alias("at"))
    if found is None:
        kind = roots.schema["node"].dataType.simpleString()
        return roots.sparkSession.createDataFrame([], f"depth int, path array<long>, caller {kind}, callee {kind}, sites long")
    return found


def prefix_tree(df: DataFrame, segments: Column, separator: str = "/") -> DataFrame:
    """Nodes of the tree that paths make: (path, depth, entries), with the number of paths at or below each."""
    parts = df.select(segments.alias("_p")).where(F.size("_p") > 0)
    nodes = parts.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    return nodes.groupBy(F.array_join(F.slice("_p", 1, F.col("depth")), separator).alias("path"), "depth").agg(F.count(F.lit(1)).alias("entries"))
