"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The records of a source, in an order shuffled by hash, are cut into blocks of ``block_bytes``.  With share a of a total W, block j
(from 0) of a source is released at slot floor(j W / a) and due at slot ceil((j + 1) W / a).  At every slot the released block with the
earliest deadline goes (ties: the source listed first).  After any number of slots each source has had its weight's
part of them to less than one block.

The schedule repeats after W slots, so one period is simulated (a fold over W steps, in SQL) and every block's slot follows by
arithmetic.  When a source has no more blocks, a new phase begins in which the others share by their weights; there are as
many phases as sources at most.  Shares are integers, their sum (after dividing by the common divisor) is at most ``LONGEST_PERIOD``.

Records whose source is null or not listed belong to the source ``OTHER``, with share ``other_share``.  Every record is scheduled, repeated ones
as often as they come; null texts have size 1 like empty ones.  The place of a record in its source is found by totals of ``BUCKETS`` hash
buckets and a running sum inside a bucket, so no source is gathered in one task.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dexlake.llm.common import byte_size

OTHER = "(other)"
BLOCK_BYTES, BUCKETS, LONGEST_PERIOD = 65_536, 4096, 4096


def period(spark: SparkSession, shares: list[int]) -> list[int]:
    """Which of the sources goes at each slot of one period."""
    w, k = sum(shares), len(shares)
    share = F.array(*[F.lit(a).cast("long") for a in shares])

    def step(state: Column, slot: Column) -> Column:
        # a source that has had n blocks: its next is released at floor(n w / a), due at ceil((n + 1) w / a)
        due = F.zip_with(state["had"], share, lambda n, a: F.when(F.floor(n * w / a) <= slot, F.floor(((n + 1) * w + a - 1) / a)))
        open_ = F.filter(F.transform(due, lambda d, i: F.struct(d.alias("due"), i.alias("source"))), lambda x: x["due"].isNotNull())
        source = F.array_min(open_)["source"]
        return F.struct(
            F.transform(state["had"], lambda n, i: n + F.when(i == source, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("had"),
            F.concat(state["order"], F.array(source)).alias("order"),
        )

    start = F.struct(F.array(*[F.lit(0).cast("long")] * k).alias("had"), F.array().cast("array<int>").alias("order"))
    folded = spark.range(1).select(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long")), start, step)["order"].alias("order"))
    return list(folded.first()[0])


def phases(spark: SparkSession, blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """The schedule as (phase, source) entries: blocks first to last take slots at ``places`` of periods of ``w`` slots from ``start``."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, found, number = 0, [], 0
    while left:
        active = [s for s in shares if s in left]
        common = math.gcd(*(shares[s] for s in active))
        share = [shares[s] // common for s in active]
        w = sum(share)
        if w > LONGEST_PERIOD:
            raise ValueError(f"the shares add up to {w}, more than {LONGEST_PERIOD}")
        order = period(spark, share) if len(active) > 1 else [0]
        places = {s: [t for t, k in enumerate(order) if k == i] for i, s in enumerate(active)}
        last = {s: (n - 1) // len(places[s]) * w + places[s][(n - 1) % len(places[s])] for s, n in left.items()}
        length = min(last.values()) + 1
        rounds, rest = divmod(length, w)
        for s in active:
            n = rounds * len(places[s]) + sum(t < rest for t in places[s])
            if n:
                found.append({"phase": number, "source": s, "first": done[s], "last": done[s] + n - 1, "start": start, "w": w, "share": len(places[s]), "places": places[s]})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start, number = start + length, number + 1
    return found


def schedule(df: DataFrame, shares: dict[str, int], *, other_share: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with columns _mix_source, _mix_size, _mix_order, _mix_block, _mix_phase, _mix_release, _mix_deadline and _mix_slot."""
    if any(int(a) != a or a < 1 for a in [*shares.values(), other_share]):
        raise ValueError("shares are positive integers")
    spark = df.sparkSession
    shares = {**shares, OTHER: other_share}
    key = F.col(id_col).cast("string")
    order = F.md5(F.coalesce(key, F.lit("")).cast("binary"))
    listed = [s for s in shares if s != OTHER]
    records = (
        df.withColumn("_mix_source", F.when(F.col(source_col).isin(listed), F.col(source_col)).otherwise(F.lit(OTHER)))
        .withColumn("_mix_size", F.greatest(byte_size(F.col(text_col)), F.lit(1).cast("long")))
        .withColumn("_mix_order", order)
        .withColumn("_mix_bucket", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    )
    at = ["_mix_source", "_mix_bucket"]
    sums = records.groupBy(*at).agg(F.sum("_mix_size").alias("_mix_bytes"))
    totals = {r[0]: r[1] for r in sums.groupBy("_mix_source").agg(F.sum("_mix_bytes")).collect()}
    plan = phases(spark, {s: -(-n // block_bytes) for s, n in totals.items()}, shares)
    kind = "array<struct<phase:int,source:string,first:bigint,last:bigint,start:bigint,w:bigint,share:bigint,places:array<int>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), kind))).withColumnsRenamed({c: f"_p_{c}" for c in ("phase", "source", "first", "last", "start", "w", "share", "places")})
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*at, F.coalesce(F.sum("_mix_bytes").over(earlier), F.lit(0)).alias("_mix_before"))
    inside = Window.partitionBy(*at).orderBy("_mix_order", F.col(id_col).asc_nulls_first(), "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    placed = records.join(sums, at).withColumn("_mix_block", F.floor(run / block_bytes))
    # at most a row for each pair of listed sources
    j, w, a = F.col("_mix_block") - F.col("_p_first"), F.col("_p_w"), F.col("_p_share")
    dated = placed.join(F.broadcast(table), (F.col("_mix_source") == F.col("_p_source")) & F.col("_mix_block").between(F.col("_p_first"), F.col("_p_last")))
    turn = F.floor(j / a)
    return (
        dated.withColumn("_mix_phase", F.col("_p_phase"))
        .withColumn("_mix_release", F.col("_p_start") + F.floor(j * w / a))
        .withColumn("_mix_deadline", F.col("_p_start") + F.floor(((j + 1) * w + a - 1) / a))
        .withColumn("_mix_slot", F.col("_p_start") + turn * w + F.element_at("_p_places", (j - turn * a + 1).cast("int")))
        .drop("_mix_bucket", "_mix_before", *[c for c in table.columns])
    )


def mixed(df: DataFrame, shares: dict[str, int], *, partitions: int | None = None, **kw) -> DataFrame:
    """The rows and columns of ``df``, laid out in the order of the schedule: partition by partition, and inside each."""
    dated = schedule(df, shares, **kw)
    if partitions is None:
        partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = max(1, dated.agg(F.max("_mix_slot")).first()[0] or 0) + 1
    part = F.expr(f"cast((_mix_slot * {partitions}L) div {slots}L as int)")
    return dated.repartitionById(partitions, part).sortWithinPartitions("_mix_slot", "_mix_order").select(*df.columns)
