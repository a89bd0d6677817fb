"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, id), so equal texts stand together.  A size-weighted sample of these keys gives
quantile boundaries; they cut the records into ranges of similar bytes, several for each shard, and ranges that came out overfull
are sampled again and subdivided (a text with very many copies is subdivided by id).  Range totals are exact, so each
record knows how many bytes stand before it anywhere: the shard is where the middle of the record falls when all
bytes are divided evenly.  The result doesn't depend on the sample: the sample only makes the work even.

A shard's bytes differ from an even share by at most the size of the records at its two ends.  Slots count a shard's records from 0 in
key order.  Null texts have the empty text's hash and the least size; null ids come first.  Repeated rows get slots of their own.
"""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dexlake.llm.common import byte_size, cut

RANGES_PER_SHARD, ROWS_PER_RANGE, MOST_RANGES, SAMPLES_PER_RANGE = 8, 200_000, 4096, 16
RECORD_BYTES = 8


def sort_key(text: Column, key: Column) -> Column:
    """A string that orders records by the text's hash, then by an integer id (null first)."""
    digest = F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)
    ordinal = F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(digest, F.coalesce(ordinal, F.lit("")))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many boundaries are at or below ``key``; two levels, so that few are compared."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    tops = bounds[::step]
    rows = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    top = F.size(F.filter(F.array(*map(F.lit, tops)), lambda b: b <= key))
    row = F.element_at(rows, F.greatest(top, F.lit(1)))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + F.size(F.filter(row, lambda b: b <= key)))


def _draw(records: DataFrame, rate: Column, least: Column, seed: str) -> DataFrame:
    """Records whose hashed key falls below their size times ``rate``: (key, weight)."""
    u = F.xxhash64(F.lit(seed), "key").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return records.where(u < F.col("size") * rate).select("key", F.greatest(F.col("size").cast("double"), least).alias("weight"))


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    sample = sorted(sample)
    total = sum(w for _, w in sample)
    found, run, at = [], 0.0, 1
    for key, weight in sample:
        if run >= total * at / parts:
            found.append(key)
            at = math.floor(run * parts / total) + 1
        run += weight
    return found


def splitters(records: DataFrame, total: int, ranges: int) -> list[str]:
    """Boundaries for about ``ranges`` ranges of similar bytes; ``records`` has key and size."""
    wanted = ranges * SAMPLES_PER_RANGE
    drawn = _draw(records, F.lit(wanted / total), F.lit(total / wanted), "splitters").collect()
    bounds = sorted(set(_quantiles([(r[0], r[1]) for r in drawn], ranges)))
    target = total / ranges
    for attempt in itertools.count():
        sizes = {r[0]: (r[1], r[2]) for r in records.groupBy(_range_of(F.col("key"), bounds).alias("r")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
        over = {k: n for k, (n, rows) in sizes.items() if n > 2 * target and rows > 1}
        if not over or len(bounds) + len(over) > MOST_RANGES:
            break
        rate = F.create_map(*[F.lit(x) for k, n in over.items() for x in (k, SAMPLES_PER_RANGE * math.ceil(n / target) / n)])
        ranged = records.withColumn("r", _range_of(F.col("key"), bounds)).where(F.col("r").isin(list(over)))
        again = _draw(ranged, rate[F.col("r")], F.lit(1.0) / rate[F.col("r")], f"subdivide {attempt}").collect()
        added: set[str] = set()
        for k, n in over.items():
            mine = [(r[0], r[1]) for r in again if bisect.bisect_right(bounds, r[0]) == k]
            if mine:
                added.update(_quantiles(mine, math.ceil(n / target)))
        if added <= set(bounds):  # nothing left to divide by: the rows of such a range have one key
            break
        bounds = sorted({*bounds, *added})
    return bounds


def shard_by_bytes(df: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): all rows in ``shards`` shards of near equal bytes."""
    text = F.col(text_col)
    records = cut(
        df.select(
            F.col(id_col).alias("id"),
            (byte_size(text) + RECORD_BYTES).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            sort_key(text, F.col(id_col)).alias("key"),
        ),
        "records",
    )
    rows, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES // 2, max(RANGES_PER_SHARD * shards, math.ceil(rows / ROWS_PER_RANGE)))
    bounds = splitters(records, total, ranges) if rows else []
    ranged = records.withColumn("r", _range_of(F.col("key"), bounds))
    # a row for each range, some thousand at most: what stands before it
    sums = ranged.groupBy("r").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("r").orderBy("key")
    placed = (
        ranged.withColumn("n", F.row_number().over(inside))
        .withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(sums), "r")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("run")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(middle * {shards}L) div {2 * max(1, total)}L"), F.lit(shards - 1)).cast("int"))
        .select("id", "size", "text_crc32", "r", "n", "shard")
    )
    placed = cut(placed, "placed")
    parts = placed.groupBy("r", "shard").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    parts = parts.select("r", "shard", (F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))
    done = placed.join(F.broadcast(parts), ["r", "shard"])
    return done.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
