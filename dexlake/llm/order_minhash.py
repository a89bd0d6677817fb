"""Order MinHash fingerprints: sketches that follow edit distance rather than the bag of words.

Every k-mer of a text (k code points) is numbered by its occurrence.  Each of ``lanes`` hash functions selects the
``2`` numbered k-mers with the least values; the two are put in the order in which they stand in the text, and the pair is
hashed.  Two texts agree in a lane if they share those k-mers *and* have them in the same order.  The likeness of two
fingerprints is the share of lanes that agree.

Defined results: null is the empty text; texts shorter than k are one k-mer; the empty text has no k-mer and the fingerprint
of all ones.  Equal texts have equal fingerprints.  Whole texts are processed, in blocks of columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import bounded_batches

U = np.uint64
K, LANES = 8, 48
BLOCK = 2_048  # columns; with all lanes they fit a core's cache
_MULTIPLIER = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer; ``x`` is overwritten."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class OrderMinHash:
    """Fingerprints of texts; ``lanes`` 16-bit values each."""

    def __init__(self, k: int = K, lanes: int = LANES, seed: int = 1):
        self.k, self.lanes = k, lanes
        draw = np.random.Generator(np.random.PCG64(seed))
        self.odd = (draw.integers(0, 1 << 31, lanes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.lane = _mix(np.arange(1, lanes + 1, dtype=U))
        self.room = np.empty(lanes * BLOCK, np.uint32)
        self.empty = np.full(lanes, 0xFFFF, np.uint16)

    def _kmers(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U) + U(1)
        k = min(self.k, len(codes))
        h, width, power = codes, 1, _MULTIPLIER
        parts = {1: codes}
        powers = {1: power}
        while 2 * width <= k:
            h = h[:-width] * power + h[width:]
            width, power = 2 * width, power * power
            parts[width], powers[width] = h, power
        n, at, left = len(codes) - k + 1, width, k - width
        h = h[:n].copy() if width == 1 else h[:n]
        for w in sorted(parts, reverse=True):
            if left >= w:
                h = h * powers[w] + parts[w][at : at + n]
                at, left = at + w, left - w
        return _mix(h)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return self.empty
        with np.errstate(over="ignore"):
            h = self._kmers(text)
            n = len(h)
            # occurrence numbers: equal k-mers stand together after sorting, in text order
            place = same = None
            if n < 1 << 24:  # hash and place fit one word, which sorts faster
                packed = np.sort((h & U(0xFFFFFFFFFF000000)) | np.arange(n, dtype=U))
                place = (packed & U(0xFFFFFF)).astype(np.int64)
                same = h[place]
                if ((same[1:] != same[:-1]) & (packed[1:] >> U(24) == packed[:-1] >> U(24))).any():
                    place = None  # two k-mers agree in the 40 bits that were sorted: the whole hashes decide
            if place is None:
                place = np.argsort(h, kind="stable")
                same = h[place]
            rank = np.arange(n)
            first = np.empty(n, bool)
            first[0] = True
            np.not_equal(same[1:], same[:-1], out=first[1:])
            occurrence = rank - np.maximum.accumulate(np.where(first, rank, 0))
            h = h[place]
            numbered = occurrence.astype(U)
            numbered *= U(0xD6E8FEB86659FD93)
            numbered += h
            numbered *= _MULTIPLIER
            value = (numbered >> U(32)).astype(np.uint32)
            best, where = [], []
            rows = np.arange(self.lanes)
            for at in range(0, n, BLOCK):
                part = value[None, at : at + BLOCK]
                got = np.multiply(part, self.odd, out=self.room[: self.lanes * part.shape[1]].reshape(self.lanes, -1))
                for _ in range(min(2, got.shape[1])):
                    i = got.argmin(axis=1)
                    best.append(got[rows, i])
                    where.append(i + at)
                    got[rows, i] = 0xFFFFFFFF
            if len(best) == 1:
                pair = h[where[0]] * U(3)
            else:
                order = np.argsort(np.stack(best), axis=0, kind="stable")[:2]
                where = np.take_along_axis(np.stack(where), order, axis=0)
                a, b = where
                swap = place[a] > place[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                pair = _mix(h[a]) + h[b] * U(0x2545F4914F6CDD1D)  # h[a] is a copy
            return (_mix(pair ^ self.lane) >> U(48)).astype(np.uint16)

    @staticmethod
    def spell(fingerprint: np.ndarray) -> str:
        return fingerprint.astype(">u2").tobytes().hex()

    @staticmethod
    def likeness(a: np.ndarray, b: np.ndarray) -> float:
        return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS_PER_RANGE, MOST_RANGES = 4096, 32_768


def order_fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, lanes: int = LANES, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The next document is the one that follows by ascending id (null ids first, equal ids by text); after the
    last comes the first.  Ids are cut into ranges at quantiles that are ids themselves (``rows_per_range`` rows each, at most
    32,768 ranges, so the cut points have a bounded size); each range becomes one partition, and the row that opens a
    range is also sent, marked, to the end of the range before it.  Texts are so shuffled once and streamed in order.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, known = rows.agg(F.count(F.lit(1)), F.count("id")).first()
    ranges = max(1, min(MOST_RANGES, math.ceil(total / rows_per_range)))
    starts: list[int] = []
    if known:
        at = rows.select(F.percentile_approx("id", [i / ranges for i in range(ranges)], 4 * max(ranges, 2500)), F.min("id")).first()
        starts = sorted({*at[0][1:], at[1]})
    ranges, nulls = max(1, len(starts)), known < total
    cuts = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        filled = ids.fillna(np.iinfo(np.int64).min).astype("int64") if ids.isna().any() else ids.astype("int64")
        return pd.Series(np.maximum(np.searchsorted(cuts, filled.to_numpy(), side="right") - 1, 0).astype("int32"))

    @F.pandas_udf("boolean")
    def opens(ids: pd.Series) -> pd.Series:
        return pd.Series(ids.isna().to_numpy() | np.isin(ids.fillna(0).astype("int64").to_numpy(), cuts[1:] if nulls else cuts) & ids.notna().to_numpy())

    before = F.when(F.col("range") == 0, F.lit(ranges - 1)).otherwise(F.col("range") - 1)
    dealt = (
        rows.withColumn("range", range_of("id"))
        .withColumn("opens", opens("id"))
        .withColumn("to", F.explode(F.when(F.col("opens"), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")), F.struct(before.alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))))))
        .select(F.col("to.range").alias("range"), F.col("to.tail").alias("tail"), "id", "text")
        .repartitionById(ranges, F.col("range"))
        .sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), "text")
    )
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, lanes)
        out: list[list] = [[] for _ in names]
        held = None
        for batch in batches:
            tails, ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for tail, key, text in zip(tails, ids, texts, strict=True):
                mark = sketch(text)
                if held is not None:
                    h_id, h_text, h_mark = held
                    changed = edited(h_text, text)
                    changed_mark = sketch(changed)
                    row = (h_id, len(h_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), sketch.spell(h_mark), sketch.spell(changed_mark), sketch.likeness(h_mark, changed_mark), sketch.likeness(h_mark, mark))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                held = None if tail else (key, text, mark)
                if tail:
                    break  # only the first of the marked rows is the next document
            if len(out[0]) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    made = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)
