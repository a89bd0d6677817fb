"""Removal of repeated passages: every byte covered by a string of ``window`` bytes that also starts elsewhere goes.

A suffix array of the whole corpus can't be built in one place, so the corpus is first dealt to groups that can't miss a repeat:

1. The *anchor* of a window is its least-hashed substring of ``gram`` bytes (the first of equals).  Equal windows have
   equal anchors at equal offsets.  The window starts of a text that share an anchor form a unit; the bytes of its windows are its context.
   Only hashes travel: a unit is (anchor hash, context hash, place).
2. Units with one anchor hash are a group.  A group of one unit has no repeat.  Units with equal contexts repeat each other whole;
   one of them stands for all.  Groups that have a context without an equal go on with the bytes of their distinct contexts.
3. A group of more than ``MOST_CONTEXTS`` distinct contexts is dealt again, by the middle that all windows within a narrow range of
   offsets have in common; ranges get narrower until a range is one window, where equal middles are equal windows.
4. In a group, contexts are cut down to what they share with the context that is nearest in order on either side of the anchor, for no window
   beyond that can have an equal.  A suffix array of what remains (linear grouping construction, :mod:`dexlake.llm.lyndon`) puts equal
   windows next to each other; neighbours are compared byte by byte.
5. The repeated window starts go back to all units of their context, and each document is cut.  A context gets one run, however many parts found it:
   the starts of a unit lie closer together than a window is long, so what its repeated windows cover has no gap.

Two contexts count as equal when the 128-bit XXH3 hashes of their bytes are (BLAKE2b where groups are dealt again).  The rolling hash of the anchors only deals.

Defined results: texts are UTF-8 bytes, null is the empty text; texts shorter than the window lose nothing; repeats in one document count.  What a
row loses depends on its text alone, so texts are known by their SHA-256 (128 bits of it) and ids never matter: null ids and repeated ids are judged row by row, and
repeated rows repeat each other.  Nothing is capped: long texts are read in blocks, large groups are dealt again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import bounded_batches, cut, drop
from dexlake.llm.lyndon import suffix_array

U = np.uint64
WINDOW, GRAM = 400, 200
MOST_CONTEXTS = 256
WIDTHS = (26, 1)  # offsets that share a middle, when a large group is dealt again
BLOCK = 1 << 19  # window starts handled at once
BATCH_BYTES = 1 << 17
_BASE = U(0x9E3779B97F4A7C15)
_DOWN = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_CUT = re.compile(rb"[\x80-\xff]")
#: A character of UTF-8, or a byte by itself.
_CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xff][\x80-\xbf]{3}|.", re.DOTALL)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x9FB21C651E98DF25)
    x ^= x >> U(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _DOWN)):
                steps = np.full(size, base, U)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def units_of(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash (with the anchor's offset as its seed), first window start, number of starts and anchor offset of every unit of a text."""
    n = len(raw)
    parts = []
    reach = window - gram + 1
    for at in range(0, max(0, n - window + 1), BLOCK):
        codes = np.frombuffer(raw, np.uint8)[at : min(n, at + BLOCK + window - 1)]
        up, down = _powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            # sums[i] is the polynomial of the first i bytes; a substring's polynomial is a difference, moved down to place 0
            sums = np.empty(len(codes) + 1, U)
            sums[0] = 0
            terms = codes.astype(U)
            terms += U(1)
            terms *= up[: len(codes)]
            np.cumsum(terms, out=sums[1:])
            m = len(codes) - gram + 1
            hashes = sums[gram:] - sums[:m]
            hashes *= down[:m]
            hashes = _mixed(hashes)
            least = (hashes & U(0xFFFFFFFFFFF00000)) | np.arange(m, dtype=U)
            width = 1
            while 2 * width <= reach:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < reach:
                k = len(least) - (reach - width)
                least = np.minimum(least[:k], least[reach - width :])
            anchors = (least & U(0xFFFFF)).astype(np.int64)
            edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            first = np.concatenate([[0], edges])
            starts = np.diff(np.append(first, len(anchors)))
            place = anchors[first]
            stop = first + starts - 1 + window
            parts.append((hashes[place], first + at, starts, place - first))
    if not parts:
        return (np.empty(0, U), [], *(np.empty(0, np.int64) for _ in range(3)))
    anchors, first, starts, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
    stop = first + starts - 1 + window
    contexts = [xxhash.xxh3_128_digest(raw[a:b], seed=o) for a, b, o in zip(first.tolist(), stop.tolist(), offset.tolist(), strict=True)]
    return anchors, contexts, first, starts, offset


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _shared(parts: list[bytes]) -> list[int]:
    """For each string the longest beginning that it shares with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    found = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        k = _common(parts[i], parts[j])
        found[i] = max(found[i], k)
        found[j] = max(found[j], k)
    return found


class RepeatFinder:
    """Gathers groups of contexts and finds the repeated windows of many groups with one suffix array."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.kept: dict[tuple[int, int, bytes], list] = {}  # (group, starts, bytes): how often, contexts and where in them

    def add(self, group: int, contexts: list[tuple[int, int, int, bytes]]) -> None:
        """contexts of one group: (name, copies, anchor offset, bytes)."""
        window = self.window
        right = _shared([c[o:] for _, _, o, c in contexts])
        left = _shared([c[:o][::-1] for _, _, o, c in contexts])
        for (name, copies, offset, raw), r, l in zip(contexts, right, left, strict=True):
            if l + r >= window:
                part = raw[offset - l : offset + r]
                held = self.kept.setdefault((group, l, part), [0, []])
                if not held[1]:
                    self.size += len(part)
                held[0] += copies
                held[1].append((name, offset - l))

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """(context, first, last) of runs of repeated window starts in the contexts gathered."""
        window = self.window
        items = list(self.kept.items())
        text = b"\xff".join(part for (_, _, part), _ in items)  # a byte that UTF-8 doesn't have
        begins = np.cumsum([0, *(len(part) + 1 for (_, _, part), _ in items)])
        usable = np.zeros(len(text) + 1, bool)
        often = np.zeros(len(text) + 1, bool)
        for ((_, _, part), (copies, _)), b in zip(items, begins, strict=False):
            usable[b : b + len(part) - window + 1] = True
            often[b : b + len(part) - window + 1] = copies > 1
        repeated = np.zeros(len(text) + 1, bool)
        order = np.array(suffix_array(text), np.int64)
        order = order[usable[order]].tolist()
        before = None
        same = None
        for i in order:
            own = text[i : i + window]
            if own == same:
                repeated[i] = repeated[before] = True
            before, same = i, own
        repeated |= often
        for ((_, _, part), (_, members)), b in zip(items, begins, strict=False):
            marks = np.flatnonzero(np.diff(np.concatenate([[False], repeated[b : b + len(part) - window + 1], [False]]).astype(np.int8)))
            for first, end in zip(marks[::2].tolist(), marks[1::2].tolist(), strict=True):
                for name, shift in members:
                    yield name, first + shift, end - 1 + shift
        self.clear()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _units(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, anchor, context, first, starts, offset, copies) of every unit; texts that come several times in a batch make their units once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, counts = [], []
            often: dict[bytes, int] = {}
            place: list[int] = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if doc not in often:
                    place.append(i)
                often[doc] = often.get(doc, 0) + 1
            batch = batch.take(pa.array(place))
            for text in batch.column(1).to_pylist():
                made.append(units_of((text or "").encode("utf-8", "surrogatepass"), window, gram))
                counts.append(len(made[-1][0]))
            if sum(counts):
                anchor, first, starts, offset = (np.concatenate([m[k] for m in made]) for k in (0, 2, 3, 4))
                context = pa.array([c for m in made for c in m[1]], pa.binary())
                docs_ = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([docs_, pa.array(anchor.view(np.int64)), context, pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(np.repeat(np.array(list(often.values()), np.int64), counts))], names=["doc", "anchor", "context", "first", "starts", "offset", "copies"])

    return docs.mapInArrow(run, "doc binary, anchor long, context binary, first int, starts int, offset int, copies long")


def _suffix_groups(contexts: DataFrame, window: int) -> DataFrame:
    """(group, context, first, last) of repeated starts, from contexts (group, context, copies, offset, raw) of groups of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = RepeatFinder(window)
        names, types = ["group", "context", "first", "last"], [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        current, held = None, []

        def found() -> pa.RecordBatch:
            return _batch([(g, c, a, b) for (g, c), a, b in finder.repeats()], names, types)

        for batch in batches:
            for group, context, copies, offset, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != current:
                    if len(held) > 1:
                        finder.add(current, held)
                    current, held = group, []
                    if finder.size >= BATCH_BYTES:
                        yield found()
                held.append(((group, context), copies, offset, raw))
        if len(held) > 1:
            finder.add(current, held)
        if finder.kept:
            yield found()

    columns = ["group", "context", "copies", "offset", "raw"]
    return contexts.select(*columns).repartition("group").sortWithinPartitions("group", "context").mapInArrow(run, "group long, context binary, first int, last int")


def _dealt_again(contexts: DataFrame, width: int, window: int) -> DataFrame:
    """Contexts of large groups by the middle of ``width`` neighbouring offsets: adds (group, context) of the part and (parent_group, parent, shift)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "context", "copies", "offset", "raw", "parent_group", "parent", "shift"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]

        def digest(*parts: bytes, size: int) -> bytes:
            return hashlib.blake2b(b"".join(parts), digest_size=size).digest()

        for batch in batches:
            rows = []
            for group, context, copies, offset, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a window that starts at s has its anchor at offset - s; starts are taken together by that distance
                s, last = 0, len(raw) - window
                while s <= last:
                    part = (offset - s) // width
                    end = min(last, offset - part * width)  # the last start of this part, its distance is part * width
                    middle = raw[offset - part * width : offset - part * width - width + 1 + window]
                    own = raw[s : end + window]
                    key = int.from_bytes(digest(part.to_bytes(4, "little"), middle, size=8), "little", signed=True)
                    rows.append((key, digest((offset - s).to_bytes(4, "little"), own, size=16), copies, offset - s, own, group, context, s))
                    s = end + 1
            if rows:
                yield _batch(rows, names, types)

    schema = "group long, context binary, copies long, offset int, raw binary, parent_group long, parent binary, shift int"
    return contexts.select("group", "context", "copies", "offset", "raw").mapInArrow(run, schema)


def _distinct(parts: DataFrame) -> DataFrame:
    return parts.groupBy("group", "context").agg(F.sum("copies").alias("copies"), F.first("offset").alias("offset"), F.first("raw").alias("raw"))


def _group_sizes(contexts: DataFrame) -> DataFrame:
    """(group, distinct contexts, copies of all, contexts without an equal)."""
    return contexts.groupBy("group").agg(F.count(F.lit(1)).alias("distinct"), F.sum("copies").alias("all"), F.count(F.when(F.col("copies") == 1, 1)).alias("alone"))


def _whole(contexts: DataFrame, window: int) -> DataFrame:
    """Contexts that have an equal repeat in all their windows."""
    return contexts.where("copies > 1").select("group", "context", F.lit(0).alias("first"), (F.length("raw") - window).cast("int").alias("last"))


def _one_run(runs: DataFrame, *names: str) -> DataFrame:
    """One run for each context, from its first repeated start to its last: a join on ``names`` then makes no more rows than it reads."""
    return runs.groupBy(*names).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _repeats(contexts: DataFrame, sizes: DataFrame, window: int, most: int, widths: tuple[int, ...], between: list[DataFrame]) -> DataFrame:
    """Repeated starts of contexts in groups with several distinct ones; tables that they are read from are added to ``between``."""
    mixed_ = contexts.join(sizes.where("distinct > 1 and alone > 0"), "group")
    found = _suffix_groups(mixed_.where(F.col("distinct") <= most), window)
    large = mixed_.where(F.col("distinct") > most)
    if not widths or large.isEmpty():
        return found
    parts = cut(_dealt_again(large, widths[0], window), "parts")
    again = cut(_distinct(parts), "again")
    between += [parts, again]
    inner = _whole(again, window)
    if widths[0] > 1:
        between.append(sizes := cut(_group_sizes(again), "sizes"))
        inner = _one_run(inner.unionByName(_repeats(again, sizes, window, most, widths[1:], between)), "group", "context")
    back = parts.join(inner, ["group", "context"])
    return found.unionByName(back.select(F.col("parent_group").alias("group"), F.col("parent").alias("context"), (F.col("first") + F.col("shift")).cast("int").alias("first"), (F.col("last") + F.col("shift")).cast("int").alias("last")))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc, spans) of the texts (doc, text) that have repeated windows; spans are [first start, last start + window), at most one for each unit, unmerged.  ``doc`` is :func:`text_key`."""
    bounded_batches(docs.sparkSession)
    every = cut(_units(docs, window, gram), "units")
    names = ["anchor", "context"]
    # most anchors come once: they are counted by themselves, and the rest works on the others' units
    again = every.groupBy("anchor").agg(F.sum("copies").alias("all")).where(F.col("all") > 1).select("anchor")
    units = cut(every.join(again, "anchor", "left_semi"), "units")
    drop(every)
    distinct = units.groupBy(*names).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc", "first", "starts", "offset")).alias("at"))
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct"), F.sum("copies").alias("all"), F.count(F.when(F.col("copies") == 1, 1)).alias("alone")).where(F.col("all") > 1)
    candidates = cut(distinct.join(groups, "anchor"), "candidates")
    whole = candidates.where("copies > 1").select("anchor", "context", F.lit(0).alias("first"), (F.col("at.starts") - 1).alias("last"))

    needed = candidates.where("distinct > 1 and alone > 0")
    by_doc = needed.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct("anchor", "context", "copies", F.col("at.first").alias("first"), F.col("at.starts").alias("starts"), F.col("at.offset").alias("offset"))).alias("wanted"))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["group", "context", "copies", "offset", "raw"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    rows.append((w["anchor"], w["context"], w["copies"], w["offset"], raw[w["first"] : w["first"] + w["starts"] - 1 + window]))
                if len(rows) > 4096:
                    yield _batch(rows, columns, types)
                    rows = []
            if rows:
                yield _batch(rows, columns, types)

    texts = docs.join(by_doc, "doc").dropDuplicates(["doc"])  # of a repeated text one is enough
    contexts = cut(texts.select("text", "wanted").mapInArrow(fetched, "group long, context binary, copies long, offset int, raw binary"), "contexts")
    sizes, between = cut(_group_sizes(contexts), "sizes"), []
    found = _repeats(contexts, sizes, window, most_contexts, widths, between)
    runs = whole.unionByName(found.select(F.col("group").alias("anchor"), "context", "first", "last"))
    runs = cut(_one_run(runs, *names), "runs")
    spans = units.select("doc", "anchor", "context", F.col("first").alias("start")).join(runs, names)
    spans = spans.select("doc", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + window).alias("b"))
    spans = cut(spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")  # a set: a repeated text says the same as often as it comes
    drop(units, candidates, contexts, sizes, runs, *between)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    found: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``raw`` less the runs."""
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def text_key(text: Column) -> Column:
    """What a text is known by: 128 bits of its SHA-256; null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def whole_characters(raw: bytes) -> bytes:
    """``raw`` without the bytes of characters that were cut in two."""
    return b"".join(c for c in _CHARACTER.findall(raw) if len(c) > 1 or c < b"\x80") if _CUT.search(raw) else raw


def dedup_digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, text) of every row; text is what remains, less the bytes of characters cut in two."""
    docs = df.select(text_key(F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, **kw)
    id_type = df.schema[id_col].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for text, spans_ in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merged(spans_ or [])
                left = without(raw, runs)
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), whole_characters(left).decode("utf-8", "replace") if runs else text or ""))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=columns)

    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))
    return rows.join(spans, "doc", "left").select("id", "text", "spans").mapInArrow(digested, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def deduplicated(df: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """``df`` with the repeated passages taken out of its texts; characters of which only a part is covered stay.  A null text stays null."""
    key = text_key(F.col(text_col))
    spans = repeated_spans(df.select(key.alias("doc"), F.col(text_col).alias("text")), **kw)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, runs, strict=True):
            if found is None or not isinstance(text, str):
                out.append(text)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            whole = []
            for a, b in merged([{"a": x["a"], "b": x["b"]} for x in found]):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append((a, b))
            out.append(without(raw, whole).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype="object")

    joined = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("doc")).join(spans, "doc", "left")  # a struct: no name can clash
    text = F.col("row").getField(text_col)
    cut_ = F.when(F.col("spans").isNull(), text).otherwise(kept(text, F.col("spans")))
    return joined.select(*[cut_.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
