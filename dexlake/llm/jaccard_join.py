"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct w-word shingles.  A shingle is a 64-bit hash: the XXH3 hashes of its words, mixed in their order.  Documents with equal sets are one class, and all
that follows is between classes.  In any one order of all shingles, two sets of similarity t share at least ``l`` of their first ``n - ceil(t n) + l``,
for every l up to ``ceil(t n)``; the prefix may be lengthened if more shared shingles are asked for.

1. All shingles are counted over all documents (blocks of 32-bit rests of their hashes, counted in the map tasks first).  Those in ``KNOWN`` or more
   documents form a table of at most ``MOST_KNOWN`` entries; the least count is raised until it fits.  Sets are ordered by it: unlisted shingles first, then by count.
2. Each document chooses its l by estimated cost: a candidate costs as much as its set is long, and the shared shingles that the lists of a prefix
   let expect, by l, bound the candidates; a longer prefix costs its own entries and those of the lists it joins.
3. Shingles that at most ``LONG`` documents have are dealt into blocks; two documents of similar size that meet in such a list are counted.  They are verified if
   they meet in as many as the lesser l asks for, less what both may share in longer lists.
4. Longer lists are never paired.  A similar pair that isn't met in step 3 shares a shingle of a longer list in the plain prefixes (l = 1).  In each
   such list, by size, the document with most of these shingles is the *pivot*, and every other one is written as its symmetric difference from
   the pivot.  With the difference's size m and f = m - n (1 - t) / (1 + t), x and y are similar exactly if their differences share (f(x) + f(y)) / 2 or
   more.  Where that is none, both are linked by the member of least f.  The others are joined on the shortest prefixes of their differences that
   their f allows for, rarest first: the further from the pivot, the more must be shared.
5. Candidates are verified on their whole sets; links make the components.

No list is cut off and no pair left out: ``KNOWN``, ``LONG`` and the estimate decide about work only.  If the table is full, ``LONG`` grows to its least count.

Defined results: words are cut and lower-cased as bytes (A-Z, ASCII white space); with fewer words than w the whole sequence is one shingle; a document
without words (null, empty or white space only) has the empty set and no link: its component is its own id.  Rows are told apart by their sets, so repeated rows and
repeated ids are judged row by row; a row's component is the least id that its class reaches.  A row without an id shares its class's component (null
if no row of the class has an id) and makes no links of its own.  ``similarity`` is taken exactly as its decimal digits say.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import bounded_batches, by_rows, cut, drop
from dexlake.llm.components import components

KNOWN, LONG, MOST_KNOWN = 4, 32, 1_000_000
#: Entries of a block, about, and blocks at most.
BLOCK_ENTRIES, MOST_BLOCKS = 1 << 20, 1 << 16
#: What is expected of a shingle that isn't in the table: so many other documents that have it.
UNLISTED = 0.1
FEW_IDS = 500_000  # ids, 8 bytes each, that may be broadcast; more are joined by shuffling
NODE_BYTES = 10
ENTRY = np.dtype([("token", "<u8"), ("node", f"V{NODE_BYTES}"), ("n", "<u4"), ("need", "<u4"), ("hidden", "<u4")])


MEMO_WORDS = 1 << 16


class _WordHashes(dict):
    """XXH3 of words, remembered in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending (uint64)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):  # every word goes into a state that was mixed with all before it
        h ^= words[i : i + n]
        _mixed(h)
        h += np.uint64(0x9E3779B97F4A7C15)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(tokens: np.ndarray) -> bytes:
    """The name of a class: 80 bits of a digest of its whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=NODE_BYTES).digest()


def ratio(similarity: float) -> tuple[int, int]:
    """A similarity above 0 and up to 1 as the fraction that its decimal digits say."""
    found = Fraction(str(similarity))
    if not 0 < found <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    return found.numerator, found.denominator


def prefix_length(n: int, similarity: float, matches: int = 1) -> int:
    """Shingles of a set of n among which a similar set has ``matches`` in common."""
    a, b = ratio(similarity)
    return max(0, min(n, n - -(-a * n // b) + matches))


class Known:
    """How many documents have the shingles of the table; the order of all sets."""

    def __init__(self, shift: int, keys: np.ndarray, counts: np.ndarray, long: int):
        self.shift, self.keys, self.counts, self.long = shift, keys, counts, long

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The count of each shingle, 0 if it isn't in the table."""
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        keys = tokens >> np.uint64(self.shift)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def ordered(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set in the common order, with its counts."""
        counts = self.of(tokens)
        order = np.argsort(counts, kind="stable")
        return tokens[order], counts[order]


def matches_asked(counts: np.ndarray, a: int, b: int) -> int:
    """The l of the least estimated cost, for a set whose ``counts`` are in order."""
    n = len(counts)
    overlap = -(-a * n // b)
    most = max(1, min(overlap, 1 + n // 10))
    expected = np.cumsum(np.where(counts > 0, counts - 1.0, UNLISTED))
    l = np.arange(1, most + 1)
    met = expected[n - overlap + l - 1]
    return int(l[np.argmin((10 + n / 8) * met / l + met + 3.0 * l)])


def _by_block(blocks: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values, sorted by ascending ``blocks``, of each block."""
    edges = np.flatnonzero(np.diff(blocks)) + 1
    for block, part in zip(blocks[np.concatenate([[0], edges])].tolist(), np.split(values, edges), strict=True):
        yield block, part


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, its rows) of batches that are sorted by their first column."""
    current, held = None, []
    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != current:
                if held:
                    yield current, held
                current, held = block, []
            held.append(row)
    if held:
        yield current, held


def _blocks_for(entries: int) -> int:
    """Bits of a shingle's hash that name its block."""
    return max(0, min(MOST_BLOCKS, entries // BLOCK_ENTRIES).bit_length())


def known_counts(docs: DataFrame, total: int, width: int, least: int = KNOWN, most: int = MOST_KNOWN, long: int = LONG) -> Known:
    """The table of shingles in ``least`` or more documents, from all shingles of all documents (id, text); ``total`` is how many there are."""
    bits = _blocks_for(total)
    shift = 32 - bits  # bits of a hash that don't count here
    mask = np.uint64(0xFFFFFFFF)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for often in (False, True):
                own = (n > 1) == often
                if own.any():
                    packed = np.stack([(keys[own] & mask).astype("<u4"), n[own].astype("<u4")], axis=1) if often else (keys[own] & mask).astype("<u4")
                    rows += [(block, often, part.tobytes()) for block, part in _by_block((keys[own] >> np.uint64(32)).astype(np.int64), packed)]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary())], names=["block", "often", "packed"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                if len(s := shingle_set(text, width)):
                    held.append(s >> np.uint64(shift))
                    size += len(s)
                    if size >= 1 << 20:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches):
            rests, counts = [], []
            for often, packed in rows:
                part = np.frombuffer(packed, "<u4")
                rests.append(part[::2] if often else part)
                counts.append(part[1::2] if often else np.ones(len(part), "<u4"))
            rest, n = np.concatenate(rests), np.concatenate(counts).astype(np.int64)
            order = np.argsort(rest, kind="stable")
            rest, n = rest[order], n[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(rest)) + 1])
            sums = np.add.reduceat(n, first)
            many = sums >= least
            if many.any():
                keys = (np.uint64(block) << np.uint64(32)) | rest[first][many].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[many])], names=["key", "n"])

    packed = docs.mapInArrow(counted, "block int, often boolean, packed binary")
    found = cut(packed.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "key long, n long"), "known")
    by_count = sorted(((r[0], r[1]) for r in found.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().collect()), reverse=True)
    kept, held = by_count[0][0] + 1 if by_count else least, 0
    for n, rows in by_count:  # as low a least count as the table has room for
        if held + rows > most:
            break
        kept, held = n, held + rows
    table = found.where(F.col("n") >= kept).toArrow()
    drop(found)
    keys, counts = (c.to_numpy() for c in table.columns)
    order = np.argsort(keys, kind="stable")
    return Known(shift, keys[order].view(np.uint64), counts[order], max(long, kept - 1))


def _dealt(docs: DataFrame, known: Broadcast, total: int, width: int, a: int, b: int) -> DataFrame:
    """One pass over the texts, rows of three kinds: 0 (id, n, node) of every row; 1 (block, packed) entries of short lists; 2 (token, size, node, n) those
    of long lists in plain prefixes, n being how many the document has.  A class is dealt once in each task."""
    bits = _blocks_for(total // 4)
    step = math.log(b / a) if a < b else 1.0
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"kind int, id {id_type}, n long, node binary, block int, packed binary, token long, size int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(kind: int, count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * count, pa.int32()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held, size = known.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            blocks = (entries["token"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), np.int64)
            order = np.argsort(blocks, kind="stable")
            parts = [(block, part.tobytes()) for block, part in _by_block(blocks[order], entries[order])]
            return rows(1, len(parts), block=[p[0] for p in parts], packed=[p[1] for p in parts])

        for batch in batches:
            sizes, nodes, long_ = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, width)
                n = len(tokens)
                node = node_of(tokens) if n else None
                sizes.append(n)
                nodes.append(node)
                if not n or node in seen:
                    continue
                seen.add(node)
                tokens, counts = table.ordered(tokens)
                l = matches_asked(counts, a, b)
                reach = n - -(-a * n // b) + l
                short = int(np.searchsorted(counts[:reach], table.long, "right"))  # counts ascend
                own = np.empty(short, ENTRY)
                own["token"], own["node"], own["n"], own["need"], own["hidden"] = tokens[:short], np.void(node), n, l, reach - short
                held.append(own)
                size += short
                if short < (plain := reach - l + 1):
                    # similar sizes are in one range or in neighbouring ones; each document goes to its own range and the next
                    at = int(math.log(n) / step + 1e-9) if a < b else n
                    long_ += [(t, s, node, plain - short) for t in tokens[short:plain].view(np.int64).tolist() for s in (at, at + 1)]
                if size >= 1 << 18:
                    yield flush()
                    held, size = [], 0
            if sizes:
                yield rows(0, len(sizes), id=batch.column(0), n=sizes, node=nodes)
            if long_:
                columns = list(zip(*long_, strict=True))
                yield rows(2, len(long_), token=columns[0], size=columns[1], node=columns[2], n=columns[3])
        if size:
            yield flush()

    return cut(docs.mapInArrow(run, schema), "dealt")


def _met(packed: DataFrame, a: int, b: int) -> DataFrame:
    """(u, v) of classes that meet in as many short lists as they must to be similar, from (block, packed)."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            entries = np.concatenate([np.frombuffer(r[0], ENTRY) for r in rows])
            entries = entries[np.argsort(entries["token"], kind="stable")]
            token = entries["token"]
            same = np.concatenate([[False], token[1:] == token[:-1], [False]])
            entries = entries[same[1:] | same[:-1]]
            xs, ys, shift = [], [], 0
            while True:  # lists are short, so few shifts have equal tokens
                shift += 1
                i = np.flatnonzero(entries["token"][shift:] == entries["token"][:-shift])
                if not len(i):
                    break
                x, y = entries[i], entries[i + shift]
                near = b * np.minimum(x["n"], y["n"]).astype(np.int64) >= a * np.maximum(x["n"], y["n"]).astype(np.int64)
                near &= x["node"] != y["node"]
                xs.append(x[near])
                ys.append(y[near])
            if xs and sum(map(len, xs)):
                x, y = np.concatenate(xs), np.concatenate(ys)
                lack = np.minimum(x["need"], y["need"]).astype(np.int64) - np.minimum(x["hidden"], y["hidden"]).astype(np.int64)
                for at in range(0, len(x), 1 << 16):
                    u, v = (pa.FixedSizeBinaryArray.from_buffers(pa.binary(NODE_BYTES), len(z), [None, pa.py_buffer(z.tobytes())]).cast(pa.binary()) for z in (x["node"][at : at + (1 << 16)], y["node"][at : at + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([u, v, pa.array(lack[at : at + (1 << 16)])], names=["x", "y", "lack"])

    rows = packed.repartition("block").sortWithinPartitions("block").mapInArrow(paired, "x binary, y binary, lack long")
    met = rows.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count(F.lit(1)).alias("met"), F.first("lack").alias("lack"))
    return met.where("met >= lack").select("u", "v")


def _members(lists: DataFrame) -> DataFrame:
    """(pivot, node): for each long list (token, size, node, n) all its documents with the one that has most such shingles."""
    lists = lists.distinct()
    pivots = lists.groupBy("token", "size").agg(F.max(F.struct("n", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return lists.join(pivots, ["token", "size"]).select("pivot", "node").distinct()


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the classes in ``nodes``: whole sets, made again from the texts; 8 bytes a shingle, ascending."""
    ids = cut(classes.join(nodes, "node", "left_semi").select("id"), "ids")
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")

    def made(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
        return {"node": [node_of(s) for s in sets], "tokens": [s.tobytes() for s in sets]}

    sets = cut(by_rows(wanted, made, "node binary, tokens binary").dropDuplicates(["node"]), "sets")
    drop(ids)
    return sets


def _compared(pairs: DataFrame, sets: DataFrame, made: Callable[[bytes, bytes, np.ndarray, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """What ``made`` says of each of ``pairs`` (u, v) and its whole sets; rows of None are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, v, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row := made(u, v, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))) is not None:
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return both.select("u", "v", "a", "b").mapInArrow(run, schema)


def _links(pairs: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are similar enough."""

    def linked(u: bytes, v: bytes, x: np.ndarray, y: np.ndarray) -> tuple | None:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return (u, v) if b * shared >= a * (len(x) + len(y) - shared) else None

    return _compared(pairs, sets, linked, "u binary, v binary")


def _around_pivots(members: DataFrame, sets: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(links that are certain, candidates, tables that both read) of the members (pivot, node) of each pivot; see step 4 of the module."""
    whole = a + b

    def apart(pivot: bytes, node: bytes, x: np.ndarray, y: np.ndarray) -> tuple:
        other = np.setxor1d(x, y, assume_unique=True)
        return pivot, node, len(other), whole * len(other) - (b - a) * len(y), other.view(np.int64)

    apart_ = cut(_compared(members.select(F.col("pivot").alias("u"), F.col("node").alias("v")), sets, apart, "pivot binary, node binary, m long, f long, tokens array<long>"), "apart")
    best = apart_.groupBy("pivot").agg(F.min(F.struct("f", "node")).alias("best"), F.max("f").alias("most"))
    # f is kept as a whole number, (a + b) times what the module's text says
    placed = apart_.join(best.select("pivot", F.col("best.f").alias("least"), F.col("best.node").alias("centre"), "most"), "pivot").withColumn("outside", F.col("f") + F.col("least") > 0)
    certain = placed.where("not outside and node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))

    asked = F.when(F.col("outside"), F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("least")) / (2 * whole)))).otherwise(F.floor((F.col("f") - F.col("least")) / (2 * whole)) + 1)
    open_ = placed.where("most + least > 0").withColumn("dealt", F.col("m") - asked + 1).where("dealt > 0")  # in a group without an outsider all is certain
    tokens = open_.select("pivot", "node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = tokens.join(often, ["pivot", "token"]).groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("places"))
    rows = ordered.join(open_.select("pivot", "node", "m", "f", "outside", "dealt"), ["pivot", "node"])
    rows = rows.select("pivot", "node", "m", "f", "outside", F.posexplode(F.slice("places", F.lit(1), F.col("dealt").cast("int"))).alias("i", "at"))
    rows = cut(rows.where("at.n > 1").select("pivot", F.col("at.token").alias("token"), "node", "f", "outside", (F.col("m") - F.col("i")).alias("left")), "differences")
    x, y = (rows.select("pivot", "token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "f", "outside", "left")]) for side in "xy")
    met = x.join(y, ["pivot", "token"]).where(
        (F.col("outside_x") & ((F.col("node_x") < F.col("node_y")) | ~F.col("outside_y") & (F.col("node_x") != F.col("node_y"))))
        & (2 * whole * F.least("left_x", "left_y") >= F.col("f_x") + F.col("f_y"))
    )
    return certain, met.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct(), [apart_, rows]


def _nodes(*pairs: DataFrame) -> DataFrame:
    found = None
    for p in pairs:
        for c in p.columns:
            one = p.select(F.col(c).alias("node"))
            found = one if found is None else found.unionByName(one)
    return found.distinct()


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, known: int = KNOWN, long: int = LONG, most_known: int = MOST_KNOWN) -> DataFrame:
    """(id_col, n_shingles, component_id): one row per input row; see the module for what is done."""
    spark = df.sparkSession
    bounded_batches(spark)
    a, b = ratio(similarity)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # about how many shingles there are, for the size of blocks only
    most = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    table = spark.sparkContext.broadcast(known_counts(docs, most, width, known, most_known, long))  # 16 bytes an entry, most_known at most
    dealt = _dealt(docs, table, most, width, a, b)
    signed = cut(dealt.where("kind = 0").select("id", F.col("n").alias("n_shingles"), "node"), "signed")
    classes = cut(signed.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id")), "classes")
    pairs = cut(_met(dealt.where("kind = 1").select("block", "packed"), a, b), "pairs")
    members = cut(_members(dealt.where("kind = 2").select("token", "size", "node", "n")), "members")
    drop(dealt)
    sets = _sets(docs, classes, _nodes(pairs, members), width)
    certain, more, between = _around_pivots(members, sets, a, b)
    every = pairs.unionByName(more.join(pairs, ["u", "v"], "left_anti"))
    links = _links(every, sets, a, b).unionByName(certain)

    ids = links.join(classes.select(F.col("node").alias("u"), F.col("id").alias("x")), "u").join(classes.select(F.col("node").alias("v"), F.col("id").alias("y")), "v")
    joined = components(ids.select(F.col("x").alias("u"), F.col("y").alias("v")))
    drop(pairs, members, sets, *between)
    found = classes.join(joined, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    done = signed.join(found, "node", "left")
    return done.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
