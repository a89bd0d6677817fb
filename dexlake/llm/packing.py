"""Packing: documents are laid end to end and cut into sequences by order-preserving dynamic programming.

The tokens of the documents, in the order in which they come, form one stream.  A plan chooses cuts among the ends of
documents and sentences (and, where none of these comes for a long stretch, every few tokens).  A sequence between
two cuts holds at most ``window`` tokens and costs its padding, which is ``window`` less its length, or nothing where
its length is a power of two; a cut costs nothing after a document, ``sentence_penalty`` after a sentence and
``inner_penalty`` inside one.  The least total is found exactly: over all starts that a window can reach, the best is at
the head of a monotone queue, and the few starts at a power of two (an eighth of the window at least) are looked up.  As soon as all plans that are still open share their beginning,
that part is given out, so memory doesn't grow with the stream.

Each partition of the input is a stream of its own, in stored order; nothing is shuffled.  Every token lies in exactly one piece.
Null and empty texts are one end token.  Repeated rows are packed as often as they come.  A sequence id is the
partition's number times 2**32 plus the sequence's number in it.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dexlake.llm.common import bounded_batches, texts_of

MEMO_WORDS = 200_000  # some 40 MB; a worker keeps the table between stages
SENTENCE_PENALTY, INNER_PENALTY = 3, 24
INNER_STEP = 64  # tokens between cuts that may be made inside a long sentence
END_MARKS = (".", "!", "?", "…", "。", "\n")


class TokenIds:
    """Token ids of the byte-level BPE, as little-endian 16-bit words.

    Pre-tokens never reach over a single space, so ids of words between spaces are remembered (table of bounded size); a text
    with two white-space characters side by side is encoded as a whole.  Where a text holds one of ``special`` (string: id), that string is its id,
    and what stands before and behind it is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        self.special = dict(special or {})
        self.cutter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values(), default=0) > 0xFFFF or max(self.special.values(), default=0) > 0xFFFF:
            raise ValueError("ids don't fit 16 bits")
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.double = re.compile(r"\s\s")
        self.memo: dict[str, bytes] = {}
        texts = {i: b.decode("utf-8", "replace") for b, i in ranks.items()}
        size = max([*ranks.values(), *self.special.values()]) + 2
        self.ends = np.zeros(size, bool)
        self.opens = np.zeros(size, bool)
        for i, t in texts.items():
            self.ends[i] = t.rstrip(" \"')]").endswith(END_MARKS)
            self.opens[i] = t[:1].isspace()

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``."""
        base = word.rstrip(".,;:!?")
        if base != word and base.isalpha():
            found = self.memo.get(base)
            if found is None:
                found = self.memo[base] = self._encode(" " + base)
            tail = word[len(base) :]
            mark = self.memo.get(key := "\0" + tail)
            if mark is None:
                mark = self.memo[key] = self._encode(tail)
            return found + mark
        return self._encode(" " + word)

    def __call__(self, text: str) -> np.ndarray:
        if self.cutter is not None and len(parts := self.cutter.split(text)) > 1:
            return np.concatenate([np.array([self.special[part]], "<u2") if k % 2 else self._plain(part) for k, part in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u2")
        if self.double.search(text):
            return np.frombuffer(self._encode(text), "<u2")
        first, *words = text.split(" ")
        memo = self.memo
        try:
            got = list(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            got = []
            for w in words:
                ids = memo.get(w)
                if ids is None:
                    ids = self._word(w)
                    if len(w) <= 48:
                        memo[w] = ids
                got.append(ids)
        return np.frombuffer(self._encode(first) + b"".join(got), "<u2")

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions behind the last token of a sentence."""
        if len(ids) < 2:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.ends[ids[:-1]] & self.opens[ids[1:]]) + 1


class Planner:
    """The dynamic program over batches of cut points, with the exact plan given out as it settles.

    Cuts are numbered from the last one that was given out (0).  ``weight`` is the least cost up to a cut plus its
    position: what a later cut at ``at`` pays on top is ``window - at``, the same for all starts.
    """

    def __init__(self, window: int = 1024):
        self.window = window
        self.powers = [p for p in (1 << i for i in range(window.bit_length())) if window // 8 <= p <= window]
        self.position = np.zeros(1, np.int64)
        self.weight, self.parent = [0.0], [0]
        self.queue: deque[int] = deque([0])

    def extend(self, positions: np.ndarray, penalties: np.ndarray) -> None:
        """Cuts may be made at these positions (ascending, no two neighbours further apart than the window)."""
        window, queue, weight, parents = self.window, self.queue, self.weight, self.parent
        k = len(self.position)
        every = self.position = np.concatenate([self.position, positions])
        exact: dict[int, list[tuple[int, int]]] = {}
        for p in self.powers:
            i = np.searchsorted(every, positions - p)
            hit = np.flatnonzero(every[i] == positions - p)
            for a, b in zip((hit + k).tolist(), i[hit].tolist(), strict=True):
                exact.setdefault(a, []).append((b, p))
        first = np.searchsorted(every, positions - window).tolist()
        for low, at, penalty in zip(first, positions.tolist(), penalties.tolist(), strict=True):
            head = queue[0]
            while head < low:
                queue.popleft()
                head = queue[0]
            best, parent = weight[head] + window - at, head
            if k in exact:
                for i, p in exact[k]:
                    if (free := weight[i] + p - at) < best:  # its cost alone: no padding
                        best, parent = free, i
            parents.append(parent)
            own = best + penalty + at
            weight.append(own)
            while queue and weight[queue[-1]] >= own:
                queue.pop()
            queue.append(k)
            k += 1

    def settled(self, final: bool = False) -> list[int]:
        """Positions, after those given out before, of the cuts that every plan still open goes through."""
        last = len(self.position) - 1
        parent = self.parent
        live = {last} if final else set(range(int(np.searchsorted(self.position, self.position[last] - self.window)), last + 1))
        while len(live) > 1:  # the latest goes to where it came from, until all have met
            k = max(live)
            live.discard(k)
            live.add(parent[k])
        meet = k = live.pop()
        found = []
        while k > 0:
            found.append(int(self.position[k]))
            k = parent[k]
        self.position, self.weight = self.position[meet:], self.weight[meet:]
        self.parent = [max(p - meet, 0) for p in parent[meet:]]
        self.queue = deque(k - meet for k in self.queue if k >= meet)
        return found[::-1]


def plan(length: int, cuts: list[tuple[int, float]], window: int = 1024) -> list[int]:
    """Ends of the sequences for a stream of ``length`` tokens whose possible cuts are (position, penalty)."""
    if not length:
        return []
    p = Planner(window)
    p.extend(np.array([c for c, _ in cuts]), np.array([x for _, x in cuts], float))
    return p.settled(final=True)


def cuts_of(sentences: np.ndarray, length: int, window: int, sentence_penalty: float, inner_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a document of ``length`` tokens, and what each costs."""
    stops = np.append(sentences, length)
    penalties = np.full(len(stops), float(sentence_penalty))
    penalties[-1] = 0.0
    gaps = np.diff(stops, prepend=0)
    if gaps.max() > window // 4:
        inner = np.concatenate([np.arange(stop - gap + INNER_STEP, stop, INNER_STEP) for stop, gap in zip(stops, gaps, strict=True) if gap > window // 4])
        stops = np.concatenate([stops, inner])
        penalties = np.concatenate([penalties, np.full(len(inner), float(inner_penalty))])
        order = np.argsort(stops, kind="stable")
        stops, penalties = stops[order], penalties[order]
    return stops, penalties


def pack_stream(docs: Iterator[tuple], ids_of: Callable[[str], np.ndarray], sentence_ends: Callable[[np.ndarray], np.ndarray], *, end_id: int = 0, window: int = 1024, sentence_penalty: float = SENTENCE_PENALTY, inner_penalty: float = INNER_PENALTY, settle_every: int = 4096) -> Iterator[tuple]:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence, offset) of documents (key, text), in order."""
    planner = Planner(window)
    held: deque[tuple] = deque()  # documents not wholly given out: key, ids, place in the stream
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    at = given = added = number = 0
    end = np.array([end_id], "<u2")

    def give(final: bool) -> Iterator[tuple]:
        nonlocal given, number, added
        planner.extend(np.concatenate([c for c, _ in waiting]), np.concatenate([p for _, p in waiting]))
        waiting.clear()
        added = 0
        for stop in planner.settled(final):
            start = given
            while given < stop:
                key, ids, place = held[0]
                a, b = given - place, min(stop - place, len(ids))
                yield key, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), number, given - start
                given = place + b
                if b == len(ids):
                    held.popleft()
            number += 1

    for key, text in docs:
        ids = np.concatenate([ids_of(text), end])
        held.append((key, ids, at))
        cuts, penalties = cuts_of(sentence_ends(ids), len(ids), window, sentence_penalty, inner_penalty)
        waiting.append((cuts + at, penalties))
        added += len(cuts)
        at += len(ids)
        if added >= settle_every:
            yield from give(False)
    if at:
        if not waiting:
            waiting.append((np.empty(0, np.int64), np.empty(0)))
        yield from give(True)


_IDS: dict[tuple, TokenIds] = {}


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings that a ``tokenizers`` file names as tokens of their own."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, ranks_path: str, pattern: str, *, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = 1024, sentence_penalty: float = SENTENCE_PENALTY, inner_penalty: float = INNER_PENALTY) -> DataFrame:
    """One row per piece: which tokens of which document stand where in which sequence."""
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern, tuple(sorted((special or {}).items())))
        ids = _IDS.get(key)
        if ids is None:
            ids = _IDS[key] = TokenIds(ranks_path, pattern, special)
        high = TaskContext.get().partitionId() << 32
        kind = None

        def docs() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array([high + n for n in columns[5]], pa.int64()), pa.array(columns[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        for row in pack_stream(docs(), ids, ids.sentence_ends, end_id=end_id, window=window, sentence_penalty=sentence_penalty, inner_penalty=inner_penalty):
            rows.append(row)
            if len(rows) >= 8192:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {PIECE}")
