"""Token counts without tokens: a Viterbi pass that carries only the best score and the number of pieces.

An Aho-Corasick automaton over the unigram vocabulary reports, for every end position of a text, the pieces that
end there, the longest first.  The best segmentation up to that position is kept as (score, pieces).  A later
candidate replaces an earlier one only when its score is strictly higher: that is the tie rule of the unigram tokenizer,
which meets candidates by ascending start.  A character that is no piece of its own can always be an unknown, scored
``min(scores) - unk_penalty``; with byte fallback it counts as many pieces as it has UTF-8 bytes, without it a run of
unknowns counts once.

Scores are added in float64, as the tokenizer does.  Where the vocabulary has the word-start mark only in front of
pieces, and some white space in no piece at all, no piece can reach over those places: the best path of a text is
the concatenation of the best paths between them, and its count their sum.  So counts of words are remembered (in a
table of bounded size); a text without such places is one word, and nothing is ever cut short.

Null and empty texts have 0 tokens.  Repeated rows give repeated results.  Other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from dexlake.llm.common import by_rows, texts_of

SPACE_MARK = "▁"
MEMO_WORDS = 1_000_000
_COUNTERS: dict[str, UnigramCounter] = {}


class UnigramCounter:
    """Counts the pieces that a unigram tokenizer would cut a text into."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], *, byte_fallback: bool = True, unk_penalty: float = 10.0, add_prefix: bool = True):
        import ahocorasick

        if not pieces or len(pieces) != len(scores):
            raise ValueError("a vocabulary needs as many scores as pieces, one at least")
        self.byte_fallback, self.add_prefix = byte_fallback, add_prefix
        self.unk = min(scores) - unk_penalty
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        best: dict[str, float] = dict(zip(pieces, scores, strict=True))
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        every = set("".join(best))
        free = "".join(c for c in "\n\r\t\v\f" if c not in every)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in best):
            self.words = None
        else:
            stop = f"{SPACE_MARK}{re.escape(free)}"
            self.words = re.compile(f"{SPACE_MARK}+[^{stop}]*|[^{stop}]+" + (f"|[{re.escape(free)}]+" if free else ""))
            if not byte_fallback:  # a run of unknowns may cross these places
                self.words = None
        self.memo: dict[str, int] = {}

    def _viterbi(self, word: str) -> int:
        n = len(word)
        low = float("-inf")
        best, count = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(word):  # no unknown can win a place: every end has a piece
            for end, (length, score) in self.automaton.iter(word):
                s = end + 1 - length
                score += best[s]
                if score > best[end + 1]:
                    best[end + 1] = score
                    count[end + 1] = count[s] + 1
            return count[n]
        unknown = [False] * (n + 1)
        single, unk = self.single, self.unk

        def close(e: int) -> None:
            c = word[e - 1]
            if c not in single and best[e - 1] + unk > best[e]:
                best[e] = best[e - 1] + unk
                if self.byte_fallback:
                    count[e] = count[e - 1] + len(c.encode("utf-8", "surrogatepass"))
                else:
                    count[e] = count[e - 1] + (not unknown[e - 1])
                    unknown[e] = True

        done = 0
        for end, (length, score) in self.automaton.iter(word):
            e = end + 1
            while done < e - 1:
                done += 1
                close(done)
            s = e - length
            score += best[s]
            if score > best[e]:
                best[e], count[e], unknown[e] = score, count[s] + 1, False
        while done < n:
            done += 1
            close(done)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE_MARK)
        if self.add_prefix:
            text = SPACE_MARK + text
        if self.words is None:
            return self._viterbi(text)
        words = self.words.findall(text)
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
        total = 0
        for w in words:
            if (k := memo.get(w)) is None:
                k = self._viterbi(w)
                if len(w) <= 64:
                    memo[w] = k
            total += k
        return total


def vocabulary_of(model_path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]


def count_tokens(df: DataFrame, pieces: Sequence[str], scores: Sequence[float], *, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, n_chars (code points), n_tokens.  A narrow pass: nothing is shuffled.

    The vocabulary (some 32,000 pieces, its size doesn't depend on the data) is broadcast once.
    """
    pieces, scores = list(pieces), list(map(float, scores))
    name = hashlib.md5(repr((pieces, scores, byte_fallback)).encode("utf-8", "surrogatepass")).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast((pieces, scores))
    id_type = df.schema[id_col].dataType.simpleString()

    def counted(batch: pa.RecordBatch) -> dict:
        counter = _COUNTERS.get(name)
        if counter is None:
            counter = _COUNTERS[name] = UnigramCounter(*shipped.value, byte_fallback=byte_fallback)
        texts = texts_of(batch.column(1))
        return {id_col: batch.column(0), "n_chars": [len(t) for t in texts], "n_tokens": [counter.count(t) for t in texts]}

    return by_rows(df.select(id_col, text_col), counted, f"`{id_col}` {id_type}, n_chars long, n_tokens long")
