"""Language identification: known words by their log frequency, unseen words by ever shorter character n-grams.

A model is learned from a bounded sample of labelled texts (``docs_per_language``, default 1,200, of the ``most_languages``, default 256, with most
labelled texts).  It holds the log frequency of words and n-grams (one to five letters, with marks for a word's start and end) in each
language.  Every language brings its own most frequent ones (``words_per_language`` and ``ngrams_per_language``, default 15,000 each): these parameters
bound the model, so it can be broadcast.

A text is lower-cased and cut into runs of letters.  A word that the model knows has its log frequency in each language;
for any other word the longest n-grams of it that the model knows are taken (all of that length, their mean), and a word of which not
even one letter is known says nothing.  The language with the highest mean over all words wins, ties go to the first in
alphabetical order.  The score is the softmax of the means, sharpened by ``SHARPNESS``.

Null texts and texts without a letter are ``und`` with score 0.  Without any labelled text everything is ``und``.
Whole texts are read; language, source and id are never used for a prediction.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import by_rows, texts_of

DOCS_PER_LANGUAGE = 1200
MOST_LANGUAGES, WORDS_PER_LANGUAGE, NGRAMS_PER_LANGUAGE, LONGEST = 256, 15_000, 15_000, 5
MEMO_WORDS = 500_000
SHARPNESS = 2.0
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def ngrams(word: str, n: int) -> list[str]:
    """n-grams of a word with its start and end marked; single letters are taken without the marks."""
    if n > 1:
        word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    @classmethod
    def learn(cls, labelled: Iterable[tuple[str, str]], *, words_per_language: int = WORDS_PER_LANGUAGE, ngrams_per_language: int = NGRAMS_PER_LANGUAGE) -> LanguageModel:
        counts: dict[str, Counter] = {}
        for text, language in labelled:
            counts.setdefault(language, Counter()).update(WORD.findall(text.lower()))
        languages = sorted(counts)
        grams: dict[str, Counter] = {}
        for language in languages:
            found = grams[language] = Counter()
            for word, n in counts[language].items():
                for size in range(1, LONGEST + 1):
                    for g in ngrams(word, size):
                        found[g] += n

        def table(by: dict[str, Counter], most: int) -> tuple[dict[str, int], np.ndarray]:
            total: Counter = Counter()
            for c in by.values():
                total.update(c)
            chosen = {k for c in by.values() for k in heapq.nsmallest(most, c, key=lambda k, c=c: (-c[k], k))}
            kept = sorted(chosen, key=lambda k: (-total[k], k))
            scores = np.empty((len(kept), len(languages)), np.float32)
            for j, language in enumerate(languages):
                own = by[language]
                whole = math.log(sum(own.values()) + 0.5 * (len(total) + 1))
                scores[:, j] = [math.log(own.get(k, 0) + 0.5) - whole for k in kept]
            return {k: i for i, k in enumerate(kept)}, scores

        return cls(languages, *table(counts, words_per_language), *table(grams, ngrams_per_language))


class LanguageScorer:
    """Predicts with a model; remembers the scores of words (table of bounded size)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows = np.zeros((MEMO_WORDS + 2, max(1, len(model.languages))), np.float32)
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.used = 0

    def word(self, word: str) -> np.ndarray:
        m = self.model
        if (i := m.words.get(word)) is not None:
            return m.word_scores[i]
        for size in range(LONGEST, 0, -1):
            known = [k for g in ngrams(word, size) if (k := m.grams.get(g)) is not None]
            if known:
                return m.gram_scores[known].mean(axis=0)
        return np.zeros(len(m.languages), np.float32)

    def __call__(self, text: str) -> tuple[str, float]:
        words = WORD.findall(text.lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            try:
                rows = list(map(self.memo.__getitem__, part))
            except KeyError:
                if self.used + len(part) > MEMO_WORDS:
                    self.clear()
                rows = []
                for w in part:
                    k = self.memo.get(w)
                    if k is None:
                        k = self.memo[w] = self.used
                        self.rows[k] = self.word(w)
                        self.used += 1
                    rows.append(k)
            total += self.rows[rows].sum(axis=0, dtype=np.float64)
        mean = total / len(words)
        best = int(mean.argmax())
        odds = np.exp((mean - mean[best]) * SHARPNESS)
        return self.model.languages[best], float(odds[best] / odds.sum())


def learn_languages(df: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, **sizes: int) -> LanguageModel:
    """Learn from rows where ``learn_from`` holds and text and language are known.

    The sample of a language is the rows whose hash (of id and text) falls below a threshold that lets ``docs_per_language`` through on average; rows
    that are repeated whole count once.  ``sizes`` are the bounds of the model's tables.
    """
    usable = df.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()}
    if not counts:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < share[F.col(lang_col)] * (1 << 30)
    rows = usable.where(drawn).select(id_col, text_col, lang_col).distinct().select(text_col, lang_col).toLocalIterator(prefetchPartitions=False)
    return LanguageModel.learn(((r[0], r[1]) for r in rows), **sizes)


_SCORERS: dict[str, LanguageScorer] = {}


def identify_languages(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score.  A narrow pass."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    name = f"{df.sparkSession.sparkContext.applicationId}-{shipped._jbroadcast.id()}"
    id_type = df.schema[id_col].dataType.simpleString()

    def predicted(batch: pa.RecordBatch) -> dict:
        scorer = _SCORERS.get(name)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[name] = LanguageScorer(shipped.value)
        made = [scorer(t) for t in texts_of(batch.column(1))]
        return {id_col: batch.column(0), "lang_pred": [p for p, _ in made], "score": [s for _, s in made]}

    return by_rows(df.select(id_col, text_col), predicted, f"`{id_col}` {id_type}, lang_pred string, score double")
