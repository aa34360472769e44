"""Language identification with word-first backoff.

A word the model knows scores by its log frequency in each language.  A word it
doesn't know falls back to its character n-grams, the longest order first and
shorter ones only while fewer than half of that order's n-grams are known.

Training counts the words of a bounded sample: at most ``docs_per_lang`` labelled
different texts of each language, the ones with the smallest hash.  That is the
only bound: every label is learned, with every word and n-gram of its sample, and
the model, which is broadcast, grows with the number of labels alone.  Prediction
reads every text whole.

Words are runs of letters, lower-cased, in training as in prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
repeated rows and ties get equal results (languages are tried in name order);
a null label is no label; an empty training set makes every text ``und``; texts
are never cut, and a long text costs memory for its words, not for words times
languages; other columns are carried through, except ``lang_pred`` and ``score``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import materialise, ship, small

UNKNOWN = "und"
#: Orders of the n-grams, the first tried first.
ORDERS = (4, 3, 2, 1)
#: N-grams that training met less often are left out.
MIN_GRAMS = 2
WORDS = regex.compile(r"\p{L}+")
#: The same for lower-case ASCII, where it is faster.
ASCII_WORDS = re.compile("[a-z]+")
#: The posterior counts at most so many words, so that scores stay graded.
EVIDENCE_WORDS = 12
#: Scores of words met that a worker keeps, in bytes and words, and words of a text scored at once.
CACHE_BYTES, CACHE_WORDS, CHUNK_WORDS = 16 << 20, 100_000, 1 << 16


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text)


class Table:
    """Smoothed log frequencies of words, or of n-grams of one order, in each language.

    ``floor`` holds what a language gives to an entry it lacks; an entry keeps
    only what the languages that have it gain over that.
    """

    def __init__(self, counts: dict[str, dict[int, int]], n_langs: int) -> None:
        totals = np.full(n_langs, 0.5 * len(counts))
        for of in counts.values():
            for lang, c in of.items():
                totals[lang] += c
        self.floor = np.log(0.5 / totals).tolist() if counts else [0.0] * n_langs
        same: dict[tuple, tuple] = {}  # most entries are rare, so that a few tuples serve all
        self.gains = {}
        for x, of in counts.items():
            key = tuple(of.items())
            if key not in same:
                same[key] = tuple((lang, math.log(2 * c + 1)) for lang, c in key)
            self.gains[x] = same[key]

    def mean(self, entries: list[str], least: float) -> list[float] | None:
        """Mean log frequencies of the entries that are known, if at least so many are."""
        found = [x for x in map(self.gains.get, entries) if x is not None]
        n = len(found)
        if not n or n < least:
            return None
        out = [0.0] * len(self.floor)
        for gains in found:
            for lang, gain in gains:
                out[lang] += gain
        return [a + b / n for a, b in zip(self.floor, out)]


class Model:
    """Per-language log frequencies of words and n-grams, to be broadcast."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.langs = sorted({lang for lang, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        words: dict[str, dict[int, int]] = defaultdict(dict)
        grams: dict[int, dict[str, dict[int, int]]] = {order: defaultdict(dict) for order in ORDERS}
        for (lang, word), c in sorted(counts.items()):
            k = at[lang]
            words[word][k] = words[word].get(k, 0) + c
            for order in ORDERS:
                for g in ngrams(word, order):
                    of = grams[order][g]
                    of[k] = of.get(k, 0) + c
        n = len(self.langs)
        self.words = Table(words, n)
        self.orders = [(order, Table({g: of for g, of in grams[order].items() if sum(of.values()) >= MIN_GRAMS}, n)) for order in ORDERS]

    def word_scores(self, word: str) -> list[float]:
        scores = self.words.mean([word], 1)
        for order, table in self.orders:
            if scores is not None:
                return scores
            grams = ngrams(word, order)
            scores = table.mean(grams, len(grams) / 2)
        return scores or [0.0] * len(self.langs)


def ngrams(word: str, order: int) -> list[str]:
    """N-grams of a word with its borders marked; single letters have no marks."""
    w = word if order == 1 else f"<{word}>"
    return [w[k : k + order] for k in range(len(w) - order + 1)]


class Scorer:
    """Predicts texts; the scores of words met are kept, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.most = max(min(CACHE_BYTES // (8 * max(len(model.langs), 1)), CACHE_WORDS), 1024)
        self.table = np.zeros((1024, len(model.langs)))

    def _row(self, word: str) -> int:
        k = len(self.rows)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.model.word_scores(word)
        self.rows[word] = k
        return k

    def _sum(self, words: list[str]) -> np.ndarray:
        """Scores of some words, added up; the cache may outgrow its bound by these words."""
        if len(self.rows) > self.most:
            self.rows, self.table = {}, np.zeros((1024, len(self.model.langs)))
        found = list(map(self.rows.get, words))
        if None in found:
            for w in dict.fromkeys(w for k, w in zip(found, words, strict=True) if k is None):
                self._row(w)
            found = list(map(self.rows.get, words))
        return self.table[found].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        step = min(CHUNK_WORDS, self.most)
        mean = sum((self._sum(words[k : k + step]) for k in range(0, len(words), step)), np.zeros(len(self.model.langs))) / len(words)
        odds = (mean - mean.max()) * min(len(words), EVIDENCE_WORDS)
        best = int(np.argmax(odds))
        return self.model.langs[best], 1.0 / float(np.exp(odds).sum())


def train(labelled: DataFrame, docs_per_lang: int = 400, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of ``labelled`` (see above)."""
    ship(labelled.sparkSession)
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    labelled = labelled.select(lang.alias("lang"), text.alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # Copies of a text have one draw, so distinct draws count the different texts.
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000_007)) / 1_000_000_007
    texts = labelled.select("lang", draw.alias("draw")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    # A first cut by hash thins large languages in the scan, so that no sort gets a hot one.
    # It is written, so that Spark sees how small it is before it plans the join.
    cuts = materialise(texts.select("lang", (F.lit(docs_per_lang + 6 * math.sqrt(docs_per_lang) + 10) / F.col("texts")).alias("cut")), "language-cuts")
    thinned = labelled.withColumn("draw", draw).join(cuts, "lang").where(F.col("draw") <= F.col("cut"))
    order = Window.partitionBy("lang").orderBy("draw")
    # One copy of a text stands for all.
    sample = thinned.dropDuplicates(["lang", "draw"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            langs = np.repeat(np.arange(batch.num_rows), [len(w) for w in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(langs)), pa.array([w for x in found for w in x], pa.string())], names=["lang", "word"])

    counts = sample.mapInArrow(split, "lang string, word string").groupBy("lang", "word").count()
    model = {(r["lang"], r["word"]): r["count"] for r in counts.toLocalIterator()}
    # A language none of whose sampled texts has a letter is no less a label, but nothing can be said of it.
    return Model(model)


def held_out(doc_id: Column) -> Column:
    """The fold kept from training; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended: a narrow map, no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    out = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in rest]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small(batches, at):
            got = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, out)
