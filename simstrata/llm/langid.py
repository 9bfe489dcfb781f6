"""Operator 1: language identification by words first, with back-off to shorter and shorter character n-grams.

Training counts words per language over labelled texts; n-gram counts follow from the word counts. A token's vector of
log-probabilities (one per language) is that of its word if the word is known; else its n-grams of the longest order
are looked up, and each stretch of the word that no known n-gram of that order covers is tried with the next shorter
order, each step down costing ``BACKOFF``. Vectors add up over the tokens of a text.

``fit`` learns from about ``max_docs`` labelled texts, drawn by a hash of text and language: a documented parameter that
bounds what is broadcast. Of these it knows all words and n-grams that occur at least ``least`` times. Whole texts are
read in training and in prediction. Letters are those of the Unicode category L, in both.

Defined cases: null texts, empty texts and texts without a letter get ``und`` with score 0; ties between languages go
to the first in alphabetical order; with no labelled text at all every text gets ``und``; repeated rows are judged one by
one; an empty table gives an empty table; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import remainder, written

MAX_DOCS, LEAST, ORDER = 10_000, 3, 5
BACKOFF, CACHE = np.log(0.4), 200_000

_WORD = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """``words`` and ``grams[n]`` map to rows of log-probabilities, one column per language of ``langs``."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    rows: np.ndarray
    floor: np.ndarray


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def model_of(counts: list[tuple[str, dict[str, int]]], grams: list[tuple[int, str, dict[str, float]]], order: int = ORDER) -> Model:
    """A model from (word, counts by language) and (n, n-gram, counts by language)."""
    langs = sorted({x for _, by in counts for x in by})
    at = {x: i for i, x in enumerate(langs)}
    index: list[dict[str, int]] = [{} for _ in range(order + 2)]
    rows, start = [], 0
    for slot in range(1, order + 2):
        own = counts if slot > order else [(g, by) for n, g, by in grams if n == slot]
        found = np.zeros((len(own), len(langs)))
        for i, (_, by) in enumerate(own):
            for lang, n in by.items():
                found[i, at[lang]] += n
        rows.append(np.log((found + 0.5) / (found.sum(axis=0) + 0.5 * max(1, len(found)))))
        index[slot] = {key: start + i for i, (key, _) in enumerate(own)}
        start += len(own)
    return Model(langs, index[order + 1], index[: order + 1], np.concatenate(rows), np.full(len(langs), np.log(1e-7)))


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, least: int = LEAST,
    order: int = ORDER,
) -> Model:
    """Learn from ``df``'s non-null languages and texts, on a bounded sample of rows (see above)."""
    rows = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    share = min(1.0, max_docs / max(1, rows.count()))
    # A filter by a hash, so no text is shuffled to draw the sample.
    sample = rows.where(F.pmod(F.xxhash64("t", "l"), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = sample.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).where("w != ''")
    counted = words.groupBy("w", "l").agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by")
    per_word = counted.groupBy("w").agg(F.sum("n").alias("all"), by)
    top = written(per_word.where(F.col("all") >= least).select("w", "by"), "langid-words")
    # The n-grams of all these words, counted where the words are.
    padded = top.select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"), "by")
    sized = padded.select("p", "by", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")).where("length(p) >= n")
    spots = sized.select("n", "by", F.expr("explode(transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n)))").alias("g"))
    flat = spots.select("n", "g", F.explode("by").alias("l", "c")).groupBy("n", "g", "l").agg(F.sum("c").alias("c"))
    grams = flat.groupBy("n", "g").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("by"))
    best = grams.where(F.col("all") >= least).select("n", "g", "by").toLocalIterator()
    return model_of(sorted(((r.w, r.by) for r in top.toLocalIterator()), key=lambda r: r[0]), sorted(((r.n, r.g, r.by) for r in best), key=lambda r: r[:2]), order)


class _Rows(dict):
    """Raw token to its row in the scorer's table; a token that isn't there is worked out."""

    def __init__(self, new) -> None:
        self.new = new

    def __missing__(self, token: str) -> int:
        return self.new(token)


class Scorer:
    """Token vectors with a cache; the last column of ``table`` counts the words of letters in a token."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = _Rows(self.token)
        self.table = np.zeros((1024, len(model.langs) + 1))

    def vector(self, word: str) -> np.ndarray:
        m = self.model
        if (i := m.words.get(word)) is not None:
            return m.rows[i]
        return self.back_off(f" {word} ", len(m.grams) - 1)

    def back_off(self, part: str, n: int) -> np.ndarray:
        """Mean per n-gram of the longest order that is known, scaled to one word."""
        m, total, count = self.model, np.zeros(len(self.model.langs)), 0
        stack = [(part, n, 0.0)]
        while stack:
            s, n, cost = stack.pop()
            if n == 0:
                total, count = total + m.floor + cost, count + 1
                continue
            if len(s) < n:
                stack.append((s, len(s), cost))
                continue
            unknown = -1
            for i in range(len(s) - n + 1):
                row = m.grams[n].get(s[i : i + n])
                if row is None:
                    unknown = i if unknown < 0 else unknown
                    continue
                if unknown >= 0:
                    stack.append((s[unknown : i + n - 1], n - 1, cost + BACKOFF))
                    unknown = -1
                total, count = total + m.rows[row] + cost, count + 1
            if unknown >= 0:
                stack.append((s[unknown:], n - 1, cost + BACKOFF))
        return total / max(1, count)

    def token(self, token: str) -> int:
        """Works out the row of a raw token."""
        i = len(self.ids)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = self.table[i]
        word = token.rstrip(".,").lower()
        known = self.model.words.get(word)
        if known is not None:
            row[:-1], row[-1] = self.model.rows[known], 1
        else:
            row[:] = 0
            for word in _WORD.findall(word):
                row[:-1] += self.vector(word)
                row[-1] += 1
        self.ids[token] = i
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return "und", 0.0
        if len(self.ids) > CACHE:
            self.ids.clear()
        ids = list(map(self.ids.__getitem__, text.split()))
        if not ids:
            return "und", 0.0
        sums = self.table[ids].sum(axis=0)
        if sums[-1] == 0:
            return "und", 0.0
        mean = sums[:-1] / sums[-1]
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with a language and a score: the share of the best language in the per-word geometric means."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(x) for x in batch], columns=["lang", "score"])

    found = df.withColumn("__judged", judged(F.col(text)))
    return found.withColumn(lang_pred, F.col("__judged.lang")).withColumn(score, F.col("__judged.score")).drop("__judged")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    judged = predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
