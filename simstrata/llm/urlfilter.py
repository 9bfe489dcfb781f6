"""Operator 3: URL filters by host word segmentation and multinomial naive Bayes, below explicit rules.

Rules of the form (verdict, host, path) decide first: a rule fits its host and all subdomains if the url's path starts
with the rule's path, and the longest rule wins. The naive Bayes model decides the rest. It is learned from the urls
that the rules decide, together with a few seed words per verdict (parameters).

Host labels are split into words by unigram Viterbi. The unigrams are the words of letters of the pages themselves, all
counted. All substrings of the distinct host labels are joined with the unigram counts, so the segmentation works on the
whole vocabulary without shipping it. Words of the segmented host and of the path are hashed into ``BUCKETS`` features,
which bounds the model that is broadcast; numbers are features by their length.

A host's words are found once per distinct host, and joined back to the rows.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the prior alone; ties
between verdicts go to ``allow``; between rules of equal length to ``block``; if no url is decided by a rule, the seeds
alone are the training set; repeated rows are judged one by one; an empty table gives an empty table; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SEEDS = {"block": ("casino", "win", "spam", "farm", "adult", "porn", "xxx", "sex", "ads", "track", "bet", "poker", "viagra", "phish", "malware"), "allow": ("blog", "news", "docs", "wiki", "edu")}
#: Each seed word counts as this share of its verdict's features, and of ``SEED_BASE`` more.
SEED_SHARE, SEED_BASE, BUCKETS = 0.02, 10_000, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?``, ``#`` or the end)."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text like ``org/``, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def unigrams(text: DataFrame, col: str) -> DataFrame:
    """(word, n): the words of a-z of a text column, lower-cased, over all rows."""
    words = text.select(F.explode(F.split(F.lower(F.col(col)), "[^a-z]+")).alias("word"))
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, logp: dict[str, float], unknown: float) -> list[str]:
    """Best split of a label into words; an unknown word of length k costs ``unknown * k - 2``."""
    longest = max(map(len, logp), default=0)
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    run, start = -math.inf, 0  # the best split that ends in an unknown word, and where that word begins
    for j in range(1, len(label) + 1):
        if best[j - 1] - 2 > run:
            run, start = best[j - 1] - 2, j - 1
        run += unknown
        best[j], back[j] = run, start
        for i in range(max(0, j - longest), j):
            p = logp.get(label[i:j])
            if p is not None and best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    out, j = [], len(label)
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct ``label``s, by the unigram counts (word, n)."""
    whole = counts.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).first()
    total, longest = whole.total or 1, whole.longest or 1  # no substring longer than the longest word is one
    spots = labels.where(F.length("label") > 0).select("label", F.explode(F.expr("sequence(1, length(label))")).alias("i"))
    subs = spots.select("label", F.explode(F.expr(f"transform(sequence(1, least({longest}, length(label) - i + 1)), k -> substring(label, i, k))")).alias("word"))
    known = subs.distinct().join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for label, found in batches:
            logps = ({d["word"]: math.log(d["n"] / total) for d in f} if f is not None else {} for f in found)
            yield pd.Series([viterbi(x, logp, -math.log(total + 1) / 2 - 1) if x else [] for x, logp in zip(label, logps, strict=True)])

    return labels.join(known, "label", "left").select("label", split("label", "found").alias("words"))


def features(words: Column) -> Column:
    """Hash buckets of an array of words; numbers by their length."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w)), F.lit(BUCKETS)).cast("int"))


def judge(df: DataFrame, words: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """(id, host, path, rule, verdict, block_log_odds) of every row; ``words`` are unigram counts (word, n)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("__url"))
    host, path = url_parts(F.col("__url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    rows = rows.withColumn("path_features", features(F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda w: w != "")))

    hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
    parts = hosts.select("host", F.split("host", "[^a-z0-9]+").alias("labels"))
    labels = written(parts.select(F.explode("labels").alias("label")).where("label != ''").distinct(), "url-labels")
    split = segment(labels, written(words, "url-words"))
    tokens = parts.select("host", F.posexplode("labels").alias("i", "label")).join(split, "label")
    tokens = tokens.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x.words)).alias("host_words"))
    tokens = written(tokens.withColumn("host_features", features("host_words")), "url-hosts")
    # A join of plain tables, so adaptive execution splits the rows of a hot host; written, as it is read three times.
    rows = rows.join(tokens, "host", "left").withColumn("all_features", F.concat(F.coalesce("host_features", F.array().cast("array<int>")), "path_features"))
    rows = written(rows, "url-rows")

    # At most 2 * BUCKETS rows come to the driver, whatever the size of the table.
    trained = rows.where("ruled is not null").select("ruled", F.explode("all_features").alias("f")).groupBy("ruled", "f").agg(F.count("*").alias("n")).collect()
    docs = {r.ruled: r.n for r in rows.where("ruled is not null").groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    seeded = spark.createDataFrame([(v, list(ws)) for v, ws in seeds.items()], "v string, ws array<string>").select("v", features(F.col("ws")).alias("fs")).collect()
    counts = {v: np.full(BUCKETS, 0.5) for v in ("allow", "block")}
    for r in trained:
        counts[r.ruled][r.f] += r.n
    for r in seeded:
        share = SEED_SHARE * (counts[r.v].sum() - BUCKETS / 2 + SEED_BASE)
        for f in r.fs:
            counts[r.v][f] += share
    odds = np.log(counts["block"] / counts["block"].sum()) - np.log(counts["allow"] / counts["allow"].sum())
    prior = math.log((docs.get("block", 0) + 1) / (docs.get("allow", 0) + 1))
    shared = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("double")
    def log_odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([prior + float(shared.value[np.asarray(x, dtype=np.int64)].sum()) for x in batch], dtype="float64")

    rows = rows.withColumn("block_log_odds", log_odds("all_features"))
    by_model = F.when(F.col("block_log_odds") > 0, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "block_log_odds", "host_words")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, unigrams(pages, "html")).select("page_id", "host", "path", "rule", "verdict", "block_log_odds")
