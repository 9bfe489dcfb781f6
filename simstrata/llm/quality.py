"""Operator 4: quality rules by counts within a text and by line frequency across the documents of a host.

Only DataFrame functions are used. Lines are normalised (lower case, white space collapsed and trimmed) and hashed; for
each host the distinct documents that hold a line are counted, where exact copies count as one document. A line that
more than ``greatest(MIN_DOCS, MAX_SHARE * documents of the host)`` documents hold is removed, and a document that keeps
less than ``MIN_KEPT`` of its characters is rejected as depleted.

Repeated 8-word windows are found by 64-bit hashes of the windows of one text: no rows leave their task for that. Joins
that hand back what was found for a line or a text go over a salt too, so hot lines and large groups of copies spread.

Defined cases: a null text has no words, counts of 0, fails the base rule and isn't kept; an empty text likewise; a null
host is the host ``''``; of equal lines the first isn't counted as a duplicate; repeated rows are judged alike, each on
its own; an empty table gives an empty table; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import WS

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
MIN_DOCS, MAX_SHARE, MIN_KEPT, SALTS = 20, 0.02, 0.3, 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns ``BASE``, ``base_failed`` and ``base_ok``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("__words", F.array_remove(F.split(t, WS), ""))
    rows = rows.withColumn("__n", F.size("__words"))
    windows = F.transform(F.sequence(F.lit(1), F.col("__n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW)))
    rows = rows.withColumn("__hashes", F.when(F.col("__n") > WINDOW, windows))
    rows = rows.withColumn("word_chars", F.coalesce(F.length(F.array_join("__words", "")), F.lit(0)).cast("long")).drop("__words")
    # Only texts that have a repeated window sort their windows.
    repeated = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    rows = rows.withColumn("__sorted", F.when(repeated, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.drop("__hashes")
    same = lambda x, j: (x.h == F.get(F.col("__sorted"), j - 1).h) | (x.h == F.get(F.col("__sorted"), j + 1).h)
    spots = F.sort_array(F.transform(F.filter("__sorted", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x.i))
    rows = rows.withColumn("__spots", spots).drop("__sorted")
    covered = F.transform("__spots", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__spots"), j + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__spots")
    rows = rows.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    rows = rows.withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
    rows = rows.withColumn("n_words", F.col("__n").cast("long")).drop("__n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WS, " ")))


def line_rows(df: DataFrame, text: str, host: str) -> DataFrame:
    """(host, doc, line, chars): per distinct text of a host, its line hashes with the characters they take."""
    doc = F.struct(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("a"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    lines = df.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), doc.alias("doc"),
        F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("raw"),
    )
    rows = lines.select("host", "doc", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.length("raw").cast("long").alias("chars"))
    # max: all copies of a text say the same; the sum within a text is made by the count of equal lines.
    return rows.groupBy("host", "doc", "line").agg(F.max("chars").alias("chars"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line): lines held by more distinct documents of the host than its limit."""
    held = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    totals = lines.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("total"))
    return held.join(totals, "host").where(F.col("docs") > F.col("total") * max_share).select("host", "line")


def removed_lines(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, doc, removed): for each distinct text of a host that holds frequent lines, the hashes of these lines."""
    lines = line_rows(df, text, host)
    frequent = frequent_lines(lines, min_docs, max_share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.col("doc.a"), F.lit(SALTS)).cast("int"))
    return salted.join(frequent, ["host", "line", "salt"]).groupBy("host", "doc").agg(F.collect_set("line").alias("removed"))


def with_removed(df: DataFrame, removed: DataFrame, text: str, host: str) -> DataFrame:
    """``df`` with ``__removed``, null where a text holds no frequent line."""
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn("__host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("__doc", F.struct(F.xxhash64(t).alias("a"), F.length(t).alias("n")))
    other = [c for c, kind in df.dtypes if c not in (text, host) and not kind.startswith(("map", "variant", "array", "struct"))]
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(F.lit(0), *other), F.lit(SALTS)).cast("int"))
    spread = removed.select(F.col("host").alias("__host"), F.col("doc").alias("__doc"), F.col("removed").alias("__removed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return keyed.join(spread, ["__host", "__doc", "__salt"], "left").drop("__host", "__doc", "__salt")


def line_hashes(text: Column) -> Column:
    """(line, chars) of each line of a text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.length(x).alias("chars")))


def judge(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """``df`` without its text, with ``BASE``, ``base_failed``, ``kept_share`` and ``kept``."""
    removed = removed_lines(df, text, host, min_docs, max_share)
    counted = base_counts(df, text)
    # The text itself isn't shuffled: its line hashes are, for the sum of what is left.
    light = counted.withColumn("__lines", line_hashes(F.col(text)))
    joined = with_removed(light, removed, text, host).drop(text)
    return verdict(joined, min_kept).drop("__lines", "__removed")


def verdict(joined: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """Adds ``kept_share`` and ``kept`` by ``__lines`` and ``__removed``."""
    chars = F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + x.chars)
    gone = F.aggregate(F.filter("__lines", lambda x: F.array_contains(F.col("__removed"), x.line)), F.lit(0).cast("long"), lambda a, x: a + x.chars)
    share = F.when(F.col("__removed").isNull() | (chars == 0), F.lit(1.0)).otherwise(1.0 - gone / chars)
    return joined.withColumn("kept_share", share).withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))


def clean(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """The rows of ``df`` that are kept, with their frequent lines removed from the text. Columns may have any names."""
    names = df.columns
    df = df.toDF(*(f"__column{i}" for i in range(len(names))))
    text, host = (f"__column{names.index(c)}" for c in (text, host))
    removed = removed_lines(df, text, host, min_docs, max_share)
    # The id, which isn't deterministic, keeps the optimizer from pushing the filter down into the counts and unfolding
    # all their steps into one expression.
    counted = base_counts(df, text).withColumn("__stop", F.monotonically_increasing_id())
    kept = counted.where(~F.col("base_failed") & (F.col("__stop") >= 0)).drop(*BASE, "__stop")
    joined = with_removed(kept, removed, text, host).withColumn("__lines", line_hashes(F.col(text)))
    judged = verdict(joined, min_kept).where("kept")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col("__removed"), F.xxhash64(normalised(x)))), "\n")
    return judged.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(left)).select(*df.columns).toDF(*names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    judged = judge(docs)
    return judged.select("doc_id", *BASE, "base_failed", "kept", F.round("kept_share", 6).alias("kept_share"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS wlines,
         string_split(text, chr(10)) AS lines
  FROM d),
b AS (
  SELECT rid, doc_id, source, text, lines, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(wlines) - len(list_distinct(wlines)) AS BIGINT) AS n_dup_lines
  FROM w),
win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, n_words - 6)) AS i FROM b WHERE n_words >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
ln AS (
  SELECT rid, source, text, l AS raw, trim(regexp_replace(lower(l), '[ \x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT rid, source, text, unnest(lines) AS l FROM b)),
fr AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS docs FROM ln GROUP BY ALL)
  JOIN (SELECT source, count(DISTINCT text) AS total FROM d GROUP BY ALL) USING (source)
  WHERE docs > 20 AND docs > total * 0.02),
gone AS (
  SELECT rid, 1.0 - sum(CASE WHEN fr.norm IS NOT NULL THEN length(raw) ELSE 0 END)::DOUBLE / sum(length(raw)) AS share
  FROM ln LEFT JOIN fr USING (source, norm) GROUP BY rid HAVING sum(length(raw)) > 0 AND count(fr.norm) > 0),
f AS (
  SELECT b.*, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.share, 1.0) AS share
  FROM b LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND share >= 0.3 AS kept,
       round(share, 6) AS kept_share
FROM f
"""
