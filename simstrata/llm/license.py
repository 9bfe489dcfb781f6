"""Operator 10: licence scans by sparse TF-IDF cosine to templates, and inheritance from the nearest directory above.

Only DataFrame functions are used. The units of a text are its lines and the sentences of its paragraphs, which may span
lines; they are compared with the templates ``HEADERS``. Licence files are also compared as a
whole with ``TEXTS``. Vectors are term counts times inverse template frequency (terms in no template get the largest; stop words are left out);
a unit's licence is that of its best template, from a cosine of ``threshold`` on.

Units without any *trigger* term are skipped, which is exact: ``triggers`` picks the terms so that, by the
Cauchy-Schwarz inequality, a unit that shares only the other terms with a template can't reach the threshold.

A file without a licence of its own inherits that of the nearest directory above it (its own first) that has a licence
file. Distinct directories are joined with the licensed ones over the hashes of their ancestors' paths, and the paths
are compared thereafter; what was found goes back to the files in a join of plain tables, whose hot directories
adaptive execution splits.

Defined cases: null and empty texts have no licence of their own and may inherit; of equally good templates the first
by name wins; of several licence files in a directory the best score, then the first name; null paths have no directory
and don't inherit; repeated rows are judged one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import written
from simstrata.llm.license_texts import HEADERS, TEXTS

THRESHOLD, SPLIT, SENTENCE, PARAGRAPH = 0.75, "[^a-z0-9.+-]+", "[.!?]+[ \\t\\r\\n]+", "\\n[ \\t\\r]*\\n"
#: Words that no vector holds.
STOP = tuple("a an and any are as at be by can for in into is it may not of or so that the this to under which with you your".split())
Templates = tuple[tuple[str, str], ...]


def tokens(text: str) -> list[str]:
    return [t for x in re.split(SPLIT, text.lower()) if (t := x.strip(".-+")) and t not in STOP]


def weights(templates: Templates) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(idf by term, idf of other terms, (name, unit vector) of each template)."""
    counts = [(name, Counter(tokens(text))) for name, text in templates]
    df = Counter(t for _, c in counts for t in c)
    top = math.log(1 + len(counts)) + 1
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = []
    for name, c in counts:
        v = {t: n * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {t: x / norm for t, x in v.items()}))
    return idf, top, vectors


def triggers(templates: Templates = HEADERS, threshold: float = THRESHOLD) -> list[str]:
    """Terms without any of which no unit reaches ``threshold``: what is left of each unit vector is shorter than it."""
    vectors, found = [v for _, v in weights(templates)[2]], set()
    while True:
        left = [sum(x * x for t, x in v.items() if t not in found) for v in vectors]
        k = max(range(len(vectors)), key=lambda k: (left[k], k))
        if left[k] < (threshold - 1e-6) ** 2:
            return sorted(found)
        open_terms = {t: x for t, x in vectors[k].items() if t not in found}
        found.add(max(open_terms, key=lambda t: (len(t) > 1, open_terms[t] * sum(t in v for v in vectors), t)))


def term_array(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), SPLIT), lambda x: F.regexp_replace(x, "^[.+-]+|[.+-]+$", "")), lambda x: (x != "") & ~x.isin(*STOP))


def cosines(units: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """(key, license, score): each hit of at least ``threshold`` of the units (key, text), the best template's.

    A unit's vector is made within its row: the sorted terms give counts by their runs. Nothing is shuffled.
    """
    idf, top, vectors = weights(templates)
    known = F.create_map(*(F.lit(x) for t, w in sorted(idf.items()) for x in (t, w)))
    rows = units.select("key", F.sort_array(term_array(F.col("text"))).alias("s"))
    changes = lambda i: (i == 1) | (F.get("s", i - 1) != F.get("s", i - 2))
    rows = rows.where(F.size("s") > 0).withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("s")), changes))
    runs = F.transform("starts", lambda i, k: F.struct(F.get("s", i - 1).alias("t"), (F.coalesce(F.get("starts", k + 1), F.size("s") + 1) - i).alias("tf")))
    rows = rows.select("key", runs.alias("runs"))
    weighted = F.transform("runs", lambda r: F.struct(r.t.alias("t"), F.try_element_at(known, r.t).alias("idf"), r.tf.alias("tf")))
    rows = rows.select("key", weighted.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda x, r: x + F.pow(r.tf * F.coalesce(r.idf, F.lit(top)), F.lit(2.0))))
    shared = F.transform(F.filter("v", lambda r: r.idf.isNotNull()), lambda r: F.struct(r.t.alias("t"), (r.tf * r.idf).alias("w")))
    # The id, which isn't deterministic, keeps filters from being unfolded into the steps above.
    rows = rows.select("key", norm.alias("norm"), shared.alias("v"), F.monotonically_increasing_id().alias("stop"))
    rows = rows.where((F.size("v") > 0) & (F.col("stop") >= 0))

    def scored(name: str, vector: dict[str, float]):
        x = F.create_map(*(F.lit(y) for t, w in sorted(vector.items()) for y in (t, w)))
        dot = F.aggregate("v", F.lit(0.0), lambda a, r: a + r.w * F.coalesce(F.try_element_at(x, r.t), F.lit(0.0)))
        # Rounded, so that sums taken in another order give the same winner.
        return F.struct(F.round(dot / F.col("norm"), 9).alias("score"), F.lit(name).alias("license"))

    hits = F.filter(F.array(*(scored(*v) for v in vectors)), lambda h: h.score >= threshold)
    rows = rows.select("key", F.explode(hits).alias("h"))
    return rows.select("key", "h.license", "h.score")


def scan(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "path", is_file: str = "is_license_file",
    headers: Templates = HEADERS, texts: Templates = TEXTS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``df``: id, path, own license and score, effective license, and where it comes from."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = "|".join(x.replace(".", "\\.").replace("+", "\\+") for x in triggers(headers, threshold))
    pattern = f"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"
    files = df.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.coalesce(F.col(is_file), F.lit(False)).alias("is_file"), t.alias("text"))
    files = files.withColumn("key", F.struct("id", "path", F.xxhash64("text").alias("h")))
    # A regular expression over the whole text comes first: few texts have a trigger at all.
    near = files.where(F.col("text").rlike(pattern))
    pieces = F.flatten(F.transform(F.split("text", PARAGRAPH), lambda x: F.split(x, SENTENCE)))
    units = F.filter(F.array_distinct(F.concat(F.split("text", "\n"), pieces)), lambda x: x.rlike(pattern))
    units = near.select("key", F.explode(units).alias("text"))
    whole = files.where("is_file").select("key", "text")
    hits = cosines(units, headers, threshold).unionByName(cosines(whole, texts, threshold))
    best = hits.groupBy("key").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("h"))
    best = best.select("key", "h.license", "h.score")

    own = files.select("key", "is_file").join(best, "key", "left")
    slash = F.length("key.path") - F.length(F.substring_index("key.path", "/", -1)) - 1
    own = own.withColumn("dir", F.when(F.col("key.path").isNotNull(), F.substring(F.col("key.path"), F.lit(1), F.greatest(slash, F.lit(0)))))
    own = written(own.select("key", "is_file", "license", "score", "dir"), "license-own")
    found = inherited(own)
    return own.join(found, "dir", "left").select(
        F.col("key.id").alias(id_col), F.col("key.path").alias(path), "license", "score",
        F.coalesce("license", "dir_license").alias("effective_license"), F.when(F.col("license").isNull(), F.col("from_dir")).alias("inherited_from"),
    )


def inherited(own: DataFrame) -> DataFrame:
    """(dir, from_dir, dir_license) of every directory with a licence file in it or above it."""
    licensed = own.where("is_file and license is not null and dir is not null").groupBy("dir").agg(
        F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("dir_license"))
    licensed = licensed.select(F.col("dir").alias("from_dir"), "dir_license", F.xxhash64("dir").alias("h"))
    dirs = own.where("dir is not null").select("dir").distinct()
    # The hashes of all ancestors, the root (the empty path) first: eight bytes for each level.
    ups = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda i: F.xxhash64(F.call_function("substring_index", F.col("dir"), F.lit("/"), i)))
    above = dirs.select("dir", F.posexplode(ups).alias("depth", "h"))
    under = (F.col("dir") == F.col("from_dir")) | (F.col("from_dir") == "") | F.startswith("dir", F.concat("from_dir", F.lit("/")))
    nearest = above.join(licensed, "h").where(under).groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("n"))
    return written(nearest.select("dir", "n.from_dir", "n.dir_license"), "license-dirs")


def layout(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: source, then a folder for each of the id's thousands, hundreds and tens.

    Texts with an even id that speak of a licence are the licence files of the folder id / 2 modulo 4 levels down.
    """
    digit = lambda n: F.pmod(F.floor(F.col("doc_id") / n), F.lit(10)).cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    folders = F.array(F.coalesce("source", F.lit("none")), *(F.coalesce(digit(n), F.lit("x")) for n in (1000, 100, 10)))
    is_file = F.coalesce((F.col("doc_id") % 2 == 0) & F.col("text").rlike("(?i)licen[sc]e"), F.lit(False))
    depth = F.pmod(F.floor(F.col("doc_id") / 2), F.lit(4)).cast("int") + 1
    path = F.when(is_file, F.concat(F.array_join(F.slice(folders, F.lit(1), depth), "/"), F.lit("/LICENSE-"), name)).otherwise(F.concat(F.array_join(folders, "/"), F.lit("/"), name, F.lit(".txt")))
    return docs.select("doc_id", "text", path.alias("path"), is_file.alias("is_license_file"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(layout(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))
    return found.select("doc_id", "path", "license", F.round("score", 6).alias("score"), "effective_license", "inherited_from")


def op10_sql(headers: Templates = HEADERS, texts: Templates = TEXTS, threshold: float = THRESHOLD) -> str:
    """All units, without the triggers; ancestors by climbing."""

    def values(templates: Templates, kind: str) -> tuple[str, str, str]:
        idf, top, vectors = weights(templates)
        return ", ".join(f"('{kind}', '{t}', {w!r}::DOUBLE)" for t, w in sorted(idf.items())), ", ".join(
            f"('{kind}', {k}, '{n}', '{t}', {x!r}::DOUBLE)" for k, (n, v) in enumerate(vectors) for t, x in sorted(v.items())), f"('{kind}', {top!r}::DOUBLE)"

    (idf_h, uses_h, top_h), (idf_t, uses_t, top_t) = values(headers, "h"), values(texts, "t")
    return rf"""
WITH RECURSIVE idf(kind, term, idf) AS (VALUES {idf_h}, {idf_t}), uses(kind, k, license, term, x) AS (VALUES {uses_h}, {uses_t}), tops(kind, top) AS (VALUES {top_h}, {top_t}),
i AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
      coalesce(doc_id % 2 = 0 AND regexp_matches(text, '(?i)licen[sc]e'), false) AS is_file,
      [coalesce(source, 'none'), coalesce(CAST(doc_id // 1000 % 10 AS VARCHAR), 'x'), coalesce(CAST(doc_id // 100 % 10 AS VARCHAR), 'x'), coalesce(CAST(doc_id // 10 % 10 AS VARCHAR), 'x')] AS folders
      FROM documents),
d AS (SELECT rid, doc_id, text, is_file, array_to_string(CASE WHEN is_file THEN folders[1:CAST(doc_id // 2 % 4 + 1 AS INT)] ELSE folders END, '/') AS dir,
      CASE WHEN is_file THEN 'LICENSE-' || doc_id ELSE coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END AS name FROM i),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS t FROM d),
p AS (SELECT rid, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS t FROM d),
u AS (SELECT rid, 'h' AS kind, t, row_number() OVER () AS unit FROM (
      SELECT rid, t FROM l UNION ALL SELECT rid, unnest(regexp_split_to_array(t, '[.!?]+[ \t\r\n]+')) FROM p)
      UNION ALL SELECT rid, 't', text, -1 FROM d WHERE is_file),
tok AS (SELECT rid, kind, unit, trim(unnest(regexp_split_to_array(lower(t), '[^a-z0-9.+-]+')), '.+-') AS term FROM u),
tf AS (SELECT rid, kind, unit, term, count(*) AS n FROM tok WHERE term <> '' AND term NOT IN {STOP!r} GROUP BY ALL),
w AS (SELECT rid, kind, unit, term, n * coalesce(idf, top) AS w FROM tf JOIN tops USING (kind) LEFT JOIN idf USING (kind, term)),
nr AS (SELECT rid, kind, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dt AS (SELECT rid, kind, unit, k, license, sum(w * x) AS dot FROM w JOIN uses USING (kind, term) GROUP BY ALL),
sc AS (SELECT rid, license, round(dot / norm, 9) AS score FROM dt JOIN nr USING (rid, kind, unit)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, license) AS r FROM sc WHERE score >= {threshold}) WHERE r = 1),
own AS (SELECT d.*, license, score FROM d LEFT JOIN best USING (rid)),
ld AS (SELECT dir, license AS dir_license FROM (SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS r
       FROM own WHERE is_file AND license IS NOT NULL) WHERE r = 1),
climb AS (SELECT DISTINCT dir, dir AS up FROM d UNION ALL SELECT dir, CASE WHEN contains(up, '/') THEN regexp_replace(up, '/[^/]*$', '') ELSE '' END FROM climb WHERE up <> ''),
nearest AS (SELECT dir, up AS from_dir, dir_license FROM (SELECT climb.dir, up, dir_license, row_number() OVER (PARTITION BY climb.dir ORDER BY length(up) DESC) AS r FROM climb JOIN ld ON ld.dir = up) WHERE r = 1)
SELECT doc_id, dir || '/' || name AS path, license, round(score, 6) AS score, coalesce(license, dir_license) AS effective_license, CASE WHEN license IS NULL THEN from_dir END AS inherited_from
FROM own LEFT JOIN nearest USING (dir)
"""
