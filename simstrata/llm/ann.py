"""Operator 8: approximate nearest neighbours by balanced posting lists.

There are ``LISTS`` times the square root of the number of distinct vectors lists, so the centroids, which the driver and
every task hold, and the length of a list both grow with the square root of the table. Centroids are found by
size-balanced spherical k-means in two levels on ``SAMPLE`` vectors a centroid, drawn by a hash (a documented sample;
every vector is indexed). A vector goes to the list of its nearest centroid and, if it lies at a boundary, to those of
up to ``REPLICAS`` centroids that aren't farther than ``SPREAD`` times the least distance. Nearest centroids are found by
a best-first search on a graph of the centroids in memory, for many points at once. A query reads the lists of the
centroids found that aren't farther than ``RATIO`` times its nearest one: few where vectors form clusters, very many
where they are isotropic; and more lists if these might hold fewer than ``k`` others. Lists are cut into pieces by a hash, so none is long. Candidates are scored by the exact cosine
of the original vectors in double precision, and a task returns at most ``k`` of a piece for each query.

Equal vectors are one entry with their ``k + 1`` least ids, which is exact, since of equal scores the smaller ids win:
a vector that a third of all rows share is one entry. The cosine of vectors of different lengths isn't defined. The
index holds those of the most common length; those of each other length make one list, which all queries of that length
read.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as
candidates nor as queries; ties go to the smaller id; a query's own id is never among its neighbours; rows that repeat
an id and a vector count once; with fewer than k candidates all are returned; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simstrata.llm.common import written

LISTS, SAMPLE, LIST_ROWS, QUERY_ROWS = 2.0, 16, 1024, 1024
REPLICAS, SPREAD, RATIO, DEGREE, BEAM = 4, 1.1, 1.3, 16, 8


def usable(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors as little-endian doubles, each with its ``k + 1`` least ids; equal ones meet map-side."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), strict=True):
                found.setdefault(v, []).append(i)
            ids = [sorted(set(x))[: k + 1] for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["v", "ids"])

    each = rows.select("id", "vector").mapInArrow(local, "v binary, ids array<long>")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return each.groupBy("v").agg(merged.alias("ids"))


def _bytes_of(column) -> list[bytes]:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype="<f8") + 0.0  # no negative zero
    ends = np.cumsum([len(x) for x in column])
    return [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(``n`` unit centroids at most, the one of each unit row); clusters over their share of rows are made to look farther."""
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    penalty, at = np.zeros(len(c)), np.zeros(len(x), np.int64)
    for _ in range(rounds):
        at = np.concatenate([(x[lo : lo + 2048] @ c.T - penalty).argmax(axis=1) for lo in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=len(c))
        empty = (size == 0) | (np.linalg.norm(sums, axis=1) < 1e-9)
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        penalty = 0.05 * np.clip(size / max(1e-9, len(x) / len(c)) - 1, -1, 2)
    return c, at


def centroids_of(sample: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """``n`` unit centroids at most: those of the square root of n clusters, each cut in proportion to its rows."""
    x, rng = _unit(sample), np.random.default_rng(seed)
    coarse, at = balanced_means(x, math.ceil(math.sqrt(n)), rng)
    parts = [x[at == k] for k in range(len(coarse))]
    return np.concatenate([balanced_means(p, max(1, round(n * len(p) / len(x))), rng)[0] for p in parts if len(p)])


class Graph:
    """Nearest-neighbour graph of the centroids, with a ring so that all are reached, and best-first search on it."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE) -> None:
        n = len(c)
        self.c = c
        near, degree = [], min(degree, max(1, n - 1))
        for lo in range(0, n, block := max(1, (1 << 22) // n)):
            s = c[lo : lo + block] @ c.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
            near.append(np.argpartition(-s, degree - 1, axis=1)[:, :degree])
        ring = ((np.arange(n)[:, None] + np.array([1, -1, n // 2, n // 3])) % n).astype(np.int64)
        self.near = np.concatenate([np.concatenate(near), ring], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Squared distances of unit rows to the visited centroids, infinite for the others.

        The nearest centroid that isn't expanded yet is expanded as long as it is one of the ``beam`` nearest found or
        within ``ratio`` of the nearest found.
        """
        n, m = len(self.c), len(x)
        beam = min(beam, n)
        d2, done, rows = np.full((m, n), np.inf), np.zeros((m, n), bool), np.arange(m)
        d2[:, self.entry] = 2 - 2 * x @ self.c[self.entry].T
        while True:
            own = d2[rows]
            bound = np.maximum(np.partition(own, beam - 1, axis=1)[:, beam - 1], ratio * ratio * np.maximum(own.min(axis=1), 1e-12))
            own[done[rows] | (own > bound[:, None])] = np.inf
            width = min(4, n)
            pick = np.argpartition(own, width - 1, axis=1)[:, :width]
            real = np.isfinite(np.take_along_axis(own, pick, axis=1))
            live = real.any(axis=1)
            if not live.any():
                break
            rows, pick, real, own = rows[live], pick[live], real[live], own[live]
            pick = np.where(real, pick, own.argmin(axis=1)[:, None])
            done[rows[:, None], pick] = True
            nearby = self.near[pick].reshape(len(rows), -1)
            d2[rows[:, None], nearby] = 2 - 2 * np.einsum("ijk,ik->ij", self.c[nearby], x[rows])
        return np.maximum(d2, 0)

    def lists(self, vectors: np.ndarray, ratio: float, most: int | None = None, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The lists of each vector by the distance ratio, nearest first, ``most`` at most (None: all); more of them
        where these hold under ``least`` entries by ``sizes``."""
        out: list[list[int]] = []
        for lo in range(0, len(vectors), block := max(1, min(512, (1 << 22) // len(self.c)))):
            x = _unit(vectors[lo : lo + block])
            for own, d2 in zip(x, self.search(x, ratio), strict=True):
                at = np.flatnonzero(d2 <= ratio * ratio * max(d2.min(), 1e-12))
                found = at[np.argsort(d2[at], kind="stable")][:most]
                if sizes is not None and sizes[found].sum() < least:
                    order = np.argsort(2 - 2 * self.c @ own, kind="stable")
                    found = order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1]
                out.append(found.tolist())
        return out


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", ratio: float = RATIO, replicas: int = REPLICAS, spread: float = SPREAD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row for which ``queries`` holds."""
    hits = _hits(df, queries, k, id_col, vector, ratio, replicas, spread)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed(df: DataFrame, queries: Column, k: int, id_col: str, vector: str, ratio: float, replicas: int, spread: float) -> tuple[DataFrame, DataFrame]:
    """((v, ids, list) of all vectors, (v, id, list) of the queries)."""
    spark = df.sparkSession
    rows = df.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), queries.alias("asks")).where("id is not null")
    entries = written(distinct_vectors(rows, k), "ann-entries")
    asked = rows.where("asks").select("id", "vector").dropDuplicates()

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bytes_of(batch.column(1)), pa.binary()), batch.column(0)], ["v", "id"])

    asked = asked.mapInArrow(binary, "v binary, id long")
    size = entries.groupBy(F.length("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        none = F.array(F.lit(0))
        return entries.select("v", "ids", F.explode(none).alias("list")), asked.select("v", "id", F.explode(none).alias("list"))
    n_lists = math.ceil(LISTS * math.sqrt(size.n))
    share = min(1.0, SAMPLE * n_lists / size.n)
    drawn = entries.where((F.length("v") == size.d) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30)))).select("v").collect()
    sample = sorted(bytes(r.v) for r in drawn) or [bytes(entries.where(F.length("v") == size.d).agg(F.min("v")).first()[0])]
    graph = Graph(centroids_of(_matrix(sample), n_lists))
    shared = spark.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_pylist()
            usual = [i for i, x in enumerate(v) if len(x) == size.d]
            lists = [[-len(x)] for x in v]  # those of other lengths
            for i, found in zip(usual, shared.value.lists(_matrix([v[i] for i in usual]), **how) if usual else [], strict=True):
                lists[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    posted = entries.mapInArrow(lambda b: assign(b, ratio=spread, most=replicas), "v binary, ids array<long>, lists array<int>")
    posted = written(posted.select("v", "ids", F.explode("lists").alias("list")), "ann-lists")
    sizes = np.zeros(len(graph.c), np.int64)  # a row for each list
    for r in posted.where("list >= 0").groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r.n
    # So many entries, each in up to ``replicas`` lists, hold k others for every query.
    asked = asked.mapInArrow(lambda b: assign(b, ratio=ratio, sizes=sizes, least=replicas * (k + 1)), "v binary, id long, lists array<int>")
    return posted, written(asked.select("v", "id", F.explode("lists").alias("list")), "ann-asked")


def _hits(df: DataFrame, queries: Column, k: int, id_col: str, vector: str, ratio: float, replicas: int, spread: float) -> DataFrame:
    posted, asked = indexed(df, queries, k, id_col, vector, ratio, replicas, spread)
    # A row per list: with the square root of the number of rows.
    size = lambda t, name, most: t.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cuts = F.broadcast(written(size(posted, "pieces", LIST_ROWS).join(size(asked, "lots", QUERY_ROWS), "list"), "ann-cuts"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(cuts, "list").withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).withColumn("lot", copies("lots"))
    right = asked.join(cuts, "list").withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")).withColumn("piece", copies("pieces"))

    def compare(asking: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(postings) and len(asking):
            p, ids = _matrix(postings["v"].tolist()), [np.asarray(x) for x in postings["ids"]]
            unit = _unit(p)
            for lo in range(0, len(asking), 256):
                some = asking.iloc[lo : lo + 256]
                q = _matrix(some["v"].tolist())
                s = _unit(q) @ unit.T
                # An entry may hold the query itself, so one more than k; what ties with these stays for the exact scores.
                least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if s.shape[1] > k + 1 else np.full(len(s), -np.inf)
                for i, own in enumerate(some["id"].tolist()):
                    at = np.flatnonzero(s[i] >= least[i] - 1e-9)
                    exact = cosines(q[i], p[at])
                    mine = np.concatenate([ids[j] for j in at])
                    scores = np.repeat(exact, [len(ids[j]) for j in at])[mine != own]
                    mine = mine[mine != own]
                    top = np.lexsort((mine, -scores))[:k]
                    found += [(own, y, x) for y, x in zip(mine[top].tolist(), scores[top].tolist(), strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["list", "piece", "lot"]
    pairs = right.select("id", "v", *keys).groupBy(*keys).cogroup(left.select("v", "ids", *keys).groupBy(*keys))
    return pairs.applyInPandas(compare, "query_id long, vec_id long, score double")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one vector with many; a pair's value doesn't depend on the others."""
    return (b * a).sum(axis=1) / (math.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
