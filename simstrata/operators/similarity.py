"""Sign signatures, multi-probe buckets and the similarity join over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from simstrata.sources.shared import materialised

#: Vectors of a block, and rows of a product that are worked on at once; how far single precision may be off; bits of
#: buckets that are compared in blocks.
PACK, SLICE, SLACK, FEW_BITS = 2048, 256, 1e-5, 16


def sign_bits(vec: str | Column) -> Column:
    """One character per component, '0' where it is negative."""
    return F.concat_ws("", F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: F.when(x < 0, "0").otherwise("1")))


def bucket_of(bits: str | Column) -> Column:
    """The bits as a BIGINT pattern, first character lowest."""
    return F.conv(F.reverse(bits), 2, -10).cast("long")


def bits_of(bucket: str | Column, n: int = 64) -> Column:
    """Inverse of ``bucket_of``."""
    return F.reverse(F.lpad(F.conv(F.col(bucket).cast("string") if isinstance(bucket, str) else bucket.cast("string"), 10, 2), n, "0"))


def routing_key(bucket: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(bucket)), 16, "0")


def probes(bucket: str, vec: str, n_bits: int) -> Column:
    """The bucket itself, then its one-bit neighbours, least certain component first."""
    ranked = F.array_sort(F.transform(F.slice(F.col(vec), 1, n_bits), lambda x, i: F.struct(F.abs(x).alias("a"), i.alias("i"))))
    flips = F.transform(ranked, lambda x: F.col(bucket).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.i)))
    return F.concat(F.array(F.col(bucket)), flips)


def signed(df: DataFrame, vec: str = "vec", n_bits: int = 64) -> DataFrame:
    """Adds ``bits`` and ``bucket_id`` of the first ``n_bits`` components."""
    return df.withColumn("bits", sign_bits(F.slice(F.col(vec).cast("array<double>"), 1, n_bits))).withColumn("bucket_id", bucket_of("bits"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, vec: str = "vec", name: str = "norm") -> DataFrame:
    return df.withColumn(name, F.sqrt(dot(vec, vec)))


def probe_join(queries: DataFrame, store: DataFrame, threshold: float, n_bits: int, k: int | None = None) -> DataFrame:
    """Pairs of ``queries`` (q_id, vec) and ``store`` (s_id, vec) in the same or a one-bit neighbour bucket, with cosine
    of at least ``threshold``: (q_id, s_id, similarity). With ``k``, at least the ``k`` best of each query are among them
    (ties to the smaller s_id), and others are left out where that saves rows.

    A few bits make few buckets, in which most of the work is products: these are made in blocks (see ``_compared``). Many
    bits make buckets that few share: those are matched by keys, and vectors are joined to the pairs.
    """
    if n_bits <= FEW_BITS:
        return _compared(_packs(queries, "q_id", PACK, n_bits), _packs(store, "s_id", PACK, n_bits), threshold, k)
    q, s = (signed(df, "vec", n_bits).select(i, "bucket_id") for df, i in ((queries, "q_id"), (store, "s_id")))
    near = near_buckets(q.select("bucket_id"), s.select("bucket_id"))
    pairs = near.join(q.withColumnRenamed("bucket_id", "q_bucket"), "q_bucket").join(s.withColumnRenamed("bucket_id", "s_bucket"), "s_bucket").select("q_id", "s_id")
    q_vec = with_norm(queries).where("norm > 0").select("q_id", F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    s_vec = with_norm(store).where("norm > 0").select("s_id", F.col("vec").alias("s_vec"), F.col("norm").alias("s_norm"))
    joined = pairs.join(q_vec, "q_id").join(s_vec, "s_id")
    scored = joined.select("q_id", "s_id", (dot("q_vec", "s_vec") / (F.col("q_norm") * F.col("s_norm"))).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def near_buckets(queries: DataFrame, store: DataFrame) -> DataFrame:
    """(q_bucket, s_bucket): the distinct buckets (bucket_id) of both that are equal or differ in one bit.

    Such a pair agrees in seven of eight bytes. So a bucket has nine keys, itself and without each of its bytes, where
    probes would need one for every bit. Each pair meets at one key.
    """
    byte = lambda p: F.lit(255).cast("long") if p == 0 else F.call_function("shiftleft", F.lit(255).cast("long"), F.lit(8 * p))
    kept = [F.struct(F.lit(-1).alias("p"), F.col("bucket_id").alias("key"))]
    kept += [F.struct(F.lit(p).alias("p"), F.col("bucket_id").bitwiseAND(F.bitwise_not(byte(p))).alias("key")) for p in range(8)]
    keyed = lambda df, name: df.distinct().select(F.col("bucket_id").alias(name), F.explode(F.array(*kept)).alias("k")).select(name, "k.*")
    x = F.col("q_bucket").bitwiseXOR(F.col("s_bucket"))
    met = keyed(queries, "q_bucket").join(keyed(store, "s_bucket"), ["p", "key"])
    return met.where(F.bit_count(x) == F.when(F.col("p") < 0, 0).otherwise(1)).select("q_bucket", "s_bucket")


def exact_join(queries: DataFrame, store: DataFrame, threshold: float, block: int = PACK, k: int | None = None) -> DataFrame:
    """As ``probe_join``, but of all pairs: every block of queries meets every block of the store in matrix products.

    Work grows with the product of the two sizes; no pair is left out. Vectors of other lengths don't meet.
    """
    return _compared(_packs(queries, "q_id", block), _packs(store, "s_id", block), threshold, k)


def _packs(df: DataFrame, id_col: str, rows: int, n_bits: int | None = None) -> DataFrame:
    """Vectors in blocks of ``rows`` of one length: (key, size, reach, ids, buckets, norms, vecs), as a table; ``reach``
    has the buckets that occur. With ``n_bits`` rows lie by bucket, so that blocks have few."""
    kind = dict(df.dtypes)[id_col]
    held = df.withColumn("vec", F.col("vec").cast("array<double>"))
    held = (signed(held, "vec", n_bits) if n_bits else held.withColumn("bucket_id", F.lit(0).cast("long"))).select(F.col(id_col).alias("id"), "bucket_id", "vec")
    held = with_norm(held).where("norm > 0")
    parts = max(1, min(-(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n_bits:
        held = held.repartitionByRange(parts, "bucket_id", F.xxhash64("id")).sortWithinPartitions("bucket_id")
    else:
        held = held.repartition(parts, F.xxhash64("id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        made = TaskContext.get().partitionId() << 32

        def blocks(size: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            whole = pa.Table.from_batches(waiting[size])
            while whole.num_rows >= least and whole.num_rows:
                part, whole = whole.slice(0, rows), whole.slice(rows)
                ids, (buckets, norms) = part.column(0).combine_chunks(), (part.column(c).to_numpy() for c in (1, 3))
                one = [pa.array([made], pa.int64()), pa.array([size], pa.int32()), pa.array([np.unique(buckets).tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(ids)], ids)]
                one += [pa.array([x.tobytes()], pa.binary()) for x in (buckets, norms, part.column(2).combine_chunks().flatten().to_numpy())]
                yield pa.RecordBatch.from_arrays(one, ["key", "size", "reach", "ids", "buckets", "norms", "vecs"])
                made += 1
            waiting[size] = whole.to_batches()

        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(sizes).tolist():
                waiting.setdefault(size, []).append(batch.filter(pa.array(sizes == size)))
                if sum(b.num_rows for b in waiting[size]) >= rows:
                    yield from blocks(size, rows)
        for size in [x for x, left in waiting.items() if left]:
            yield from blocks(size, 1)

    return materialised(held.mapInArrow(pack, f"key long, size int, reach array<long>, ids array<{kind}>, buckets binary, norms binary, vecs binary"), "packs")


class _Block:
    """Vectors of a block, also scaled to length 1 in single precision; vectors that can't be scaled are NaN there."""

    def __init__(self, size: int, ids: pa.Array, buckets: pa.Buffer, norms: pa.Buffer, vecs: pa.Buffer) -> None:
        self.ids, self.buckets, self.norms = ids, np.frombuffer(buckets, np.int64), np.frombuffer(norms, np.float64)
        rows = np.frombuffer(vecs, np.float64).reshape(-1, size)
        usable = np.isfinite(self.norms) & (self.norms > 1e-140)
        self.by_place = np.ascontiguousarray(rows.T)
        self.unit = np.where(usable[:, None], rows / np.where(usable, self.norms, 1)[:, None], np.nan).astype(np.float32)
        self.whole = bool(np.isfinite(self.unit).all())


def _near(a: _Block, b: _Block, low: np.ndarray, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in neighbouring buckets whose cosine may be ``low`` or more, by query; with ``k`` only those that may
    be among a query's ``k`` best here. Single precision is wrong by less than ``SLACK``."""
    for at in range(0, len(a.norms), SLICE):
        cosine = a.unit[at : at + SLICE] @ b.unit.T
        fits = cosine >= (low[at : at + SLICE] - SLACK)[:, None].astype(np.float32)
        if not (a.whole and b.whole):
            fits |= np.isnan(cosine)
        if k and k < len(b.norms) and np.count_nonzero(fits) > 4 * k * len(cosine):
            x = a.buckets[at : at + SLICE, None].astype(np.uint16) ^ b.buckets.astype(np.uint16)
            own = np.where(fits & (x & (x - np.uint16(1)) == 0), np.where(np.isnan(cosine), np.float32(np.inf), cosine), np.float32(-np.inf))
            kth = np.partition(own, -k, axis=1)[:, -k] - np.float32(2 * SLACK)
            i, j = np.divmod(np.flatnonzero((own >= kth[:, None]) & (own > -np.inf)), len(b.norms))
        else:
            i, j = np.divmod(np.flatnonzero(fits), len(b.norms))
            x = a.buckets[at + i] ^ b.buckets[j]
            one = x & (x - 1) == 0
            i, j = i[one], j[one]
        if len(i):
            yield at + i, j


def _cosines(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In double precision, added up place by place as SQL does it, so equal vectors have equal cosines."""
    total = np.zeros(len(i))
    for x, y in zip(a.by_place, b.by_place, strict=True):
        total += x[i] * y[j]
    with np.errstate(all="ignore"):
        return total / (a.norms[i] * b.norms[j])


def _best(i: np.ndarray, ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each ``i``, in order; NaN is the largest, ties go to the smaller id."""
    order = np.lexsort((ids, np.where(np.isnan(similarity), -np.inf, -similarity), i))
    own = i[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _compared(queries: DataFrame, store: DataFrame, threshold: float, k: int | None) -> DataFrame:
    """(q_id, s_id, similarity) over all blocks of both that may hold neighbours.

    Blocks are read from their tables by the tasks that compare them, so nothing is shuffled, and a task holds two blocks
    and a slice of their product. With ``k`` a task keeps the best of a block of queries over all blocks of the store that
    it reads; those tasks are as many as the store's table has splits.
    """
    q_kind, s_kind = (dict(df.dtypes)["ids"].removeprefix("array<")[:-1] for df in (queries, store))
    a, b = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for df, side in ((queries, "q"), (store, "s")))
    # Not an equality of two columns, for which Spark would shuffle.
    meets = F.expr("q_size - s_size = 0 and exists(q_reach, x -> exists(s_reach, y -> bit_count(x ^ y) <= 1))")
    columns = [f"{side}_{c}" for side in "qs" for c in ("key", "size", "ids", "buckets", "norms", "vecs")]
    out = to_arrow_schema(StructType.fromDDL(f"q_id {q_kind}, s_id {s_kind}, similarity double"))
    text = pa.types.is_string(out.types[1])

    def block(batch: pa.RecordBatch, row: int, first: int) -> _Block:
        return _Block(batch.column(first + 1)[row].as_py(), batch.column(first + 2)[row].values, *(batch.column(first + c)[row].as_buffer() for c in (3, 4, 5)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, low, held, count = None, None, None, [], 0

        def trimmed() -> None:
            nonlocal held, count
            i, ids, similarity = (np.concatenate(x) for x in zip(*held, strict=True))
            best = _best(i, ids, similarity, k)
            held, count = [(i[best], ids[best], similarity[best])], len(best)
            full = np.flatnonzero(np.r_[np.diff(held[0][0]) != 0, True])  # the last of each query, if it has k
            full = full[np.searchsorted(held[0][0], held[0][0][full]) == full - k + 1]
            kth = held[0][2][full]
            low[held[0][0][full]] = np.where(np.isnan(kth), np.inf, np.maximum(kth, threshold))

        def kept() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if held:
                trimmed()
                i, ids, similarity = held[0]
                s_id = pa.array([x.decode() for x in ids.tolist()], out.types[1]) if text else pa.array(ids, out.types[1])
                yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), s_id, pa.array(similarity)], schema=out)
            held, count = [], 0

        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() != key:
                    yield from kept()
                    key, own = batch.column(0)[row].as_py(), block(batch, row, 0)
                    low = np.full(len(own.norms), float(threshold))
                other = block(batch, row, 6)
                ids = None
                for i, j in _near(own, other, low, k):
                    similarity = _cosines(own, other, i, j)
                    good = ~(similarity < threshold)
                    i, j, similarity = i[good], j[good], similarity[good]
                    if k is None:
                        yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), other.ids.take(pa.array(j)), pa.array(similarity)], schema=out)
                        continue
                    if ids is None:
                        ids = np.array([x.encode() for x in other.ids.to_pylist()]) if text else other.ids.to_numpy()
                    held.append((i, ids[j], similarity))
                    count += len(i)
                    if count > 4 * k * len(low) + (1 << 18):
                        trimmed()
                if held and (count > 2 * k * len(low) or (low == threshold).any()):
                    trimmed()
        if k is not None:
            yield from kept()

    return a.join(b, meets).select(*columns).mapInArrow(compare, f"q_id {q_kind}, s_id {s_kind}, similarity double")


def top_k(matches: DataFrame, k: int, by: str = "q_id", other: str = "s_id") -> DataFrame:
    """The ``k`` most similar per query, ties to the smaller id; ``rnk`` from 1. Spark trims each task's groups first."""
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), other)
    return matches.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def best_match(matches: DataFrame, by: str = "q_id", other: str = "s_id") -> DataFrame:
    best = F.min_by(F.struct(other, "similarity"), F.struct(-F.col("similarity"), F.col(other)))
    return matches.groupBy(by).agg(best.alias("b")).select(by, f"b.{other}", "b.similarity")


def with_default(queries: DataFrame, best: DataFrame, by: str = "q_id", other: str = "s_id") -> DataFrame:
    """Every query; ``fresh`` where nothing matched."""
    return queries.select(by).join(best, by, "left").withColumn("fresh", F.col(other).isNull())


def representatives(df: DataFrame, id_col: str, vec: str, group: str) -> DataFrame:
    """(group, members, rep): the member with the least L1 distance to its group's mean, ties to the smaller id.

    The means are made by partial sums per component, and only the distances meet again: no group is gathered.
    """
    spread = df.select(group, id_col, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    means = spread.groupBy(group, "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centre"))
    gaps = F.zip_with(F.col(vec).cast("array<double>"), F.col("centre"), lambda a, b: F.abs(a - b))
    far = df.join(centre, group).select(group, id_col, F.round(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x), 9).alias("far"))
    return far.groupBy(group).agg(F.count("*").alias("members"), F.min_by(id_col, F.struct("far", id_col)).alias("rep"))
