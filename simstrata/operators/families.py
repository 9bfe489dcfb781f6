"""Families of similar files, their packs, and consolidation of families that are scattered over packs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from simstrata.functions import udfs
from simstrata.sources import ccf
from simstrata.sources.shared import materialised

I_FRAME, P_FRAME, KEEP_BELOW, MIN_FAMILY = 0, 1, 0.85, 3
#: Bytes of frames that a task holds before it hands them on.
FRAME_BYTES = 4 << 20


def exact_families(files: DataFrame, refs: str = "refs") -> DataFrame:
    """(family, members): files with equal references, more than one."""
    return files.groupBy(F.sha2(refs, 256).alias("family")).agg(F.count("*").alias("members")).where("members > 1")


#: Fixed value: the seed of the one band.
FAMILY_SEED = 0x9E3779B185EBCA87


def minhash_families(refs: DataFrame, exact: DataFrame | None = None, seed: int = FAMILY_SEED) -> DataFrame:
    """(file_id, family): ``ov:`` and the least mixed hash over a file's distinct buckets that aren't 0; for files without
    one ``exact:`` and the SHA-256 of their references, from ``exact`` (file_id, sha), else that of no references. The
    minimum is made by partial aggregation."""
    signed = seed - (1 << 64) if seed >> 63 else seed
    mixed = refs.where("bucket_id is not null and bucket_id != 0").select("file_id", udfs.mix64(F.col("bucket_id").bitwiseXOR(F.lit(signed))).alias("h"))
    # Minimum of unsigned values: flip the sign bit.
    least = mixed.groupBy("file_id").agg(F.min(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("m"))
    named = least.select("file_id", F.concat(F.lit("ov:"), F.lpad(F.lower(F.hex(F.col("m").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")).alias("family"))
    found = refs.select("file_id").distinct().join(named, "file_id", "left")
    none = F.sha2(F.lit(b""), 256)
    if exact is not None:
        found, none = found.join(exact.select("file_id", "sha"), "file_id", "left"), F.coalesce("sha", none)
    return found.select("file_id", F.coalesce("family", F.concat(F.lit("exact:"), none)).alias("family"))


def catalog(refs: DataFrame, position: str = "pos") -> DataFrame:
    """(bucket_id, chunk_id, idx): dense numbers of distinct references by first appearance.

    The numbers are built from counts per range of positions, so no task holds the whole catalog. The ranges are written
    once, as both branches must see the same.
    """
    first = refs.groupBy("bucket_id", "chunk_id").agg(F.min(position).alias("first"))
    part = first.repartitionByRange("first", "bucket_id", "chunk_id").withColumn("part", F.spark_partition_id())
    part = materialised(part, "catalog")
    own = part.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("first", "bucket_id", "chunk_id")))
    before = part.groupBy("part").agg(F.count("*").alias("size"))
    start = before.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(start.select("part", "start")), "part").select("bucket_id", "chunk_id", (F.col("start") + F.col("n") - 1).alias("idx"))


def decoded(encoded: DataFrame, named: DataFrame) -> DataFrame:
    """References by their numbers in the catalog."""
    return encoded.join(named.select("idx", "bucket_id", "chunk_id"), "idx")


def source_packs(entries: DataFrame, most: int = 2) -> DataFrame:
    """(family, pack_id, n, rnk): of each scattered family the ``most`` packs that hold most of its members."""
    per = entries.groupBy("family", "pack_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "pack_id")
    ranked = per.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= most)
    return ranked.join(scattered(entries).select("family"), "family", "left_semi")


def frames(entries: DataFrame, keep_below: float = KEEP_BELOW) -> DataFrame:
    """Entries (file_id, family, blob) as (file_id, family, frame_type, base_id, data).

    A family's longest blob (ties to the smallest id) is its base; others become differences against it where these
    take less than ``keep_below`` of the blob and rebuild it exactly. Members are joined to their base, not gathered.
    """
    kind = dict(entries.dtypes)["file_id"]
    base = entries.groupBy("family").agg(F.min_by(F.struct("file_id", F.col("blob").alias("base")), F.struct(-F.length("blob"), F.col("file_id"))).alias("b"))
    paired = entries.join(base, "family").select("file_id", "family", "blob", F.col("b.file_id").alias("base_id"), "b.base")

    schema = f"file_id {kind}, family string, frame_type int, base_id {kind}, data binary, raw_len long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
        for batch in batches:
            for row in range(batch.num_rows):  # a row's bytes at a time, and a few MB of answers
                file_id, family, blob, base_id, base = (c[row].as_py() for c in batch.columns)
                data, is_p = blob, False
                if file_id != base_id:
                    p = ccf.p_frame(blob, base)
                    if len(p) < keep_below * len(blob) and ccf.from_p_frame(p, base) == blob:
                        data, is_p = p, True
                out.append((file_id, family, P_FRAME if is_p else I_FRAME, base_id if is_p else None, data, len(blob)))
                size += len(data)
                if len(out) == 1000 or size > FRAME_BYTES:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    return paired.mapInArrow(build, schema)


def unframed(packed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(file_id, blob): P-frames rebuilt from their bases; ``ids`` restricts the files."""
    wanted = packed if ids is None else packed.join(ids, "file_id", "left_semi")
    bases = packed.where(F.col("frame_type") == I_FRAME).select(F.col("file_id").alias("base_id"), F.col("data").alias("base"))

    @F.pandas_udf("binary")
    def rebuilt(data: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([bytes(d) if b is None else ccf.from_p_frame(bytes(d), bytes(b)) for d, b in zip(data, base, strict=True)], dtype=object)

    return wanted.join(bases, "base_id", "left").select("file_id", rebuilt("data", "base").alias("blob"))


def savings(packed: DataFrame) -> DataFrame:
    """(entries, p_frames, raw_bytes, stored_bytes, ratio)."""
    raw, stored = F.sum("raw_len"), F.sum(F.length("data"))
    return packed.agg(F.count("*").alias("entries"), F.count_if(F.col("frame_type") == P_FRAME).alias("p_frames"), raw.alias("raw_bytes"), stored.cast("long").alias("stored_bytes"), F.round(F.try_divide(stored, raw), 6).alias("ratio"))


def write_packs(packed: DataFrame, path: str) -> None:
    """Packs as a table partitioned by a hash of the family, so a base lies with its members and reads prune."""
    packed.withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(64)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("file_id"), F.lit(8))).write.partitionBy("bucket").parquet(path)


def scattered(entries: DataFrame, min_members: int = MIN_FAMILY) -> DataFrame:
    """(family, members, packs): families of at least ``min_members`` that lie in more than one pack, largest first."""
    found = entries.groupBy("family").agg(F.count("*").alias("members"), F.count_distinct("pack_id").alias("packs"))
    return found.where((F.col("members") >= min_members) & (F.col("packs") > 1)).orderBy(F.desc("members"), "family")


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The prefix of each group, in order, whose running size stays within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def train_dictionary(samples: list[bytes], size: int = 64 << 10, least: int = 10) -> bytes | None:
    """A zstd dictionary of a bounded sample; None for fewer than ``least`` samples or if training fails."""
    import zstandard

    if len(samples) < least:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def sample_for_dictionary(entries: DataFrame, n: int = 500, seed: int = 0x5EED5) -> list[bytes]:
    """``n`` blobs by a seeded hash of their ids: a sampling operator with a fixed bound."""
    rows = entries.select("blob", F.xxhash64("file_id", F.lit(seed)).alias("h")).orderBy("h").limit(n).collect()
    return [bytes(r.blob) for r in rows]


def fit_stream(values: np.ndarray, hidden: int = 24, rounds: int = 2000, rate: float = 0.01, seed: int = 1) -> tuple[bytes, tuple[float, ...], bytes] | None:
    """A small neural model of a byte stream: position in, value out, one ReLU layer, 8-bit weights with a scale for each
    of the four groups of weights.

    Returns (weights, scales, residuals mod 256); None for fewer than 32 values or if under a fifth is predicted exactly.
    """
    n = len(values)
    if n < 32:
        return None
    x = np.linspace(0, 1, n)[:, None]
    y = values.astype(np.float64)[:, None] / 255
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1, (1, hidden)), rng.normal(0, 0.5, hidden), np.zeros((hidden, 1)), np.full(1, y.mean())]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        z = x @ p[0] + p[1]
        a = np.maximum(z, 0)
        e = (a @ p[2] + p[3] - y) * (2 / n)
        back = (e @ p[2].T) * (z > 0)
        for i, g in enumerate((x.T @ back, back.sum(0), a.T @ e, e.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p[i] = p[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    scales = tuple(127 / max(1e-9, float(np.abs(a).max())) for a in p)
    weights = np.concatenate([np.round(a.ravel() * s) for a, s in zip(p, scales, strict=True)]).astype(np.int8)
    residuals = values.astype(np.uint8) - _predict(weights, scales, n, hidden)
    return (weights.tobytes(), scales, residuals.tobytes()) if np.count_nonzero(residuals == 0) * 5 >= n else None


def _predict(weights: np.ndarray, scales: tuple[float, ...], n: int, hidden: int) -> np.ndarray:
    a, b, c, d = (w / s for w, s in zip(np.split(weights.astype(np.float64), [hidden, 2 * hidden, 3 * hidden]), scales, strict=True))
    y = np.maximum(np.linspace(0, 1, n)[:, None] * a + b, 0) @ c + d
    return np.clip(np.round(y * 255), 0, 255).astype(np.uint8)


def restore_stream(weights: bytes, scales: tuple[float, ...], residuals: bytes, hidden: int = 24) -> bytes:
    r = np.frombuffer(residuals, np.uint8)
    return (r + _predict(np.frombuffer(weights, np.int8), scales, len(r), hidden)).tobytes()
