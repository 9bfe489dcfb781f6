"""Arrow UDFs over the byte kernels and formats, and their registration for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simstrata.functions import kernels


def _series(values: list, kind: str = "object") -> pd.Series:
    return pd.Series(values, dtype=kind)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def lsh_vector(chunk: pd.Series) -> pd.Series:
    """64 projections of each chunk; chunks of one length share a matrix product."""
    out: list = [None] * len(chunk)
    sizes = chunk.map(lambda x: len(x) if x is not None else -1)
    for size, rows in pd.Series(np.arange(len(chunk))).groupby(sizes.to_numpy()):
        if size > 0:
            block = np.frombuffer(b"".join(chunk.iloc[rows]), np.uint8).reshape(len(rows), size)
            for i, v in zip(rows, kernels.chunk_vectors(block), strict=True):
                out[i] = v
    return _series(out)


def lane_hashes_of(lanes: int):
    """A function that hashes ``lanes`` lanes of a chunk."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hashes(chunk: pd.Series) -> pd.Series:
        return _series([None if x is None else kernels.lane_hashes(x, lanes) for x in chunk])

    return hashes


lane_hashes = lane_hashes_of(kernels.LANES)


@F.pandas_udf(T.IntegerType())
def byte_hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    return _series([None if x is None or y is None else kernels.hamming(x, y) for x, y in zip(a, b, strict=True)], "Int32")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("off", T.IntegerType()), T.StructField("delta", T.IntegerType())])))
def byte_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """(offset, delta mod 256) that turn b into a."""
    pairs = ((None if x is None or y is None else kernels.diff(x, y)) for x, y in zip(a, b, strict=True))
    return _series([None if p is None else [{"off": int(o), "delta": int(d)} for o, d in zip(*p, strict=True)] for p in pairs])


@F.pandas_udf(T.BinaryType())
def byte_mask(a: pd.Series, b: pd.Series) -> pd.Series:
    """A bit for each byte, set where two chunks of one length differ; the lowest bit of a byte first."""
    pairs = ((None if x is None or y is None else np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)) for x, y in zip(a, b, strict=True))
    return _series([None if p is None else np.packbits(p, bitorder="little").tobytes() for p in pairs])


@F.pandas_udf(T.BinaryType())
def apply_diff(base: pd.Series, offsets: pd.Series, deltas: pd.Series) -> pd.Series:
    rows = zip(base, offsets, deltas, strict=True)
    return _series([None if b is None else kernels.patch(b, np.asarray(o, np.int64), np.asarray(d, np.int64)) for b, o, d in rows])


@F.pandas_udf(T.LongType())
def murmur3_32(key: pd.Series) -> pd.Series:
    there = key.notna()
    return _series(kernels.murmur3_many([x.encode() for x in key[there]]).tolist(), "Int64").set_axis(key.index[there]).reindex(key.index)


@F.pandas_udf(T.LongType())
def mix64(x: pd.Series) -> pd.Series:
    """Bit patterns in, bit patterns out."""
    return pd.Series(kernels.mix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.DoubleType())
def byte_entropy(chunk: pd.Series) -> pd.Series:
    return _series([None if x is None else kernels.entropy(x) for x in chunk], "float64")


@F.pandas_udf(T.BinaryType())
def zstd_compress(data: pd.Series, level: pd.Series) -> pd.Series:
    return _series([None if x is None else zstandard.ZstdCompressor(level=int(n)).compress(x) for x, n in zip(data, level, strict=True)])


@F.pandas_udf(T.BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    d = zstandard.ZstdDecompressor()
    return _series([None if x is None else d.decompressobj().decompress(x) for x in data])


_CCF = T.StructType(
    [T.StructField("version", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("n_chunks", "chunk_size", "n_zero", "n_exact", "n_diff")]
    + [T.StructField("n_errors", T.LongType()), T.StructField("trim", T.BinaryType()), T.StructField("sha256", T.StringType())]
)


@F.pandas_udf(_CCF)
def ccf_parse(blob: pd.Series) -> pd.DataFrame:
    from simstrata.sources import ccf

    rows = []
    for x in blob:
        p = ccf.parse(x)
        flags = np.bincount([f.flag for f in p.fates], minlength=3).tolist()
        rows.append((p.version, len(p.fates), p.chunk_size, *flags, sum(len(f.offsets) for f in p.fates if f.flag == ccf.DIFF), p.trim, p.sha256.hex()))
    return pd.DataFrame(rows, columns=_CCF.names)


@F.udtf(returnType=T.StructType([T.StructField("block_idx", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("original_len", T.LongType())]))
class ccf_blocks:  # noqa: N801
    """Table function: the blocks of a container."""

    def eval(self, blob: bytes):
        from simstrata.sources import ccf

        for i, (block, n) in enumerate(ccf.read_container(bytes(blob))[0]):
            yield i, block, n


ALL = {
    "lsh_vector": lsh_vector, "lane_hashes": lane_hashes, "byte_hamming": byte_hamming, "byte_diff": byte_diff, "byte_mask": byte_mask, "apply_diff": apply_diff,
    "murmur3_32": murmur3_32, "mix64": mix64, "byte_entropy": byte_entropy, "zstd_compress": zstd_compress, "zstd_decompress": zstd_decompress,
    "ccf_parse": ccf_parse,
}


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL."""
    for name, f in ALL.items():
        spark.udf.register(name, f)
    spark.udtf.register("ccf_blocks", ccf_blocks)
