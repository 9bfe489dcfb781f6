"""Chunks of payloads: split, trim, windows, zero test, content address, entropy, and first owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payloads(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(file_id, bytes) of a text column; null texts are empty."""
    return df.select(F.col(id_col).alias("file_id"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("bytes"))


def chunks(files: DataFrame, size: int, *keep: str) -> DataFrame:
    """(file_id, chunk_idx, chunk, *keep): the whole chunks; what is left over is the trim. A narrow step, no shuffle."""
    spots = F.sequence(F.lit(0), (F.length("bytes") / size).cast("int") - 1)
    found = files.where(F.length("bytes") >= size).select("file_id", *keep, "bytes", F.explode(spots).alias("chunk_idx"))
    return found.select("file_id", "chunk_idx", F.expr(f"substring(bytes, chunk_idx * {size} + 1, {size})").alias("chunk"), *keep)


def trims(files: DataFrame, size: int) -> DataFrame:
    """(file_id, trim)."""
    return files.select("file_id", F.expr(f"substring(bytes, length(bytes) div {size} * {size} + 1, {size})").alias("trim"))


def windows(files: DataFrame, size: int) -> DataFrame:
    """(file_id, block_idx, block): windows of ``size`` bytes, the last may be short; an empty file has one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.length("bytes") / size).cast("int") - 1)
    found = files.select("file_id", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("block_idx"))
    return found.select("file_id", "block_idx", F.expr(f"substring(bytes, block_idx * {size} + 1, {size})").alias("block"))


def frames(files: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(file_id, seq, data, eof): ``windows`` as frames of a stream."""
    last = F.greatest(F.lit(0), F.ceil(F.length("bytes") / size).cast("int") - 1)
    cut = files.select("file_id", "bytes", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    return cut.select("file_id", "seq", F.expr(f"substring(bytes, seq * {size} + 1, {size})").alias("data"), (F.col("seq") == F.col("last")).alias("eof"))


def guid(chunk: str = "chunk") -> Column:
    return F.sha2(F.col(chunk), 256)


def is_zero(chunk: str = "chunk") -> Column:
    return F.expr(f"{chunk} = cast(unhex(repeat('00', length({chunk}))) as binary)")


def byte_counts(rows: DataFrame, key: list[str], chunk: str = "chunk") -> DataFrame:
    """(*key, byte, n): bytes by value, by way of two hex digits each."""
    digits = F.expr(f"transform(sequence(1, length({chunk})), i -> hex(substring({chunk}, i, 1)))")
    spread = rows.where(F.length(chunk) > 0).select(*key, F.explode(digits).alias("h"))
    return spread.groupBy(*key, "h").agg(F.count("*").alias("n")).select(*key, F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def entropies(rows: DataFrame, key: list[str], chunk: str = "chunk") -> DataFrame:
    """(*key, entropy): Shannon entropy of each key's bytes."""
    counted = byte_counts(rows, key, chunk)
    # -sum(p log p) in one pass: log N - sum(n log n) / N.
    total = F.sum("n")
    return counted.groupBy(*key).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def owners(rows: DataFrame, size: int) -> DataFrame:
    """(guid, file_id, chunk_idx, refs, bytes_saved): who stores a chunk first; all its other places are references."""
    keyed = rows.select(guid().alias("guid"), F.struct("file_id", "chunk_idx").alias("at"))
    grouped = keyed.groupBy("guid").agg(F.min("at").alias("at"), (F.count("*") - 1).alias("refs"))
    return grouped.select("guid", "at.file_id", "at.chunk_idx", "refs", (F.col("refs") * size).alias("bytes_saved"))


def dedup_report(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """(*by, n_chunks, n_unique, n_zero, bytes_saved), by way of one row per guid."""
    per = rows.select(*by, guid().alias("guid"), is_zero().alias("zero")).groupBy(*by, "guid").agg(F.count("*").alias("n"), F.any_value("zero").alias("zero"))
    saved = (F.sum("n") - F.count("*")) * size
    return per.groupBy(*by).agg(
        F.sum("n").alias("n_chunks"), F.count("*").alias("n_unique"), F.sum(F.when(F.col("zero"), F.col("n")).otherwise(0)).alias("n_zero"), saved.alias("bytes_saved")
    )


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Zero-based numbers within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
