"""Byte differences as rows: gaps, runs, classes and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_rows(pairs: DataFrame, key: list[str], new: str = "chunk", base: str = "base") -> DataFrame:
    """(*key, off, delta): the bytes in which two chunks of one length differ. A narrow step."""
    at = lambda c: F.conv(F.hex(F.expr(f"substring({c}, off + 1, 1)")), 16, 10).cast("int")
    spots = pairs.where(F.length(new) == F.length(base)).where(F.length(new) > 0)
    spread = spots.select(*key, new, base, F.explode(F.sequence(F.lit(0), F.length(new) - 1)).alias("off"))
    return spread.where(F.expr(f"substring({new}, off + 1, 1) != substring({base}, off + 1, 1)")).select(*key, "off", (at(new) - at(base)).alias("delta"))


def gaps(diffs: DataFrame, key: list[str]) -> DataFrame:
    """Offsets as distances from the one before; the first is absolute."""
    w = Window.partitionBy(*key).orderBy("off")
    return diffs.withColumn("gap", F.col("off") - F.coalesce(F.lag("off").over(w), F.lit(0)))


def from_gaps(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Inverse of ``gaps``."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("off", F.sum("gap").over(w))


def runs(diffs: DataFrame, key: list[str]) -> DataFrame:
    """(*key, start, len, delta): runs of neighbouring bytes with one delta (gaps and islands)."""
    w = Window.partitionBy(*key, "delta").orderBy("off")
    island = F.col("off") - F.row_number().over(w)
    return diffs.withColumn("__i", island).groupBy(*key, "delta", "__i").agg(F.min("off").alias("start"), F.count("*").alias("len")).drop("__i")


def literal_runs(diffs: DataFrame, key: list[str], size: int) -> DataFrame:
    """Contiguous offsets of 4 to 255 bytes that are cheap enough to write out: 7 + len < size / 8."""
    w = Window.partitionBy(*key).orderBy("off")
    rows = diffs.withColumn("__i", F.col("off") - F.row_number().over(w)).groupBy(*key, "__i").agg(F.min("off").alias("start"), F.count("*").alias("len"))
    return rows.where((F.col("len") >= 4) & (F.col("len") <= 255) & (7 + F.col("len") < size / 8)).drop("__i")


def column_runs(values: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(*by, first, len, step, savings): maximal arithmetic runs (step 0: constant) of at least three neighbours.

    Neighbouring differences are compared, so a run never mixes steps.
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    rows = values.withColumn("__step", F.when(F.col(order) - F.lag(order).over(w) == 1, step))
    changed = F.when(F.col("__step").eqNullSafe(F.lag("__step").over(w)) & F.col("__step").isNotNull(), 0).otherwise(1)
    rows = rows.withColumn("__c", changed).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where("__step is not null").groupBy(*by, "__run", F.col("__step").alias("step")).agg((F.min(order) - 1).alias("first"), (F.count("*") + 1).alias("len"))
    savings = 5 * F.col("len") - F.when(F.col("step") == 0, 9).otherwise(10)
    return found.where("len >= 3").withColumn("savings", savings).drop("__run")


def _spans(kind: str, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, delta) of the differences of a matrix, one row per chunk.

    ``runs``: neighbours with one delta; ``literals``: neighbours with any; ``gaps``: every difference by itself, its
    length being the distance from the one before.
    """
    n, size = delta.shape
    row, off = np.nonzero(delta)
    value = delta[row, off]
    joins = np.zeros(len(row), bool)
    if len(row) > 1:
        joins[1:] = (row[1:] == row[:-1]) & (off[1:] == off[:-1] + 1)
        if kind == "runs":
            joins[1:] &= value[1:] == value[:-1]
    if kind == "gaps":
        same = np.r_[False, row[1:] == row[:-1]][: len(row)]
        return row, off, off - np.where(same, np.r_[0, off[:-1]][: len(row)], 0), value
    starts = np.flatnonzero(~joins)
    return row[starts], off[starts], np.diff(np.r_[starts, len(row)]), value[starts]


def spans(pairs: DataFrame, kind: str, new: str = "chunk", base: str = "base") -> DataFrame:
    """(start, len, delta) of all differences between chunks of one length, by kind (see above). A narrow step: all of a
    chunk's bytes are in its row, so nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (0, 1))
            for size in sorted({len(a) for a in x}):
                own = [(a, b) for a, b in zip(x, y, strict=True) if len(a) == size]
                for lo in range(0, len(own), step := max(1, (1 << 20) // size)):
                    a, b = (np.frombuffer(b"".join(p[k] for p in own[lo : lo + step]), np.uint8).reshape(-1, size).astype(np.int16) for k in (0, 1))
                    _, start, length, delta = _spans(kind, a - b)
                    yield pa.RecordBatch.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(delta, pa.int32())], ["start", "len", "delta"])

    usable = pairs.where((F.length(new) == F.length(base)) & (F.length(new) > 0))
    return usable.select(new, base).mapInArrow(work, "start int, len int, delta int")


def bloat_class(n_diff: str | Column, size: int, limit: float = 0.40) -> Column:
    """``exact``, ``diff``, ``tight`` (within the share, but its diff takes more bytes than the chunk) or ``bloated``."""
    n = F.col(n_diff) if isinstance(n_diff, str) else n_diff
    return F.when(n == 0, "exact").when(n > limit * size, "bloated").when(2 + 4 * n >= size, "tight").otherwise("diff")


def error_bin(n_diff: str | Column, size: int) -> Column:
    n = F.col(n_diff) if isinstance(n_diff, str) else n_diff
    return F.least(F.lit(9), F.floor(10 * n / size)).cast("int")
