"""The pre-pass of the legacy encoder over matched chunks: what becomes of each, and the statistics of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGULAR, CLUSTER = 0.40, 0.60


def override(threshold: float | None, default: float = REGULAR) -> float:
    """A request's own threshold, if it is in (0, 1]."""
    return threshold if threshold is not None and 0 < threshold <= 1 else default


def fate(matched: Column, to_store: Column, is_rep: Column, n_diff: Column, size: int, regular: float = REGULAR, cluster: float = CLUSTER) -> Column:
    """``zero_ref``, ``empty`` (a new chunk, or no difference), ``diff``, or ``ejected`` (too many bytes differ, stored anew).

    Members of a group may differ in more bytes than others, as ejecting one adds to the store.
    """
    limit = F.when(is_rep, F.lit(int(size * regular))).otherwise(F.lit(int(size * cluster)))
    return F.when(~matched, "zero_ref").when(to_store, "empty").when(n_diff > limit, "ejected").when(n_diff == 0, "empty").otherwise("diff")


def statistics(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """Counters of (fate, n_diff), and the mean error over reused chunks with differences only."""
    diff = F.col("fate") == "diff"
    n, total = F.count_if(diff), F.sum(F.when(diff, F.col("n_diff")))
    counts = [F.count_if(F.col("fate") == x).alias(f"n_{x}") for x in ("zero_ref", "empty", "diff", "ejected")]
    return rows.groupBy(*by).agg(*counts, F.round(F.coalesce(F.try_divide(total, n * size), F.lit(0.0)), 6).alias("avg_error"))


def overlap(rows: DataFrame, size: int) -> DataFrame:
    """What a second reference would mend: of (n_best, n_both) bytes in which the best candidate, or both, differ."""
    n, best, both = F.count("*"), F.sum("n_best"), F.sum("n_both")
    percent = lambda x, y: F.round(F.coalesce(100 * F.try_divide(x, y), F.lit(0.0)), 4)
    return rows.agg(n.alias("n_chunks"), percent(best, n * size).alias("avg_error_best"), percent(both, n * size).alias("combined_error"), percent(best - both, best).alias("fixed_by_second"))


def representative_fates(rows: DataFrame, group: str, index: str, is_rep: str, stored: str) -> DataFrame:
    """(group, index, rep, kind): a group's members against its representative; where that is new and stored, it is
    ``self_fresh`` and its members ``rep_fresh``, else all are ``ref``. The representative is found by an aggregate."""
    rep = rows.where(F.col(is_rep)).groupBy(group).agg(F.min_by(F.struct(F.col(index).alias("rep"), F.col(stored).alias("fresh")), index).alias("r"))
    kind = F.when(~F.col("r.fresh"), "ref").when(F.col(index) == F.col("r.rep"), "self_fresh").otherwise("rep_fresh")
    return rows.join(rep, group).select(group, index, "r.rep", kind.alias("kind"))
