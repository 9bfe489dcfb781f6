"""Operator 6: conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

A document takes its words and one end. Longer documents are cut into whole bins and a rest; the rest is packed as an
item. A bin never holds two items of the same duplicate cluster (by default texts equal but for case and white space;
``items_of`` also takes the classes of the near-duplicate operator, which cost more than packing itself), and at most
``max_per_source`` items of a source. Every open bin carries a bitmap of the clusters and counts of the sources it
holds, open bins are ordered by what is left in them, and for each item (largest first) the search goes from the
smallest bin that has room to its successors until a compatible one is found: the tightest compatible bin. If there is
none, the item opens a new bin.

Items are dealt to shards of about ``shard_rows`` items by a hash of id, source, cluster, length and a number among
equal items, and each shard is packed by itself: the tightest compatible bin is that of the shard. So shards are of the
same size however many rows are alike, and only ids and lengths are shuffled, not texts. ``shard_rows`` bounds the memory and the time of a task; the number of shards follows the number
of rows. No row is dropped.

Defined cases: null and empty texts take one word (the end); a null source is a source of its own; ties go to the
smaller id, then the smaller piece; repeated rows are items of the same cluster, so they go to different bins; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import WS, written

CAPACITY, MAX_PER_SOURCE, SHARD_ROWS = 4096, 4, 4096
SCHEMA = "doc_id long, piece int, start long, n_words long, bin_id string, bin_offset long"


class Bin:
    __slots__ = ("clusters", "name", "order", "room", "sources", "used")

    def __init__(self, name: str, order: int, capacity: int) -> None:
        self.name, self.order, self.room, self.used = name, order, capacity, 0
        self.clusters, self.sources = 0, []


def best_fit(items: list[tuple[int, int, int]], capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, source, cluster), in the given order; sources and clusters are small integers.

    ``sources`` of a bin is a list of bitmaps: bit s of the k-th is set if the bin holds more than k items of source s.
    """
    open_bins: list[tuple[int, int]] = []  # (room, number), in order
    bins: list[Bin] = []
    out = []
    for size, source, cluster in items:
        bit, own = 1 << source, 1 << cluster
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = bins[open_bins[at][1]]
            if not b.clusters & own and (len(b.sources) < max_per_source or not b.sources[max_per_source - 1] & bit):
                break
            at += 1
        if at < len(open_bins):
            b = bins[open_bins.pop(at)[1]]
        else:
            b = Bin("", len(bins), capacity)
            bins.append(b)
        out.append((b.order, b.used))
        b.used += size
        b.room -= size
        b.clusters |= own
        for k in range(max_per_source):
            if k == len(b.sources):
                b.sources.append(bit)
                break
            if not b.sources[k] & bit:
                b.sources[k] |= bit
                break
        if b.room > 0:
            insort(open_bins, (b.room, b.order))
    return out


def items_of(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_words) of each row. ``classes`` (id, class_id), one row an id, name clusters of near copies."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.array_remove(F.split(t, WS), "")) + 1
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.regexp_replace(t, f"^{WS}|{WS}$", ""), WS, " ")))
    items = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.alias("cluster"), words.cast("long").alias("n_words"))
    if classes is None:
        return items
    named = items.join(classes.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left")
    return named.select("doc_id", "source", F.coalesce("class_id", "cluster").alias("cluster"), "n_words")


def pack(items: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of ``SCHEMA`` for (doc_id, source, cluster, n_words): where each piece of each document goes."""
    items = written(items, "pack-items")
    shards = max(1, -(-items.count() // shard_rows))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "n_words", "source"], kind="stable", na_position="first")
        name, full, rests = key[0], [], []
        sources, clusters = ({} for _ in range(2))
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        for k, (doc, source, cluster, n) in enumerate(zip(ids, pdf["source"], pdf["cluster"], pdf["n_words"], strict=True)):
            whole, rest = divmod(int(n), capacity)
            full += [(doc, p, p * capacity, capacity, f"{name}-{k}-full{p}", 0) for p in range(whole)]
            if rest:
                s = sources.setdefault(source if isinstance(source, str) else None, len(sources))
                c = clusters.setdefault(int(cluster), len(clusters))
                rests.append((rest, s, c, doc, whole))
        rests.sort(key=lambda x: -x[0])
        placed = best_fit([x[:3] for x in rests], capacity, max_per_source)
        full += [(doc, p, p * capacity, rest, f"{name}-{b}", offset) for (rest, _, _, doc, p), (b, offset) in zip(rests, placed, strict=True)]
        out = pd.DataFrame(full, columns=["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset"])
        return out.astype({"doc_id": "Int64"})

    columns = ["doc_id", "source", "cluster", "n_words"]
    # Equal rows meet as one with a count first, so none of them makes a shard large.
    each = items.groupBy(*columns).agg(F.count("*").cast("int").alias("n")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64(*columns, "k"), F.lit(shards)).cast("long")).drop("k")
    return dealt.groupBy("shard").applyInPandas(shard, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack(items_of(docs))
