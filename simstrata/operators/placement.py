"""Placement on a consistent-hash ring and by rendezvous hashing; replicas and quorum."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simstrata.functions.kernels import murmur3_many

VNODES, REPLICAS, ACKS = 256, 3, 2
#: Agents whose ring may be held by every task; beyond that ``ring_of`` raises.
MAX_AGENTS = 10_000


def ring_of(agents: list[str], vnodes: int = VNODES) -> tuple[np.ndarray, list[str]]:
    """(sorted hashes, agent of each): ``vnodes`` places per agent, hashed from ``agent#i``."""
    names = sorted(set(agents))
    if len(names) > MAX_AGENTS:
        raise ValueError(f"{len(names)} agents; the ring is held by every task and is bounded to {MAX_AGENTS}")
    places = [(a, i) for a in names for i in range(vnodes)]
    spots = sorted(zip(murmur3_many([f"{a}#{i}".encode() for a, i in places]).tolist(), (a for a, _ in places), strict=True))
    return np.array([h for h, _ in spots], np.int64), [a for _, a in spots]


def replicas(key: str | Column, agents: list[str], n: int = REPLICAS, vnodes: int = VNODES) -> Column:
    """The first ``n`` different agents clockwise from the key's hash (all, if there are fewer)."""
    hashes, owner = ring_of(agents, vnodes)
    want, size = min(n, len(set(owner))), len(owner)

    @F.pandas_udf("array<string>")
    def clockwise(keys: pd.Series) -> pd.Series:
        known: dict[int, list[str]] = {}  # by the first place: keys that fall on one place have the same replicas

        def from_place(at: int) -> list[str]:
            if at not in known:
                found, k = [], at
                while len(found) < want:
                    if owner[k % size] not in found:
                        found.append(owner[k % size])
                    k += 1
                known[at] = found
            return known[at]

        first = np.searchsorted(hashes, murmur3_many([str(k).encode() for k in keys]))
        return pd.Series([from_place(at) for at in first.tolist()], dtype=object)

    return clockwise(F.col(key) if isinstance(key, str) else key)


def rendezvous(bucket: str | Column, nodes: list[str]) -> Column:
    """The node with the largest hash of ``bucket|node``, ties to the first by name."""
    names = sorted(set(nodes))
    if len(names) > MAX_AGENTS:
        raise ValueError(f"more than {MAX_AGENTS} nodes")

    @F.pandas_udf("string")
    def owner(buckets: pd.Series) -> pd.Series:
        best, at = np.full(len(buckets), -1), np.full(len(buckets), -1)
        for i, n in enumerate(names):
            h = murmur3_many([f"{b}|{n}".encode() for b in buckets])
            best, at = np.maximum(best, h), np.where(h > best, i, at)
        return pd.Series([names[i] if i >= 0 else None for i in at.tolist()], dtype=object)

    return owner(F.col(bucket) if isinstance(bucket, str) else bucket)


def hint_first(hint: str, others: str) -> Column:
    """Replicas in order, the hinted one first."""
    return F.array_distinct(F.concat(F.array(F.col(hint)), F.col(others)))


def quorum(acks: DataFrame, key: str, acked: str, write_acks: int = ACKS) -> DataFrame:
    """(key, replicas, acks, ok): ok if at least ``least(write_acks, replicas)`` replicas acknowledged."""
    n = F.count("*")
    got = F.count_if(F.col(acked))
    return acks.groupBy(key).agg(n.alias("replicas"), got.alias("acks"), (got >= F.least(F.lit(write_acks), n)).alias("ok"))


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value, ties to the smallest."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def fallback(df: DataFrame, key: list[str], *sources: DataFrame, value: str = "chunk") -> DataFrame:
    """``value`` from the first source that has the key."""
    named = [s.select(*key, F.col(value).alias(f"__{i}")) for i, s in enumerate(sources)]
    joined = reduce(lambda d, s: d.join(s, key, "left"), named, df)
    return joined.withColumn(value, F.coalesce(*(f"__{i}" for i in range(len(sources))))).drop(*(f"__{i}" for i in range(len(sources))))
