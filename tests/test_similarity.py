from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from simstrata.operators import similarity


def _rows(n=240, size=12):
    """Clusters with exact copies, which tie, a vector of zeros, one of another length, and one that isn't a number."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, size))[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, size))).round(3)
    x[n // 2 : n // 2 + 40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return [*rows, (n, [0.0] * size), (n + 1, [1.0] * (size - 1)), (n + 2, [float("nan")] * size)]


def _brute(rows, threshold, n_bits=None):
    sign = lambda v: [c < 0 for c in v[:n_bits]]
    found = {}
    for q, a in rows:
        for s, b in rows:
            if len(a) != len(b) or not any(a) or not any(b) or (n_bits and sum(x != y for x, y in zip(sign(a), sign(b), strict=True)) > 1):
                continue
            norms = [float(np.sqrt(sum(x * x for x in v))) for v in (a, b)]
            cosine = sum(x * y for x, y in zip(a, b, strict=True)) / (norms[0] * norms[1])
            if not cosine < threshold:
                found.setdefault(q, []).append((s, cosine))
    order = lambda m: (0 if np.isnan(m[1]) else 1, -m[1], m[0])
    return {q: sorted(m, key=order) for q, m in found.items()}


@pytest.mark.parametrize("n_bits", [None, 5])
@pytest.mark.parametrize("block", [1, 10, 2048])
def test_the_best_are_kept_in_the_tasks(spark, monkeypatch, n_bits, block):
    rows, k = _rows(60 if block == 1 else 240), 5
    monkeypatch.setattr(similarity, "PACK", block)
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for kind in ("long", "string"):
        q, s = (df.select(F.format_string("%04d", "id").alias(i) if kind == "string" else F.col("id").alias(i), "vec") for i in ("q_id", "s_id"))
        join = lambda k: similarity.probe_join(q, s, 0.5, n_bits, k) if n_bits else similarity.exact_join(q, s, 0.5, block, k)  # noqa: B023, E731
        want = _brute(rows, 0.5, n_bits)
        best = join(k)
        assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        got = {}
        for r in similarity.top_k(best, k).orderBy("q_id", "rnk").collect():
            got.setdefault(int(r.q_id), []).append(int(r.s_id))
        assert got == {q: [s for s, _ in m[:k]] for q, m in want.items()}
        assert block < 2048 or best.count() == sum(min(k, len(m)) for m in want.values())
        assert sorted((int(r.q_id), int(r.s_id)) for r in join(None).collect()) == sorted((q, s) for q, m in want.items() for s, _ in m)


def test_near_buckets_need_nine_keys(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 30).tolist()
    flip = lambda x, *bits: int(np.int64(np.uint64(x & (1 << 64) - 1) ^ np.uint64(sum(1 << b for b in bits))))
    both = base + [flip(x, b) for x in base[:10] for b in (0, 7, 8, 63)] + [flip(x, 3, 5) for x in base[:10]] + [flip(x, 3, 60) for x in base[:10]]
    df = spark.createDataFrame([(x,) for x in both], "bucket_id long")
    want = sorted((a, b) for a in set(both) for b in set(both) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 1)
    assert sorted(map(tuple, similarity.near_buckets(df, df).collect())) == want
