"""The whole job: no words, pairs, texts or candidates are left out."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simstrata.llm import lm
from simstrata.operators import similarity
from simstrata.plans import catalogue


def test_lm_scores_every_counted_word(spark):
    """2,000 words, most of them outside the head: each counts by its own number, and their classes are context."""
    rows = [(i, " ".join(f"a{i % 1000}x b{i % 1000}y" for _ in range(1 + i % 3)), "x") for i in range(2000)]
    df = spark.createDataFrame([*rows, (9000, "q" * 100, "x")], "doc_id long, text string, score string")
    counts = lm.count_words(df)
    model = lm.fit(df, counts, head=1.0)
    n = {bytes(r.word): r.n for r in counts.collect()}
    assert model.total == sum(n.values()) and model.distinct == len(n) == 2002 and len(model.head) < 200
    assert model.masses.sum() == sum(c for w, c in n.items() if w not in model.head)
    assert np.abs(model.params.r - lm.start_of(counts, head=1.0).params.r)[model.tails[model.masses > 0]].sum(axis=1).min() > 0
    got = {r.doc_id: r for r in lm.score(df, counts, model).collect()}
    assert got[9000].n_known == 2 and all(r.n_known == r.n_tokens for r in got.values())
    assert len({round(r.score, 9) for r in got.values()}) > 500


def test_exact_join_sees_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(x @ x.T >= catalogue.SIMILAR)
    want = sorted((rows[a].vec_id, rows[b].vec_id) for a, b in zip(i, j, strict=True) if a != b)
    assert sorted((r.q_id, r.s_id) for r in catalogue.queries()["sim_join_threshold"](spark, sf_dir).collect()) == want
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    small = similarity.exact_join(v.withColumnRenamed("vec_id", "q_id"), v.withColumnRenamed("vec_id", "s_id"), catalogue.SIMILAR, block=37)
    assert sorted((r.q_id, r.s_id) for r in small.where("q_id != s_id").collect()) == want


def test_containers_are_read_back(spark, sf_dir):
    rows = catalogue.queries()["container_roundtrip"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.ok for r in rows)


def _pipeline():
    return pytest.importorskip("corpus_pipeline")


def _documents(spark, rows):
    """Documents with extra columns that are named like outputs and helpers of the stages."""
    full = [(i, t, la, s, len(t or ""), "x", 1.0, "y") for i, t, la, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, class_id string, n_words double, lang_pred string")


def _text(seed, n=60, lang="en"):
    r = random.Random(seed)
    own = {"en": ["the", "house", "is", "green", "and", "warm", "near", "old", "trees"], "de": ["das", "haus", "ist", "rot", "und", "warm", "nahe", "alte", "baum"]}[lang]
    return " ".join(r.choice(own) + r.choice(["", "", "s", str(r.randrange(50))]) for _ in range(n))


def test_pipeline_stages(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns: what each stage returns, row by row."""
    p = _pipeline()
    rows = [(i, _text(i, lang=["en", "de"][i % 2]), ["en", "de"][i % 2], "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, "12 ½ !", None, "s"), (103, _text(9, 30_000), "en", "s"), (104, "the house", "en", None)]
    rows += [(5, rows[5][1], "de", "s"), (200, rows[3][1], "de", "t"), (201, rows[4][1] + " tail", "en", "t"), (None, _text(77), None, None)]
    df, stages = _documents(spark, rows), dict(p.STAGES)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    own = [i for i, t, _, _ in rows if t and any(c.isalpha() for c in t)]
    kept = stages["language"](spark, df, "")
    assert kept.columns == df.columns and set(ids(kept)) <= set(own) and len(ids(kept)) >= len(own) - 2
    ruled = stages["rules"](spark, df, "")
    assert ruled.columns == df.columns and ids(ruled) == sorted((i for i, t, _, _ in rows if t and len(t.split()) >= 20), key=str)
    single = stages["near_duplicates"](spark, df, "")
    # 5 is there once, 200 copies 3, 201 is near 4, and texts without words are one class.
    assert single.columns == df.columns and ids(single) == sorted((i for i in {i for i, *_ in rows} - {101, 200, 201}), key=str)
    packed = stages["pack"](spark, df, "").collect()
    assert {r.doc_id for r in packed} == {i for i, *_ in rows}
    for name, stage in p.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0, name


def test_pipeline_equals_its_stages(spark, sf_dir):
    """run() gives what the stages give one after another, and each stage's decisions take effect."""
    p = _pipeline()
    got = sorted((r.doc_id, r.piece, r.n_words) for r in p.run(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert got == sorted((r.doc_id, r.piece, r.n_words) for r in p.pack(spark, docs, sf_dir).collect())
