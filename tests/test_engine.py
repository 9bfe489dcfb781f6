from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from simstrata import engine
from simstrata.functions import udfs
from simstrata.operators import chunking, diffs, families, placement, similarity, store
from simstrata.functions.kernels import murmur3_32
from simstrata.streaming import telemetry

SIZE = 64


def _file(kind: str) -> bytes:
    import random

    rnd = random.Random(5)
    body = bytes(rnd.randrange(256) for _ in range(SIZE * 4))
    return {
        "empty": b"", "short": body[: SIZE - 1], "one": body[:SIZE], "over": body[: SIZE + 1], "all": body + b"tail",
        "zeros": bytes(SIZE * 3), "same": body[:SIZE] * 5, "near": body[:10] + bytes([body[10] ^ 1]) + body[11 : SIZE * 4],
    }[kind]


KINDS = ["empty", "short", "one", "over", "all", "zeros", "same"]


def test_engine_round_trip(spark, tmp_path):
    e = engine.Engine(spark, f"file://{tmp_path}/engine", size=SIZE, block=SIZE * 2)
    rows = [(i, bytearray(_file(k))) for i, k in enumerate(KINDS)]
    e.compress(spark.createDataFrame(rows, "file_id long, bytes binary"))
    e.compress(spark.createDataFrame([(100, bytearray(_file("near")))], "file_id long, bytes binary"))
    back: dict = {}
    for r in e.decompress().orderBy("file_id", "block_idx").collect():
        assert r.ok
        back[r.file_id] = back.get(r.file_id, b"") + bytes(r.bytes)
    assert back == {**{i: bytes(b) for i, b in rows}, 100: _file("near")}
    assert e.get(100) == _file("near")
    with pytest.raises(ValueError):
        e.get(555)
    s = e.stats().first()
    assert (s.files, s.n_diff, s.n_errors, s.chunks, s.n_zero) == (len(KINDS) + 1, 1, 1, 4, 3)
    frames = e.packs()
    assert frames.count() == e.blobs().count()
    assert e.clear() > 0 and e.blobs().count() == 0


def test_damaged_store_is_noticed(spark):
    files = spark.createDataFrame([(1, bytearray(_file("all")))], "file_id long, bytes binary")
    blobs, new = store.compress(files, store.empty_store(spark), SIZE)
    assert [r.ok for r in store.decompress(blobs, new.limit(2)).collect()] == [False]
    bad = new.withColumn("chunk", F.concat(F.lit(b"x"), F.expr("substring(chunk, 2)")))
    assert [r.ok for r in store.decompress(blobs, bad).collect()] == [False]


def test_bits_and_probes(spark):
    df = spark.createDataFrame([(1, [0.5, -0.1, 0.0, -3.0])], "id int, vec array<double>")
    r = similarity.signed(df, "vec", 4).withColumn("p", similarity.probes("bucket_id", "vec", 4)).withColumn("back", similarity.bits_of("bucket_id", 4)).first()
    assert (r.bits, r.bucket_id, r.back) == ("1010", 5, "1010")
    assert r.p == [5, 5 ^ 4, 5 ^ 2, 5 ^ 1, 5 ^ 8]


def test_ring_is_first_clockwise(spark):
    agents = ["a", "b", "c", "d", "e"]
    spots = sorted((murmur3_32(f"{a}#{i}".encode()), a) for a in agents for i in range(256))
    for r in spark.range(50).select(F.col("id").cast("string").alias("k")).withColumn("r", placement.replicas("k", agents)).collect():
        h, want = murmur3_32(r.k.encode()), []
        for _, a in [s for s in spots if s[0] >= h] + spots:
            if a not in want:
                want.append(a)
        assert r.r == want[:3]
    assert spark.range(1).select(placement.replicas(F.lit("k"), ["x"]).alias("r")).first().r == ["x"]
    with pytest.raises(ValueError):
        placement.ring_of([str(i) for i in range(placement.MAX_AGENTS + 1)])


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdef"), bytearray(b"bccdgg"))], "id int, chunk binary, base binary")
    rows = diffs.byte_rows(df, ["id"])
    assert sorted((r.off, r.delta) for r in rows.collect()) == [(0, -1), (1, -1), (4, -2), (5, -1)]
    assert sorted((r.start, r.len, r.delta) for r in diffs.runs(rows, ["id"]).collect()) == [(0, 2, -1), (4, 1, -2), (5, 1, -1)]
    g = diffs.gaps(rows, ["id"]).withColumn("o", F.col("off"))
    assert all(r.off == r.o for r in diffs.from_gaps(g, ["id"], "o").collect())


def test_registered_functions(spark):
    udfs.register(spark)
    r = spark.sql("select murmur3_32('test') a, byte_hamming(X'0102', X'0103') b, zstd_decompress(zstd_compress(X'010203', 3)) c, byte_entropy(X'0001') d, mix64(0L) e").first()
    assert (r.a, r.b, bytes(r.c), r.d, r.e) == (0x704B81DC, 1, b"\1\2\3", 1.0, 0xE220A8397B1DCDAF - (1 << 64))


def test_frames(spark):
    rows = [(1, "f", bytearray(b"abc" * 400)), (2, "f", bytearray(b"abc" * 399 + b"abd")), (3, "g", bytearray(b""))]
    packed = families.frames(spark.createDataFrame(rows, "file_id long, family string, blob binary"))
    assert {r.file_id: (r.frame_type, r.base_id) for r in packed.collect()} == {1: (0, None), 2: (1, 1), 3: (0, None)}
    assert {r.file_id: r.blob for r in families.unframed(packed).collect()} == {i: b for i, _, b in rows}


def test_breaker_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(seconds=i), not 3 <= i < 9) for i in range(60)] + [("b", base, True)]
    df = spark.createDataFrame(rows, "agent string, ts timestamp, ok boolean")
    batch = sorted(map(tuple, telemetry.breaker(df).collect()))
    assert any(r[4] == "open" for r in batch) and not all(r[3] for r in batch)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    telemetry.run_available(telemetry.breaker(stream, streaming=True), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == batch


def test_rolling_percentiles_are_exact(spark):
    """25,000 values in a window, more than the 10,000 that the approximate ones keep; nulls come last, and rows without a
    time have windows without a start."""
    n, at = 25_000, dt.datetime(2024, 1, 1, 3)
    values = F.when(F.col("id") % 500 == 0, None).otherwise(F.pmod(F.col("id") * 7919, F.lit(n)) / 7.0)
    rows = spark.range(n).select(F.lit("s").alias("stage"), F.lit(at).alias("ts"), values.alias("ms"))
    rows = rows.unionByName(spark.createDataFrame([("t", None, 2.0), ("t", None, 1.0)], "stage string, ts timestamp, ms double"))
    got = telemetry.rolling(rows, size="1 day", slide="6 hours").collect()
    held = sorted(v for i in range(n) if (v := None if i % 500 == 0 else i * 7919 % n / 7.0) is not None)
    want = tuple(held[-(-q * n // 100) - 1] for q in (50, 95, 99))
    assert [(r.n, r.p50, r.p95, r.p99) for r in got if r.stage == "s"] == [(n, *want)] * 4
    assert [(r.start, r.n, r.p50, r.p99) for r in got if r.stage == "t"] == [(None, 8, 1.0, 2.0)]


def test_tumbling_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    out = telemetry.tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.stage, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, telemetry.tumbling(events).collect()))


def test_ingest(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(b"abc")
    r = engine.ingest(spark, f"file://{tmp_path}/f").first()
    assert r.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert engine.listing(spark, f"file://{tmp_path}/f", 2).count() == 0


def test_windows_of_an_empty_file(spark):
    df = spark.createDataFrame([(1, bytearray(b""))], "file_id int, bytes binary")
    assert [(r.block_idx, bytes(r.block)) for r in chunking.windows(df, 8).collect()] == [(0, b"")]


def test_delete_survives_crashes(spark, tmp_path, monkeypatch):
    from simstrata.engine import Engine

    files = spark.createDataFrame([(i, bytes([i]) * 100 + bytes(range(200))) for i in range(6)], "file_id long, bytes binary")
    engine = Engine(spark, f"file://{tmp_path}/s", 64)
    engine.compress(files.where("file_id < 3"))
    engine.compress(files.where("file_id >= 3"))
    held = lambda: sorted(r.file_id for r in Engine(spark, f"file://{tmp_path}/s", 64).blobs().collect())
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "file_id long")
    engine.delete(gone(1, 99))
    assert held() == [0, 2, 3, 4, 5] and not engine.recover()

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:  # after the journal: recovery finishes the deletion
        m.setattr(Engine, "_finish", crash)
        with pytest.raises(RuntimeError):
            engine.delete(gone(2))
    assert held() == [0, 2, 3, 4, 5]
    assert engine.recover() and held() == [0, 3, 4, 5] and not engine.recover()
    finish, fs = Engine._finish, engine._fs()
    with monkeypatch.context() as m:  # half way: the new run is in place, the old ones aren't gone
        m.setattr(Engine, "_finish", crash)
        with pytest.raises(RuntimeError):
            engine.delete(gone(3))
    run = [r.value for r in spark.read.text(f"file://{tmp_path}/s/work/journal").collect()][0]
    fs.rename(engine._path(f"work/{run}"), engine._path(f"blobs/{run}"))
    finish(engine)
    assert held() == [0, 4, 5]
    spark.range(1).write.parquet(f"file://{tmp_path}/s/work/stray")  # before the journal: nothing has happened
    assert not engine.recover() and held() == [0, 4, 5] and engine.get(4) == bytes([4]) * 100 + bytes(range(200))


def test_ingest_checks_sizes(spark, tmp_path):
    import hashlib

    from simstrata.engine import ingest

    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"xyz")
    found = {r.path: r for r in ingest(spark, f"file://{tmp_path}").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    declared = [(p, r.sha256, 3 if p.endswith("a") else 4) for p, r in found.items()]
    kept = ingest(spark, f"file://{tmp_path}", spark.createDataFrame(declared, "path string, sha256 string, length long")).collect()
    assert [bytes(r.bytes) for r in kept] == [b"abc"] and kept[0].sha256 == sha(b"abc")
