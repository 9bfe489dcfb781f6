"""More registered queries: scalar functions, the legacy pre-pass, places of chunks, memberships and jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simstrata.functions import kernels, scalars, udfs
from simstrata.operators import chunking, families, legacy, prepass
from simstrata.plans import late
from simstrata.plans.catalogue import CHUNKS_SQL, SIZE, _chunks, _files, query, table
from simstrata.streaming import telemetry

# Scalar functions.

@query(f"SELECT c_custkey, CAST({late.murmur('c_name')} AS BIGINT) AS hash FROM customer")
def murmur_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.murmur3_32("c_name").alias("hash"))


@query(f"SELECT o_orderkey, lpad(lower(printf('%x', {late.mix('o_orderkey')})), 16, '0') AS mixed FROM orders")
def mix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.lower(F.hex(udfs.mix64("o_orderkey"))), 16, "0").alias("mixed"))


@query("SELECT bit_count(o_orderkey) AS bits, count(*) AS n FROM orders GROUP BY 1")
def popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.bit_count("o_orderkey").alias("bits")).agg(F.count("*").alias("n"))


@query(f"""WITH {CHUNKS_SQL} SELECT CAST(i AS INT) AS i, (CAST(concat('0x', substring(hx, 2 * (i // 2) + 1, 2)) AS INT) >> CAST(i % 2 * 4 AS INT)) & 15 AS selector, count(*) AS n
FROM g, unnest(range(0, 16)) AS t(i) GROUP BY ALL""")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 four-bit selectors of every chunk."""
    rows = _chunks(spark, sf_dir).select(F.substring("chunk", 1, 8).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    return rows.groupBy("i", scalars.selector(F.col("c"), F.col("i")).alias("selector")).agg(F.count("*").alias("n"))


@query(f"""WITH {CHUNKS_SQL} SELECT CAST(i AS INT) AS i, count(*) FILTER (substring(hx, 2 * (i // 2) + 2 - i % 2, 1) <> '5') AS changed, count(*) AS n FROM g, unnest(range(0, 16)) AS t(i) GROUP BY ALL""")
def selectors_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the first 16 selectors set to 5: how many change, where all others must stay."""
    rows = _chunks(spark, sf_dir).select(F.substring("chunk", 1, 8).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    rows = rows.withColumn("new", scalars.with_selector(F.col("c"), F.col("i"), F.lit(5)))
    others = F.forall(F.sequence(F.lit(0), F.lit(15)), lambda j: (j == F.col("i")) | (scalars.selector(F.col("new"), j) == scalars.selector(F.col("c"), j)))
    good = others & (scalars.selector(F.col("new"), F.col("i")) == 5) & (F.length("new") == F.length("c"))
    return rows.groupBy("i").agg(F.count_if(good & (F.col("new") != F.col("c"))).alias("changed"), F.count_if(good).alias("n"))


_NEIGHBOURS_SQL = f"""{CHUNKS_SQL}, nb AS (SELECT doc_id, chunk_idx, hx, lag(hx) OVER w AS b1, lag(hx, 2) OVER w AS b2 FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)),
by_byte AS (SELECT doc_id, chunk_idx, b1 IS NOT NULL AS one, b2 IS NOT NULL AS two, i, b1 IS NOT NULL AND substring(hx, 2 * i + 1, 2) <> substring(b1, 2 * i + 1, 2) AS d1,
            b2 IS NOT NULL AND substring(hx, 2 * i + 1, 2) <> substring(b2, 2 * i + 1, 2) AS d2 FROM nb, unnest(range(0, {SIZE})) AS t(i)),
nd AS (SELECT doc_id, chunk_idx, bool_and(one) AS one, bool_and(two) AS two, CAST(sum(CAST(d1 AS INT)) AS INT) AS n1, CAST(sum(CAST(d2 AS INT)) AS INT) AS n2, CAST(sum(CAST(d1 AND d2 AS INT)) AS INT) AS n12 FROM by_byte GROUP BY ALL)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the two before it in its file, as its best and second candidate."""
    w = Window.partitionBy("file_id").orderBy("chunk_idx")
    rows = _chunks(spark, sf_dir).withColumn("b1", F.lag("chunk").over(w)).withColumn("b2", F.lag("chunk", 2).over(w))
    return rows.withColumn("m1", udfs.byte_mask("chunk", "b1")).withColumn("m2", udfs.byte_mask("chunk", "b2"))


@query(f"WITH {_NEIGHBOURS_SQL} SELECT CAST(i % 8 AS INT) AS bit, CAST(sum(CAST(d1 AS INT)) AS BIGINT) AS n FROM by_byte WHERE one AND i < 32 GROUP BY ALL")
def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the masks of differing bytes, over the first 32 bytes of every chunk and the chunk before it."""
    rows = _neighbours(spark, sf_dir).where("m1 is not null").select("m1", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return rows.groupBy((F.col("i") % 8).cast("int").alias("bit")).agg(F.sum(scalars.mask_bit(F.col("m1"), F.col("i"))).alias("n"))


@query("SELECT vec_id, to_base64(unhex(sha256(array_to_string(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN '0' ELSE '1' END), '') || ':' || array_to_string(list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',')))) AS cache_key FROM embeddings")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from simstrata.operators.similarity import sign_bits

    return table(spark, sf_dir, "embeddings").select("vec_id", scalars.cache_key(sign_bits("embedding"), F.col("embedding")).alias("cache_key"))


@query("SELECT event_id, CAST([1, 2, 5, 10, 20][least(event_id % 7, 4) + 1] AS INT) AS retry_s, CAST(least(4000, 250 * (1 << CAST(event_id % 7 AS INT))) AS INT) AS retry_ms FROM events")
def retry_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("event_id") % 7
    return table(spark, sf_dir, "events").select("event_id", scalars.retry_s(attempt).alias("retry_s"), scalars.search_retry_ms(attempt).cast("int").alias("retry_ms"))


@query("""WITH l AS (SELECT event_id, event_id % 100 / 100.0 AS cpu, event_id % 89 / 89.0 AS mem FROM events)
SELECT event_id, least(CASE WHEN cpu >= 0.80 THEN 0.30 WHEN cpu >= 0.60 THEN 0.50 WHEN cpu >= 0.40 THEN 0.75 ELSE 1.0 END, CASE WHEN mem >= 0.85 THEN 0.30 WHEN mem >= 0.70 THEN 0.50 WHEN mem >= 0.50 THEN 0.75 ELSE 1.0 END)::DOUBLE AS factor FROM l""")
def load_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", telemetry.load_factor(F.col("event_id") % 100 / 100, F.col("event_id") % 89 / 89).alias("factor"))


@query("SELECT event_id, left(event_type, 4) AS short, epoch_ns(ts) AS ns, strftime(ts, '%H:%M:%S.%g') AS clock FROM events")
def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.left("event_type", F.lit(4)).alias("short"), scalars.unix_ns(F.col("ts")).alias("ns"), scalars.clock(F.col("ts")).alias("clock"))


@query("SELECT doc_id, true AS ok FROM documents")
def kernels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nibbles split and joined, bytes quantised and restored, varints of all lengths, differences applied: all lossless."""
    @F.pandas_udf("boolean")
    def lossless(data: pd.Series) -> pd.Series:
        out = []
        for x in data:
            back = x[::-1]
            reader = kernels.Reader(kernels.varints([len(x), *x[:64]]))
            out.append(
                kernels.join_nibbles(*kernels.split_nibbles(x), len(x)) == x and kernels.unquantise(*kernels.quantise(x, 7), 7) == x
                and [reader.varint() for _ in range(1 + min(64, len(x)))] == [len(x), *x[:64]] and kernels.patch(back, *kernels.diff(x, back)) == x
            )
        return pd.Series(np.array(out, bool))

    return _files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), lossless("bytes").alias("ok"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS ok FROM documents")
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels 3, 9 and 19 by turns."""
    level = F.element_at(F.array(F.lit(3), F.lit(9), F.lit(19)), (F.col("file_id") % 3).cast("int") + 1)
    back = udfs.zstd_decompress(udfs.zstd_compress("bytes", level))
    return _files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), F.length("bytes").cast("long").alias("n_bytes"), (back == F.col("bytes")).alias("ok"))


# Chunks: where they lie, what they are encoded against, and the pre-pass.


@query(f"""WITH {CHUNKS_SQL}, o AS (SELECT *, first_value(doc_id) OVER w AS o_doc, first_value(chunk_idx) OVER w AS o_idx, hx = repeat('00', {SIZE}) AS zero FROM g WINDOW w AS (PARTITION BY guid ORDER BY doc_id, chunk_idx))
SELECT doc_id AS file_id, CASE WHEN zero THEN 'empty-base' WHEN o_doc = doc_id AND o_idx = chunk_idx THEN 'self-fresh' WHEN o_doc = doc_id THEN 'rep[' || o_idx || ']-fresh' ELSE 'dedup-cached' END AS label,
CASE WHEN zero THEN 0 WHEN o_doc = doc_id AND o_idx = chunk_idx THEN 2 ELSE 1 END AS ref_byte, count(*) AS n FROM o GROUP BY ALL""")
def chunk_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by what they are encoded against: nothing, themselves, a chunk of the same file, or another file's."""
    rows = _chunks(spark, sf_dir).select("file_id", "chunk_idx", chunking.guid().alias("guid"), chunking.is_zero().alias("zero"))
    owner = rows.groupBy("guid").agg(F.min(F.struct("file_id", "chunk_idx")).alias("o"))
    kind = F.when(F.col("zero"), "zeros").when(F.col("o.file_id") != F.col("file_id"), "ref").when(F.col("o.chunk_idx") == F.col("chunk_idx"), "self_fresh").otherwise("rep_fresh")
    placed = rows.join(owner, "guid").withColumn("kind", kind)
    return placed.groupBy("file_id", scalars.case_label(F.col("kind"), F.col("o.chunk_idx")).alias("label"), scalars.ref_byte(F.col("kind")).alias("ref_byte")).agg(F.count("*").alias("n"))


@query(f"""WITH {CHUNKS_SQL}, r AS (SELECT *, min(chunk_idx) OVER (PARTITION BY doc_id, left(guid, 1)) AS rep, count(*) OVER (PARTITION BY guid) = 1 AS own FROM g)
SELECT r.doc_id AS file_id, CASE WHEN NOT h.own THEN 'ref' WHEN r.chunk_idx = r.rep THEN 'self_fresh' ELSE 'rep_fresh' END AS kind, count(*) AS n FROM r JOIN r h ON h.doc_id = r.doc_id AND h.chunk_idx = r.rep GROUP BY ALL""")
def representative_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a file's chunks (by the first digit of their address) against their first, which is new if no other chunk equals it."""
    rows = _chunks(spark, sf_dir).select("file_id", "chunk_idx", chunking.guid().alias("guid"))
    alone = rows.groupBy("guid").agg((F.count("*") == 1).alias("own"))
    rows = rows.join(alone, "guid").withColumn("group", F.struct("file_id", F.left("guid", F.lit(1)).alias("g")))
    first = F.min("chunk_idx").over(Window.partitionBy("group"))
    found = prepass.representative_fates(rows.withColumn("is_rep", F.col("chunk_idx") == first), "group", "chunk_idx", "is_rep", "own")
    return found.groupBy(F.col("group.file_id").alias("file_id"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_NEIGHBOURS_SQL}, fates AS (SELECT doc_id, n1, CASE WHEN NOT one THEN 'zero_ref' WHEN n1 > CASE WHEN chunk_idx % 2 = 0 THEN {int(SIZE * 0.9)} ELSE {int(SIZE * 0.95)} END THEN 'ejected' WHEN n1 = 0 THEN 'empty' ELSE 'diff' END AS fate FROM nd)
SELECT doc_id AS file_id, count(*) FILTER (fate = 'zero_ref') AS n_zero_ref, count(*) FILTER (fate = 'empty') AS n_empty, count(*) FILTER (fate = 'diff') AS n_diff, count(*) FILTER (fate = 'ejected') AS n_ejected,
round(coalesce(sum(n1) FILTER (fate = 'diff') / (count(*) FILTER (fate = 'diff') * {SIZE}), 0), 6) AS avg_error FROM fates GROUP BY doc_id""")
def prepass_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk against the one before it; chunks at odd places count as members of a group, with the more lenient limit."""
    rows = _neighbours(spark, sf_dir).select("file_id", "chunk_idx", F.col("b1").isNotNull().alias("matched"), F.coalesce(udfs.byte_hamming("chunk", "b1"), F.lit(0)).alias("n_diff"))
    fate = prepass.fate(F.col("matched"), F.lit(False), F.col("chunk_idx") % 2 == 0, F.col("n_diff"), SIZE, prepass.override(0.9), prepass.override(0.95, prepass.CLUSTER))
    return prepass.statistics(rows.withColumn("fate", fate), SIZE, "file_id")


@query(f"""WITH {_NEIGHBOURS_SQL} SELECT count(*) AS n_chunks, round(coalesce(100 * sum(n1) / (count(*) * {SIZE}), 0), 4) AS avg_error_best, round(coalesce(100 * sum(n12) / (count(*) * {SIZE}), 0), 4) AS combined_error,
round(coalesce(100 * sum(n1 - n12) / nullif(sum(n1), 0), 0), 4) AS fixed_by_second FROM nd WHERE two""")
def overlap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _neighbours(spark, sf_dir).where("m2 is not null")
    ones = lambda m: F.length(F.regexp_replace(F.conv(F.hex(m), 16, 2), "0", ""))
    parts = lambda f: sum((ones(f(8 * k)) for k in range(SIZE // 64)), F.lit(0))
    both = lambda at: F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("m1", at + 1, 8)), 16, -10).cast("long").bitwiseAND(F.conv(F.hex(F.substring("m2", at + 1, 8)), 16, -10).cast("long"))), 16, "0"))
    return prepass.overlap(rows.select(parts(lambda at: F.substring("m1", at + 1, 8)).alias("n_best"), parts(both).alias("n_both")), SIZE)


@query("""WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), s AS (SELECT *, unnest(range(0, greatest(1, (n + 1023) // 1024))) AS i FROM b)
SELECT doc_id AS file_id, CAST(i AS INT) AS seq, CAST(least(1024, n - 1024 * i) AS INT) AS n_bytes, i = greatest(1, (n + 1023) // 1024) - 1 AS eof FROM s""")
def output_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequenced frames of 1 KiB; the last of a file says so."""
    return chunking.frames(_files(spark, sf_dir), 1024).select("file_id", "seq", F.length("data").alias("n_bytes"), "eof")


@query("SELECT source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS INT) AS batch, doc_id FROM documents")
def query_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return rows.select("source", F.floor(F.col("idx") / 16).cast("int").alias("batch"), "doc_id")


@query(f"""WITH {CHUNKS_SQL}, d AS (SELECT DISTINCT doc_id, guid, min(chunk_idx) OVER (PARTITION BY doc_id, guid) AS first FROM g) SELECT doc_id AS file_id, count(*) AS refs, count(DISTINCT guid) AS entries FROM g GROUP BY doc_id""")
def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as numbers in the catalog, and back again: only those that come back right count."""
    rows = _chunks(spark, sf_dir).select("file_id", F.crc32(chunking.guid()).alias("bucket_id"), F.xxhash64(chunking.guid()).alias("chunk_id"), (F.col("file_id") * 1_000_000 + F.col("chunk_idx")).alias("pos"))
    named = families.catalog(rows)
    encoded = rows.join(named, ["bucket_id", "chunk_id"]).select("file_id", "pos", "idx", F.struct("bucket_id", "chunk_id").alias("want"))
    back = families.decoded(encoded, named)
    return back.where(F.struct("bucket_id", "chunk_id") == F.col("want")).groupBy("file_id").agg(F.count("*").alias("refs"), F.count_distinct("idx").alias("entries"))


@query(f"""WITH {CHUNKS_SQL}, a AS (SELECT doc_id, source, min(guid) AS family FROM g GROUP BY doc_id, source), p AS (SELECT family, source, count(*) AS n FROM a GROUP BY ALL)
SELECT family, source AS pack_id, CAST(r AS INT) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, source) AS r, count(*) OVER (PARTITION BY family) AS packs, sum(n) OVER (PARTITION BY family) AS m FROM p) WHERE packs > 1 AND m >= 3 AND r <= 2""")
def consolidation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each scattered family the two packs that hold most of it."""
    least = _chunks(spark, sf_dir, "source").groupBy("file_id", F.col("source").alias("pack_id")).agg(F.min(chunking.guid()).alias("family"))
    return families.source_packs(least, 2).select("family", "pack_id", "rnk")


# Membership, jobs and JSON.

_ENTRY_SQL = """e AS (SELECT event_id, ts, CASE WHEN event_id % 10 = 0 THEN '/other/' ELSE '/agents/' END || user_id AS key,
'{' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '"ip":"10.0.0.' || (user_id % 250) || '",' END || '"vnodes":' || (event_id % 5 - 1) * 64 || CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN ',"status":"Ready"' ELSE ',"status":"draining"' END || '}' AS value FROM events)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    key = F.concat(F.when(F.col("event_id") % 10 == 0, "/other/").otherwise("/agents/"), user)
    ip = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit('"ip":"10.0.0.'), (F.col("user_id") % 250).cast("string"), F.lit('",')))
    status = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", ',"status":"Ready"').otherwise(',"status":"draining"')
    value = F.concat(F.lit("{"), ip, F.lit('"vnodes":'), ((F.col("event_id") % 5 - 1) * 64).cast("string"), status, F.lit("}"))
    return e.select("event_id", "ts", key.alias("key"), value.alias("value"))


@query(f"""WITH {_ENTRY_SQL} SELECT event_id, substring(key, 9) AS name, json_extract_string(value, '$.ip') AS ip, CASE WHEN CAST(json_extract(value, '$.vnodes') AS INT) > 0 THEN CAST(json_extract(value, '$.vnodes') AS INT) ELSE 256 END AS vnodes
FROM e WHERE starts_with(key, '/agents/') AND json_extract_string(value, '$.ip') IS NOT NULL AND lower(coalesce(json_extract_string(value, '$.status'), 'ready')) = 'ready'""")
def membership_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _entries(spark, sf_dir).select("event_id", scalars.membership_entry(F.col("key"), F.col("value")).alias("m")).where("m is not null")
    return found.select("event_id", "m.name", "m.ip", "m.vnodes")


@query(f"""WITH {_ENTRY_SQL} SELECT left(key, 8) AS prefix, left(key, 7) || chr(ascii(substring(key, 8, 1)) + 1) AS prefix_end, count(*) AS n FROM e WHERE key >= '/agents/' AND key < '/agents0' GROUP BY ALL""")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a prefix as a range: what a sorted store would scan."""
    prefix = F.lit(scalars.AGENTS)
    rows = _entries(spark, sf_dir).where((F.col("key") >= prefix) & (F.col("key") < scalars.prefix_end(prefix)))
    return rows.groupBy(F.left("key", F.lit(8)).alias("prefix")).agg(F.count("*").alias("n")).select("prefix", scalars.prefix_end(F.col("prefix")).alias("prefix_end"), "n")


@query("""WITH j AS (SELECT 'job' || user_id AS parent_job_id, 'job' || user_id || ':b' || event_id % 4 AS job_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' ELSE 'stage' END AS phase FROM events)
SELECT parent_job_id, job_id, min(ts) AS started, max(ts) FILTER (phase IN ('completed', 'failed')) AS ended, count(*) AS n_events,
CASE WHEN count(*) FILTER (phase = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (phase = 'completed') > 0 THEN 'completed' ELSE 'running' END AS status FROM j GROUP BY ALL""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of jobs, named after their parent; a purchase completes one and a sign-up makes it fail."""
    e = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "failed").otherwise("stage")
    rows = e.select(telemetry.block_job(F.concat(F.lit("job"), F.col("user_id").cast("string")), F.col("event_id") % 4).alias("job"), "ts", phase.alias("phase"))
    return telemetry.jobs(rows, "job", "ts", "phase").select("job.*", "started", "ended", "n_events", "status")


@query("SELECT event_type, json_object('stage', event_type, 'events', count(*), 'users', count(DISTINCT user_id), 'last_ns', max(epoch_ns(ts)))::VARCHAR AS stats FROM events GROUP BY event_type")
def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max(scalars.unix_ns(F.col("ts"))).alias("last_ns"))
    return rows.select("event_type", F.to_json(F.struct(F.col("event_type").alias("stage"), "events", "users", "last_ns")).alias("stats"))


@query("""WITH e AS (SELECT user_id, ts, event_id, json_object('level', '1', 'startTime', strftime(ts, '%H:%M:%S.%g'), 'stepName', event_type, 'type', 'step')::VARCHAR AS j, strftime(ts, '%H:%M:%S.%g') AS t FROM events)
SELECT user_id, json_object('HeadRouteID', 'r' || user_id, 'events', list(j ORDER BY ts, event_id), 'events_time_stamps', list(t ORDER BY ts, event_id))::VARCHAR AS trace FROM e GROUP BY user_id""")
def route_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user a JSON text whose events are JSON texts themselves."""
    time = scalars.clock(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", time.alias("t"), F.to_json(F.struct(F.lit("1").alias("level"), time.alias("startTime"), F.col("event_type").alias("stepName"), F.lit("step").alias("type"))).alias("j"))
    held = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "t", "j"))).alias("e"))
    trace = F.struct(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("HeadRouteID"), F.transform("e", lambda x: x.j).alias("events"), F.transform("e", lambda x: x.t).alias("events_time_stamps"))
    return held.select("user_id", F.to_json(trace).alias("trace"))


@query("""WITH a AS (SELECT DISTINCT n_nationkey AS k FROM nation), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT coalesce(a.k, b.k) AS agent, a.k IS NOT NULL AS before, b.k IS NOT NULL AS after, a.k IS NOT NULL AND b.k IS NOT NULL AS stays FROM a FULL JOIN b ON a.k = b.k""")
def ring_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two memberships compared: who stays, joins and leaves."""
    before = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("agent"))
    after = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("agent"))
    return telemetry.membership_changes(before, after, "agent")


# Blobs of version 5.6.


@query("SELECT doc_id AS file_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS ok FROM documents")
def legacy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a blob of version 5.6, with references, pairs and mosaics, and back again."""
    files = _files(spark, sf_dir)
    blobs, held = legacy.compress(files, SIZE)
    back = legacy.decompress(blobs, held, SIZE).join(files.select("file_id", F.col("bytes").alias("want")), "file_id")
    return back.select("file_id", F.length("bytes").cast("long").alias("n_bytes"), (F.col("ok") & (F.col("bytes") == F.col("want"))).alias("ok"))
