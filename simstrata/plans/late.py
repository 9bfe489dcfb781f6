"""DuckDB counterparts that are put together from tables of values: hashes, projections, ring positions and state machines."""

from __future__ import annotations

from simstrata.functions import kernels
from simstrata.operators import families, placement
from simstrata.streaming import telemetry

SIZE = 256
_MASK = 18446744073709551616


def murmur(key: str, seed: int = kernels.MURMUR_SEED) -> str:
    """The published 32-bit hash of an ASCII text."""
    m = "4294967296"
    rot = lambda x, r: f"((({x}) << {r}) % {m} + (({x}) >> {32 - r}))"
    byte = lambda i: f"(CASE WHEN {i} < length({key}) THEN ascii(substr({key}, CAST({i} + 1 AS BIGINT), 1)) ELSE 0 END)::UBIGINT"
    word = lambda i: " + ".join(f"{byte(f'({i} * 4 + {k})')} * {1 << 8 * k}" for k in range(4))
    mixed = lambda i: f"({rot(f'(({word(i)}) * 3432918353) % {m}', 15)} * 461845907) % {m}"
    blocks = f"list_reduce(list_transform(range(0, length({key}) // 4), lambda i: {mixed('i')}), lambda h, k: ({rot('xor(h, k)', 13)} * 5 + 3864292196) % {m}, {seed}::UBIGINT)"
    tail = f"xor(xor({blocks}, {mixed(f'(length({key}) // 4)')}), length({key})::UBIGINT)"  # without a tail the mixed word is 0
    step = lambda h, s, f: f"(xor({h}, ({h}) >> {s}) * {f}) % {m}"
    return f"list_transform([list_transform([list_transform([{tail}], lambda h: {step('h', 16, 2246822507)})[1]], lambda h: {step('h', 13, 3266489909)})[1]], lambda h: xor(h, h >> 16))[1]"


def mix(x: str) -> str:
    """The splitmix64 step of an unsigned 64-bit value."""
    times = lambda h, f: f"(({h})::UHUGEINT * {f}::UHUGEINT % {_MASK}::UHUGEINT)::UBIGINT"
    first = f"(({x})::UHUGEINT + {kernels.MIX_ADD}::UHUGEINT) % {_MASK}::UHUGEINT"
    return f"list_transform([list_transform([list_transform([({first})::UBIGINT], lambda h: {times('xor(h, h >> 30)', kernels.MIX_1)})[1]], lambda h: {times('xor(h, h >> 27)', kernels.MIX_2)})[1]], lambda h: xor(h, h >> 31))[1]"


def _buckets(size: int = SIZE) -> str:
    """CTEs: b (doc_id, guid, bucket) of every chunk; bit i is set where the i-th projection isn't negative."""
    rows = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in row)}]::DOUBLE[])" for i, row in enumerate(kernels.projection(kernels.DIMENSIONS, size, kernels.CHUNK_SEED)))
    return f"""f AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, substring(h, {2 * size} * i + 1, {2 * size}) AS hx FROM (SELECT *, unnest(range(0, length(h) // {2 * size})) AS i FROM f)),
g AS (SELECT doc_id, sha256(unhex(hx)) AS guid, hx FROM c),
u AS (SELECT guid, list_transform(range(0, {size}), lambda i: CAST(CAST(concat('0x', substring(any_value(hx), 2 * i + 1, 2)) AS INT) AS DOUBLE)) AS x FROM g GROUP BY guid),
p(i, row) AS (VALUES {rows}),
s AS (SELECT guid, sum(CASE WHEN list_dot_product(x, row) < 0 THEN 0::HUGEINT ELSE 1::HUGEINT << i END) AS bucket FROM u, p GROUP BY guid)"""


def lsh_bucket_chunks() -> str:
    return f"WITH {_buckets()} SELECT CAST(CASE WHEN bucket >= {1 << 63}::HUGEINT THEN bucket - {1 << 64}::HUGEINT ELSE bucket END AS BIGINT) AS bucket_id, count(*) AS n_chunks FROM s GROUP BY ALL"


def family_minhash() -> str:
    mixed = mix(f"xor(CAST(bucket AS UBIGINT), {families.FAMILY_SEED}::UBIGINT)")
    return f"""WITH {_buckets()}, m AS (SELECT doc_id, min({mixed}) AS h FROM g JOIN s USING (guid) WHERE bucket <> 0 GROUP BY doc_id)
SELECT 'ov:' || lpad(lower(printf('%x', h)), 16, '0') AS family, count(*) AS members FROM m GROUP BY h"""


def ring_placement() -> str:
    """Every place by its distance clockwise from the key; of each agent the nearest one counts."""
    hashes, owners = placement.ring_of([f"agent-{i}" for i in range(25)])
    spots = ", ".join(f"({h}, '{a}')" for h, a in zip(hashes.tolist(), owners, strict=True))
    return f"""WITH ring(pos, agent) AS (VALUES {spots}), k AS (SELECT s_suppkey, CAST({murmur("('key-' || s_suppkey)")} AS BIGINT) AS h FROM supplier),
d AS (SELECT s_suppkey, agent, min((pos - h + 4294967296) % 4294967296) AS far FROM k, ring GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY far, agent) AS n FROM d)
SELECT s_suppkey, list(agent ORDER BY n) AS agents FROM r WHERE n <= {placement.REPLICAS} GROUP BY s_suppkey"""


def rendezvous_owner() -> str:
    return f"""WITH k AS (SELECT s_suppkey, 'agent-' || n_nationkey AS agent, lpad(lower(printf('%x', s_suppkey)), 16, '0') || '|agent-' || n_nationkey AS t FROM supplier, nation),
h AS (SELECT s_suppkey, agent, {murmur('t')} AS h FROM k)
SELECT s_suppkey, agent FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY h DESC, agent) AS n FROM h) WHERE n = 1"""


def stage_rolling() -> str:
    at = lambda p: f"list_sort(list(value))[greatest(1, CAST(ceil({p} * count(*)) AS BIGINT))]"
    return f"""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start FROM events, unnest(range(0, 4)) AS t(k))
SELECT start, event_type AS stage, count(*) AS n, {at(0.5)} AS p50, {at(0.95)} AS p95, {at(0.99)} AS p99 FROM w GROUP BY ALL"""


def circuit_breaker() -> str:
    """One step per call of each agent; calls at one time go by failed first."""
    n, wait = telemetry.FAILURES, telemetry.COOLDOWN_S
    held = f"(b.state = 'open' AND c.t - b.opened < {wait})"
    fails = "(CASE WHEN c.ok THEN 0 ELSE b.failures + 1 END)"
    opens = f"(NOT c.ok AND (b.state = 'open' OR b.failures + 1 >= {n}))"
    return f"""WITH RECURSIVE c AS (SELECT user_id AS agent, epoch_us(ts) / 1e6 AS t, value >= 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, value >= 50) AS k FROM events),
b(agent, k, state, failures, opened, admitted) AS (
  SELECT agent, k, CASE WHEN NOT ok AND {n} <= 1 THEN 'open' ELSE 'closed' END, CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN NOT ok AND {n} <= 1 THEN t ELSE 0.0 END, true FROM c WHERE k = 1
  UNION ALL
  SELECT c.agent, c.k, CASE WHEN {held} OR {opens} THEN 'open' ELSE 'closed' END, CASE WHEN {held} THEN b.failures ELSE {fails} END,
         CASE WHEN {held} THEN b.opened WHEN {opens} THEN c.t ELSE 0.0 END, NOT {held}
  FROM b JOIN c ON c.agent = b.agent AND c.k = b.k + 1)
SELECT agent, state, count(*) AS n, count(*) FILTER (admitted) AS admitted FROM b GROUP BY agent, state"""
