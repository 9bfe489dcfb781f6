"""Scalar functions as column expressions: bits, keys, schedules, texts, times and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGENTS, VNODES = "/agents/", 256
#: Reference bytes and labels of what a chunk is encoded against.
REF_BYTES = {"zeros": 0, "rep_fresh": 1, "ref": 1, "self_fresh": 2, "mosaic": 4, "pair": 5}
LABELS = {"zeros": "empty-base", "ref": "dedup-cached", "self_fresh": "self-fresh", "mosaic": "mosaic", "pair": "mosaic"}


def byte_at(data: Column, i: Column | int) -> Column:
    """The byte at a zero-based place."""
    return F.conv(F.hex(F.substring(data, (F.lit(i) if isinstance(i, int) else i) + 1, F.lit(1))), 16, 10).cast("int")


def selector(data: Column, i: Column) -> Column:
    """The i-th four-bit selector; the even ones are the low halves of bytes."""
    return F.call_function("shiftright", byte_at(data, F.floor(i / 2).cast("int")), (i % 2 * 4).cast("int")).bitwiseAND(15)


def with_selector(data: Column, i: Column, value: Column) -> Column:
    """``data`` with its i-th selector set."""
    at = F.floor(i / 2).cast("int")
    old, low = byte_at(data, at), value.bitwiseAND(15)
    new = F.when(i % 2 == 0, old.bitwiseAND(0xF0).bitwiseOR(low)).otherwise(old.bitwiseAND(0x0F).bitwiseOR(F.call_function("shiftleft", low, F.lit(4))))
    return F.concat(F.substring(data, F.lit(1), at), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(data, at + 2, F.length(data)))


def mask_bit(mask: Column, i: Column) -> Column:
    """The i-th bit of a mask, the lowest of each byte first."""
    return F.call_function("shiftright", byte_at(mask, F.floor(i / 8).cast("int")), (i % 8).cast("int")).bitwiseAND(1)


def ref_byte(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in REF_BYTES.items() for x in kv)), kind)


def case_label(kind: Column, rep: Column) -> Column:
    """Short label; members of a group name the place of their representative."""
    plain = F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), kind)
    return F.when(kind == "rep_fresh", F.concat(F.lit("rep["), rep.cast("string"), F.lit("]-fresh"))).otherwise(F.coalesce(plain, F.lit("unknown")))


def cache_key(bits: Column, vector: Column) -> Column:
    """SHA-256 in base64 of the bits, a colon, and the components with four decimals."""
    parts = F.array_join(F.transform(vector, lambda x: F.format_string("%.4f", x.cast("double"))), ",")
    return F.base64(F.unhex(F.sha2(F.concat(bits, F.lit(":"), parts), 256)))


def retry_s(failed: Column) -> Column:
    """Seconds to wait after so many failed attempts, counted from 0."""
    return F.element_at(F.array(*map(F.lit, (1, 2, 5, 10, 20))), F.least(failed, F.lit(4)).cast("int") + 1)


def search_retry_ms(attempt: Column) -> Column:
    """250 ms, doubled with each attempt (from 0) up to 4 s."""
    return F.least(F.lit(4000), 250 * F.call_function("shiftleft", F.lit(1), F.least(attempt, F.lit(10)).cast("int")))


def unix_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def agent_name(key: Column) -> Column:
    """The name in an agent's key; null for other keys."""
    name = F.substring(key, F.lit(len(AGENTS) + 1), F.length(key))
    return F.when(F.startswith(key, F.lit(AGENTS)) & (F.trim(name) != ""), name)


def prefix_end(prefix: Column) -> Column:
    """The least key beyond all keys with an ASCII prefix: its last character is raised by one."""
    n = F.length(prefix)
    return F.when(n == 0, F.lit("\x00")).otherwise(F.concat(F.substring(prefix, F.lit(1), n - 1), F.char(F.ascii(F.substring(prefix, n, F.lit(1))) + 1)))


def membership_entry(key: Column, value: Column) -> Column:
    """(name, ip, vnodes) of a key and its JSON value; null unless there is a name and an ip, and the agent is ready.

    Missing or impossible vnodes are ``VNODES``; a missing or empty status is ready.
    """
    name, v = agent_name(key), F.from_json(value, "ip string, vnodes string, status string")
    vnodes = F.try_to_number(v.vnodes, F.lit("999999999")).cast("int")
    ready = (F.coalesce(v.status, F.lit("")) == "") | (F.lower(v.status) == "ready")
    entry = F.struct(name.alias("name"), v.ip.alias("ip"), F.when(vnodes > 0, vnodes).otherwise(VNODES).alias("vnodes"))
    return F.when(name.isNotNull() & (F.trim(v.ip) != "") & ready, entry)
