from __future__ import annotations

import random

import numpy as np
import pytest

from simstrata.operators import legacy
from simstrata.sources import ccf5

SIZE = 256


def _file(seed: int) -> bytes:
    """Fresh, zero, near and merged chunks, and a trim."""
    r = random.Random(seed)
    a, b = (bytes(r.randrange(256) for _ in range(SIZE)) for _ in range(2))
    near = bytearray(a)
    for k in range(0, SIZE, 11):
        near[k] ^= 1
    pair = bytes(x if k % 3 else y for k, (x, y) in enumerate(zip(a, b, strict=True)))
    shifted = a[4:] + a[:4]
    return a + b + bytes(SIZE) + bytes(near) + pair + shifted + b + b"trim"


def _blob(seed: int = 1) -> tuple[bytes, bytes, dict]:
    data = _file(seed)
    chunks = [data[k : k + SIZE] for k in range(0, len(data) // SIZE * SIZE, SIZE)]
    stored, bases, against = [], [], []
    for c in chunks:
        near = legacy.choose(c, stored, SIZE, 0.4) if any(c) else (ccf5.Base(ccf5.ZEROS), bytes(SIZE))
        if near is None:
            stored.append(((1 << 63 | 7, len(stored)), c))
            near = ccf5.Base(ccf5.FRESH, [stored[-1][0]]), c
        bases.append(near[0])
        against.append(near[1])
    return ccf5.write(chunks, bases, against, SIZE, b"trim", b"h" * 32), data, dict(stored)


def test_blob_round_trip():
    blob, data, stored = _blob()
    p = ccf5.parse(blob, SIZE)
    assert p.rebuilt(stored, SIZE) == data and p.sha256 == b"h" * 32 and p.trim == b"trim"
    assert {b.kind for b in p.bases} == {ccf5.ZEROS, ccf5.REF, ccf5.FRESH, ccf5.MOSAIC, ccf5.PAIR}
    assert len(stored) == 2 and p.places() == list(stored)


def test_layout_of_a_small_blob():
    blob = ccf5.write([b"abcdefgh"], [ccf5.Base(ccf5.REF, [(5, 9)])], [b"abcdefgX"], 8, b"", b"")
    assert blob[:10] == b"\x06\0\0\0v5.6.0"
    refs = (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (5).to_bytes(8, "little") + (9).to_bytes(8, "little") + b"\x01\0\0"
    assert blob[10:14] == len(refs).to_bytes(4, "little") and blob[14:18] == blob[18:22] and blob[26 : 26 + len(refs)] == refs
    p = ccf5.parse(blob, 8)
    assert p.differs.tolist() == [[False] * 7 + [True]] and p.values.tolist() == [ord("h")]


def test_broken_blobs():
    blob, _, stored = _blob()
    for bad in (blob[:40], b"\x06\0\0\0v9.9.9" + blob[10:], blob[:30] + b"\xff\xff" + blob[32:], blob[: len(blob) // 2]):
        with pytest.raises(ValueError):
            ccf5.parse(bad, SIZE).rebuilt(stored, SIZE)
    with pytest.raises(ValueError):
        ccf5.parse(blob, SIZE).rebuilt({}, SIZE)
    places = [ccf5.Base(ccf5.REF, [(k, 0)]) for k in range(1 << 16)]
    with pytest.raises(ValueError):
        ccf5._refs(places)


def test_files_round_trip(spark):
    rows = [(k, _file(k)) for k in range(5)] + [(10, b""), (11, b"short"), (12, bytes(3 * SIZE)), (13, _file(1) * 3)]
    df = spark.createDataFrame(rows, "file_id long, bytes binary")
    blobs, held = legacy.compress(df, SIZE)
    got = {r.file_id: (bytes(r.bytes), r.ok) for r in legacy.decompress(blobs, held, SIZE).collect()}
    assert got == {i: (d, True) for i, d in rows}
    lost = legacy.decompress(blobs, held.where("bucket_id != 3"), SIZE).where("not ok").collect()
    assert [r.file_id for r in lost] == [3]
    assert np.isclose(held.count(), len({(r.bucket_id, r.chunk_id) for r in held.collect()}))
