from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simstrata.functions import kernels as k
from simstrata.operators import families, mosaic
from simstrata.sources import ccf


def test_known_answers():
    r = k.SeededRandom(42)
    assert [r.next_double() for _ in range(4)] == [0.6681064659115423, 0.14090729837348093, 0.12551828945312568, 0.5227642760252413]
    assert k.SeededRandom(42).next() == 1434747710
    assert k.SeededRandom(43).next_double() == 0.1905317801006752
    assert [k.murmur3_32(x) for x in (b"", b"test", b"Hello, world!", b"agent-0#0")] == [0xEBB6C228, 0x704B81DC, 0x24884CBA, 0xFC8B776E]
    assert int(k.mix64(0)) == 0xE220A8397B1DCDAF


@given(st.binary(min_size=1, max_size=300), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_diff_and_patch(new, seed):
    base = np.random.default_rng(seed).integers(0, 256, len(new), dtype=np.uint8).tobytes()
    at, deltas = k.diff(new, base)
    assert k.patch(base, at, deltas) == new
    assert len(at) == k.hamming(new, base)
    signed = np.frombuffer(new, np.uint8)[at].astype(int) - np.frombuffer(base, np.uint8)[at]
    assert k.patch(base, at, signed) == new


@given(st.lists(st.integers(0, 2**31 - 1)))
def test_varints(values):
    r = k.Reader(k.varints(values))
    assert [r.varint() for _ in values] == values and r.at == len(r.data)


@given(st.binary(max_size=200), st.integers(1, 255))
def test_halves_and_steps(data, step):
    assert k.join_nibbles(*k.split_nibbles(data), len(data)) == data
    assert k.unquantise(*k.quantise(data, step), step) == data


def test_entropy_bounds():
    assert k.entropy(b"") == 0 and k.entropy(b"aaaa") == 0 and k.entropy(bytes(range(256))) == 8


def _fates(rng, n, size):
    out = []
    for i in range(n):
        flag = int(rng.integers(0, 3))
        count = int(rng.integers(0, size // 4))
        at = np.sort(rng.choice(size, count, replace=False)) if flag == 2 else None
        out.append(ccf.Fate(flag, *((0, 0, b"") if flag == 0 else (int(rng.integers(-(2**62), 2**62)), i, bytes(rng.integers(0, 256, 32, dtype=np.uint8)))), at, rng.integers(1, 256, count).astype(np.uint8) if flag == 2 else None))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_blob_round_trip(seed):
    rng = np.random.default_rng(seed)
    fates = _fates(rng, seed * 7, 256)
    blob = ccf.write(fates, 256, b"tail", b"h" * 32)
    p = ccf.parse(blob)
    assert (p.trim, p.sha256, p.chunk_size, len(p.fates)) == (b"tail", b"h" * 32, 256, len(fates))
    for a, b in zip(fates, p.fates, strict=True):
        assert (a.flag, a.bucket_id, a.chunk_id, a.guid) == (b.flag, b.bucket_id, b.chunk_id, b.guid)
        if a.flag == ccf.DIFF:
            assert a.offsets.tolist() == b.offsets.tolist() and a.deltas.tolist() == b.deltas.tolist()
    for cut in (3, 9, len(blob) // 2, len(blob) - 1):
        with pytest.raises(ValueError):
            ccf.parse(blob[:cut])


def test_bad_flag_and_mode():
    blob = bytearray(ccf.write([ccf.Fate(0)], 256, b"", b"h" * 32))
    blob[4 + 6 + 20] = 9
    with pytest.raises(ValueError):
        ccf.parse(bytes(blob))
    with pytest.raises(ValueError):
        ccf.decode_errors(b"\x07abc", 1, 256)


@pytest.mark.parametrize("magic", [ccf.CV4, ccf.CV5])
def test_containers(magic):
    blob = ccf.write_container([(b"abc", 10), (b"", 0)], b"x" * 32, magic)
    assert ccf.sniff(blob) == magic[:3].decode().lower()
    assert ccf.read_container(blob) == ([(b"abc", 10), (b"", 0)], b"x" * 32)


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=40, deadline=None)
def test_p_frames(member, base):
    assert ccf.from_p_frame(ccf.p_frame(member, base), base) == member


def test_mosaics_never_lose_to_a_single_candidate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, 256, dtype=np.uint8).tobytes() for _ in range(2))
    chunk = a[:128] + b[128:]
    assert mosaic.best_single(chunk, [a, b])[1] > 100
    i, j, n, mask = mosaic.best_pair(chunk, [a, b])
    assert (i, j, n) == (0, 1, 0) and mosaic.merged(a, b, mask) == chunk
    base, spots = mosaic.mosaic(chunk, [a, b])
    assert base == chunk and None not in spots
    assert mosaic.mosaic(chunk, [])[1] == [None] * 64


def test_stream_model_is_lossless():
    assert families.fit_stream(np.arange(10)) is None
    found = families.fit_stream(np.repeat(np.uint8(7), 64), rounds=300)
    assert found is not None and families.restore_stream(*found) == bytes([7]) * 64


def test_dictionary_needs_samples():
    assert families.train_dictionary([b"abc"] * 3) is None
