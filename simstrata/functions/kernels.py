"""Byte kernels in numpy that the Arrow UDFs share. All of them take and return whole batches or single values."""

from __future__ import annotations

import numpy as np

# The seed of the ring's hash, those of the two projections, and the finaliser's multipliers.
MURMUR_SEED = 0x9747B28C
CHUNK_SEED, LANE_SEED = 42, 43
DIMENSIONS, LANES, LANE_BITS = 64, 64, 16
MIX_ADD, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
INT_MAX = 2147483647
RANDOM_SEED = 161803398


class SeededRandom:
    """The subtractive lagged generator (lags 55 and 34 of Knuth's algorithm) that seeded .NET programs get."""

    def __init__(self, seed: int) -> None:
        last, nxt = RANDOM_SEED - abs(seed), 1
        ring = [0] * 55
        ring[54] = last
        for i in range(1, 55):
            ring[21 * i % 55 - 1] = nxt
            last, nxt = nxt, (last - nxt) % INT_MAX if last < nxt else last - nxt
            nxt, last = nxt, ring[21 * i % 55 - 1]
        for _ in range(4):
            for i in range(55):
                x = ring[i] - ring[(i + 31) % 55]
                ring[i] = x + INT_MAX if x < 0 else x
        self.ring, self.at = ring, 0

    def next(self) -> int:
        i = self.at
        x = self.ring[i] - self.ring[(i + 21) % 55]
        x -= x == INT_MAX
        self.ring[i] = x = x + INT_MAX if x < 0 else x
        self.at = (i + 1) % 55
        return x

    def next_double(self) -> float:
        return self.next() * (1.0 / INT_MAX)


_MATRICES: dict[tuple[int, int, int], np.ndarray] = {}


def projection(rows: int, width: int, seed: int) -> np.ndarray:
    """rows x width values in [-0.5, 0.5), single precision as stored, double as used; kept per process."""
    key = (rows, width, seed)
    if key not in _MATRICES:
        draw = SeededRandom(seed).next_double
        flat = np.array([draw() - 0.5 for _ in range(rows * width)], dtype=np.float32)
        _MATRICES[key] = flat.reshape(rows, width).astype(np.float64)
    return _MATRICES[key]


def chunk_vectors(chunks: np.ndarray, seed: int = CHUNK_SEED) -> np.ndarray:
    """n x 64 projections of n x size bytes."""
    return chunks.astype(np.float64) @ projection(DIMENSIONS, chunks.shape[1], seed).T


def lane_hashes(chunk: bytes, lanes: int = LANES, bits: int = LANE_BITS, seed: int = LANE_SEED) -> np.ndarray:
    """One ``bits``-wide sign hash per lane; a short last lane is padded with zeros, lanes beyond the bytes are 0."""
    width = max(1, len(chunk) // lanes)
    body = np.zeros(lanes * width, np.uint8)
    own = np.frombuffer(chunk, np.uint8)[: lanes * width]
    body[: len(own)] = own
    sums = body.reshape(lanes, width).astype(np.float64) @ projection(bits, width, seed).T
    out = ((sums >= 0) @ (1 << np.arange(bits))).astype(np.int64)
    out[np.arange(lanes) * width >= len(own)] = 0
    return out


def murmur3_many(keys: list[bytes], seed: int = MURMUR_SEED) -> np.ndarray:
    """MurmurHash3 x86 32 bit of each key, by the published algorithm; keys of one length are hashed together."""
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    mixed = lambda k: turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    out, lengths = np.zeros(len(keys), np.int64), np.array([len(k) for k in keys])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n).astype(np.uint32)
        h = np.full(len(at), seed, np.uint32)
        word = lambda lo, size: sum((data[:, lo + j] << np.uint32(8 * j) for j in range(size)), np.zeros(len(at), np.uint32))  # noqa: B023, E731
        for lo in range(0, n - 3, 4):
            h = turn(h ^ mixed(word(lo, 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ mixed(word(n // 4 * 4, n % 4)) ^ np.uint32(n)  # without a tail the mixed word is 0
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[at] = h ^ h >> np.uint32(16)
    return out


def murmur3_32(data: bytes, seed: int = MURMUR_SEED) -> int:
    return int(murmur3_many([data], seed)[0])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 step on unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(MIX_ADD)
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_1)
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_2)
    return x ^ x >> np.uint64(31)


def hamming(a: bytes, b: bytes) -> int:
    """Differing bytes; what one has over the other counts as differing."""
    n = min(len(a), len(b))
    return int(np.count_nonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) + abs(len(a) - len(b))


def diff(new: bytes, base: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, deltas mod 256) that turn ``base`` into ``new``, both of one length."""
    x, y = np.frombuffer(new, np.uint8), np.frombuffer(base, np.uint8)
    at = np.flatnonzero(x != y)
    return at, x[at] - y[at]


def patch(base: bytes, at: np.ndarray, deltas: np.ndarray) -> bytes:
    """Inverse of ``diff``; signed deltas work as well, as everything is modulo 256."""
    out = np.frombuffer(base, np.uint8).copy()
    out[at] += np.asarray(deltas).astype(np.int64).astype(np.uint8)
    return out.tobytes()


def entropy(chunk: bytes) -> float:
    """Shannon entropy in bits per byte; 0 for no bytes."""
    if not chunk:
        return 0.0
    p = np.bincount(np.frombuffer(chunk, np.uint8))
    p = p[p > 0] / len(chunk)
    return float(-(p * np.log2(p)).sum()) + 0.0


def varints(values: np.ndarray | list[int]) -> bytes:
    """LEB128 of each value, joined."""
    out = bytearray()
    for v in np.asarray(values, dtype=np.int64).tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


class Reader:
    """Checked reads from bytes; every failure is a ValueError."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def integer(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little", signed=True)

    def varint(self) -> int:
        value = 0
        for shift in range(0, 35, 7):
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
        raise ValueError("varint of more than five groups")


def split_nibbles(data: bytes) -> tuple[bytes, bytes]:
    """High and low halves of each byte, packed two to a byte."""
    x = np.frombuffer(data, np.uint8)
    x = np.concatenate([x, np.zeros(len(x) % 2, np.uint8)])
    pack = lambda h: (h[0::2] << 4 | h[1::2]).astype(np.uint8).tobytes()
    return pack(x >> 4), pack(x & 15)


def join_nibbles(high: bytes, low: bytes, length: int) -> bytes:
    """Inverse of ``split_nibbles`` for ``length`` bytes."""
    spread = lambda p: np.stack([np.frombuffer(p, np.uint8) >> 4, np.frombuffer(p, np.uint8) & 15], axis=1).ravel()
    return (spread(high) << 4 | spread(low)).astype(np.uint8).tobytes()[:length]


def quantise(data: bytes, step: int) -> tuple[bytes, bytes]:
    """(whole steps, residuals)."""
    x = np.frombuffer(data, np.uint8)
    return (x // step).tobytes(), (x % step).tobytes()


def unquantise(steps: bytes, residuals: bytes, step: int) -> bytes:
    return (np.frombuffer(steps, np.uint8) * np.uint8(step) + np.frombuffer(residuals, np.uint8)).tobytes()
