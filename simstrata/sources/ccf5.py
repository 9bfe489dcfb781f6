"""Blob format of version 5.6: references by a table of places, differences as bit masks and replaced bytes.

After the header (version, lengths of refs, of errors twice, and of the trim) come the refs: the number of chunks, the
table of (bucket, number in the bucket) places, then for each chunk a kind byte and what belongs to it. The error section
has three zstd streams: a bit per chunk that differs, a mask of its differing bytes for each of these, and the bytes that
take their place. Everything is little-endian, the lowest bit of a byte comes first. Broken input raises ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import zstandard

from simstrata.functions.kernels import Reader

# Fixed values of the format.
VERSION = b"v5.6.0"
ZEROS, REF, FRESH, MOSAIC, PAIR = 0, 1, 2, 4, 5
LANES, LEVEL, MAX_PLACES = 64, 19, 65535

Place = tuple[int, int]


@dataclass
class Base:
    """What a chunk is compared with: nothing, a stored chunk, lanes of up to 15 donors, or bytes of two donors.

    ``lanes`` has (donor, lane of the donor) or None for each lane; ``mask`` is set where a byte is the second donor's.
    """

    kind: int
    donors: list[Place] = field(default_factory=list)
    lanes: list[tuple[int, int] | None] = field(default_factory=list)
    mask: np.ndarray | None = None


def stitched(base: Base, donors: list[bytes], size: int) -> bytes:
    """The bytes of a base, from those of its donors."""
    if base.kind in (REF, FRESH):
        return donors[0]
    out = np.zeros(size, np.uint8)
    if base.kind == PAIR:
        out[:] = np.where(base.mask, *(np.frombuffer(donors[k], np.uint8) for k in (1, 0)))
    elif base.kind == MOSAIC:
        width = max(1, size // LANES)
        held = [k for k, spot in enumerate(base.lanes) if spot is not None]
        if held:
            each = size // width
            if any(len(d) != size for d in donors) or max(base.lanes[k][1] for k in held) >= each:
                raise ValueError("a lane lies beyond its donor")
            lanes = np.frombuffer(b"".join(d[: each * width] for d in donors), np.uint8).reshape(-1, width)
            out[: len(base.lanes) * width].reshape(-1, width)[held] = lanes[[base.lanes[k][0] * each + base.lanes[k][1] for k in held]]
    return out.tobytes()


def _refs(bases: list[Base]) -> bytes:
    table = {place: i for i, place in enumerate(dict.fromkeys(p for b in bases for p in b.donors))}
    if len(table) > MAX_PLACES:
        raise ValueError(f"{len(table)} places; a block of this version holds {MAX_PLACES} at most")
    out = [struct.pack("<iH", len(bases), len(table)), *(struct.pack("<2Q", *(x % (1 << 64) for x in p)) for p in table)]
    for b in bases:
        out.append(bytes([b.kind]))
        numbers = struct.pack(f"<{len(b.donors)}H", *(table[p] for p in b.donors))
        if b.kind == MOSAIC:
            held = np.array([s is not None for s in b.lanes])
            spots = np.array([s or (0, 0) for s in b.lanes], np.uint8)
            halves = spots[0::2, 0] | spots[1::2, 0] << 4
            out += [bytes([len(b.donors)]), numbers, np.packbits(held, bitorder="little").tobytes(), halves.astype(np.uint8).tobytes(), spots[:, 1].tobytes()]
        elif b.kind == PAIR:
            out += [numbers, np.packbits(b.mask, bitorder="little").tobytes()]
        elif b.kind != ZEROS:
            out.append(numbers)
    return b"".join(out)


def _read_refs(data: bytes, size: int) -> list[Base]:
    r = Reader(data)
    n, places = r.integer(4), int.from_bytes(r.take(2), "little")
    table = [struct.unpack("<2Q", r.take(16)) for _ in range(places)]

    def donors(k: int) -> list[Place]:
        found = struct.unpack(f"<{k}H", r.take(2 * k))
        if found and max(found) >= places:
            raise ValueError("a reference lies beyond the table of places")
        return [table[i] for i in found]

    out = []
    for _ in range(n):
        kind = r.take(1)[0]
        if kind == ZEROS:
            out.append(Base(kind))
        elif kind in (REF, FRESH):
            out.append(Base(kind, donors(1)))
        elif kind == PAIR:
            own = donors(2)
            out.append(Base(kind, own, mask=np.unpackbits(np.frombuffer(r.take(size // 8), np.uint8), bitorder="little").astype(bool)))
        elif kind == MOSAIC:
            own = donors(r.take(1)[0])
            held = np.unpackbits(np.frombuffer(r.take(LANES // 8), np.uint8), bitorder="little")
            halves = np.frombuffer(r.take(LANES // 2), np.uint8)
            which, where = np.stack([halves & 15, halves >> 4], axis=1).ravel(), r.take(LANES)
            if any(h and w >= len(own) for h, w in zip(held, which, strict=True)):
                raise ValueError("a lane names a donor that isn't there")
            out.append(Base(kind, own, [(int(w), int(p)) if h else None for h, w, p in zip(held, which, where, strict=True)]))
        else:
            raise ValueError(f"unknown kind {kind} of reference")
    if r.at != len(data):
        raise ValueError("bytes are left after the refs")
    return out


def _errors(chunks: np.ndarray, bases: np.ndarray) -> bytes:
    differs = chunks != bases
    some = differs.any(axis=1)
    streams = [np.packbits(some, bitorder="little").tobytes(), np.packbits(differs[some], axis=1, bitorder="little").tobytes(), chunks[differs].tobytes()]
    packed = [zstandard.ZstdCompressor(level=LEVEL).compress(s) for s in streams]
    return struct.pack("<6i", int(differs.sum()), chunks.size, len(chunks), *map(len, packed)) + b"".join(packed)


def _read_errors(section: bytes, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of differing bytes, the bytes that take their place, in order)."""
    r = Reader(section)
    patches, total, chunks, *lengths = (r.integer(4) for _ in range(6))
    if total != n * size or chunks != n:
        raise ValueError("the error section belongs to another number of chunks")
    try:
        modes, masks, values = (np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(r.take(k)), np.uint8) for k in lengths)
    except zstandard.ZstdError as error:
        raise ValueError(f"error section: {error}") from error
    some = np.unpackbits(modes, count=n, bitorder="little").astype(bool) if n else np.zeros(0, bool)
    differs = np.zeros((n, size), bool)
    if len(masks) != some.sum() * (size // 8):
        raise ValueError("masks of another length than the chunks that differ")
    differs[some] = np.unpackbits(masks.reshape(-1, size // 8), axis=1, bitorder="little").astype(bool)
    if differs.sum() != patches or len(values) != patches:
        raise ValueError("masks and values don't fit")
    return differs, values


def write(chunks: list[bytes], bases: list[Base], base_bytes: list[bytes], size: int, trim: bytes, sha256: bytes) -> bytes:
    """The blob of chunks against their bases; ``size`` must be a multiple of 8 and, for mosaics, of the number of lanes."""
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, size) for x in (chunks, base_bytes))
    refs, errors = _refs(bases), _errors(a, b)
    head = struct.pack("<i", len(VERSION)) + VERSION + struct.pack("<4i", len(refs), len(errors), len(errors), len(trim))
    return b"".join((head, refs, errors, trim, struct.pack("<i", len(sha256)), sha256))


@dataclass
class Parsed:
    bases: list[Base]
    differs: np.ndarray
    values: np.ndarray
    trim: bytes
    sha256: bytes

    def places(self) -> list[Place]:
        return list(dict.fromkeys(p for b in self.bases for p in b.donors))

    def rebuilt(self, stored: dict[Place, bytes], size: int) -> bytes:
        """The whole block; ValueError if a place isn't stored."""
        try:
            bases = [stitched(b, [stored[p] for p in b.donors], size) for b in self.bases]
        except KeyError as missing:
            raise ValueError(f"place {missing} isn't stored") from missing
        out = np.frombuffer(b"".join(bases), np.uint8).reshape(-1, size).copy()
        out[self.differs] = self.values
        return out.tobytes() + self.trim


def parse(blob: bytes, size: int) -> Parsed:
    r = Reader(blob)
    version = r.take(min(64, r.integer(4)))
    if version != VERSION:
        raise ValueError(f"version {version!r} isn't read")
    refs_len, err_len, _, trim_len = (r.integer(4) for _ in range(4))
    refs, errors, trim = (r.take(k) for k in (refs_len, err_len, trim_len))
    sha256 = r.take(r.integer(4))
    bases = _read_refs(refs, size)
    return Parsed(bases, *_read_errors(errors, len(bases), size), trim, sha256)
