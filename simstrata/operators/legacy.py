"""Compression into, and decompression of, blobs of version 5.6: bases within a file, donors by their places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simstrata.operators import mosaic
from simstrata.operators.store import per_block
from simstrata.sources import ccf5
from simstrata.sources.shared import materialised

#: Chunks before a chunk that may be its donors.
REACH = 4


def choose(chunk: bytes, candidates: list[tuple[ccf5.Place, bytes]], size: int, limit: float) -> tuple[ccf5.Base, bytes] | None:
    """The base that differs in the fewest bytes, and in ``limit`` of them at most: a candidate, two merged, or a mosaic."""
    if not candidates:
        return None
    places, data = [p for p, _ in candidates], [c for _, c in candidates]
    at, n = mosaic.best_single(chunk, data)
    found = [(n, ccf5.Base(ccf5.REF, [places[at]]))]
    if (pair := mosaic.best_pair(chunk, data)) is not None:
        a, b, n, mask = pair
        found.append((n, ccf5.Base(ccf5.PAIR, [places[a], places[b]], mask=mask)))
    if size % ccf5.LANES == 0:
        merged, lanes = mosaic.mosaic(chunk, data, ccf5.LANES)
        used = sorted({s[0] for s in lanes if s is not None})
        if used:
            n = int((np.frombuffer(merged, np.uint8) != np.frombuffer(chunk, np.uint8)).sum())
            found.append((n, ccf5.Base(ccf5.MOSAIC, [places[k] for k in used], [None if s is None else (used.index(s[0]), s[1]) for s in lanes])))
    n, base = min(found, key=lambda x: x[0])
    by_place = dict(candidates)
    return (base, ccf5.stitched(base, [by_place[p] for p in base.donors], size)) if n <= limit * size else None


def compress(files: DataFrame, size: int, limit: float = 0.40) -> tuple[DataFrame, DataFrame]:
    """((file_id, block_idx, blob), store rows (bucket_id, chunk_id, chunk)) of (file_id long, bytes).

    A file's chunks that are stored are those without a base near enough; their bucket is the file. Candidates are the
    last ``REACH`` stored chunks of the file, so a row is all that a task needs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs, kept = [], [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = len(data) // size * size
                chunks, bases, against, stored = [data[lo : lo + size] for lo in range(0, cut, size)], [], [], []
                for c in chunks:
                    if not any(c):
                        base, own = ccf5.Base(ccf5.ZEROS), bytes(size)
                    elif (near := choose(c, stored[-REACH:], size, limit)) is not None:
                        base, own = near
                    else:
                        place = (i, len(stored))
                        stored.append((place, c))
                        base, own = ccf5.Base(ccf5.FRESH, [place]), c
                    bases.append(base)
                    against.append(own)
                ids.append(i)
                blobs.append(ccf5.write(chunks, bases, against, size, data[cut:], hashlib.sha256(data).digest()))
                kept.append([{"bucket_id": p[0], "chunk_id": p[1], "chunk": c} for p, c in stored])
            chunk = pa.struct([("bucket_id", pa.int64()), ("chunk_id", pa.int64()), ("chunk", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int32()), pa.array(blobs, pa.binary()), pa.array(kept, pa.list_(chunk))], ["file_id", "block_idx", "blob", "stored"])

    # Few large input files would be few tasks of much work.
    made = files.select("file_id", "bytes").repartition("file_id").mapInArrow(work, "file_id long, block_idx int, blob binary, stored array<struct<bucket_id:long,chunk_id:long,chunk:binary>>")
    made = materialised(made, "legacy")
    return made.select("file_id", "block_idx", "blob"), made.select(F.explode("stored").alias("s")).select("s.*")


def decompress(blobs: DataFrame, store: DataFrame, size: int) -> DataFrame:
    """(file_id, block_idx, bytes, ok): blocks rebuilt from the places they name; ok if nothing is missing and the hash fits."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, k, blob in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                rows.append((i, k, -1, 0, 0, blob))
                rows += [(i, k, n, b - (1 << 64) if b >> 63 else b, c, None) for n, (b, c) in enumerate(ccf5.parse(blob, size).places())]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["file_id", "block_idx", "n", "bucket_id", "chunk_id", "blob"])

    named = blobs.select("file_id", "block_idx", "blob").mapInArrow(places, "file_id long, block_idx int, n int, bucket_id long, chunk_id long, blob binary")
    found = named.join(store.select("bucket_id", "chunk_id", "chunk"), ["bucket_id", "chunk_id"], "left")

    def rebuild(group: list[list]) -> list:
        files, blocks, order, buckets, numbers, parts, chunks = group
        p = ccf5.parse(parts[order.index(-1)], size)
        stored = {(b % (1 << 64), n): c for b, n, c, k in zip(buckets, numbers, chunks, order, strict=True) if k >= 0 and c is not None and len(c) == size}
        try:
            data = p.rebuilt(stored, size)
        except ValueError:
            return [files[0], blocks[0], None, False]
        return [files[0], blocks[0], data, hashlib.sha256(data).digest() == p.sha256]

    columns = found.select("file_id", "block_idx", "n", "bucket_id", "chunk_id", "blob", "chunk")
    return per_block(columns, rebuild, "file_id long, block_idx int, bytes binary, ok boolean")
