"""Operator 9: byte-level BPE encoding and decoding by a monoid tree reduction.

The encoding of a run of bytes is a sequence of tokens, and two encodings are joined by re-encoding a window around the
seam, which grows until the tokens outside are *provably stable*. A sequence of tokens is the encoding of its bytes
exactly if all neighbouring pairs are compatible, i.e. the joined bytes of a pair encode to the same two tokens. (This
needs every token of the vocabulary to encode to itself, which the tests check for the whole vocabulary.) So a window is
large enough as soon as its first and last token are compatible with their neighbours outside.

Reduction goes on at two levels. Within a match of the pattern the bytes are halved down to ``LEAF_BYTES``, leaves are
merged by rank, and halves are joined as said. A text is halved down to ``leaf`` characters, and its joins re-encode a
window of text up to edges that are stable on both sides:

* an edge between a character that is no white space and a white space character. No match of the pattern spans it
  and no look-ahead reaches over it, so the pattern splits the text there whatever stands on either side;
* an edge between two letters or two digits, not within two characters of an apostrophe (no contraction reaches over
  it), at which the tokens on both sides are compatible.

If neither kind is found, the window reaches the ends of the text, where nothing is outside. Neither of the leaf sizes
changes any result. Decoding concatenates the bytes of the tokens up the same kind of tree.

Defined cases: null texts count as empty and have no tokens; very long texts only deepen the tree; repeated rows are
encoded one by one; an empty table gives an empty table; all other columns are passed through, and a column that has
the name of an output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Characters and bytes in a leaf; caches are emptied at this many entries; windows from this size on are merged by a heap.
LEAF, LEAF_BYTES, CACHE, LARGE = 2048, 16, 400_000, 64

_EDGE = regex.compile(r"\S(?=\s)")
_CACHE: dict[int, "Encoder"] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _Pieces(dict):
    """Match of the pattern to its ids; those of new ones are worked out."""

    def __init__(self, new) -> None:
        self.new = new

    def __missing__(self, match: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        found = self[match] = self.new(match.encode())
        return found


class Encoder:
    """Tree encoder for one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES) -> None:
        self.leaf, self.leaf_bytes, self.ranks = max(4, leaf), max(1, leaf_bytes), ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.length = [len(t) for t in self.bytes_of]
        self.matches = regex.compile(pattern).findall
        self.pieces = _Pieces(self.piece)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of a run of bytes: the neighbours whose union has the least rank are merged, the leftmost first."""
        if len(data) >= LARGE:
            return self._merge_large(data)
        rank, none, cuts = self.ranks.get, len(self.bytes_of), list(range(len(data) + 1))
        ranks = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            del cuts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(data[cuts[i] : cuts[i + 2]], none)
            if i:
                ranks[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[data[i:j]] for i, j in pairwise(cuts)]

    def _merge_large(self, data: bytes) -> list[int]:
        """The same, by a heap over linked parts."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # where the part that begins at i ends; where the one before begins
        alive = bytearray(b"\1") * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not alive[i] or middle >= n or not alive[middle] or end[middle] != stop:
                continue  # one of the two has been merged since
            alive[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := rank(data[left:stop])) is not None:
                heapq.heappush(queue, (r, left, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def piece(self, data: bytes) -> list[int]:
        """Ids of the bytes of one match, by tree reduction."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        mid = len(data) // 2
        return self.joined(self.piece(data[:mid]), self.piece(data[mid:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            stable_left = i >= len(left) or self.compatible(left[-i - 1], window[0])
            stable_right = j >= len(right) or self.compatible(window[-1], right[j])
            if stable_left and stable_right:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i if stable_left else 2 * i, j if stable_right else 2 * j

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def plain(self, text: str) -> list[int]:
        """Ids of a text that isn't halved any more: those of its matches."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.matches(text))))

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        reach = 32
        while True:
            a, b = max(lo, mid - reach), min(hi, mid + reach)
            lefts = self._left_edges(text, lo, a, mid, left)
            rights = self._right_edges(text, mid, b, hi, right)
            for (p, i, sure_p), (q, j, sure_q) in self._choices(lefts, rights):
                window = self.plain(text[p:q])
                if not sure_p and not self.compatible(left[i - 1], window[0]):
                    continue
                if not sure_q and not self.compatible(window[-1], right[j]):
                    continue
                del left[i:]
                left += window
                left += right[j:]
                return left
            reach *= 4

    @staticmethod
    def _choices(lefts: list, rights: list) -> Iterator[tuple]:
        if lefts and rights:
            yield lefts[0], rights[0]
            if len(lefts) > 1 or len(rights) > 1:
                yield lefts[-1], rights[-1]

    def _left_edges(self, text: str, lo: int, a: int, mid: int, tokens: list[int]) -> list[tuple[int, int, bool]]:
        """Stable edges p in [a, mid - 3], nearest first: (p, number of tokens before p, certain)."""
        if a == lo:
            return [(lo, 0, True)]
        spaces = {m.end() for m in _EDGE.finditer(text, a - 1, mid - 2) if m.end() <= mid - 3}
        found, p, i = [], mid, len(tokens)
        need = 0
        for t in reversed(tokens):
            # steps back by whole tokens; an edge counts only where it also ends a character
            need += self.length[t]
            i -= 1
            step, p = self._back(text, p, need, a)
            need -= step
            if p < a:
                break
            if need == 0 and p <= mid - 3:
                if p in spaces:
                    found.append((p, i, True))
                    break
                if _inner(text, p, lo, mid) and i > 0:
                    found.append((p, i, False))
        found.sort(key=lambda x: not x[2])
        return found

    @staticmethod
    def _back(text: str, p: int, need: int, least: int) -> tuple[int, int]:
        """Steps back from p over whole characters that fit in ``need`` bytes: (bytes, new p)."""
        step = 0
        while p >= least and p > 0:
            size = _utf8(text[p - 1])
            if step + size > need:
                break
            step += size
            p -= 1
        return step, p

    def _right_edges(self, text: str, mid: int, b: int, hi: int, tokens: list[int]) -> list[tuple[int, int, bool]]:
        """Stable edges q in [mid + 3, b], nearest first: (q, number of tokens before q, certain)."""
        if b == hi:
            return [(hi, len(tokens), True)]
        found, q, have = [], mid, 0
        for j, t in enumerate(tokens, 1):
            have += self.length[t]
            while q < b and have >= (size := _utf8(text[q])):
                have -= size
                q += 1
            if q >= b:
                break
            if have == 0 and q >= mid + 3:
                if text[q].isspace() and not text[q - 1].isspace() and _EDGE.match(text, q - 1):
                    found.append((q, j, True))
                    break
                if _inner(text, q, mid, hi) and j < len(tokens):
                    found.append((q, j, False))
        found.sort(key=lambda x: not x[2])
        return found

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_LETTERS, _DIGITS = regex.compile(r"\p{L}{4}"), regex.compile(r"\p{N}{4}")


def _inner(text: str, p: int, lo: int, hi: int) -> bool:
    """Four letters, or four digits, around p: no contraction or other kind of match ends or begins near it."""
    return p - 2 >= lo and p + 2 <= hi and bool(_LETTERS.match(text, p - 2) or _DIGITS.match(text, p - 2)) and text[max(lo, p - 3)] not in "'’"


def _utf8(c: str) -> int:
    o = ord(c)
    return 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4


def _encoder(key: int, data, pattern: str, leaf: int) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Encoder(parse_ranks(data.value), pattern, leaf)
    return _CACHE[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", output: str = "token_ids", leaf: int = LEAF) -> DataFrame:
    """``df`` with ``output``: the ids of each text, packed as little-endian unsigned 32-bit integers.

    The vocabulary file is read by the driver and broadcast; its size (about a megabyte) doesn't depend on the data.
    """
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    key = hash((ranks_path, pattern, leaf))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(key, data, pattern, leaf)
        for batch in batches:
            yield pd.Series([np.asarray(encoder.encode(x or ""), dtype="<u4").tobytes() for x in batch], dtype=object)

    return df.withColumn(output, packed(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``df`` with ``output``: the bytes of each row's packed ids; null ids give empty bytes."""
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    key = hash((ranks_path, pattern, LEAF))

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(key, data, pattern, LEAF)
        for batch in batches:
            yield pd.Series([encoder.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch], dtype=object)

    return df.withColumn(output, bytes_of(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one Python stage that works in lots of 256 texts, so few texts are in memory at once."""
    data = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    key = hash((ranks_path, pattern, LEAF))
    rest = [c for c in df.columns if c not in (ids, output)]
    at = rest.index(text)
    schema = StructType([*df.select(*rest).schema.fields, StructField(ids, BinaryType()), StructField(output, BinaryType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, data, pattern, LEAF)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                tokens = [encoder.encode(x.as_py() or "") for x in some.column(at)]
                packed = pa.array([np.asarray(x, dtype="<u4").tobytes() for x in tokens], pa.binary())
                back = pa.array([encoder.decode(np.frombuffer(x.as_buffer(), dtype="<u4").tolist()) for x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, packed, back], [*rest, ids, output])

    return df.select(*rest).mapInArrow(both, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path, pattern).select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
