"""Operator 2: scoring texts with a log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end per text. All training tokens are counted.

The most frequent words (all of the same counts, ``HEAD`` times the square root of N at most; N: the training tokens),
the end, and ``TAILS`` classes of all other words by their last three bytes are the *ids*; so what the driver and the tasks hold grows with the square root of
the corpus. Every word has a probability: p(w | u, v) = p(id | q) p(w | id), where the two ids before give
q = c1 r_u + c2 r_v, and p(w | id) is 1 for an id of its own, else the word's share of its class, in which one more
count stands for all words that were never counted. p(id | q) = p(group | q) p(id | group, q), both factors being
log-bilinear. Groups are runs of ids in order of frequency, of about p ** -0.5 ids each, which makes the expected cost of
the two normalisers least. Normalisers are batched matrix products, so probabilities of tokens sum to one.

Training texts are dealt by a hash to shards of about ``SHARD_TOKENS`` tokens and sorted by that hash, so neither the
order nor the partitions of the table change the model. Each shard is one pass of training over all its tokens from the
same start, the unigram model, with noise drawn from the groups' frequencies and from within the id's own group; rows of
parameters are averaged by how often their ids occurred in a shard. The counts of class words are joined to the distinct
class words of each text by their 64-bit hashes (two of 10 million words collide with a probability of 3 in a million).

Defined cases: a null text counts as empty: its only token is the end; a text without words likewise; with no training
rows at all counts are 0 and the model is uniform; rows that repeat id and text are scored alike, one row each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import remainder, written

DIM, NOISE, BATCH, RATE, FLUSH, BLOCK = 16, 32, 4096, 0.1, 200_000, 4096
HEAD, TAILS, SHARD_TOKENS, LESSON = 5.0, 256, 4_000_000, 500_000
END = b" "  # can't be a word
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower() and bytes.split() know ASCII only, as asked for."""
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): counts of all tokens of all rows, the end as one space. Tasks send partial counts in bounded lots."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def lot() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                found.update(words_of(t.as_py()))
                found[END] += 1
                if len(found) > FLUSH:
                    yield lot()
        if found:
            yield lot()

    return docs.select(text).mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def layout(p: np.ndarray) -> np.ndarray:
    """First ids of the groups: runs of about p ** -0.5 ids."""
    starts, i = [], 0
    while i < len(p):
        starts.append(i)
        i += math.ceil(p[i] ** -0.5)
    return np.array(starts)


class Params:
    """One matrix of dim + 1 columns, the last being biases: a row for each id, one for each group, and two whose other
    columns weigh the two places before."""

    def __init__(self, p: np.ndarray, dim: int = DIM, seed: int = 1) -> None:
        self.starts = layout(p)
        n, vocab = len(self.starts), len(p)
        self.set(np.random.default_rng(seed).standard_normal((vocab + n + 2, dim + 1), np.float32) * np.float32(0.1))
        mass = np.add.reduceat(p, self.starts)
        self.mass = mass
        self.b[:], self.gb[:] = np.log(p / mass[self.of]), np.log(mass)
        self.c[0], self.c[1] = 1.0, 0.5

    def set(self, m: np.ndarray) -> None:
        n, dim = len(self.starts), m.shape[1] - 1
        self.m, self.vocab = m, len(m) - n - 2
        self.sizes = np.diff(np.r_[self.starts, self.vocab])
        self.of = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.r, self.b = m[: self.vocab, :dim], m[: self.vocab, dim]
        self.g, self.gb = m[self.vocab : self.vocab + n, :dim], m[self.vocab : self.vocab + n, dim]
        self.c = m[self.vocab + n :, :dim]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def train(params: Params, ids: np.ndarray, target: np.ndarray, squares: np.ndarray, seed: int, rate: float = RATE, batch: int = BATCH, k: int = NOISE) -> None:
    """One pass of noise-contrastive estimation over a run of ids, of which those marked ``target`` are predicted: for
    groups with one lot of noise shared by each batch, for ids with one noise id of the same group. ``squares`` holds
    the sums of squared gradients of each row of parameters, which set its rate."""
    rng, p = np.random.default_rng(seed), params
    cdf, dim, n_groups = np.cumsum(p.mass), p.r.shape[1], len(p.starts)
    log_kg = np.log(k * p.mass).astype(np.float32)
    log_kw = -np.log(p.sizes).astype(np.float32)  # a noise id is as likely as any other of its group
    for lo in range(0, len(ids) - 2, batch):
        a = ids[lo : lo + batch + 2]
        w, on = a[2:], target[lo + 2 : lo + batch + 2].astype(np.float32)
        at = p.of[w]
        noise = np.minimum(np.searchsorted(cdf, rng.random(k)), n_groups - 1)
        other = p.starts[at] + (rng.random(len(w)) * p.sizes[at]).astype(np.int64)
        ra, ro, rg, rn = p.r[a], p.r[other], p.g[at], p.g[noise]
        rw, q = ra[2:], ra[1:-1] * p.c[0] + ra[:-2] * p.c[1]
        dg = (_sigmoid((q * rg).sum(1) + p.gb[at] - log_kg[at]) - 1) * on  # d loss / d score of the groups
        dn = _sigmoid(q @ rn.T + (p.gb[noise] - log_kg[noise])) * on[:, None]  # and of their noise
        dw = (_sigmoid((q * rw).sum(1) + p.b[w] - log_kw[at]) - 1) * on  # of the ids
        do = _sigmoid((q * ro).sum(1) + p.b[other] - log_kw[at]) * on  # and of theirs
        gq = dg[:, None] * rg + dn @ rn + dw[:, None] * rw + do[:, None] * ro
        # An id's row is at work as the target, as the id before, and as the one before that.
        rows = np.zeros((len(a) + len(w), dim + 1), np.float32)
        rows[2 : len(a), :dim], rows[2 : len(a), dim] = dw[:, None] * q, dw
        rows[1 : len(a) - 1, :dim] += gq * p.c[0]
        rows[: len(a) - 2, :dim] += gq * p.c[1]
        rows[len(a) :, :dim], rows[len(a) :, dim] = do[:, None] * q, do
        grad_c = np.stack([(gq * ra[1:-1]).sum(0), (gq * ra[:-2]).sum(0)])
        found, sums = _sum_rows(np.concatenate([a, other]), rows)
        _step(p.m, squares, found, sums, rate)
        groups, sums = _sum_rows(np.concatenate([at, noise]).astype(np.int16 if n_groups < 1 << 15 else np.int64), np.concatenate([np.c_[dg[:, None] * q, dg], np.c_[dn.T @ q, dn.sum(0)]]))
        _step(p.m, squares, groups.astype(np.int64) + p.vocab, sums, rate)
        p.c -= np.clip(rate / len(w) * grad_c, -0.01, 0.01)


def _step(m: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    squares[at] += (grad * grad).mean(1)
    m[at] -= grad * (rate / np.sqrt(1 + squares[at]))[:, None]


def _sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of ``at``, the sums of their ``rows``)."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[starts], np.add.reduceat(rows[order], starts, axis=0)


def tail_of(word: bytes) -> int:
    """A word's class, by its last three bytes."""
    return xxhash.xxh64_intdigest(word[-3:], 42) % TAILS


class Ids(dict):
    """Ids of words; those of the head are given, others are found by their class."""

    def __init__(self, head: dict[bytes, int], tails: np.ndarray) -> None:
        super().__init__(head)
        self.tails = tails.tolist()

    def __missing__(self, word: bytes) -> int:
        return self.tails[tail_of(word)]

    def run(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, which of them are targets): two ends before each text's words, and its own end behind them."""
        end, get = self[END], self.__getitem__
        flat: list[int] = []
        for words in texts:
            flat += (end, end)
            flat += map(get, words)
            flat.append(end)
        sizes = np.array([len(t) + 3 for t in texts])
        first = np.cumsum(sizes) - sizes
        target = np.ones(len(flat), bool)
        target[first] = target[first + 1] = False
        return np.array(flat, np.int64), target


def _log_sums(q: np.ndarray, m: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log(sum(exp(q @ row))) over the rows of ``m``, for each row of ``q``; ``cells`` is memory that is used again."""
    out, some = np.empty(len(q), np.float32), max(1, len(cells) // len(m))
    for lo in range(0, len(q), some):
        part = q[lo : lo + some]
        s = cells[: len(part) * len(m)].reshape(len(part), len(m)) if len(m) <= len(cells) else np.empty((len(part), len(m)), np.float32)
        np.matmul(part, m.T, out=s)
        with np.errstate(over="ignore", divide="ignore"):
            found = np.log(np.exp(s, out=s).sum(axis=1))
        if not np.isfinite(found).all():
            s = part.astype(np.float64) @ m.T
            top = s.max(axis=1, keepdims=True)
            found = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        out[lo : lo + some] = found
    return out


def log_p(p: Params, ids: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Natural log-probabilities of all ids of a run but the first two."""
    w, n, dim = ids[2:], len(ids) - 2, p.r.shape[1]
    at = p.of[w]
    order = np.argsort(at.astype(np.int16) if len(p.starts) < 1 << 15 else at, kind="stable")
    w, at, groups, cells = w[order], at[order], p.m[p.vocab : p.vocab + len(p.starts)], np.empty(block, np.float32)
    q = np.ones((n, dim + 1), np.float32)  # the last column meets the biases
    q[:, :dim] = (p.r[ids[1:-1]] * p.c[0] + p.r[ids[:-2]] * p.c[1])[order]
    own = np.einsum("ij,ij->i", q, groups[at] + p.m[w])
    own -= _log_sums(q, groups, cells)
    ends = np.searchsorted(at, np.arange(len(groups) + 1))
    for k in np.flatnonzero(np.diff(ends)):
        some = slice(ends[k], ends[k + 1])
        own[some] -= _log_sums(q[some], p.m[p.starts[k] : p.starts[k] + p.sizes[k]], cells)
    out = np.empty(n)
    out[order] = own
    return out


class Model:
    """Parameters; the head's words with their ids and counts; ids and masses of the classes; N and V."""

    def __init__(self, params: Params, head: dict[bytes, int], counts: np.ndarray, tails: np.ndarray, masses: np.ndarray, total: int, distinct: int) -> None:
        self.params, self.head, self.counts, self.tails, self.masses, self.total, self.distinct = params, head, counts, tails, masses, total, distinct


def start_of(counts: DataFrame, head: float = HEAD, dim: int = DIM) -> Model:
    """The unigram model: ids by frequency."""
    tail = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(TAILS)).cast("int")
    by_class = {r.tail: r for r in counts.where(F.col("word") != F.lit(END)).groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_end = sum(r.n for r in counts.where(F.col("word") == F.lit(END)).collect())
    total = n_end + sum(r.n for r in by_class.values())
    # How many words have each count: as many rows as there are different counts, at most the square root of 2 N.
    words, size, least, held = counts.where(F.col("word") != F.lit(END)), head * math.sqrt(total), None, 0
    for r in sorted(words.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        held += r.words
        if held > size:
            break
        least = r.n
    top = sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, bytes(r.word))) if least else []
    masses = np.array([by_class[t].n if t in by_class else 0 for t in range(TAILS)], np.int64)
    for r in top:
        masses[tail_of(bytes(r.word))] -= r.n
    # Classes count one more, for the words that were never counted; the end counts once at least.
    n = np.array([max(1, n_end), *(r.n for r in top), *(masses + 1)], np.int64)
    names = [END, *(bytes(r.word) for r in top)]
    order = np.lexsort((np.arange(len(n)), -n))
    ids = np.empty(len(n), np.int64)
    ids[order] = np.arange(len(n))
    seen = np.array([n_end, *(r.n for r in top), *([-1] * TAILS)], np.int64)[order]  # -1: known after the join
    distinct = sum(r.v for r in by_class.values()) + (n_end > 0)
    return Model(Params(n[order] / n.sum(), dim), dict(zip(names, ids.tolist(), strict=False)), seen, ids[len(names) :], masses, total, distinct)


def fit(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text: str = "text", head: float = HEAD, dim: int = DIM, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model of ``docs``, whose counts are ``counts``."""
    model = start_of(counts, head, dim)
    if not model.total:
        return model
    shared, shards = docs.sparkSession.sparkContext.broadcast(model), -(-model.total // shard_tokens)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, ids = model.params.m.copy(), Ids(model.head, model.tails)
        shard, texts, size = None, [], 0

        def lesson() -> None:
            nonlocal used
            run, target = ids.run(texts)
            train(params, run, target, squares, seed=len(run))
            used[: params.vocab] += np.bincount(run, minlength=params.vocab)
            used[params.vocab :] += len(run)
            texts.clear()

        def results() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(used), BLOCK):
                at = np.flatnonzero(used[lo : lo + BLOCK]).astype(np.int32)
                if len(at):
                    cells = [shard, lo, at.tobytes(), used[lo + at].astype("<i8").tobytes(), params.m[lo + at].astype("<f2").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "at", "n", "x"])

        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != shard:
                    if shard is not None:
                        if texts:
                            lesson()
                        yield from results()
                    shard, size, params = own, 0, model.params
                    params.set(start.copy())
                    used, squares = np.zeros(len(start), np.int64), np.zeros(len(start), np.float32)
                texts.append(words_of(t.as_py()))
                size += len(texts[-1]) + 1
                if size > LESSON:
                    lesson()
                    size = 0
        if shard is not None:
            if texts:
                lesson()
            yield from results()

    def mean(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BLOCK, dim + 1)), np.zeros(BLOCK)
        for r in sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["shard"]):
            at, m = np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], "<i8")
            n[at] += m
            sums[at] += np.frombuffer(r["x"], "<f2").astype(np.float32).reshape(len(at), -1) * m[:, None]
        at = np.flatnonzero(n).astype(np.int32)
        x = (sums[at] / n[at, None]).astype("<f2")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "at", "x"])

    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    dealt = docs.select(F.pmod(h, F.lit(shards)).alias("shard"), F.col(text).alias("text"), h.alias("h"), F.col(id_col).alias("id"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "id").select("shard", "text")
    tasks = dealt.mapInArrow(learn, "shard long, block long, at binary, n binary, x binary")
    means = written(tasks.groupBy("block").applyInArrow(mean, "block long, at binary, x binary"), "lm-means")
    for r in means.toLocalIterator():
        at = np.frombuffer(r.at, np.int32)
        model.params.m[r.block + at] = np.frombuffer(r.x, "<f2").reshape(len(at), -1)
    return model


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, TaskContext.get().partitionId() << 40
        ids, p = Ids(model.head, model.tails), model.params
        log_base, log_mass = math.log10(model.total + model.distinct + 1), np.zeros(p.vocab)
        log_mass[model.tails] = np.log10(model.masses + 1)
        known, log_count = model.counts > 0, np.log10(np.maximum(model.counts, 0) + 1.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [words_of(t.as_py()) for t in some.column(1)]
                run, target = ids.run(texts)
                own, w = log_p(p, run) / LN10, run[2:]
                own -= log_mass[w]
                firsts, lengths = np.flatnonzero(~target)[::2], np.array([len(t) + 1 for t in texts])
                sums = lambda x: np.add.reduceat(np.where(target[2:], x, 0), firsts)  # noqa: B023, E731
                rare = [Counter(x for x in words if x not in ids) for words in texts]
                cells = [
                    some.column(0), pa.array(np.arange(n, n + len(texts))), pa.array(lengths, pa.int64()), pa.array(sums(known[w].astype(np.int64))),
                    pa.array(sums(log_count[w]) - lengths * log_base), pa.array(sums(own)),
                    pa.array([[xxhash.xxh64_intdigest(x, 42) - (1 << 63) for x in c] for c in rare], pa.list_(pa.int64())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32())),
                ]
                n += len(texts)
                yield pa.RecordBatch.from_arrays(cells, ["id", "row", "n_tokens", "n_known", "base", "own", "h", "n"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text)
    rows = written(keyed.mapInArrow(parts, "id long, row long, n_tokens long, n_known long, base double, own double, h array<long>, n array<int>"), "lm-rows")
    spots = rows.select("row", F.explode(F.arrays_zip("h", "n")).alias("s")).select("row", F.col("s.h").alias("h"), F.col("s.n").alias("n"))
    # The unsigned hash less 2 ** 63, as above.
    held = counts.where(F.col("word") != F.lit(END)).select(F.xxhash64("word").bitwiseXOR(F.lit(-(1 << 63))).alias("h"), F.col("n").alias("c"))
    hits = spots.join(held, "h").groupBy("row").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("b"), F.sum(F.col("n") * F.log10("c")).alias("s"))
    whole, zero = rows.drop("h", "n").join(hits, "row", "left"), F.lit(0)
    return whole.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = docs.where(remainder("doc_id", 7) != 2)
    counts = written(count_words(training), "lm-counts")
    scored = score(docs, counts, fit(training, counts))
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
