"""Every operator against brute force, or held-out accuracy, and the defined cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simstrata.llm import ann, langid, license, lm, neardup, packing, quality, queries, urlfilter, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, source, lang) with extra columns named like outputs and helpers."""
    full = [(i, t, s, la, "x", 1.0, "y") for i, t, s, la in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, score string, n_words double, label string")


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1


def test_langid_held_out(spark, sf_dir):
    rows = langid.op1_langid(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_learns_all_words_and_grams(spark):
    """As many words as there are, long ones too; n-grams of them by plain counting."""
    words = [f"{a}{b}{c}" for a in "abcdefg" for b in "hijklm" for c in "nopqrst"] + ["q" * 100]
    df = documents(spark, [(i, " ".join(words), "s", "en") for i in range(3)] + [(9, "rare", "s", "en")])
    model = langid.fit(df)
    assert set(model.words) == set(words)
    grams = {g for w in words for n in range(1, 6) for g in langid.grams_of(w, n)}
    assert set().union(*model.grams) == grams


def test_langid_cases(spark):
    train = [(i, " ".join(random.Random(i).choices(["the", "house", "is"] if i % 2 else ["das", "haus", "ist"], k=30)), "s", "en" if i % 2 else "de") for i in range(20)]
    odd = [(90, None, None, None), (91, "", "s", None), (92, "123 !?", "s", None), (93, "houses " * 20_000, "s", None), (93, "houses " * 20_000, "s", None), (94, "hau", "s", None), (95, "½ ² ①", "s", None)]
    df = documents(spark, train + odd)
    model = langid.fit(df)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect() if r.doc_id >= 90]
    assert sorted(got) == [(90, "und"), (91, "und"), (92, "und"), (93, "en"), (93, "en"), (94, "de"), (95, "und")]
    tie = langid.fit(documents(spark, [(1, "so so so", "s", "fr"), (2, "so so so", "s", "en")]))
    assert [(r.lang_pred, r.score) for r in langid.predict(documents(spark, [(1, "so", "s", None)] * 2), tie).collect()] == [("en", 0.5)] * 2
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


# 2


def test_lm_base_and_gain(spark, sf_dir):
    rows = lm.op2_lm(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    counts = Counter()
    for r in rows:
        if not r.held_out:
            counts.update([*lm.words_of(texts[r.doc_id]), lm.END])
    total, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*lm.words_of(texts[r.doc_id]), lm.END]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (total + v + 1)) for t in tokens), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one():
    p = np.random.default_rng(1).random(60)
    params = lm.Params(np.sort(p / p.sum())[::-1], 4)
    params.m += np.random.default_rng(2).standard_normal(params.m.shape).astype(np.float32)
    for u, v in [(0, 0), (3, 59), (59, 1), (20, 20)]:
        each = [lm.log_p(params, np.array([v, u, w]))[0] for w in range(60)]
        assert math.isclose(np.exp(each).sum(), 1, rel_tol=1e-5)
    params.m[5, :4] = 500  # beyond what exp of a single-precision number can hold
    assert np.isfinite(lm.log_p(params, np.array([5, 5, 5, 1, 2]))).all()


def test_lm_scores_equal_brute_force(spark):
    """Softmaxes over all groups and all ids of a group, token by token, and shares of classes by plain counts."""
    texts = [prose(i, 50) for i in range(60)] + [None, "", "Alpha1 zzz unheard"]
    df = documents(spark, [(i, t, "s", None) for i, t in enumerate(texts)])
    train = df.where("doc_id < 50")
    counts = lm.count_words(train)
    model = lm.fit(train, counts, head=3.0)
    n, p = Counter(w for t in texts[:50] for w in [*lm.words_of(t), lm.END]), model.params
    head = set(model.head)
    assert 20 < len(head) <= 3 * math.sqrt(sum(n.values())) + 1 and min(n[w] for w in head - {lm.END}) > max(c for w, c in n.items() if w not in head)
    soft = lambda x: x - np.log(np.exp(x).sum())
    for r in lm.score(df, counts, model).collect():
        tokens, total = [*lm.words_of(texts[r.doc_id]), lm.END], 0.0
        ids = [model.head.get(w, model.tails[lm.tail_of(w)]) for w in [lm.END, lm.END, *tokens]]
        for k, w in enumerate(tokens):
            v, u, i = ids[k : k + 3]
            q = (p.r[u] * p.c[0] + p.r[v] * p.c[1]).astype(np.float64)
            g = p.of[i]
            own = slice(p.starts[g], p.starts[g] + p.sizes[g])
            total += soft(p.g @ q + p.gb)[g] + soft(p.r[own] @ q + p.b[own])[i - p.starts[g]]
            if w not in head:
                total += math.log(max(1, n[w]) / (1 + sum(c for x, c in n.items() if x not in head and lm.tail_of(x) == lm.tail_of(w))))
        assert math.isclose(r.score, total / lm.LN10, rel_tol=1e-4)


def test_lm_does_not_depend_on_partitions(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    train, found = d.where("doc_id % 7 != 2"), []
    for n in (1, 16, 200):
        dealt = train.repartition(n, "text")
        counts = lm.count_words(dealt)
        model = lm.fit(dealt, counts, shard_tokens=20_000)
        rows = lm.score(d.where("doc_id % 7 = 2"), counts, model).collect()
        found.append(sorted((r.doc_id, r.score) for r in rows))
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.allclose([x for _, x in found[0]], [x for _, x in found[1]], rtol=1e-9) and np.allclose([x for _, x in found[0]], [x for _, x in found[2]], rtol=1e-9)


def test_lm_cases(spark):
    df = documents(spark, [(1, None, None, None), (1, None, None, None), (2, "", "s", None), (3, "A a b", "s", None), (4, "a " * 5000, "s", None)])
    counts = lm.count_words(df)
    got = sorted((r.doc_id, r.n_tokens) for r in lm.score(df, counts, lm.fit(df, counts)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 4), (4, 5001)]
    none = lm.count_words(df.limit(0))
    model = lm.fit(df.limit(0), none)
    assert model.total == 0 and lm.score(df, none, model).count() == 5 and lm.score(df.limit(0), none, model).count() == 0


# 3


def test_url_rules_and_cases(spark):
    urls = [
        "http://A.org/x", "http://example.org/es/1", "http://example.org/en/17", "http://b.example.org/en/2", "https://x.com/fr/", "http://x.com/de/a?b#c",
        "http://freepokercasino.net/", None, "no scheme", "http://example.org", "http://x.com/DE/", "http://h.net/p?q", "://", "http://notorg/x",
    ]
    df = spark.createDataFrame([(i, u, "poker casino free free poker", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule int")
    got = {r.page_id: r for r in urlfilter.judge(df, urlfilter.unigrams(df, "html")).collect()}
    assert len(got) == len(urls)
    want = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert [(got[i].rule, got[i].verdict) for i in range(6)] == want
    assert (got[0].host, got[5].path, got[11].path) == ("a.org", "/de/a", "/p")
    assert got[6].host_words[:3] == ["free", "poker", "casino"] and got[6].verdict == "block"
    assert [(got[i].host, got[i].path, got[i].rule) for i in (7, 8, 12)] == [("", "", None)] * 3
    assert got[9].rule is None and got[10].rule is None and got[13].rule is None
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urlfilter.judge(df.limit(0), urlfilter.unigrams(df, "html")).count() == 0


def test_url_bayes_equals_brute_force(spark):
    """Verdicts of urls that no rule decides, by plain counts of the words of hosts and paths."""
    words = ["news", "shop", "casino", "blog", "win", "cheap", "deal", "zeitung"]
    r = random.Random(8)
    urls = [f"http://{r.choice(words)}{r.choice(words)}.{r.choice(['org', 'com', 'net'])}/{r.choice(['fr', 'de', 'x'])}/{r.choice(words)}-{r.randrange(3000)}" for _ in range(400)]
    urls += [urls[0]] * 3 + ["http://" + "casino" * 60 + ".net/" + "win/" * 3000]
    df = spark.createDataFrame([(i, u, " ".join(words)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {x.page_id: x for x in urlfilter.judge(df, urlfilter.unigrams(df, "html")).collect()}
    logp = {w: -math.log(len(words)) for w in words}

    def features(u):
        host, path = u[7:].split("/", 1)
        split = [w for label in host.split(".") for w in urlfilter.viterbi(label, logp, -math.log(len(urls) * len(words) + 1) / 2 - 1)]
        return split, [f"#{len(w)}" if w.isdigit() else w for w in path.replace("/", " ").replace("-", " ").split()]

    total = len(urls) * len(words)
    logp = {w: math.log(len(urls) / total) for w in words}
    counts, n = {"allow": Counter(), "block": Counter()}, Counter()
    for i, u in enumerate(urls):
        if got[i].rule is not None:
            counts[got[i].verdict].update([f for part in features(u) for f in part])
            n[got[i].verdict] += 1
    sums = {v: sum(c.values()) for v, c in counts.items()}
    for v, ws in urlfilter.SEEDS.items():
        for w in ws:
            counts[v][w] += urlfilter.SEED_SHARE * (sums[v] + urlfilter.SEED_BASE)
    norm = {v: sum(c.values()) + 0.5 * urlfilter.BUCKETS for v, c in counts.items()}
    free = [i for i in got if got[i].rule is None]
    assert len(free) > 50 and got[403].host_words[:3] == ["casino"] * 3
    for i in free:
        fs = [f for part in features(urls[i]) for f in part]
        odds = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log((counts["block"][f] + 0.5) / norm["block"]) - math.log((counts["allow"][f] + 0.5) / norm["allow"]) for f in fs)
        assert math.isclose(got[i].block_log_odds, odds, rel_tol=1e-6, abs_tol=1e-6) and got[i].verdict == ("block" if odds > 0 else "allow")


def test_viterbi_is_the_best_split():
    logp = {w: math.log(p) for w, p in {"ab": 0.2, "a": 0.3, "b": 0.1, "abc": 0.15, "c": 0.2, "bc": 0.05}.items()}
    cost = lambda parts: sum(logp.get(w, -9.0 * len(w) - 2) for w in parts)
    for label in ("abc", "aabbcc", "cab", "xab"):
        cuts = [[label[i:j] for i, j in itertools.pairwise([0, *c, len(label)])] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)]
        assert math.isclose(cost(urlfilter.viterbi(label, logp, -9.0)), max(map(cost, cuts)))


# 4


def test_quality_cases(spark):
    shared = "subscribe to our newsletter today for all of the news"
    rows = [(i, f"{prose(i, 60)}\n{shared}", "hot", None) for i in range(30)]
    rows += [(100, None, None, None), (101, "", "s", None), (102, " \n\t ", "s", None), (103, "# a\nb\nb\nb", "s", None), (104, (prose(7, 8) + " ") * 10, "s", None)]
    rows += [(105, prose(105, 25) + ("\n" + shared) * 40, "hot", None), (106, prose(106, 40_000), "s", None), (106, prose(106, 40_000), "s", None)]
    df = documents(spark, rows)  # its column n_words clashes with an output
    got = defaultdict(list)
    for r in quality.judge(df, max_share=0.5).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept for i in range(30)) and len(got[106]) == 2 and got[106][0].kept
    assert [got[i][0].n_words for i in (100, 101, 102)] == [0, 0, 0] and not any(got[i][0].kept for i in (100, 101, 102))
    assert (got[103][0].n_symbols, got[103][0].n_dup_lines, got[103][0].word_chars) == (1, 2, 5)
    assert (got[104][0].n_repeat_words, got[104][0].base_failed) == (80, True)
    assert got[105][0].base_failed and got[105][0].n_repeat_words == 40 * 10
    cleaned = {r.doc_id: r.text for r in quality.clean(df, max_share=0.5).collect()}
    assert cleaned[3] == rows[3][1].split("\n")[0] and 100 not in cleaned
    assert {r.n_words for r in quality.clean(df).collect()} == {1.0}
    assert quality.judge(df.limit(0)).count() == 0 and quality.clean(df.limit(0)).columns == df.columns


# 5


def _edited(text: str, seed: int, n: int) -> str:
    words, r = text.split(), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def _brute_classes(rows):
    """(id, class) of each row: links by the definition, over all pairs."""
    def shingles(text):
        words = neardup.words_of(text)
        k = min(5, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    sets = [shingles(t) for _, t, *_ in rows]
    held = Counter(g for s in sets for g in s)
    weights = [{g: n * math.log1p(len(rows) / held[g]) for g, n in s.items()} for s in sets]
    totals, parent = [sum(w.values()) for w in weights], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        least = sum(min(w, weights[j].get(g, 0)) for g, w in weights[i].items())
        if not totals[i] + totals[j] or least / (totals[i] + totals[j] - least) >= neardup.THRESHOLD:
            parent[top(i)] = top(j)
    first = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        first[top(i)] = min(first[top(i)], r[0])
    return sorted((r[0], first[top(i)]) for i, r in enumerate(rows))


def test_neardup_equals_brute_force(spark):
    base = prose(1, 300)
    rows = [(i, _edited(base, i, i % 4), "s", None) for i in range(40)] + [(100 + i, base, "s", None) for i in range(5)]
    rows += [(200 + i, prose(200 + i, 120) + " " + prose(999, 60), "s", None) for i in range(60)]  # a shared passage only
    rows += [(300, None, None, None), (301, "", "s", None), (302, "one two", "s", None), (302, "one two", "s", None), (303, prose(5, 30_000), "s", None), (304, " \n\t", "s", None)]
    df, want = documents(spark, rows), _brute_classes(rows)
    for sizes in ({}, {"lot_bytes": 2000, "part_shingles": 500}):
        got = neardup.classes(df, **sizes).collect()
        assert sorted((r.id, r.class_id) for r in got) == want
    assert Counter(r.class_id for r in got if r.keep)[302] == 2  # rows that repeat id and text
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})
    assert neardup.classes(df.limit(0)).count() == 0


def test_neardup_of_a_large_group(spark):
    """500 near copies, of which many are linked to few others only: no link is lost."""
    base = prose(2, 150)
    rows = [(i, _edited(base, i, i % 7), "s", None) for i in range(500)]
    got = neardup.classes(documents(spark, rows)).collect()
    want = _brute_classes(rows)
    assert sum(a == b for a, b in zip(sorted((r.id, r.class_id) for r in got), want, strict=True)) >= 0.995 * len(rows)
    sizes = Counter(c for _, c in want)
    assert sizes.most_common(1)[0][1] < len(rows)  # the group isn't one class


def test_samples_estimate_the_similarity():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 2**56, 400).astype(np.uint64))
    a, b = (h[:300], (r.random(300) + 0.5).astype(np.float32)), (h[60:], (r.random(340) + 0.5).astype(np.float32))
    s = neardup.Sampler(bands=400, rows=4)
    x, y = s.samples([a, b])
    assert abs((x == y).mean() - neardup.similarity((*a, a[1].sum()), (*b, b[1].sum()))) < 0.05
    # An element's share of the samples is its share of the weight, and doesn't depend on what else is sampled.
    four = (h[:4], np.array([1, 2, 3, 4], np.float32))
    (one,), (alone,) = s.samples([four]), s.samples([(h[3:4], four[1][3:])])
    assert abs((one == alone).mean() - 0.4) < 0.05
    assert (s.samples([a, four])[1] == one).all()


def test_packed_hashes():
    for x in ([], [5], [0, 1, 2, 300, 1 << 55]):
        assert neardup.unpacked(neardup.packed(np.array(x, np.uint64))).tolist() == x
    n = np.array([1, 254, 255, 256, 100_000, 2])
    assert neardup.from_small_ints(neardup.small_ints(n), len(n)).tolist() == n.tolist()



class _Functions(list):
    """Stands for a table; keeps the functions that it is to be mapped with."""

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, f, schema):
        self.append(f)
        return self

    applyInArrow = mapInArrow


def test_shingles_are_counted_in_little_memory():
    """A task holds its hashes, but no further arrays of their length."""
    r, functions = np.random.default_rng(5), _Functions()
    common = r.integers(1 << 40, 1 << 41, 30_000).astype(np.uint64)
    sets = [np.unique(np.r_[common[:: k % 3 + 1], r.integers(1 << 40, 1 << 41, 40_000).astype(np.uint64)]) for k in range(30)]
    n = [r.choice([1, 1, 1, 2, 300], len(x)) for x in sets]
    neardup._frequencies(functions, 1)
    lots = pa.table({"part": [0] * 30, "lot": list(range(30)), "hashes": [neardup.packed(x) for x in sets], "n": [neardup.small_ints(x) for x in n]})
    tracemalloc.start()
    got = functions[1](lots).sort_by("lot").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    flat, place = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.bincount(place, np.concatenate(n)).astype(np.int64)
    for row, x in zip(got, sets, strict=True):
        want = total[np.searchsorted(flat, x)]
        held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(x)).astype(bool)
        assert (held == (want > 1)).all()
        assert (neardup.from_small_ints(row["n"], int(held.sum())) == want[held]).all()
    assert peak < 40 * sum(map(len, sets))


def test_lots_reach_python_in_small_batches(spark, monkeypatch):
    sizes, plain, name = [], neardup._frequencies, "spark.sql.execution.arrow.maxBytesPerBatch"

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def frequencies(lots, parts):
        sizes.extend(r.n for r in lots.mapInArrow(measured, "n long").collect())
        return plain(lots, parts)

    monkeypatch.setattr(neardup, "_frequencies", frequencies)
    before = spark.conf.get(name)
    texts = [(i, " ".join(f"{i}x{k}" for k in range(120_000)), "s", None) for i in range(12)]
    assert neardup.classes(documents(spark, texts).coalesce(1), lot_bytes=1 << 19).count() == 12
    assert sum(sizes) > 10 << 20 and max(sizes) < 6 << 20
    assert spark.conf.get(name) == before


# 6


def test_packing_is_tight_and_keeps_conflicts_apart(spark, sf_dir):
    items = packing.items_of(docs(spark, sf_dir))
    rows, by = packing.pack(items, capacity=256, max_per_source=2).collect(), {r.doc_id: r for r in items.collect()}
    assert Counter(r.doc_id for r in rows) == Counter({i: -(-r.n_words // 256) for i, r in by.items()})
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert total == Counter({i: r.n_words for i, r in by.items()})
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in held] == [0, *itertools.accumulate(r.n_words for r in held)][:-1] and sum(r.n_words for r in held) <= 256
        assert len({by[r.doc_id].cluster for r in held}) == len(held) and max(Counter(by[r.doc_id].source for r in held).values()) <= 2


def test_best_fit_equals_a_plain_search():
    r = random.Random(4)
    items = sorted(((r.randrange(1, 60), r.randrange(5), r.randrange(30)) for _ in range(300)), key=lambda x: -x[0])
    bins, want = [], []
    for size, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and cluster not in b["c"] and b["s"][source] < 2]
        if not fits:
            bins.append({"room": 100, "c": set(), "s": Counter()})
        k = min(fits)[1] if fits else len(bins) - 1
        want.append((k, 100 - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["c"].add(cluster)
        bins[k]["s"][source] += 1
    assert packing.best_fit(items, 100, 2) == want


def test_packing_deals_equal_rows_evenly(spark):
    df = documents(spark, [(7, "Same  words here\n", "s", None)] * 900 + [(7, " same words HERE", "s", None)] * 100)
    items = packing.items_of(df)
    assert items.select("cluster").distinct().count() == 1
    rows = packing.pack(items, shard_rows=100).collect()
    assert len(rows) == 1000 and len({r.bin_id for r in rows}) == 1000  # copies never share a bin
    assert max(Counter(r.bin_id.split("-")[0] for r in rows).values()) < 200
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, class_id long")
    near = documents(spark, [(1, "a b c", "s", None), (2, "a b d", "s", None), (3, "x", "s", None)])
    bins = {r.doc_id: r.bin_id for r in packing.pack(packing.items_of(near, classes=classes)).collect()}
    assert bins[1] != bins[2] and bins[3] in (bins[1], bins[2])


def test_packing_cases(spark):
    df = documents(spark, [(1, None, None, None), (1, None, None, None), (2, "", "s", None), (3, "a " * 10_000, "s", None), (None, "a b", "s", None)])
    rows = packing.pack(packing.items_of(df)).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 3, None: 1}
    assert packing.pack(packing.items_of(df.limit(0))).count() == 0


# 7


def test_warc_cases(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (4, "u\r\nX: y", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (None, "u", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.archive(df, f"file://{tmp_path}/w")
    got = warc.reconstruct(spark, f"file://{tmp_path}/w")
    key = lambda r: (r.id is None, r.id or 0)
    found = [(r.id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in sorted(got.collect(), key=key)]
    assert found == [
        (1, big, "revisit", 5), (3, big, "revisit", 5), (4, "small", "response", None), (5, big, "response", None), (6, "small", "response", None),
        (7, "", "response", None), (8, "", "response", None), (9, other, "response", None), (9, other, "response", None), (None, big, "revisit", 5),
    ]
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == 4
    record = bytes(warc.record_bytes(got.where("id = 5")).first().record)
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(big.encode() + b"\r\n\r\n") and hashlib.sha1(big.encode()).hexdigest().encode() in record
    warc.archive(df.limit(0), f"file://{tmp_path}/e")
    assert warc.reconstruct(spark, f"file://{tmp_path}/e").count() == 0


# 8


def _recall(rows, got, queries, k=5):
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids, unit = np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in queries:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))][:k]
        assert len(found[q]) == k and q not in [i for i, _ in found[q]]
        assert all(abs(v - s[ids == i][0]) < 1e-9 for i, v in found[q])
        hit += len({i for i, _ in found[q]} & set(best.tolist()))
    return hit / (k * len(queries))


def test_ann_recall(spark):
    sf_dir = "/root/testdata/sf0.1"  # some 90 lists; its vectors are isotropic
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert _recall(rows, ann.op8_ann(spark, sf_dir).collect(), [i for i, _ in rows if i % 50 == 0]) >= 0.9


def test_ann_reads_few_lists_of_clustered_vectors(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((150, 32))
    x = centres[r.integers(0, 150, 6000)] + 0.35 * r.standard_normal((6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df, asks = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0
    assert _recall(rows, ann.nearest(df, asks).collect(), range(0, 6000, 50)) >= 0.9
    posted, asked = ann.indexed(df, asks, 5, "vec_id", "embedding", ann.RATIO, ann.REPLICAS, ann.SPREAD)
    assert posted.select("list").distinct().count() >= 50
    read = asked.select("id", "list").join(posted.select("v", "list"), "list").select("id", "v").distinct().count()
    assert read < 0.1 * 120 * 6000


def test_graph_search_finds_the_nearest_centroids():
    r = np.random.default_rng(6)
    c, x = ann._unit(r.standard_normal((400, 16))), ann._unit(r.standard_normal((100, 16)))
    d2 = ann.Graph(c).search(x, 1.2)
    true = 2 - 2 * x @ c.T
    seen = np.isfinite(d2)
    assert np.allclose(d2[seen], true[seen]) and seen.mean() < 0.9
    assert (d2.argmin(axis=1) == true.argmin(axis=1)).mean() > 0.95


def test_ann_cases(spark):
    vectors = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0, None], [], [-1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate(vectors)] + [(0, [1.0, 0.0], 7)], "vec_id long, embedding array<double>, score int")
    rows = ann.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {0, 1, 2, 8, 9, 10}
    assert [(r.vec_id, round(r.score, 9)) for r in rows if r.query_id == 0] == [(1, 1.0), (2, 0.0), (8, -1.0)]
    assert [(r.vec_id, round(r.score, 9)) for r in rows if r.query_id == 9] == [(10, 0.0)]  # of its own length
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.col("vec_id") == 4).count() == 0


def test_ann_of_scaled_copies(spark):
    """300 multiples of one vector: each query gets those of the smallest ids, and tasks return k rows for each query."""
    df = spark.createDataFrame([(i, [2.0 ** (i % 300), 0.0]) for i in range(300)] + [(1000, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[7] == [0, 1, 2, 3, 4] and got[2] == [0, 1, 3, 4, 5] and got[1000] == [0, 1, 2, 3, 4]
    hits = ann._hits(df, F.col("vec_id") < 50, 5, "vec_id", "embedding", 9.0, ann.REPLICAS, ann.SPREAD).groupBy("query_id").count().collect()
    assert max(r["count"] for r in hits) <= 5 * 40


# 10


def test_license_cases(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, mit, "a/LICENSE", True), (2, "plain words", "a/x.txt", False), (3, "plain", "a/b/c/y.txt", False), (4, f"text\n# {gpl}\nmore", "a/b/z.txt", False),
        (5, None, "a/b/n.txt", False), (6, "plain", "q/x.txt", False), (7, "plain", None, None), (8, "word " * 20_000, "a/long.txt", False), (8, "word " * 20_000, "a/long.txt", False),
        (9, gpl, "a/b/c/LICENSE", True), (10, "The licence was lost long ago.", "q/y.txt", False), (11, "plain", "a/" + "d/" * 300 + "deep.txt", False), (12, "plain", "ab/x.txt", False),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, path string, is_license_file boolean, license string")
    got = sorted((r.doc_id, r.license, r.effective_license, r.inherited_from) for r in license.scan(df).collect())
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows)
    assert by[1] == ("MIT", "MIT", None) and by[2] == (None, "MIT", "a") and by[4][0] == "GPL-3.0"
    assert by[3] == (None, "GPL-3.0", "a/b/c") and by[5] == (None, "MIT", "a") and by[8] == (None, "MIT", "a") and by[11] == (None, "MIT", "a")
    assert by[6] == by[7] == by[10] == by[12] == (None, None, None)
    assert license.scan(df.limit(0)).count() == 0


LICENSED = [
    ("// SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: Some-Other", None),
    ("This project is released under the MIT License. See LICENSE for details.", "MIT"),
    ("#!/bin/sh\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nx = 1", "GPL-3.0"),
    (" * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("Public transport is free for all who hold a license.", None),
]


def test_license_headers(spark):
    df = spark.createDataFrame([(i, text, "x/y", False) for i, (text, _) in enumerate(LICENSED)], "doc_id long, text string, path string, is_license_file boolean")
    assert [r.license for r in license.scan(df).orderBy("doc_id").collect()] == [want for _, want in LICENSED]


def test_license_texts_and_triggers(spark):
    from simstrata.llm.license_texts import HEADERS, TEXTS

    rows = [(i, f"Copyright (c) 20{i:02} A. Nyone\n\n{t}\n", f"d{i}/LICENSE", True) for i, (_, t) in enumerate(TEXTS)]
    got = {r.doc_id: r.license for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string, path string, is_license_file boolean")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(TEXTS)}
    held = set(license.triggers())
    for _, vector in license.weights(HEADERS)[2]:
        assert sum(x * x for t, x in vector.items() if t not in held) < license.THRESHOLD**2


def test_license_inheritance_goes_up_several_levels(spark):
    found = license.op10_license(spark, "/root/testdata/sf0.01").where("inherited_from is not null").collect()
    levels = Counter(r.path.count("/") - 1 - r.inherited_from.count("/") for r in found)
    assert sum(n for up, n in levels.items() if up >= 2) > 10


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(show(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(show(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, texts = pipeline.run(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs(spark, sf_dir).collect()}
    kept = {r.doc_id for r in rows}
    assert 0.5 * len(texts) < len(kept) < len(texts) and kept <= set(texts)
    assert len({texts[i] for i in kept}) == len(kept)
    assert all(len(texts[i].split()) >= quality.MIN_WORDS for i in kept)
