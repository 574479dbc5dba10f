"""The pipeline's near-duplicate stage against all pairs by brute force."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from binlattice.llm import simhash, similar
from test_operators import components


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for _ in range(30):  # word changes: from sure links over the bound to none
        base = [word() for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
            texts.append(" ".join(word() if rng.random() < share else w for w in base))
    base = [word() for _ in range(120)]
    for _ in range(60):  # a crowded group, where buckets are large
        texts.append(" ".join(word() if rng.random() < 0.02 else w for w in base))
    for _ in range(40):  # one passage in many texts that differ
        texts.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))
    return list(enumerate(texts))


def test_stage_links_what_reaches_the_similarity(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    want = components(sets, pairs)
    assert 40 < sum(sets[a] != sets[b] for a, b in pairs)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == want
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_stage_on_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(None, a), (None, a), (1, a), (2, a), (2, b), (3, b), (4, "c")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.text)) for r in similar.first_of_each(docs).collect()) == sorted(map(str, [(1, a), (2, b), (4, "c"), (None, a), (None, a)]))
    assert similar.first_of_each(docs.where("doc_id > 9")).count() == 0


def test_stage_goes_by_fingerprints_first(spark, monkeypatch):
    """Pairs at 0.8 with fingerprints within LIMIT bits link by SimHash, nothing below 0.8 does, and the join on prefixes adds the rest."""
    rows = corpus()[:215]
    own = list(similar.sets(pa.array([t for _, t in rows])))
    texts = {int(np.uint64(similar.node(x)).view(np.int64)): (shingles(t), simhash.majority(x)) for (_, t), x in zip(rows, own, strict=True)}
    limits, found, variants, verified = [], [], simhash.variants, similar.verified
    monkeypatch.setattr(simhash, "variants", lambda fps, limit: limits.append(limit) or variants(fps, limit))

    def kept(*given):
        found.append(verified(*given))
        return found[-1]

    monkeypatch.setattr(similar, "verified", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert limits == [similar.LIMIT]
    alike = {(a, b) for a in texts for b in texts if a < b and near(texts[a][0], texts[b][0])}
    sure = {(a, b) for a, b in alike if (texts[a][1] ^ texts[b][1]).bit_count() <= similar.LIMIT}
    first, more = ({(r.a, r.b) for r in x.collect()} for x in found[:2])
    assert 20 < len(sure) < len(alike) and sure <= first <= alike and more and more <= alike
    sets = {i: shingles(t) for i, t in rows}
    assert left == set(components(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]).values())


def met(fps):
    """What near makes of the variants of fingerprints, and its pairs."""
    fps, rows = np.unique(fps), []
    for k, (first, n) in enumerate(simhash.segments(6)):
        for bit in range(n):
            own = (fps >> np.uint64(first)) & np.uint64((1 << n) - 1) & ~np.uint64(1 << bit)
            rows.append((own.astype(np.int64) | ((k * 64 + bit) << 16), fps.view(np.int64)))
    key, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((fp, key))
    batch = pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(fp[order])], ["key", "fp"])
    pairs = [(a, b) for t in simhash.near(iter([batch.slice(0, 999), batch.slice(999)]), 6, 12) for a, b in zip(*(c.to_pylist() for c in t.columns), strict=True)]
    return fps, [tuple(sorted(np.array(p).view(np.uint64).tolist())) for p in pairs]


def test_fingerprints_within_the_limit_meet_once():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps, pairs = met(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 200)).astype(np.uint64)) for k in (1, 3, 6, 9, 14)]))
    bits = {(a, b): (a ^ b).bit_count() for a in fps.tolist() for b in fps.tolist() if a < b}
    assert len(pairs) == len(set(pairs)) and max(bits[p] for p in pairs) <= 12
    assert 200 < sum(n <= 6 for n in bits.values()) and {p for p, n in bits.items() if n <= 6} <= set(pairs)


def test_pairs_of_a_crowd_grow_with_its_size():
    """Near copies are connected by few pairs each, not by all pairs and not by one pair many times."""
    rng, base = np.random.default_rng(8), np.uint64(0x123456789ABCDEF)
    for n in (300, 1200):
        fps, pairs = met(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, n)).astype(np.uint64)))
        assert len(pairs) == len(set(pairs)) < 64 * len(fps)
        assert set(components(fps.tolist(), pairs).values()) == {min(fps.tolist())}


def test_frequent_shingles_against_counts():
    rng = np.random.default_rng(6)
    for n in (0, 1, similar.OFTEN - 1, similar.OFTEN, 5000):
        held = [rng.integers(0, 600, n // 2, dtype=np.uint64) % np.uint64(max(n // 9, 1)), rng.integers(0, 600, n - n // 2, dtype=np.uint64) % np.uint64(max(n // 9, 1))]
        h, times = np.unique(np.concatenate(held), return_counts=True)
        got = similar.frequent(held)
        assert got[0].tolist() == h[times >= similar.OFTEN].tolist() and got[1].tolist() == times[times >= similar.OFTEN].tolist() and not held


def test_sets_take_little_memory_beside_the_texts():
    """Texts are worked on in short runs: tables and temporary arrays stay small, however many texts a batch has."""
    rng = random.Random(7)
    texts = pa.array([" ".join(f"m{rng.randint(0, 9999)}" for _ in range(2000)) for _ in range(500)])
    simhash.tx._powers.clear()
    tracemalloc.start()
    try:
        assert sum(len(own) > 0 for own in similar.sets(texts)) == 500
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()
