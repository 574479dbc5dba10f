"""Brute-force versions on small fixtures with nulls, empties, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from binlattice.llm import decontaminate, embeddings, fixity, lines, packing, quality, queries, secrets, simhash, substrings, text, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, keys string, fp string, mark string, score string"


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = sentence(50), "A Shared line that several documents hold"
    texts = [None, "", " \n\t ", "one", "Two words", "x" * 5000]
    for i in range(n):
        t = sentence(rng.randint(5, 120))
        if i % 4 == 0:
            t = t + "\n" + passage + " " + sentence(10)
        if i % 3 == 0:
            t = f"  {line.upper() if i % 2 else line}\t\n" + t
        texts.append(t)
    texts += [texts[10]] * 3 + [texts[12] + " tail", " ".join(texts[10].split() * 2), sentence(20000)]
    return list(enumerate(texts))


def awkward(rows):
    """The rows, and rows that repeat a doc_id with the same or another text, or have none."""
    return rows + [(8, rows[10][1]), (8, "short"), (8, rows[20][1] + " more"), (10, rows[10][1]), (None, rows[14][1]), (None, rows[14][1]), (None, None), (None, "of its own")]


def counter(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "k", "f", "m", "s") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def empty(spark):
    return table(spark, [(0, "a")]).where("doc_id < 0")


def test_tokens_match_the_patterns(rows):
    import pyarrow as pa

    for pattern, flags, fold in ((r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.ALNUM, True), (r"[^\x20\x09-\x0D]+", text.NOT_SPACE, False)):
        got = []
        for _, _, w in text.words(pa.array([t for _, t in rows], pa.string()), flags, fold):
            got += [[x.decode() for x in w.run(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [re.findall(pattern, (t or "").translate(LOW) if fold else t or "") for _, t in rows]


def lines_by_hand(rows):
    keyed = [(i, [(x, x.strip(" \t\n\v\f\r").translate(LOW)) for x in (t or "").split("\n")]) for i, t in rows]
    held = collections.defaultdict(set)
    for i, ls in keyed:
        for _, k in ls:
            if len(k) >= 20 and i is not None:
                held[k].add(i)
    for i, ls in keyed:
        kept = [x for x, k in ls if i is None or not (len(held[k]) >= 3 and max(held[k]) != i)]
        yield i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("limit, batches, fanout", [(None, 4, 4), (-1, 5, 2)])
def test_line_dedup(spark, rows, limit, batches, fanout):
    given = awkward(rows)
    want = collections.Counter(lines_by_hand(given))
    got = lines.dedup(table(spark, given), limit=limit, batches=batches, fanout=fanout)
    assert counter(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert any(k[2] for k in want)


def test_line_dedup_keeps_columns(spark, rows):
    kept = lines.dedup(table(spark, rows[:20]), keep_text=True, batches=2)
    assert kept.columns == table(spark, rows).columns and kept.count() == 20
    assert lines.dedup(empty(spark), batches=2).count() == 0


def test_line_dedup_looks_up_hot_keys(spark):
    batch = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b"), (4, b"b"), (5, b"c")], "doc_id long, key binary")
    common, hot = (spark.createDataFrame([(k, 9, last)], "key binary, n long, last long") for k, last in ((b"a", 2), (b"b", 4)))
    assert sorted((r.doc_id, bytes(r.key)) for r in lines.decide(batch, common, hot).collect()) == [(1, b"a"), (3, b"b")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs(spark, rows):
    """Runs share no key, merge as a ladder, and meet batches without a shuffle."""
    from binlattice.llm.shared import Scratch

    scratch = Scratch(spark)
    runs = lines.LineRuns(scratch, 3, fanout=2)
    every = lines.keys(table(spark, rows)).cache()
    held = set()
    for b in range(5):
        batch = every.where(F.col("doc_id") % 5 == b)
        runs.add(batch)
        held |= {bytes(r.key) for r in batch.collect()}
        seen = [bytes(r.key) for level in runs.seen for run in level for r in run.collect()]
        assert len(seen) == len(set(seen)) and set(seen) == held
    assert [len(x) for x in runs.seen] == [1, 0, 1]
    own = every.where("doc_id % 5 = 2").groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    batch = scratch.run(own.repartition(3, "key"), "key", 3)
    assert "Exchange" not in plan_of(runs.fresh(batch)) and "SortMergeJoin" in plan_of(runs.fresh(batch))
    assert "Exchange" not in plan_of(runs.rows()) and runs.fresh(batch).count() == 0
    want = every.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    assert counter(runs.rows(), "n", "last") == counter(want, "n", "last") and runs.rows().exceptAll(want.select("key", "n", "last")).count() == 0


def substrings_by_hand(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    for i, w in words:
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("limit, size", [(None, substrings.BUCKET_BYTES), (-1, 3000)])
def test_substrings(spark, rows, limit, size):
    given = awkward(rows)
    want = collections.Counter(substrings_by_hand(given))
    got = substrings.dedup(table(spark, given), limit=limit, bucket_bytes=size)
    assert counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want)
    assert substrings.dedup(empty(spark)).count() == 0


def test_long_words_collide_with_no_key():
    """Thue-Morse words have equal polynomial hashes for every base; longer words are hashed otherwise."""
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    for _, _, w in text.words(pa.array([f"{a} {b} xy"]), text.NOT_SPACE, False):
        assert len(set(w.hashes(5).tolist())) == 3 and w.hashes(5)[2] != w.hashes(6)[2]


@pytest.mark.parametrize("blocks, limit", [(1, None), (3, -1), (99, None)])
def test_decontaminate(spark, rows, blocks, limit):
    w = re.findall(r"[^\x20\x09-\x0D]+", rows[9][1])
    items = [(1, " ".join(w[:9])), (2, " ".join(w[3:30])), (3, None), (4, ""), (5, "two WORDS!"), (6, " ".join(w[:9])), (10, "not there " * 9), (None, "short"), (None, " ".join(w[4:14])), (1, " ".join(rows[20][1].split()[-9:]))]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    size = {1: 1 << 20, 3: sum(len(t or "") + 64 for _, t in items) // 3, 99: 10}[blocks]
    assert (len(list(decontaminate.item_blocks(bench, size))) == blocks) == (blocks < 99)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for item, t in items:
        x = pattern.findall((t or "").translate(LOW))
        k = min(8, len(x))
        for a in range(len(x) - k + 1) if x else ():
            wins[tuple(x[a : a + k])].add(item)
    want = collections.Counter()
    for i, t in awkward(rows):
        x, hit, ids = pattern.findall((t or "").translate(LOW)), set(), set()
        for k in {len(v) for v in wins}:
            for a in range(len(x) - k + 1):
                if found := wins.get(tuple(x[a : a + k])):
                    ids |= found
                    hit.update(range(a, a + k))
        want[i, len(x), len(hit), len(ids), decontaminate.digest([k for k in ids if k is not None])] += 1
    got = decontaminate.mark(table(spark, awkward(rows)), bench, block_bytes=size, limit=limit)
    assert counter(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want


def test_decontaminate_on_little(spark, rows):
    bench = spark.createDataFrame([(1, " ".join(rows[9][1].split()[:30])), (None, "two words")], "item_id long, text string")
    assert decontaminate.mark(empty(spark), bench).count() == 0
    assert decontaminate.mark(table(spark, rows), bench.where("item_id < 0")).where("n_items > 0").count() == 0
    kept = {r.doc_id for r in decontaminate.clean(table(spark, rows), bench).collect()}
    assert 9 not in kept and 4 not in kept and 3 in kept
    twins = table(spark, [(1, rows[9][1]), (1, "clean text"), (None, rows[9][1]), (None, "also clean")])
    assert counter(decontaminate.clean(twins, bench), "doc_id", "text") == {(1, "clean text"): 1, (None, "also clean"): 1}


def test_containment_bounds():
    """Near-verbatim items are found at 0.8 of their shingles and not below."""
    import pyarrow as pa

    item = [f"t{i}" for i in range(60)]
    groups = decontaminate.build([(1, " ".join(item))], None, 0.8, 5)
    decontaminate.order(groups, {})
    for changed, found in ((0, True), (2, True), (3, False)):
        own = list(item)
        for k in range(changed):
            own[12 + 15 * k] = "other"
        for _, _, w in text.words(pa.array(["lead " * 20 + " ".join(own) + " tail" * 5]), text.ALNUM, True):
            assert bool(list(decontaminate.find(groups, w, w.hashes()))) == found


def brute_fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_simhash(spark, rows):
    given = awkward(rows)
    fp = [(i, brute_fingerprint(t)) for i, t in given]
    near = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a][1] ^ fp[b][1]).bit_count() <= 4]
    root = components(range(len(fp)), near)
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    got = simhash.near_duplicates(table(spark, given))
    have = collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect())
    assert have == collections.Counter((i, f, least.get(root[k])) for k, (i, f) in enumerate(fp))
    kept = simhash.first_of_each(table(spark, given))
    want = collections.Counter((i, t) for k, (i, t) in enumerate(given) if i is None or i == least[root[k]])
    assert counter(kept, "doc_id", "text") == want and kept.columns == table(spark, rows).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [4, 6])
def test_simhash_variants_lose_no_link(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(8):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, limit + 2), replace=False)))
    for _ in range(3000):  # a crowded ball, where buckets are large
        fps.add(int(base[0]) ^ sum(1 << int(k) for k in rng.choice(64, 2, replace=False)))
    x = np.array(sorted(fps), dtype=np.uint64)
    table_ = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    met = simhash.variants(table_, limit).repartition("key").sortWithinPartitions("key", "fp")
    edges = [tuple(int(v) & (1 << 64) - 1 for v in r) for r in met.mapInArrow(lambda b: simhash.links(b, limit), "a long, b long").distinct().collect()]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= limit
    at = np.argwhere(np.triu(near, 1))
    ids = [int(v) for v in x]
    assert components(ids, edges) == components(ids, [(ids[a], ids[b]) for a, b in at])


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:10] + 0.1 * rng.normal(size=(10, 16)), base[:5], base[5:8] * 3, np.repeat(base[:1], 20, 0)]))]
    k = len(rows)
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 16), (k + 3, [float("nan")] + [1.0] * 15), (k + 4, [None] + [1.0] * 15), (k + 5, [float("inf")] * 16), (k + 6, [1.0, 2.0]), (k + 7, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    v32 = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = [(a, b) for a in v32 for b in v32 if a < b and len(v32[a]) == len(v32[b]) and v32[a] @ v32[b] / np.linalg.norm(v32[a]) / np.linalg.norm(v32[b]) >= 0.9]
    want = components([i for i, _ in rows], near)
    links = collections.Counter(x for p in near for x in p)
    for block in (4096, 16, 3):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], want[i], want[i] == i) for i, _ in rows}
    nameless = df.unionByName(df.where("vec_id in (0, 3)").withColumn("vec_id", F.lit(None).cast("long")))
    got = embeddings.near_duplicates(nameless).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (links[i], want[i], want[i] == i) for i, _ in rows}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2
    twice = embeddings.near_duplicates(df.where("vec_id = 5").unionByName(df.where("vec_id = 5"))).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in twice] == [(5, 1, 5, True)] * 2
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0
    assert embeddings.near_duplicates(df.where(f"vec_id between {k} and {k + 5}")).where("n_links > 0").count() == 0


def test_embedding_leaves_that_cannot_link_do_not_meet():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=8) + 0.05 * rng.normal(size=(200, 8)) for _ in range(6)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embeddings.splits(x, 8)
    at = embeddings.leaf(x, tree)
    boxes = {i: (int((at == i).sum()), x[at == i].min(axis=0), x[at == i].max(axis=0)) for i in np.unique(at).tolist()}
    met = embeddings.partners(boxes, 50, 0.9)
    assert len(met) < len(boxes) ** 2
    first = {i: b for i, b, *_ in met}
    pairs = {(i, j) for i, _, _, b, _ in met for j in first if first[j] == b}
    assert all((at[a], at[b]) in pairs for a, b in np.argwhere(x @ x.T >= 0.9))


def test_embedding_blocks_are_bounded():
    assert [embeddings.block_count(n, 64, 4096) for n in (0, 1, 4097, 131072, 1 << 20, 1 << 30)] == [0, 1, 2, 32, 32, 1 << 15]
    assert embeddings.block_count(1 << 20, 4096, 4096) == 256


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    texts = [None, "", f'password = "hunter22222" and {key}', "token:key secret=short7", "é" * 10 + "token: " + "0123456789abcdef" * 3, "plain identifiers getUserNameFromRequest here", "api-key: x apikey=abcdefghi API_KEY='" + "Zk3" * 9, "blob q8Zt1Vx0LpR7mNs4KdW2yBfH9 end"]
    docs = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert secrets.text_spans("", secrets.train({})) == ([], [])
    assert "markov" in got[7].spans and "markov" not in got[5].spans
    assert secrets.scan(empty(spark)).count() == 0


def planted(rng, k):
    import string

    sets = (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return "".join(rng.choices(rng.choice(sets), k=k))


def test_secrets_without_key_words(spark):
    """Precision and recall of the models on planted random strings, which no pattern matches."""
    rng = random.Random(21)
    names = ["getUserNameFromRequest", "configuration/settings/defaults", "internationalisation", "handle_connection_timeout", "4912345678901234", "2024-01-31", "DONAUDAMPFSCHIFF"]
    docs, truth = [], {}
    for i in range(300):
        body = " ".join(rng.choice(names) for _ in range(8))
        if i % 2:
            key = planted(rng, rng.randint(20, 31))
            body = f"{body} home/user/data/{key} {body}"
            truth[i] = body.index(key), body.index(key) + len(key)
        docs.append((i, body))
    found = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov")] for r in secrets.scan(table(spark, docs)).collect()}
    hit = sum(any(a <= truth[i][0] and b >= truth[i][1] for a, b in found[i]) for i in truth)
    assert hit >= 0.9 * len(truth)
    assert sum(len(found[i]) for i, _ in docs if i not in truth) == 0


def test_secret_models_by_hand(spark):
    samples = ["getName", "a1b2c3", "Zq/x"]
    n = secrets.transitions(samples)
    want = collections.Counter(p for t in samples for p in zip("\0" + t, t))
    assert n.sum() == sum(want.values())
    for (a, b), k in want.items():
        assert n[secrets.CODE[ord(a)], secrets.CODE[ord(b)]] == k
    own = {0: n, secrets.ORDINARY: n}
    table_ = secrets.train(own)
    base = [secrets.transitions(t) for t in secrets.built_in()]

    def share(label, a, b):
        w = 0.5 * n.sum() / (n.sum() + secrets.MIX) if label in own else 0.0
        given, seen = ((m[a, b] + 0.5) / (m[a].sum() + 0.5 * (secrets.SIZE - 1)) for m in (base[label], n))
        return (1 - w) * given + w * seen

    for token in ("a1Zq", "getName", "x" * 30):
        c = [0, *secrets.codes(token).tolist()]
        sums = [sum(np.log(share(k, a, b) / share(secrets.ORDINARY, a, b)) for a, b in zip(c, c[1:])) for k in range(secrets.ORDINARY)]
        assert secrets.llr(table_, token) == pytest.approx(max(sums) - np.log(secrets.ORDINARY))
    key = "AKIA" + "Q7" * 8
    text_ = f"a token : 'Zz/9.abcdefgh' and {key} {'0a' * 20}"
    assert secrets.samples(text_) == [(4, "Zz/9abcdefgh"), (2, key), (0, "0a" * 20)]
    docs = table(spark, [(1, "password=abcdef123456 getUserName"), (None, "plainIdentifier"), (2, None)])
    counts = secrets.counted(docs.unionByName(docs))
    assert (counts[0] == 2 * secrets.transitions(["abcdef123456"])).all() and (counts[secrets.ORDINARY] == 2 * secrets.transitions(["getUserName", "plainIdentifier"])).all()


def test_spans_of_long_texts_take_linear_time():
    import time

    table_ = secrets.train({})
    took = []
    for n in (2000, 16000):
        body = "word " * 5 + " ".join(f"token={'a' * 9} {'b' * 25}" for _ in range(n))
        began = time.perf_counter()
        secrets.text_spans(body, table_)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def held_out(scored, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    return [(r.predicted, truth[r.doc_id]) for r in scored.where("held_out").collect() if r.doc_id in truth]


def test_classifiers_held_out(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choice(["sun", "tree", "house", "river", "walk"]) for _ in range(60)) + "." for _ in range(300)]
    rows = [(i, t + " you moronic st0ff" if i % 3 == 0 else t) for i, t in enumerate(plain)]
    rows = [(i, t.upper().replace(" ", "!! ") if i % 4 == 1 else t) for i, t in rows]
    docs = table(spark, [*rows, (900, None), (901, ""), (3, rows[3][1]), (3, "sun tree."), (None, rows[3][1])])
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5000, None, None), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        scored = module.score(docs, module.train(docs, labels))
        pairs = held_out(scored, labels, name)
        assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
        assert scored.where("score is null or score < 0 or score > 1").count() == 0 and scored.count() == 305
        assert len({r.score for r in scored.collect() if r.doc_id is None}) == 1
        none = module.train(docs, labels.where("doc_id < 0"))
        assert module.score(docs, none).count() == 305 and module.score(empty(spark), none).count() == 0
        assert module.score(docs, module.train(empty(spark), labels)).count() == 305
    assert quality.accepted(docs, labels).columns == docs.columns and quality.accepted(empty(spark), labels).count() == 0


def test_quality_tables_by_hand(spark, rows):
    """Scores are the sums of each row's table entries, and tables are what their trees add up to."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, len(quality.FEATURES))).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    for row, got in zip(x, m.score(x), strict=True):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        total = m.intercept + sum(t[a] for t, a in zip(m.tables, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in m.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, total)))))
    assert (1, 0) in [(i, j) for i, j, _ in m.pairs] and ((m.score(x) > 0.5) == y).mean() > 0.9
    g, h = rng.normal(size=12), rng.uniform(0.1, 1, 12)
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
    cut = max(range(1, 12), key=lambda k: gain(slice(0, k)) + gain(slice(k, 12)))
    want = np.concatenate([np.full(cut, g[:cut].sum() / (h[:cut].sum() + 1)), np.full(12 - cut, g[cut:].sum() / (h[cut:].sum() + 1))])
    assert np.allclose(quality.tree(g, h, 1), want)
    scored = {r.doc_id: r.score for r in quality.score(table(spark, rows), m).collect()}
    assert scored == {i: pytest.approx(m.score(np.array([quality.features((t or "").encode())]))[0]) for i, t in rows}


def toxic_by_hand(model, t):
    """The features by a plain search for every entry at every word."""
    folded = toxicity.fold(t or "")
    starts = [k for k in range(len(folded)) if folded[k] == " "]
    spared = [(k, k + len(p) + 1) for p in toxicity.EXCEPTIONS for k in starts if folded.startswith(f" {p} ", k)]
    hits = []
    for k in starts:
        w = max((v for e, v in model.entries.items() if folded.startswith(e, k)), default=0.0)
        if w > 0 and not any(a <= k < b for a, b in spared):
            hits.append(w)
    n = max(1, len(folded.split()))
    return [sum(hits) / (1 + np.sqrt(n / 50)), max(hits, default=0.0), sum(hits) / n * 10]


def test_toxicity_by_hand(spark):
    rng = random.Random(12)
    model = toxicity.Model()
    model.entries |= {" idio": 2.5, " scum ": 4.0, " los": 1.0, " trash b": 3.5}
    words = ["you", "idiot", "id1ot", "idiotic", "trash", "can", "bin", "bag", "scum", "pond", "loser", "lost", "clown", "fish", "100", "sun", "ｉｄｉｏｔ"]
    texts = [None, "", " ", "1", "x" * 3000] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(200)]
    for t in texts:
        assert model.features(t) == pytest.approx(toxic_by_hand(model, t))
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, list(enumerate(texts))), model).collect()}
    w = model.weights
    for i, t in enumerate(texts):
        z = sum(a * b for a, b in zip(toxic_by_hand(model, t), w)) + w[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, z)))))


def test_folding():
    m = toxicity.Model()
    clean = m.score(np.array([m.features("a walk by the river")]))[0]
    for t in ("you IDIOT", "you 1d10t", "you іdіоt", "you ｉｄｉｏｔ", "you ïdïot", "you id\u200biot", "you i d i o t!", "you i.d.i.o.t", "you i\u0301diot"):
        assert m.features(t)[1] > 0 and m.score(np.array([m.features(t)]))[0] > clean
    assert toxicity.fold("100 1,000 in 2024") == " in " and toxicity.fold("i am a b") == " i am a b "
    assert m.features("the trash can is full")[1] == 0 and m.features(None) == m.features("")


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(400)] + [(7, "http://h/7", "again"), (None, "u", "h"), (500, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash")).withColumn("range", F.lit(1))
    args = {"range_bytes": 2000, "shard": 32, "fanout": 4}
    same = fixity.audit(pages, pages, **args)
    assert {r.status for r in same.collect()} == {"intact", "unkeyed"} and same.count() == len(rows)
    nameless = spark.createDataFrame([(None, "u", "h")] * 3 + [(None, "other", None)], "page_id long, url string, html string")
    for a, b, want in ((pages, nameless.unionByName(pages.select("page_id", "url", "html")), {"intact": 402, "unkeyed": 1, "extra": 4}), (nameless, nameless.limit(1), {"unkeyed": 1, "missing": 3})):
        got = collections.Counter((r.status, r.page_id is None) for r in fixity.audit(a, b, **args).collect())
        assert sum(got.values()) == sum(want.values()) and {k: sum(n for (s, _), n in got.items() if s == k) for k in want} == want
    chunked = fixity.unkeyed(*(fixity.hashed(x) for x in (nameless, nameless.limit(0))), chunk=2).collect()
    assert sorted((r.sha256, r.nth) for r in chunked) == sorted((r.sha256, k + 1) for r in fixity.hashed(nameless).groupBy("sha256").count().collect() for k in range(r["count"]))
    none = pages.where("page_id < -99")
    assert {r.status for r in fixity.audit(pages.where("page_id >= 0"), none, **args).collect()} == {"missing"}
    assert {r.status for r in fixity.audit(none, pages.where("page_id >= 0"), **args).collect()} == {"extra"}
    replica = pages.where("page_id <> 100").withColumn("html", F.when(F.col("page_id") == 200, "bad").otherwise(F.col("html")))
    replica = replica.unionByName(pages.where("page_id = 3").withColumn("page_id", F.lit(-9).cast("long")))
    got = {(r.page_id, r.nth): r for r in fixity.audit(pages, replica, **args).collect()}
    wrong = {k: r.status for k, r in got.items() if r.status not in ("intact", "unkeyed")}
    assert wrong == {(100, 1): "missing", (200, 1): "altered", (-9, 1): "extra", (None, 1): "missing"}  # the filter took that one too
    keyed = sorted((r for r in got.values() if r.offset is not None), key=lambda r: r.offset)
    assert all(b.offset == a.offset + a.n_bytes for a, b in zip(keyed, keyed[1:]))
    assert fixity.audit(pages.where("page_id < 0"), pages.where("page_id < 0"), **args).count() == 0


def test_packing(spark, rows):
    given = [*awkward(rows), (7, rows[7][1])] + [(None, "equal rows here")] * 30
    docs = table(spark, given)
    got = packing.best_fit(docs, lengths=(64, 128, 256), shard_docs=20).collect()
    want, have = collections.Counter(), collections.Counter()
    for i, t in given:
        want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    bins, pieces_of = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        bins[r.shard, r.bin].append(r)
        pieces_of[r.doc_id, r.tag, r.copy].append((r.piece, r.start, r.n_tokens))
    assert have == +want
    assert len(pieces_of) == sum(bool((t or "").split()) for _, t in given)
    for cut in pieces_of.values():
        cut.sort()
        assert [p for p, _, _ in cut] == list(range(len(cut))) and [s for _, s, _ in cut] == [256 * p for p, _, _ in cut]
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.slot)
        assert [r.slot for r in pieces] == list(range(len(pieces)))
        assert [r.at for r in pieces] == np.cumsum([0] + [r.n_tokens for r in pieces])[:-1].tolist()
        total = sum(r.n_tokens for r in pieces)
        assert {r.length for r in pieces} == {min(c for c in (64, 128, 256) if c >= total)}
    again = packing.best_fit(docs.repartition(3), lengths=(64, 128, 256), shard_docs=20)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert packing.best_fit(empty(spark)).count() == 0


def test_fixity_of_crowded_page_ids(spark):
    """Cutting crowded shards changes nothing: offsets, ranges and statuses are those of the plain order."""
    rows = [(i, f"u{i}", "x" * (i * 37 % 90)) for i in range(60)] + [(33, f"v{k}", "y" * (k % 50)) for k in range(300)] + [(-5, "neg", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    replica = pages.where("url <> 'v7' and url <> 'u12'").withColumn("html", F.when(F.col("url") == "v200", "bad").otherwise(F.col("html")))
    args = {"range_bytes": 2000, "shard": 16, "fanout": 4}
    plain = fixity.audit(pages, replica, **args)
    cut = fixity.audit(pages, replica, **args, hot_rows=50, slot_rows=7)
    columns = ["page_id", "nth", "offset", "n_bytes", "sha256", "shard", "range", "status"]
    assert counter(cut, *columns) == counter(plain, *columns)
    offsets = sorted((r.offset, r.n_bytes) for r in cut.collect() if r.offset is not None)
    assert len(offsets) == len(rows) and all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:]))


def best_fit_by_hand(sizes, lengths, length):
    """(room, number, used) of the bins of plain best fit, by searching all of them."""
    bins = []
    for size in sizes:
        fits = [b for b in bins if b[0] >= size]
        if fits:
            b = min(fits, key=lambda b: (b[0], b[1]))
        else:
            b = [max(length, min(c for c in lengths if c >= size)), len(bins), 0]
            bins.append(b)
        b[0] -= size
        b[2] += size
    return [b[2] for b in bins]


def joint_by_hand(sizes, lengths, price):
    left, used = sorted(sizes, reverse=True), []
    while left:
        best = None
        for c in (c for c in lengths if c >= left[0]):
            rest, own = c, []
            for k, s in enumerate(left):
                if s <= rest:
                    own.append(k)
                    rest -= s
            each = price[min(x for x in lengths if x >= c - rest)] / (c - rest)
            if best is None or each < best[0]:
                best = each, own
        used.append(sum(left[k] for k in best[1]))
        left = [s for k, s in enumerate(left) if k not in set(best[1])]
    return used


def test_packing_lengths_are_optimised_jointly():
    lengths = (64, 128, 256)
    price = packing.costs(lengths, 4, 2048)
    cost = lambda used: sum(price[min(c for c in lengths if c >= u)] for u in used)
    better = 0
    for seed in range(8):
        rng = random.Random(seed)
        sizes = sorted((min(256, max(1, int(rng.lognormvariate(4, 0.8)))) for _ in range(400)), reverse=True)
        singles = [best_fit_by_hand(sizes, lengths, c) for c in lengths]
        assert [packing.single(sizes, lengths, c)[1] for c in lengths] == singles
        at, used = packing.joint(sizes, lengths, price)
        assert used == joint_by_hand(sizes, lengths, price)
        assert used == [sum(s for s, b in zip(sizes, at, strict=True) if b == k) for k in range(len(used))]
        packed = packing.pack(sizes, lengths, price)
        final = {b: c for b, c, _ in packed}
        assert sum(price[c] for c in final.values()) == pytest.approx(min(map(cost, [used, *singles])))
        assert len(set(final.values())) > 1
        better += cost(used) < min(map(cost, singles)) - 1e-9
    assert better >= 3


def test_rows_without_id_and_repeats(spark):
    docs = table(spark, [(1, "same text here"), (1, "same text here"), (2, "other"), (None, "no id")])
    assert lines.dedup(docs).count() == 4 and substrings.dedup(docs).count() == 4 and simhash.near_duplicates(docs).count() == 4
    assert secrets.scan(docs).count() == 4 and counter(simhash.first_of_each(docs), "doc_id") == {(1,): 2, (2,): 1, (None,): 1}


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
