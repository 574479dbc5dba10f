"""Operators 11 to 13 against brute force on small fixtures."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from binlattice.llm import decontaminate, divergence, lines, search, similar, simhash, spelling, toxicity
from binlattice.llm.shared import Scratch
from binlattice.llm.text import ALNUM, Words, buffers
from binlattice.llm.text import words as tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, term string, pos long, key string, shard int"
VEC = "vec_id long, embedding array<float>, label int, e string, query long, score string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "w", 2, "t", 3, "k", 4) for i, t, lang, source in rows], DOC)


def words_by_hand(rows, least, count, altered):
    n = collections.Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if altered and h % altered == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(n, ratio):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def spelt(seed, k=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(0, None, "a", "b"), (1, "", "a", "b"), (2, "12 - × 3", None, None), (None, "Abcabc abcabc ABCABC", "a", None), (3, "x" * 3000 + " " + "X" * 2999 + " É é", "a", "b")]
    for i in range(k):
        ws = []
        for _ in range(rng.randint(1, 12)):
            w = rng.choice(base)
            at = rng.randrange(len(w))
            w = rng.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice("abz") + w[at:], w[:at] + "q" + w[at + 1 :]])
            ws.append(w)
        rows.append((rng.randrange(100), rng.choice([" ", "7", "\n", "ā"]).join(ws), "a", "b"))
    return rows


@pytest.mark.parametrize("crowd", [1, 30, 4096])
def test_spelling_groups(spark, crowd):
    rows = spelt(3)
    docs = documents(spark, rows)
    for least, count, altered in ((1, 1, 7), (4, 3, None)):
        n = words_by_hand(rows, least, count, altered)
        vocab = spelling.vocabulary(docs, least_length=least, least_count=count, altered=altered)
        assert {tuple(r) for r in vocab.collect()} == set(n.items())
        got = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.groups(vocab, ratio=2, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == groups_by_hand(n, 2)


def test_spelling_ties_chains_and_crowds(spark):
    n = {"aaaaaa": 10, "aaaaab": 10, "aaaaac": 2, "aaaaaca": 1, "zzzzzz": 1000, "zzzzzy": 100, "zzzzyy": 10, "zzzyyy": 1}
    n |= {f"prefix{a}{b}suffix": 5 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    want = groups_by_hand(n, 5)
    assert ("aaaaac", 2, 3, "aaaaaa", 10, "aaaaaa") in want and ("zzzyyy", 1, 1, "zzzzyy", 10, "zzzzzz") in want
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.groups(vocab, crowd=100).collect()} == want


def test_spelling_pieces_and_empty(spark):
    text = "".join(random.Random(1).choice("ab é,×") for _ in range(5000)) + "b" * 100
    assert "".join(spelling.pieces(text, 17)) == text
    whole = re.findall("[A-Za-zÀ-ÿ]+", text)
    assert [w for p in spelling.pieces(text, 17) for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == whole
    none = documents(spark, [(1, "a", "b", "c")]).where("doc_id < 0")
    assert spelling.groups(spelling.vocabulary(none)).collect() == []


def p_of(n, total, v):
    return 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)


def audit_by_hand(rows, least, top=10):
    term_docs, n, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [w.translate(LOW) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n.update((lang, source, w) for w in found)
        term_docs.update((lang, w) for w in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), d in term_docs.items() if x == lang and d >= least]
        sources = [s for x, s in groups if x == lang]
        own = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        v, total = len(kept), sum(own.values())
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(r, sum(f(p_of(n[lang, s, w], own[s], v), p_of(n[lang, r, w], own[r], v)) for w in kept)) for r in sources if r != s]
            terms = []
            for w in kept:
                p, q = p_of(n[lang, s, w], own[s], v), p_of(sum(n[lang, r, w] for r in sources), total, v)
                if n[lang, s, w] and p > q:
                    terms.append((w, f(p, q)))
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, x, k) for k, (i, x) in enumerate(items[:most], 1)}
    return out


def audited(df):
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def sourced(seed):
    rng = random.Random(seed)
    vocabulary = [("é" if i % 5 == 0 else "") + "".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 4))) for i in range(80)]
    rows = [(1, None, None, None), (1, "", "en", "empty"), (2, "12 34 ,", "en", "empty"), (3, "only here", "xx", "alone"), (4, None, "yy", "a"), (5, "", "yy", "b"), (None, "Aé_bÉ-c", "en", None)]
    for i in range(300):
        lang, source = rng.choice(["en", "en", "fr", ""]), f"s{min(rng.randrange(9), rng.randrange(9))}"
        rows.append((i, rng.choice([" ", "1", "\n"]).join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary[: 40 + 4 * int(source[1])], k=rng.randrange(40))), lang, source))
    return rows + rows[20:24]


@pytest.mark.parametrize(("tile", "block"), [(256, 1 << 15), (3, 50)])
def test_divergence(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = sourced(4)
    assert audited(divergence.audit(documents(spark, rows), least_docs=6, top=4, block_rows=block)) == audit_by_hand(rows, 6, 4)


def test_divergence_counts_in_pieces(monkeypatch):
    rows = sourced(6) + [(1, " ".join(["wort"] * 900 + ["ende" * 300, "x"] + ["wort"] * 50), "fr", "long"), (2, "wort", "fr", "long")]
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "source": s, "text": t} for _, t, lang, s in rows], pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))
    want, docs = collections.Counter(), collections.Counter()
    for _, t, lang, s in rows:
        found = [w.translate(LOW) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        want.update((lang or "", s or "", w) for w in found)
        docs.update([(lang or "", s or "", w) for w in set(found)] + [(lang or "", s or "", None)])
    for piece, held, most in ((1 << 19, 1 << 20, 1 << 25), (40, 1 << 20, 1 << 25), (40, 100, 1 << 25), (64, 1 << 20, 3000)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "HELD_BYTES", most)
        monkeypatch.setattr(divergence.pieces, "__defaults__", (piece,))
        n, d = collections.Counter(), collections.Counter()
        for out in divergence._count([batch.slice(0, 100), batch.slice(100)]):
            for r in out.to_pylist():
                key = r["lang"], r["source"], r["term"]
                n[key] += r["n"]
                d[key] += r["docs"]
        assert +n == want and d == docs


def test_divergence_hash_collisions():
    texts = pa.array(["aa bb aa cc", "bb cc dd bb"])
    words = Words(*buffers(texts), divergence.LETTERS, True)
    terms = divergence.Terms(digest=lambda b: len(b))
    numbers = terms.numbers(words).tolist()
    assert [terms.names[i] for i in numbers] == b"aa bb aa cc bb cc dd bb".split()
    assert [terms.names[i] for i in terms.numbers(words).tolist()] == b"aa bb aa cc bb cc dd bb".split() and len(terms.names) == 4


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(300):
        total, v = rng.randrange(10 ** rng.randint(1, 15)), rng.randrange(1, 10**6)
        n = rng.randrange(total + 1)
        assert int(divergence.share(np.array([n]), total, v)[0]) == p_of(n, total, v)


def test_divergence_of_nothing(spark):
    assert divergence.audit(documents(spark, [(1, "a", "b", "c")]).where("doc_id < 0")).collect() == []


def top_by_hand(rows, k, every=100, scale=1024):
    ok = [(i, [math.floor(float(np.float32(x)) * scale) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    best = collections.defaultdict(list)
    for i, a in ok:
        if i % every == 0:
            best[i] += [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), j) for j, b in ok if j != i]
    return sorted((i, r, j, -s) for i, found in best.items() for r, (s, j) in enumerate(sorted(found)[:k], 1))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "e", 1, "s") for i, e in rows], VEC).repartition(3)


def found(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def some_vectors(seed, n=260):
    rng = random.Random(seed)
    one = lambda: [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(6)]
    same = one()
    rows = [(i, same if i % 7 == 0 else one()) for i in range(n)]
    return rows + [(300, None), (400, []), (500, [1.0, None]), (600, [float("nan")] * 6), (700, [float("inf"), 1.0]), (800, [0.5] * 9), (900, [0.0] * 6), (None, [1.0] * 6), (1001, [3.0]), (100, same), (100, same), (100, [1.0] * 6), (7, same), (7, same), (-200, one())]


@pytest.mark.parametrize(("chunk", "scores"), [(16 << 20, 1 << 18), (300, 64)])
def test_search(spark, monkeypatch, chunk, scores):
    monkeypatch.setattr(search, "SCORES", scores)
    rows = some_vectors(1)
    for k in (1, 10):
        assert found(search.top_k(vectors(spark, rows), k=k, chunk_bytes=chunk)) == top_by_hand(rows, k)


def test_search_by_other_queries_and_few_candidates(spark):
    rows = some_vectors(2, 30)
    assert found(search.top_k(vectors(spark, rows), k=1000)) == top_by_hand(rows, 1000)
    assert found(search.top_k(vectors(spark, [(100, [1.0])]))) == []
    assert found(search.top_k(vectors(spark, rows).where("vec_id < -999"))) == []


def test_search_of_huge_components(spark):
    rows = [(0, [1e30, -2.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [2.0**40, 1.0]), (100, [2.0**30, 3.0]), (5, [2.0**25, 1.0]), (6, [0.001, 2.0])]
    assert found(search.top_k(vectors(spark, rows), k=4)) == top_by_hand(rows, 4)


def test_selection_breaks_ties_by_id():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        s, ids = rng.integers(0, 4, n), np.sort(rng.choice(1000, n, replace=False))
        want = sorted(range(n), key=lambda i: (-s[i], ids[i]))[:10]
        assert search.select(s, ids, 10).tolist() == want


def test_links_are_each_pair_once(spark):
    vocab = spark.createDataFrame([("ab", 1), ("aab", 1), ("aaab", 1), ("b", 1)], "word string, n long")
    got = sorted((min(r.x, r.y), max(r.x, r.y)) for r in spelling.near_words(vocab, Scratch(spark)).collect())
    assert got == [("aaab", "aab"), ("aab", "ab"), ("ab", "b")]


def test_units_are_compact(spark):
    """A block of benchmark text: windows of 8 words, duplicates merged, and memory far below that of a list a unit."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(800)]
    texts += [texts[0], texts[1][:100] + " other", "two words", None]
    tracemalloc.start()
    groups = decontaminate.build(list(enumerate(texts)), 8, 1.0, 5)
    decontaminate.order(groups, {})
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(len(t or "") for t in texts)
    assert held < 30 * size and most < 120 * size
    want = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(max(1, len(w) - 7) if w else 0):
            want[tuple(w[k : k + 8])].add(i)
    got = {}
    for g in groups:
        for u in range(len(g.first)):
            run = tuple(g.items.word(int(g.first[u]) + k).decode() for k in range(int(g.size[u])))
            got[run] = {g.items.ids[i] for i in g.owners[g.owned[u] : g.owned[u + 1]].tolist()}
    assert got == want
    body = pa.array(["x " + texts[5][40:300] + " y", texts[0], "only two words here"])
    for _, _, words in tokens(body, ALNUM, True):
        hits = {(d, i) for d, i, _, _ in decontaminate.find(groups, words, words.hashes())}
    assert hits == {(0, 5), (1, 0), (1, 800), (2, 802)}


def test_names_that_operators_use_may_clash(spark):
    names = "__row __tag __keys __mark ___row word n term".split()
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, *names), (2, text, *names), (3, "short one", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(7, "short one")], "item_id long, text string")
    for kept, ids in ((simhash.first_of_each(docs), [None, 1, 3]), (similar.first_of_each(docs), [None, 1, 3]), (decontaminate.clean(docs, bench), [None, 1, 2]), (lines.dedup(docs, keep_text=True), [None, 1, 2, 3])):
        assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=lambda i: i or 0) == ids


def test_spared_places_by_one_sweep():
    rng = random.Random(3)
    for _ in range(200):
        best = {rng.randrange(40): rng.random() for _ in range(rng.randrange(12))}
        spans = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(8)))]
        assert sorted(toxicity.outside(best, spans)) == sorted(w for at, w in best.items() if not any(a <= at < b for a, b in spans))
