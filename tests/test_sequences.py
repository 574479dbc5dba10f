"""Sequences read by byte ranges, and what is counted and cut in tiles."""

import random
import re

import pytest

from binlattice.sources import fasta, genome


def records(seed=3):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("ACGTacgtN") for _ in range(n))
    return {"c1": letters(187), "empty": "", "c2": letters(1), "long": letters(400), "last": letters(33)}


def written(path, seqs, width, end="\n", close=True):
    lines = []
    for k, (name, s) in enumerate(seqs.items()):
        lines.append(f">{name} record {k}")
        lines += [s[i : i + width] for i in range(0, len(s), width)]
        lines += [""] if k == 1 else []
    path.write_bytes((end.join(lines) + (end if close else "")).encode())
    return str(path)


@pytest.mark.parametrize("split", [1, 7, 13, 40, 10_000])
def test_lines_are_read_once_whatever_the_cuts(tmp_path, split):
    for width, end, close in ((10, "\n", True), (1000, "\n", False), (3, "\r\n", True)):
        path = written(tmp_path / "x.fa", records(), width, end, close)
        size = len(open(path, "rb").read())
        for buffer in (4, 1 << 20):
            got, parts = [], []
            for lo in range(0, size, split):
                for begins, text in fasta.lines_of(path, lo, min(lo + split, size), buffer):
                    (got if begins else parts).append(text) if begins or not got else got.__setitem__(-1, got[-1] + text)
            want = open(path, "rb").read().replace(b"\r\n", b"\n").split(b"\n")
            assert [x for x in got if x] == [x for x in want if x] and not parts


@pytest.mark.parametrize(("split", "piece", "width", "buffer"), [(37, 8, 10, 64), (5, 100, 1000, 40), (64 << 20, 1 << 16, 60, 1 << 20)])
def test_tiles_of_records(spark, tmp_path, split, piece, width, buffer):
    seqs = records()
    folder = tmp_path / "fa"
    folder.mkdir()
    written(folder / "a.fa", dict(list(seqs.items())[:3]), width)
    written(folder / "b.fa", dict(list(seqs.items())[3:]), width, "\r\n", False)
    pieces = fasta.read_pieces(spark, str(folder), split=split, piece=piece, buffer=buffer)
    got = {}
    for r in fasta.tiles_of(pieces, 16).collect():
        got.setdefault(r.chrom, {})[r.start] = r.seq
    assert {c: "".join(t[k] for k in sorted(t)) for c, t in got.items()} == {c: s for c, s in seqs.items() if s}
    assert all(sorted(t) == list(range(0, len(seqs[c]), 16)) for c, t in got.items())


def fragments_by_hand(seqs, site, cut):
    out = set()
    for c, s in seqs.items():
        ends = [0, *(m.start() + cut for m in re.finditer(site, s.upper())), len(s)]
        out |= {(c, a, b) for a, b in zip(ends, ends[1:]) if b > a}
    return out


@pytest.mark.parametrize("tile", [4, 16, 1 << 16])
def test_digest_and_gc_over_tiles(spark, tmp_path, tile):
    seqs = records(5)
    seqs["runs"] = "AAAAAAACGAAAATTAAA"
    tiles = fasta.read_tiles(spark, written(tmp_path / "x.fa", seqs, 60), tile=tile).persist()
    whole = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    for site, cut in (("AC", 1), ("TTA", 0), ("AAA", 2), ("G", 1)):
        want = fragments_by_hand(seqs, site, cut)
        assert {tuple(r) for r in genome.digest(tiles, site, cut, tile=tile).collect()} == want
    assert {tuple(r) for r in genome.digest(whole, "AC", 1, tile=tile).collect()} == fragments_by_hand(seqs, "AC", 1)
    bins = [(c, k, min(k + 9, len(s))) for c, s in seqs.items() for k in range(0, len(s), 9)] + [("c1", 180, 500), ("c1", 900, 910), ("none", 0, 9)]
    table = spark.createDataFrame(bins, "chrom string, start long, end long")
    for mapped in (True, False):
        got = {(r.chrom, r.start, r.end): r.gc for r in genome.gc(table, tiles, mapped, tile=tile).collect()}
        want = {}
        for c, a, b in bins:
            if seqs.get(c):
                part = seqs[c][a:b].upper()
                n = sum(x in "ACGT" for x in part) if mapped else len(part)
                want[c, a, b] = (part.count("G") + part.count("C")) / n if n else None
        assert got == pytest.approx(want)
    tiles.unpersist()
