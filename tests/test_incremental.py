"""Maps that grow by batches: against one count of all pairs, with replays, failures and restarts."""

import os
import random

import pytest

from binlattice.streaming import incremental
from binlattice.streaming.incremental import StoredMap
from binlattice.streaming.pairs import pixel_stream

SCHEMA = "chrom1 string, pos1 long, chrom2 string, pos2 long"


def pairs(spark, seed, n=60):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice("ab"), rng.randrange(50), rng.choice("ab"), rng.randrange(50)) for _ in range(n)], SCHEMA).coalesce(1)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def check(spark, stored, batches):
    """Counts, coverage and sums are those of all batches taken together."""
    everything = batches[0]
    for b in batches[1:]:
        everything = everything.union(b)
    whole = pixel_stream(everything, 10)
    assert rows(stored.pixels()) == rows(whole)
    assert rows(stored.marginals()) == rows(incremental.marginals(whole))
    s = stored.state()
    assert (s.contacts, s.cis) == (everything.count(), everything.where("chrom1 = chrom2").count())


def test_batches_replays_and_levels(spark, tmp_path):
    stored = StoredMap(spark, f"file://{tmp_path}/m", 10)
    assert stored.pixels().count() == 0 and stored.state().batch == -1
    batches = [pairs(spark, k, 20) for k in range(5)]
    for k, b in enumerate(batches):
        stored.merge(b, k)
    check(spark, stored, batches)
    assert sorted(level for level, _ in stored.state().runs) == [0, 1]
    with pytest.raises(ValueError):
        stored.merge(batches[0], 9, "another checkpoint")
    stored.merge(batches[2], 2), stored.merge(batches[4], 4)
    check(spark, stored, batches)
    folders = [x for x in os.listdir(tmp_path / "m") if x.startswith("run-")]
    assert len(folders) <= 2 * incremental.RUNS_A_LEVEL and len(os.listdir(tmp_path / "m" / "log")) <= 2 * incremental.KEPT_STATES  # with checksum files


def test_an_attempt_without_an_end_leaves_nothing(spark, tmp_path, monkeypatch):
    stored = StoredMap(spark, f"file://{tmp_path}/m", 10)
    batches = [pairs(spark, k, 20) for k in range(2)]
    stored.merge(batches[0], 0)
    with monkeypatch.context() as m:
        m.setattr(StoredMap, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stored.merge(batches[1], 1)
    check(spark, stored, batches[:1])
    StoredMap(spark, stored.path, 10).merge(batches[1], 1)
    check(spark, stored, batches)


def test_nulls_and_empty_batches(spark, tmp_path):
    stored = StoredMap(spark, f"file://{tmp_path}/m", 10)
    stored.merge(spark.createDataFrame([], SCHEMA), 0)
    odd = spark.createDataFrame([("a", None, "b", 1), (None, 1, "b", 1), ("a", 5, "a", 5)], SCHEMA)
    stored.merge(odd, 1)
    assert rows(stored.pixels()) == [(0, 0, "a", "a", 1)] and rows(stored.marginals()) == [(0, "a", 2, 2)]
    assert (stored.state().contacts, stored.state().cis) == (1, 1)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after some files, started again with more; then with a map that is ahead of the checkpoint."""
    source = f"{tmp_path}/in"
    stored = StoredMap(spark, f"file://{tmp_path}/m", 10)
    batches = [pairs(spark, k, 30) for k in range(4)]

    def go(k):
        batches[k].write.mode("append").parquet(source)
        q = stored.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), f"{tmp_path}/c", availableNow=True)
        assert q.awaitTermination(200) and q.exception() is None

    go(0), go(1)
    check(spark, stored, batches[:2])
    last = max(int(x) for x in os.listdir(tmp_path / "c" / "commits") if x.isdigit())
    for x in (f"{last}", f".{last}.crc"):  # the driver was lost after the merge and before the query's own mark: the batch is made again
        if os.path.exists(tmp_path / "c" / "commits" / x):
            os.remove(tmp_path / "c" / "commits" / x)
    go(2)
    check(spark, stored, batches[:3])


def test_a_batch_is_dealt_by_its_rows(spark):
    from binlattice.streaming.pairs import pixel_stream

    pairs = spark.range(60).selectExpr("concat('c', id % 2) as chrom1", "id as pos1", "'c1' as chrom2", "id % 7 as pos2")
    rows = lambda df: sorted(map(tuple, df.collect()))
    dealt = pixel_stream(pairs, 5, tasks=13)
    assert dealt.rdd.getNumPartitions() == 13 and rows(dealt) == rows(pixel_stream(pairs, 5))
