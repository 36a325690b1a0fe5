import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstream.llm import mixing
from fleetstream.llm.common import table
from tests.conftest import SF


def test_targets_stop_at_three_times_and_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 190], [5, 2, 1]) == [30.0, 180.0, 90.0]
    assert mixing.targets([10, 20, 270], [5, 2, 1]) == [30.0, 60.0, 210.0]
    assert mixing.targets([0, 7], [5, 2]) == [0.0, 7.0]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), n, 9)
    assert sorted(out) == list(range(n))
    if n >= 1000:
        assert (out != np.arange(n)).mean() > 0.98 and (mixing.permuted(np.arange(n), n, 10) != out).mean() > 0.98


def test_draws_use_up_each_quota():
    draws = mixing.shard_draws([1000, 10, 0, 333], 16)
    assert draws.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert draws.sum(axis=1).max() - draws.sum(axis=1).min() <= 1


def taken(docs):
    return mixing.taken_words(*mixing.mix(docs)).collect()


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = taken(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode().split()) and 0 <= r.taken <= 3 * r.size
        x = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        x[0] += r.size
        x[1] += r.taken
    names = sorted(by)
    assert [by[n][3] for n in names] == pytest.approx(mixing.targets([by[n][0] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]))
    for size, got, source_size, target in by.values():
        assert size == source_size and abs(got - target) <= 3 * mixing.BLOCK + 1
    assert {(r.doc_id, r.taken) for r in taken(docs.repartition(5))} == {(r.doc_id, r.taken) for r in rows}


def test_chunked_places_equal_one_chunk(spark, monkeypatch):
    docs = table(spark, SF, "documents").withColumn("source", F.lit("one"))
    sizes = mixing.sized(docs)
    monkeypatch.setattr(mixing, "CHUNK", 20)
    rows = sorted((r.begin, r.size) for r in mixing.placed(sizes).collect())
    at = 0
    for begin, size in sorted(rows):
        assert begin == at
        at += size


def test_pieces_are_the_blocks_of_the_plan(spark):
    docs = table(spark, SF, "documents")
    documents, pieces = mixing.mix(docs, shards=7)
    rows = pieces.collect()
    per_slot = {}
    for r in rows:
        per_slot.setdefault((r.shard, r.slot), []).append(r)
    assert all(sum(x.words for x in p) <= mixing.BLOCK and len({(x.source_no, x.block) for x in p}) == 1 for p in per_slot.values())
    assert max(np.unique([f"{r.source_no}/{r.pass_no}/{r.block}/{r.begin}/{r.doc_id}" for r in rows], return_counts=True)[1]) == 1


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (3, "one two", None, "x"), (4, "w " * 40000, "b", "x"), (4, "w " * 40000, "b", "x"), (None, "no id", "a", "x"), (5, "x y z", "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = taken(docs)
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got if not r.size) == 0
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert taken(docs.limit(0)) == []
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("text is null or text = ''").count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixed_documents_carry_the_words_taken(spark):
    docs = table(spark, SF, "documents")
    expected = {r.doc_id: r.taken for r in taken(docs) if r.taken}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert got == expected


def test_equal_rows_are_spread_and_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 1000)
    monkeypatch.setattr(mixing, "COPIES", 64)
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("web").alias("source"))
    sizes = mixing.sized(docs)
    d = mixing.placed(sizes)
    assert sorted(r.begin for r in d.collect()) == list(range(0, 40_000, 2))
    chunk = F.pmod(F.xxhash64("doc_id", "tie", "copy", F.lit("chunk")), F.lit(20))
    assert mixing.copies(sizes).groupBy(chunk).count().agg(F.max("count")).first()[0] < 1300
