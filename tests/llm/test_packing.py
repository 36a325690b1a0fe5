import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetstream.llm import packing
from fleetstream.llm.binpack import CapacityTree, best_fit_decreasing, swap_search
from fleetstream.llm.common import table
from fleetstream.llm.tokens import cut, encoder
from tests.conftest import SF

ODD = [None, "", " ", "a", " a", "a ", "a  b", "a\n\nb c", "\n a\tb", "it's a dog's  life\n", "x \n y", "12 34 5  z", "<|endoftext|> in text", "word " * 30000, "é ß 漢字 🎉 f" * 40]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_those_of_the_tokenizer(spark, plain):
    texts = ODD + [r.text for r in table(spark, SF, "documents").select("text").collect()]
    for t in texts:
        assert np.frombuffer(encoder().ids(t), dtype="<u4").tolist() == (plain.encode(t, add_special_tokens=False).ids if t else [])


@pytest.mark.parametrize("pack", [best_fit_decreasing, swap_search])
def test_bins(pack):
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.choice([7, 20, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60))]
        bins = pack(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= capacity and (fill > 0).all() and set(bins) == set(range(max(bins) + 1))
    assert pack([], 10) == []


def test_best_fit_is_best_fit():
    rnd = random.Random(4)
    for _ in range(50):
        lengths = [rnd.randint(1, 50) for _ in range(80)]
        left, total = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [x for x in left if x >= n]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(50 - n)
                total += 1
        assert max(best_fit_decreasing(lengths, 50)) + 1 == total


def test_tree_takes_the_least_capacity():
    tree = CapacityTree(20)
    for left, number in ((5, 0), (9, 1), (9, 2), (20, 3), (0, 4)):
        tree.add(left, number)
    assert [tree.take(n) for n in (6, 6, 6, 6, 5, 0, 0)] == [(9, 2), (9, 1), (20, 3), None, (5, 0), (0, 4), None]


def test_swaps_empty_bins():
    # best fit decreasing needs 3 bins here; exchanges reach the least number
    lengths, capacity = [6, 5, 5, 4, 4, 3, 3], 15
    assert max(swap_search(lengths, capacity, [0, 0, 1, 1, 2, 2, 2])) + 1 == 2


def expected_pieces(plain, rows, length=2048):
    out = {}
    for doc, text in rows:
        ids = (plain.encode(text, add_special_tokens=False).ids if text else []) + [0]
        for k, (at, n) in enumerate(cut(len(ids), length)):
            out[(doc, k)] = (at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()))
    return out


def check_sequences(rows, expected, length=2048):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_sequences_of_the_whole_table(spark, plain):
    docs = table(spark, SF, "documents")
    expected = expected_pieces(plain, [(r.doc_id, r.text) for r in docs.collect()])
    n = check_sequences(packing.pack_sequences(docs).collect(), expected)
    assert n <= -(-sum(x[1] for x in expected.values()) // 2048) + 1
    check_sequences(packing.pack_sequences(docs, group=20).collect(), expected)


def test_odd_documents(spark, plain):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sequence_id string, length int")
    check_sequences(packing.pack_sequences(docs).collect(), expected_pieces(plain, rows))
    assert packing.pack_sequences(docs.limit(0)).count() == 0
    twice = packing.pack_sequences(docs.union(docs)).collect()
    assert len(twice) == 2 * len(expected_pieces(plain, rows))
    assert packing.pack_matrices(docs.limit(0)).count() == 0
    assert packing.pack_sequences(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().doc_id is None


def test_matrices_give_back_every_document(spark, plain):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, found = packing.pack_matrices(docs).collect(), {}
    assert len({r.sequence_id for r in out}) == len(out)
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids and not ids[r.n_ids :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        for k, doc in enumerate(r.doc_ids):
            found.setdefault(doc, []).append((r.pieces[k], r.starts[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    for doc, text in rows:
        parts = sorted(found[doc])
        assert [p[0] for p in parts] == list(range(len(parts)))
        joined = [x for p in parts for x in p[2]]
        assert joined == (plain.encode(text, add_special_tokens=False).ids if text else []) + [0]
        assert [p[1] for p in parts] == np.cumsum([0] + [len(p[2]) for p in parts])[:-1].tolist()


def test_equal_rows_are_dealt_over_groups(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("word").alias("text"))
    d = packing.pack_sequences(docs, length=64, group=300)
    per_group = d.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(per_group) == 10 and max(r["count"] for r in per_group) < 450
    assert d.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0
