import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetstream.operators import knowledge, retrieval


def corpus(spark, n=700, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    rows = [(f"c{i:05d}", f"head {rng.choice(words)}", " ".join(words[min(149, int(rng.expovariate(0.05)))] for _ in range(rng.randint(0, 60))), rng.sample(["A", "B", "C"], rng.randint(0, 2))) for i in range(n)]
    rows += [(f"d{i:05d}", *rows[i][1:]) for i in range(min(n, 40))]  # copies tie
    return spark.createDataFrame(rows, "chunk_id string, heading string, text string, tags array<string>")


def plain(chunks, postings, terms, queries, k):
    """Sums over all postings of a query's terms."""
    c = F.col
    q = queries.select("query_id", F.explode(F.split("query", " ")).alias("term"), c("tags").alias("qtags")).groupBy("query_id", "qtags", "term").agg(F.count("*").alias("n"))
    hits = q.join(terms, "term").join(postings, "term").groupBy("query_id", "qtags", "tags", "chunk_id").agg(F.sum(c("n") * c("idf") * c("tf_factor")).alias("s"))
    hits = hits.withColumn("score", F.round(F.when(F.arrays_overlap("tags", "qtags"), c("s") * 1.5).otherwise(c("s")), 9))
    out = {}
    for r in hits.collect():
        out.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    return {i: [(x, round(-s, 6)) for s, x in sorted(v)[:k]] for i, v in out.items()}


@pytest.mark.parametrize("k, together", [(1, 2048), (5, 3), (40, 2048)])
def test_search_equals_summing_all_postings(spark, monkeypatch, k, together):
    monkeypatch.setattr(retrieval, "TOGETHER", together)
    rng = random.Random(k)
    chunks = corpus(spark)
    postings, terms = knowledge.bm25_index(chunks)
    index = (retrieval.sliced_index(postings, 100), knowledge.search_index(postings, terms)[1])
    asked = [(f"q{i}", " ".join(f"w{rng.randrange(160)}" for _ in range(rng.randint(1, 9))), [["A"], [], ["B", "C"], None][i % 4]) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id string, query string, tags array<string>")
    got = {}
    for r in sorted(knowledge.bm25_search(queries, chunks, index, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    assert got == plain(chunks, postings, terms, queries, k)


def test_index_counts_terms_where_chunks_are(spark):
    # three chunks of a partition, one without a word: two postings of w1 with their own counts, and no shuffle by chunk
    rows = [("c1", "w1", "w1 w2 w1", ["A"]), ("c2", "", "", None), ("c3", "", "w2", [])]
    chunks = spark.createDataFrame(rows, "chunk_id string, heading string, text string, tags array<string>").coalesce(1)
    postings, terms = knowledge.bm25_index(chunks)
    k1, b, avgdl = knowledge.K1, knowledge.B, 5 / 3
    factor = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    got = {(r.chunk_id, r.term): r.tf_factor for r in postings.collect()}
    assert got == {("c1", "w1"): factor(3, 4), ("c1", "w2"): factor(1, 4), ("c3", "w2"): factor(1, 1)}
    assert {(r.term, r.df) for r in terms.collect()} == {("w1", 1), ("w2", 2)}
    assert "hashpartitioning" not in postings._jdf.queryExecution().executedPlan().toString()


def test_slices_are_bounded_and_hold_every_posting(spark):
    postings, _ = knowledge.bm25_index(corpus(spark))
    index = retrieval.sliced_index(postings, 100)
    sizes = [len(r.ids) for r in index.where(F.col("term") == retrieval.IDS).collect()]
    assert sum(sizes) == 740 and max(sizes) < 160 and len(sizes) == 8
    for r in index.where("blocks is not null").limit(200).collect():
        tops = [b.top for b in r.blocks]
        assert tops == sorted(tops, reverse=True)
        for b in r.blocks:
            assert b.top == max(p.impact for p in b.postings) and {p.no // retrieval.BLOCK for p in b.postings} == {b.block}


def test_blocks_below_the_kth_score_are_not_read():
    n = 64 * 50
    per = [{"top": 10.0 - b, "block": b, "postings": [{"no": b * 64 + i, "impact": (10.0 - b) / (1 + i)} for i in range(64)]} for b in range(50)]
    kind = pa.list_(pa.struct([("top", pa.float64()), ("block", pa.int32()), ("postings", pa.list_(pa.struct([("no", pa.int32()), ("impact", pa.float64())])))]))
    asker = pa.list_(pa.struct([("__q", pa.string()), ("w", pa.float64()), ("least", pa.float64())]))
    rows = pa.table({
        "slice": [0, 0], "term": ["", "x"], "blocks": pa.array([None, per], kind), "ids": pa.array([[f"{i:05d}" for i in range(n)], None], pa.list_(pa.string())),
        "part": [0, 0], "askers": pa.array([[], [{"__q": "q", "w": 1.0, "least": None}]], asker),
    })
    read = []
    out = retrieval._best_of_slice(rows, 3, 1.5, read)
    assert out["score"].to_pylist() == [10.0, 9.0, 8.0] and sum(read) <= 6


def test_no_exchange_of_chunk_and_query_pairs(spark):
    chunks = corpus(spark)
    index = knowledge.search_index(*knowledge.bm25_index(chunks))
    queries = spark.createDataFrame([("a", "w1 w2", ["A"])], "query_id string, query string, tags array<string>")
    plan = knowledge.bm25_search(queries, chunks, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "chunk_id" in line.split("hashpartitioning")[1] and "__q" in line.split("hashpartitioning")[1] for line in plan.splitlines())


def test_queries_of_a_part_advance_together(monkeypatch):
    """What 300 queries of a slice get is what each gets alone, and numpy is not called per query."""
    rng = np.random.default_rng(5)
    n, terms = 64 * 8 + 9, [f"t{i:02d}" for i in range(30)]
    block = lambda b, nos: {"top": float(max(1 + x % 7 for x in nos)), "block": b, "postings": [{"no": int(x), "impact": 1.0 + x % 7} for x in nos]}
    lists = []
    for _ in terms:
        nos = np.sort(rng.choice(n, 90, replace=False))
        lists.append(sorted((block(int(b), nos[nos // 64 == b]) for b in np.unique(nos // 64)), key=lambda b: -b["top"]))
    asked = {f"q{i:03d}": rng.choice(30, 3, replace=False) for i in range(300)}
    who = [[{"__q": q, "w": 0.5 + j % 3 - (i % 50 == 0), "least": None} for i, (q, own) in enumerate(asked.items()) if j in own] for j in range(30)]
    kind = pa.list_(pa.struct([("top", pa.float64()), ("block", pa.int32()), ("postings", pa.list_(pa.struct([("no", pa.int32()), ("impact", pa.float64())])))]))
    asker = pa.list_(pa.struct([("__q", pa.string()), ("w", pa.float64()), ("least", pa.float64())]))

    def best(chosen):
        own = [[a for a in x if a["__q"] in chosen] for x in who]
        rows = pa.table({
            "slice": [0] * 31, "term": ["", *terms], "blocks": pa.array([None, *lists], kind), "ids": pa.array([[f"{i:05d}" for i in range(n)]] + [None] * 30, pa.list_(pa.string())),
            "part": [0] * 31, "askers": pa.array([[], *own], asker),
        })
        return retrieval._best_of_slice(rows, 5, 1.5).sort_by([("__q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]).to_pylist()

    calls, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **kw: (calls.append(1), real(*a, **kw))[1])
    together = best(set(asked))
    assert len(calls) < 30
    assert together == [r for q in asked for r in best({q})] and len(together) == 1500


def test_alike_queries_are_searched_once(spark, monkeypatch):
    chunks = corpus(spark)
    index = knowledge.search_index(*knowledge.bm25_index(chunks))
    seen, real = [], knowledge.slice_hits
    monkeypatch.setattr(knowledge, "slice_hits", lambda texts, *a: (seen.append(texts.count()), real(texts, *a))[1])
    rows = [("a", "w1 w2 zz1", ["A", "B"]), ("b", "zz2 w2 W1", ["B", "A", "A"]), ("c", "w1 w2 w2", ["A", "B"]), ("d", "w1 w2", None), ("e", "zz3", ["A"]), ("f", "", ["A"])]
    queries = spark.createDataFrame(rows, "query_id string, query string, tags array<string>")
    got = {}
    for r in knowledge.bm25_search(queries, chunks, index, 5, pad=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert seen == [4] and got["a"] == got["b"] != got["c"] and got["a"] != got["d"] and got["e"] == got["f"]
    assert [len(got[q]) for q in "abcdef"] == [5] * 6


def test_empty_tables(spark):
    chunks = corpus(spark, 5)
    index = knowledge.search_index(*knowledge.bm25_index(chunks))
    none = spark.createDataFrame([], "query_id string, query string, tags array<string>")
    assert knowledge.bm25_search(none, chunks, index, 5).collect() == []
    unknown = spark.createDataFrame([("a", "zzz", ["A"])], none.schema)
    assert knowledge.bm25_search(unknown, chunks, index, 5).collect() == []
    assert [r.score for r in knowledge.bm25_search(unknown, chunks, index, 5, pad=True).collect()] == [0.0] * 5
