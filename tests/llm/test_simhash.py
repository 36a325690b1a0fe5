import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetstream.llm import simhash
from fleetstream.llm.common import table
from tests.conftest import SF


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, fp) -> {doc_id: smallest doc_id reachable}"""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}


def test_whole_table_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    expected = plain_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(rows)
    assert {r.doc_id: r.component_id for r in got} == expected


@pytest.mark.parametrize("tile", [8, 8192])
def test_links_of_dense_and_chained_prints(spark, tile):
    rnd = random.Random(5)
    prints = []
    for _ in range(4):
        center = rnd.getrandbits(64)
        prints += [center] + [center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))) for _ in range(90)]
    x = rnd.getrandbits(64)
    for _ in range(12):  # a chain, each three bits from the last
        prints.append(x)
        x ^= sum(1 << b for b in rnd.sample(range(64), 3))
    prints += [rnd.getrandbits(64) for _ in range(50)] + [0, 2**64 - 1]
    rows = [(i, p) for i, p in enumerate(dict.fromkeys(prints))]
    frame = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in rows], "id long, fp long").repartition(3)
    from fleetstream.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame, tile)).collect()}
    expected = plain_components(rows)
    signed = {i: (p - 2**64 if p >= 2**63 else p) for i, p in rows}
    groups = {}
    for i, least in expected.items():
        groups.setdefault(least, set()).add(roots.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "one Two", "x"), (5, "ONE two", "x"), (6, "a b c " * 30000, "x"), (7, "a b c " * 30001, "x"), (None, "lonely words of no id at all", "x"), (4, "one Two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("4", "4"), ("5", "4"), ("6", "6"), ("7", "6"), ("None", "None")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_an_id_and_with_a_repeated_one(spark):
    texts = [" ".join(random.Random(k).choices([f"word{i}" for i in range(500)], k=60)) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[2]), (2, texts[3]), (2, texts[4]), (3, texts[4]), (None, texts[1])]
    wanted = sorted(map(str, [(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[4])]))
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(str((r.doc_id, r.text)) for r in simhash.keep_one(docs).collect()) == wanted


def test_hot_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same words in each copy of this text")).otherwise(F.concat(F.lit("w"), F.col("id"), F.lit(" text "), F.col("id") * 7, F.lit(" of its own "), F.xxhash64("id"))).alias("text"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i] == 0 for i in range(0, 3000, 3)) and len(got) == 3000
