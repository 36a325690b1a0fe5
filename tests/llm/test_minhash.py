import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstream.llm import minhash


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def plain_result(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        of = min((d for d in least[root(i)] if d is not None), default=None)
        out.append((doc, len(sets[i]), of, doc == of))
    return out


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def varied(rng, n_groups, copies, words, changes):
    rows = []
    for _ in range(n_groups):
        base = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = "Neu" + str(rng.random())
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words, changes", [(3, 1), (12, 1), (60, 3), (200, 12)])
def test_against_all_pairs(spark, words, changes):
    rows = varied(random.Random(words), 40, 12, words, changes)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert ordered(got) == ordered(plain_result(rows))


@pytest.mark.parametrize("tile, bound", [(8, 300), (3, 1)])
def test_tiled_lists_and_groups_give_the_same(spark, monkeypatch, tile, bound):
    rows = varied(random.Random(7), 12, 60, 40, 9)
    monkeypatch.setattr(minhash.candidates, "__defaults__", (minhash.MATCHES, tile))
    monkeypatch.setattr(minhash.confirmed, "__defaults__", (bound,))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(plain_result(rows))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (9, "ONE"), (5, "one two three"), (6, "one  two\nthree"), (7, "ÄRGER x y z"), (8, "ärger x y z"),
        (20, long), (21, long.upper()), (22, long + " more"), (None, "n u l l s"), (None, "n u l l s"), (30, "n u l l s"), (None, "alone it is"), (None, None),
        (40, "twice the same row"), (40, "twice the same row"), (40, "other text of this id"), (39, "other text of this id"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, low long")
    got = ordered(minhash.near_duplicates(df).collect())
    want = [(d, n, c, True if d is None and c is None else k) for d, n, c, k in plain_result(rows)]
    assert got == ordered(want)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_thousands_of_copies_is_kept(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 3 + "a b c d e f g h i j k l m n o p q r s t u v w x y z A1 B1 C1 D1 "), F.col("id").cast("string")).alias("text"))
    out = minhash.near_duplicates(df)
    assert out.filter("kept").count() == 1 and out.filter("component_id = 0").count() == 6000


def test_prefix_and_skip_find_what_counting_finds():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (200, minhash.COORDINATES), dtype=np.uint32)
    near = minhash.matching(values)
    for i in range(0, 200, 17):
        others = np.arange(i + 1, 200)
        assert (near(i, others) == ((values[others] == values[i]).sum(axis=1) >= minhash.MATCHES)).all() if len(others) else True
