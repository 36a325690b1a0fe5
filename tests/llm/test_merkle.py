import hashlib
import zlib
from collections import defaultdict

import pytest

from fleetstream.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))


def plain_tree(nodes):
    """Root and, per leaf, (left, right) siblings of each level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, where, strict=True):
            a = p // 16 * 16
            path.append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + 16])))
        nodes = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
        where = [p // 16 for p in where]
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        own = plain_leaf(r, r[4])
        by[r[1]].append((r[0] is not None, r[0] or 0, own, plain_leaf(r, low if hit else r[4]), r[0]))
    if not by:
        return []
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = [plain_tree([x[2] for x in sorted(by[s])]) for s in sources]
    root, over = plain_tree([r for r, _ in low])
    out = []
    for s, (subroot, paths), top in zip(sources, low, over, strict=True):
        for (_, _, leaf, changed, doc), path in zip(sorted(by[s]), paths, strict=True):
            node = changed
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((doc, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return out


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (300, 3), (600, 40)])
def test_against_a_plain_tree(spark, n, sources):
    rows = [(i, f"s{i * i % sources}", "en", i, f"Text {i} ÄB") for i in range(n)]
    got = merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert ordered(got) == ordered(plain_manifest(rows))


def test_a_hot_source_of_three_levels(spark):
    rows = [(i, "hot" if i % 100 else f"s{i}", "en", None, f"A{i}") for i in range(5000)]
    got = merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ordered(got) == ordered(plain_manifest(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 3, "ABC"), (None, "a", "en", 3, "ABD"),
        (7, "a", "en", 3, "x" * 300_000), (7, "a", "de", 3, "Ä\u0000Z|:"), (7, "a", "de", 3, "Ä\u0000Z|:"), (8, "é", "en", -5, "q"), (9, "z", "en", 1, "Z"),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", h string, pos long, key long")
    assert ordered(merkle.verified_manifest(df).collect()) == ordered(plain_manifest(rows))
    assert merkle.verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_rows_fall_into_several_ranges(spark):
    df = spark.range(20_000, numPartitions=8).selectExpr("cast(null as long) doc_id", "'s' source", "'en' lang", "1L n_chars", "'same' text")
    leaves = merkle.document_leaves(df)
    placed = merkle.placed(leaves, "key", "doc_id", "h")
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(20_000))
    got = merkle.verified_manifest(df)
    assert got.select("root").distinct().count() == 1 and got.filter("verified").count() == 20_000


def test_altered_rows_fail_and_no_others(spark):
    rows = [(i, f"s{i % 7}", "en", 1, f"Capital {i}" if i % 2 else f"small {i}") for i in range(400)]
    for r in merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or r.doc_id % 2 == 0)
