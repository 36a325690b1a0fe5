"""Columns and row counts of the registered queries, and that the rest imports without them."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from fleetstream.llm import queries
from fleetstream.llm.common import table
from scripts.check import rows
from tests.conftest import SF

COLUMNS = {
    "op1_nnpu_toxicity": "doc_id held_out score predicted",
    "op2_voronoi_knn": "query_id rank vec_id score",
    "op4_line_crf": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_dom_crf": "page_id url text n_chars",
    "op7_block_mixing": "doc_id size source_size target taken",
    "op9_swap_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_bitslice_simhash": "doc_id fingerprint component_id",
    "op11_chebyshev_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_inverted_minhash": "doc_id n_shingles component_id kept",
}
PER_DOCUMENT = ["op1_nnpu_toxicity", "op4_line_crf", "op5_kneser_ney", "op7_block_mixing", "op10_bitslice_simhash", "op12_merkle_manifest", "op13_inverted_minhash"]


def test_all_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, SF)
    wanted = COLUMNS.get(name, "").split()
    assert out.columns[: len(wanted)] == wanted
    n = out.count()
    assert n > 0
    if name in PER_DOCUMENT:
        assert n == table(spark, SF, "documents").count()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_links_of_documents(spark):
    found = queries.QUERIES["op3_collinear_passages"](spark, SF).collect()
    partners = {}
    for r in found:
        assert r.n_passages == len(r.passages) and len(r.other_ids) == len({p.other_id for p in r.passages})
        assert all(i < r.doc_id for i in r.other_ids)
        for i in r.other_ids:
            partners.setdefault(r.doc_id, set()).add(i)
            partners.setdefault(i, set()).add(r.doc_id)
    assert len(found) == table(spark, SF, "documents").count() and all(r.n_links == len(partners.get(r.doc_id, ())) for r in found)


def test_the_rest_imports_without_this_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 100 and 'pipeline' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0
