"""Registered queries of this subpackage, and the SQL that checks them where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstream.llm import knn, lines, merkle, minhash, mixing, ngrams, packing, pages, simhash, tiles, toxicity, whitening
from fleetstream.llm.common import small_batches, table
from fleetstream.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, by a model learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of each vector whose id is divisible by 50 with the others."""
    rows = knn.quantized(table(spark, sf_dir, "embeddings"))
    return knn.top_k(rows, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


SQL["op2_voronoi_knn"] = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""


@query
def op3_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: how many documents it shares passages with, the earlier ones of them, and the passages shared with these."""
    docs = table(spark, sf_dir, "documents")
    found = stage(tiles.all_passages(docs), "op3-passages")
    passage = F.struct("start", "end", "other_id", "other_start", "other_end", "similarity")
    own = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("other_id")).alias("other_ids"), F.sort_array(F.collect_list(passage)).alias("passages"))
    pairs = found.select("doc_id", "other_id").distinct()
    partners = pairs.select("doc_id").union(pairs.select("other_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(partners, "doc_id", "left").join(own, "doc_id", "left")
    none = lambda name: F.coalesce(name, F.array().cast(own.schema[name].dataType)).alias(name)
    return rows.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"), none("other_ids"), none("passages"))


@query
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document and whether its content lines keep it."""
    docs = table(spark, sf_dir, "documents")
    found = lines.label_lines(docs, lines.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


@query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document under a model of the trusted ones, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return ngrams.perplexities(docs, ngrams.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    rows = table(spark, sf_dir, "pages")
    return pages.main_text(rows, pages.train(rows)).select("page_id", "url", "text", "n_chars")


@query
def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources at weights 5, 2, 1 takes of each document."""
    found = mixing.taken_words(*mixing.mix(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents."""
    return packing.pack_matrices(table(spark, sf_dir, "documents"))


@query
def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 2048 tokens."""
    out = packing.pack_sequences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_bitslice_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading whitened components of each vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and what a simulated alteration of some of them does to the root."""
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


SQL["op12_merkle_manifest"] = r"""WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS skey,
    concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    text,
    doc_id IS NOT NULL AND xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))
    )) % 5 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT rid, doc_id, skey,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN hit THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS changed
  FROM base
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY skey) AS n FROM leaves
), tree AS (
  SELECT 0 AS lv, skey, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lv + 1, skey, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lv, skey, pos // 16, n
), top AS (
  SELECT 0 AS lv, row_number() OVER (ORDER BY encode(skey)) - 1 AS pos, count(*) OVER () AS n, h FROM tree WHERE n = 1
  UNION ALL
  SELECT lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 16, n
), sources AS (
  SELECT skey, h AS subroot, row_number() OVER (ORDER BY encode(skey)) - 1 AS tpos FROM tree WHERE n = 1
), low_steps AS (
  SELECT lv, skey, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
    || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lv, skey, pos // 16 ORDER BY pos)
), top_steps AS (
  SELECT lv, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
    || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lv, pos // 16 ORDER BY pos)
), low_paths AS (
  SELECT p.rid, list(s.step ORDER BY s.lv) AS path FROM placed p JOIN low_steps s ON s.skey = p.skey AND s.pos = p.pos // (16 ** s.lv)::BIGINT GROUP BY p.rid
), top_paths AS (
  SELECT p.skey, list(s.step ORDER BY s.lv) AS path FROM sources p JOIN top_steps s ON s.pos = p.tpos // (16 ** s.lv)::BIGINT GROUP BY p.skey
), proven AS (
  SELECT p.doc_id, p.leaf, o.subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.changed, p.leaf) AS start,
    list_concat(coalesce(l.path, []), coalesce(t.path, [])) AS path
  FROM placed p JOIN sources o USING (skey) LEFT JOIN low_paths l USING (rid) LEFT JOIN top_paths t USING (skey)
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(start, path), lambda acc, step: sha256(replace(step, '|', acc))) AS folded_root, folded_root = root AS verified
FROM proven
"""


@query
def op13_inverted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and near-duplicate component of each document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op13_inverted_minhash"] = r"""WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, rid, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
  FROM words
), classes AS (
  SELECT min(rid) AS cid, min(doc_id) AS first_id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT cid, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.cid AS u, b.cid AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.cid <> b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT cid AS u, cid AS v FROM classes
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least_id AS (
  SELECT r.u, min(c.first_id) AS component_id FROM reach r JOIN classes c ON c.cid = r.v GROUP BY r.u
), found AS (
  SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE i.component_id END AS component_id
  FROM sets d LEFT JOIN classes c ON c.s = d.s AND len(d.s) > 0 LEFT JOIN least_id i ON i.u = c.cid
)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""
