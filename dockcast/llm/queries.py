"""The registered queries opN_<name> and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.llm import conversations, decontam, katz, langid, licenses, mixing, ngram_join, quality, token_files, token_rollup, toxicity, vector_dedup, whitening
from dockcast.llm.text import id_hash_mod, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(mod: int, at: int):
    return (id_hash_mod(F.col("doc_id"), mod) == at).alias("held_out")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, train=id_hash_mod(F.col("doc_id"), 4) != 2)
    return langid.identify(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of links of every document."""
    return ngram_join.jaccard_degrees(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_links", "component_id")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM words WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
OP2_LINKS_SQL = OP2_SQL.replace(
    "min(r) AS component_id\nFROM reach LEFT JOIN n USING (doc_id)",
    "min(r) AS component_id, coalesce(any_value(n_links), 0) AS n_links\nFROM reach LEFT JOIN n USING (doc_id)"
    " LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) d USING (doc_id)",
)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup totals after three batches: all documents as first seen (every fifth
    id under another source and with half of its text), their revisions, and the deletion of every seventh
    id; the second batch is committed twice, which must not matter."""
    docs = _table(spark, sf_dir, "documents")
    counts = token_rollup.token_counts(docs)
    store = token_rollup.Rollup(spark, scratch(spark, "rollup"))
    early = F.when(F.col("doc_id") % 5 == 0, F.lit("staging")).otherwise(F.col("source"))
    half = F.when(F.col("doc_id") % 5 == 0, F.expr("left(text, cast(length(text) / 2 as int))")).otherwise(F.col("text"))
    store.commit(1, token_rollup.token_counts(docs.withColumns({"source": early, "text": half})))
    for _ in range(2):
        store.commit(2, counts.where("doc_id % 5 = 0"))
    store.commit(3, deletes=docs.where("doc_id % 7 = 0").select("doc_id"))
    return store.totals()


OP3_SQL = r"""
WITH live AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id % 7 <> 0
), counted AS (
  SELECT source, lang, 'space_words_v1' AS tokenizer,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM live
  UNION ALL
  SELECT source, lang, 'alnum_words_v1',
         len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM live
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY ALL
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written bit-packed and read back."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision for every document: a mix of as many tokens as there are, with no
    source repeated more than 1.25 times."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), repetition_limit=1.25)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS width, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM bench WHERE len(ws) > 0)
), widths AS (SELECT DISTINCT width FROM win),
pos AS (
  SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM w, widths WHERE len(ws) >= width
), hit AS (
  SELECT doc_id, i, p.width, item_id FROM pos p JOIN win ON win.width = p.width
  AND win.k = array_to_string(ws[i:i + p.width - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under n-grams of three words, whose model is
    stored too; learns from rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    return katz.score_texts(docs, held_out=id_hash_mod(F.col("doc_id"), 5) == 1, order=3, model_path=scratch(spark, "katz-model"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of every embedding."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learns from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"), train=id_hash_mod(F.col("doc_id"), 4) != 2)
    return quality.score(docs, weights).select("doc_id", _held_out(4, 2), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learns from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), train=id_hash_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted", "n_clauses", "kinds")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after the damage."""
    convs = _table(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(convs), names=convs)


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), numbered AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, *,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), drawn AS (
  SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM numbered, crc_table
), damaged AS (
  SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM drawn)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM damaged
), faulty AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS two
  FROM (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth FROM placed)
), counted AS (
  SELECT g, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY g
), inserts (q, q2, c, a, r) AS (
  VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
         (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
         (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])
), edits AS (
  SELECT g, i, q, 'D' AS a, 3 AS c, q AS q2, CAST([] AS VARCHAR[]) AS r FROM faulty, range(4) AS s(q)
  UNION ALL
  SELECT g, i, q, 'K', (fault = 'truncated')::INT, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, [role || ':' || text]
  FROM faulty, range(4) AS s(q) WHERE fault IN ('', 'truncated')
  AND ((left(role, 1) = 's' AND q = 0) OR (left(role, 1) = 'u' AND q <> 2) OR (left(role, 1) = 'a' AND q = 2))
  UNION ALL
  SELECT g, i, q, 'R', 2 + (fault = 'truncated')::INT, CASE q WHEN 2 THEN 3 ELSE 2 END,
         [CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] FROM faulty, range(4) AS s(q) WHERE fault IN ('', 'truncated')
), ways AS (
  SELECT g, e.i, x.q, e.q2, x.c + e.c AS c, x.a || e.a AS a, x.r || e.r AS r FROM edits e JOIN inserts x ON x.q2 = e.q
), best AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS c, '' AS a, CAST([] AS VARCHAR[]) AS r FROM numbered
  UNION ALL
  SELECT w.g, w.i, w.q2, min(b.c + w.c), arg_min(b.a || w.a, {'c': b.c + w.c, 'a': b.a || w.a}), arg_min(b.r || w.r, {'c': b.c + w.c, 'a': b.a || w.a})
  FROM best b JOIN ways w ON w.g = b.g AND w.i = b.i + 1 AND w.q = b.q GROUP BY w.g, w.i, w.q2
), done AS (
  SELECT b.g, min(b.c + x.c) AS cost, arg_min(b.a || x.a, {'c': b.c + x.c, 'a': b.a || x.a}) AS audit, arg_min(b.r || x.r, {'c': b.c + x.c, 'a': b.a || x.a}) AS lines
  FROM best b LEFT JOIN counted USING (g) JOIN inserts x ON x.q = b.q WHERE b.i = coalesce(n, 0) AND x.q2 IN (0, 3) GROUP BY b.g
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256, coalesce(n, 0) AS n_rows, len(lines) AS n_repaired
FROM (SELECT DISTINCT g, conv_id FROM numbered) JOIN done USING (g) LEFT JOIN counted USING (g)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every finite embedding."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_ngram_join": op2_ngram_join,
    "op2_ngram_links": op2_ngram_links,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_katz": op7_katz,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op2_ngram_links": OP2_LINKS_SQL, "op3_token_counts": OP3_SQL, "op6_decontamination": OP6_SQL, "op12_conversation_repair": OP12_SQL}
