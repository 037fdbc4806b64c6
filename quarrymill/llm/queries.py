"""One query for each operator, over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import (
    chat,
    decontaminate,
    filter_audit,
    infill,
    near_dedup,
    packing,
    perplexity,
    pii,
    quality_classifier,
    sharding,
    toxicity,
    warc,
    wrapper,
)
from quarrymill.llm.common import table


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.Classifier(docs, table(spark, sf_dir, "labels")).score(docs)


def op11_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.Classifier(docs, table(spark, sf_dir, "labels")).score(docs)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(infill.with_boundaries(table(spark, sf_dir, "documents")), seed=7, rate=100, spm=50))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_lpt_sharding, op3_warc_revisits, op4_pii_bootstrap, op5_wrapper_induction,
        op6_packing, op7_minhash_dedup, op8_decontamination, op9_perplexity_rules, op10_quality_classifier, op11_nb_toxicity,
        op12_fill_in_middle, op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op1_chat_perspectives": """
WITH turns AS (
  SELECT conv_id, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) / 512) AS BIGINT) AS part,
         turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), shown AS (
  SELECT t.conv_id, p.perspective, t.part, t.turn, t.role, t.text, t.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = 'system' THEN t.role
                                ELSE 'user name=' || t.role END || chr(10) AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS k,
         sum(length(head) + length(text) + 11) OVER w - length(text) - 11 AS begin_at
  FROM shown
  WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begin_at + length(text) AS BIGINT) AS VARCHAR), ','
                ORDER BY k) FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(text)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part""",
    "op3_warc_revisits": """
WITH read AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM read WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM read LEFT JOIN firsts USING (payload_digest)""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(node, there) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.there
), least AS (
  SELECT node, min(there) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.node = d.doc_id""",
    "op12_fill_in_middle": r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(l) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(l) + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(l) + 1) AS k2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM lines
), cut AS (
  SELECT *, array_to_string(l[1:least(k1, k2)], '') AS p, array_to_string(l[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
         array_to_string(l[greatest(k1, k2) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut""",
    "op13_filter_audit": r"""
WITH letters(c, b) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v JOIN letters w ON w.c <> v.c JOIN letters x ON x.c NOT IN (v.c, w.c) JOIN letters y ON y.c NOT IN (v.c, w.c, x.c)
  JOIN letters z ON z.c NOT IN (v.c, w.c, x.c, y.c)
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS b, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS e
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
), read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), known AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY 1
), masks AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
         coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM read LEFT JOIN known USING (doc_id)
)
SELECT part, filter_order, step, count(*) FILTER (WHERE mask & (b | e) = 0) AS kept, count(*) FILTER (WHERE mask & b <> 0 AND mask & e = 0) AS removed,
       count(*) FILTER (WHERE mask & b <> 0 AND mask & e <> 0) AS redundant, count(*) FILTER (WHERE mask = b) AS unique_fails,
       count(*) FILTER (WHERE good AND mask & b <> 0 AND mask & e = 0) AS good_lost, count(*) FILTER (WHERE bad AND mask & b <> 0 AND mask & e = 0) AS toxic_lost,
       CAST(coalesce(sum(120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & b <> 0), 0) AS BIGINT) AS shapley
FROM masks, steps GROUP BY part, filter_order, step""",
}
