"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrycast.llm import encoding, garbled, leaks, mail_text, matching, neardup
from quarrycast.runtime import spread, table


def p7_ids(spark, sf_dir):
    return encoding.encode(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def p8_found(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return leaks.find(documents, table(spark, sf_dir, "eval_items", "item_id", "text")).distinct()


def matched(spark, sf_dir):
    items = table(spark, sf_dir, "funding_items", "id", "company_name", "headline", "resolved_domain")
    return matching.match(items, table(spark, sf_dir, "companies", "id", "name", "domain", "notes"))


def p3_found(spark, sf_dir):
    found = matched(spark, sf_dir)
    return found.where(F.col("confidence") > matching.LEAST_CONFIDENCE).select(F.col("id").alias("funding_id"), "company_id")


def p3_confidence(spark, sf_dir):
    """Every match with the rule that made it and the rule's confidence, weak ones included."""
    return matched(spark, sf_dir).select(F.col("id").alias("funding_id"), "company_id", "rule", "confidence")


def p5_found(spark, sf_dir):
    return mail_text.written_lines(table(spark, sf_dir, "mail_messages", "gmail_id", "thread_id", "from_addr", "body", "received_at", "seen_at"))


def p6_found(spark, sf_dir):
    jobs = table(spark, sf_dir, "jobs", "id", "title", "jd_text").where(F.col("jd_text").rlike(r"(?U)\S"))
    return neardup.all_pairs(spread(jobs), "id", ["title", "jd_text"], threshold=0.7, n=3).distinct()


def p6_classes(spark, sf_dir):
    """One row for each job: its class of equal sets and the number of other classes that are near."""
    jobs = table(spark, sf_dir, "jobs", "id", "title", "jd_text").where(F.col("jd_text").rlike(r"(?U)\S"))
    return neardup.classes(spread(jobs), "id", ["title", "jd_text"], threshold=0.7, n=3)


def p7_decoded(spark, sf_dir):
    """The texts that the ids stand for: every document comes back as it was."""
    ids = encoding.encode(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return ids.select("doc_id", encoding.decode(F.col("ids"), spark).alias("text"))


def p8_spans(spark, sf_dir):
    """Where in the documents the items' passages are."""
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return leaks.spans(documents, table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_without(spark, sf_dir):
    """The documents without the items' passages."""
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return leaks.without_leaks(documents, table(spark, sf_dir, "eval_items", "item_id", "text"))


def p9_found(spark, sf_dir):
    found = garbled.restore(spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    return found.select("doc_id", F.when(F.col("lost"), F.lit("")).otherwise(F.md5(F.encode("restored", "UTF-8"))).alias("restored_md5")).distinct()


QUERIES = {"p9_found": p9_found, "p3_found": p3_found, "p3_confidence": p3_confidence, "p5_found": p5_found, "p6_found": p6_found, "p6_classes": p6_classes, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p8_spans": p8_spans, "p8_without": p8_without}

SQL = {
    "p6_classes": r"""
WITH j AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || jd_text), '[\p{L}\p{N}]+') AS w FROM jobs WHERE regexp_matches(jd_text, '[^\s\pZ]')),
     s AS (SELECT DISTINCT id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS p FROM j)),
     m AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY id)),
     r AS (SELECT s.* FROM s JOIN m USING (id) WHERE id = class_id),
     n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
     c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
     l AS (SELECT a AS class_id, count(*) AS links FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c.c >= 0.7 * (x.n + y.n - c.c) - 1e-9 GROUP BY a)
SELECT id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (class_id)""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_found": r"""
WITH j AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || jd_text), '[\p{L}\p{N}]+') AS w FROM jobs WHERE regexp_matches(jd_text, '[^\s\pZ]')),
     s AS (SELECT DISTINCT id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS p FROM j)),
     n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
     c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c.c >= 0.7 * (a.n + b.n - c.c) - 1e-9""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
     es AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (s)""",
}
