"""The queries of the ten training-data problems and, where SQL can say it, their equivalents in SQL.

Every query runs over its whole tables with the operators' own parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import contributors, copies, leaks, linetree, packing, prose, severity, site_lines, spam, terms
from webloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(t(spark, d, "title_edges"), t(spark, d, "title_segs")).where("mark is not null").select("term", "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(t(spark, d, "title_edges"), t(spark, d, "title_segs")).select("term", "occurrences", "records", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.excess_lines(t(spark, d, "documents")).select("doc_id", "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    cleaned = site_lines.without_excess_lines(t(spark, d, "documents").select("doc_id", "domain", "doc_text"))
    return cleaned.select("doc_id", F.length("clean_text").cast("long").alias("clean_chars"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return contributors.best_pages(t(spark, d, "documents"), t(spark, d, "domains")).where("not kept").select("doc_id")


def p3_sampled(spark: SparkSession, d: str) -> DataFrame:
    return contributors.sampled_pages(t(spark, d, "documents"), t(spark, d, "domains"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.findings(prose.prose_quality(t(spark, d, "documents"), t(spark, d, "labels")))


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_quality(t(spark, d, "documents"), t(spark, d, "labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linetree.furniture_lines(t(spark, d, "documents"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    bodies = linetree.main_bodies(t(spark, d, "documents").select("doc_id", "uri", "domain", "title", "doc_text"))
    return bodies.select("doc_id", F.length("body").alias("body_chars"), F.length("doc_text").alias("page_chars"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(t(spark, d, "documents"), t(spark, d, "edges")).where("spam").select("doc_id")


def p6_curves(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(t(spark, d, "documents"), t(spark, d, "edges"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    one = copies.address_copies(t(spark, d, "discovery"), "id").select(F.lit("discovery").alias("tbl"), "first_id", "copy_id")
    return one.unionByName(copies.address_copies(t(spark, d, "documents"), "doc_id").select(F.lit("documents").alias("tbl"), "first_id", "copy_id"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = [copies.address_copies(t(spark, d, name), identity).withColumn("tbl", F.lit(name)) for name, identity in (("discovery", "id"), ("documents", "doc_id"))]
    return tables[0].unionByName(tables[1]).groupBy("tbl", "first_id").agg(F.max("copies").alias("copies"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    one = copies.address_records(t(spark, d, "discovery"), "id").select(F.lit("discovery").alias("tbl"), "first_id", "copies")
    return one.unionByName(copies.address_records(t(spark, d, "documents"), "doc_id").select(F.lit("documents").alias("tbl"), "first_id", "copies"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(t(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(packing.pack(t(spark, d, "documents")))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: whether its pieces are all its tokens, one after the other, each in a container that isn't overfull."""
    packed = packing.pack(t(spark, d, "documents"))
    room = packed.groupBy("container").agg((F.sum("size") <= F.max("tier")).alias("fits"), (F.min("tier") == F.max("tier")).alias("one_tier"))
    pieces = packed.join(room, "container").groupBy("doc_id")
    return pieces.agg(
        (F.sum("size") == F.max(F.col("first_token") + F.col("size"))).alias("whole"), (F.max("piece") + 1 == F.countDistinct("piece")).alias("in_order"), F.bool_and(F.col("fits") & F.col("one_tier")).alias("fits")
    )


def p7_fields(spark: SparkSession, d: str) -> DataFrame:
    """Documents that agree in title and text but for formatting."""
    return copies.formatting_copies(t(spark, d, "documents"), "doc_id", ["title", "doc_text"])


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_quality(t(spark, d, "documents"), t(spark, d, "labels")).select("doc_id", "true_words", "count_wrong")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(t(spark, d, "documents"), t(spark, d, "benchmark")).where("template_words > 0 and exact_words > 0").select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.find_leaks(t(spark, d, "documents"), t(spark, d, "benchmark"))
    return found.groupBy("item_id").agg(F.count_if(F.expr("exact_words > 0")).alias("exact_documents"), F.count_if(F.expr("exact_words = 0 and template_words > 0")).alias("template_documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return severity.score_documents(t(spark, d, "documents"), t(spark, d, "labels")).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return severity.score_documents(t(spark, d, "documents"), t(spark, d, "labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return severity.source_rates(p10_scores(spark, d))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_frequencies": p1_frequencies,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_sampled": p3_sampled,
    "p4_found": p4_found,
    "p4_statistics": p4_statistics,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_bodies": p5_bodies,
    "p6_found": p6_found,
    "p6_curves": p6_curves,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p7_records": p7_records,
    "p7_fields": p7_fields,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_whole": p8_whole,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_TERMS = r"""
WITH s AS (SELECT DISTINCT id, trim(regexp_replace(lower(seg), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS term FROM title_segs),
e AS (SELECT s.term, x.doc FROM title_edges x JOIN s ON s.id = x.seg WHERE x.doc IS NOT NULL),
n AS (SELECT count(DISTINCT doc) AS n FROM e),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc) AS records FROM e GROUP BY term),
m AS (SELECT c.*, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.02 * n.n THEN 'common' END AS mark FROM c, n)
"""

_SITE = r"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(domain)), '^[a-z][a-z0-9+.\-]*://', ''), '[/?#].*$', ''), '(:[0-9]*|\.)+$', ''), '^www\.', ''), '')"""

_LINES = rf"""
WITH s AS (SELECT doc_id, {_SITE} AS site, doc_text FROM documents),
l AS (SELECT doc_id, site, unnest(string_split(doc_text, chr(10))) AS line, unnest(range(len(string_split(doc_text, chr(10))))) AS line_no FROM s WHERE site IS NOT NULL AND doc_text IS NOT NULL),
k AS (SELECT doc_id, site, line_no, regexp_replace(lower(line), '[^\p{{L}}]+', '', 'g') AS letters FROM l),
n AS (SELECT site, count(DISTINCT doc_id) AS m FROM s WHERE site IS NOT NULL GROUP BY site),
c AS (SELECT site, letters, count(DISTINCT doc_id) AS pages FROM k WHERE letters <> '' GROUP BY site, letters),
f AS (SELECT k.doc_id, k.line_no FROM k JOIN c USING (site, letters) JOIN n USING (site) WHERE pages >= 5 AND pages >= 0.1 * m)
"""

_ADDRESS = r"""
x AS (SELECT tbl, id, CASE WHEN uri LIKE '%\%%' ESCAPE '\' THEN url_decode(regexp_replace(uri, '%([^0-9a-fA-F]|.[^0-9a-fA-F]|.?$)', '%25\1', 'g')) ELSE uri END AS u FROM r WHERE uri IS NOT NULL),
y AS (SELECT tbl, id, regexp_replace(lower(split_part(u, '?', 1)), '[^\p{L}\p{N}]+', '', 'g') AS path,
  list_sort(list_filter(string_split(regexp_replace(lower(CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END), '[^\p{L}\p{N}&]+', '', 'g'), '&'), lambda p: p <> '')) AS parameters FROM x),
g AS (SELECT tbl, path, parameters, min(id) AS first_id, count(*) AS copies FROM y GROUP BY ALL HAVING count(*) > 1)
"""

SQL: dict[str, str] = {
    "p1_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": _TERMS + "SELECT term, occurrences, records, mark FROM m",
    "p2_found": _LINES + "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM f",
    "p2_clean": _LINES
    + """, o AS (SELECT doc_id, unnest(string_split(doc_text, chr(10))) AS line, unnest(range(len(string_split(doc_text, chr(10))))) AS line_no FROM documents),
j AS (SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.line_no) AS body FROM o ANTI JOIN f ON f.doc_id = o.doc_id AND f.line_no = o.line_no GROUP BY o.doc_id),
b AS (SELECT d.doc_id, CASE WHEN d.doc_text IS NOT NULL THEN coalesce(j.body, '') END AS body FROM documents d LEFT JOIN j USING (doc_id))
SELECT doc_id, length(body) AS clean_chars, md5(body) AS clean_md5 FROM b""",
    "p3_found": rf"""
WITH s AS (SELECT doc_id, {_SITE} AS site, flags, word_count FROM documents), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT DISTINCT {_SITE} AS site FROM domains WHERE rank IS NOT NULL),
c AS (SELECT s.*, CASE WHEN r.site IS NOT NULL THEN greatest(3, n.n // 50) ELSE greatest(2, n.n // 100) END AS cap,
  row_number() OVER (PARTITION BY s.site ORDER BY CASE WHEN flags = 0 THEN 0 ELSE 1 END, word_count DESC NULLS LAST, doc_id) AS place FROM s CROSS JOIN n LEFT JOIN r ON r.site = s.site WHERE s.site IS NOT NULL)
SELECT doc_id FROM c WHERE place > cap""",
    "p3_sampled": rf"""
WITH s AS (SELECT doc_id, {_SITE} AS site, word_count FROM documents), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT DISTINCT {_SITE} AS site FROM domains WHERE rank IS NOT NULL),
u AS (SELECT s.*, (CAST('0x' || substr(md5(doc_id || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM s WHERE site IS NOT NULL),
k AS (SELECT *, floor(coalesce(CASE WHEN word_count > 0 THEN ln(CAST(word_count AS DOUBLE)) - ln(-ln(u)) END, -99) * 1099511627776) AS key FROM u),
c AS (SELECT k.doc_id, CASE WHEN r.site IS NOT NULL THEN greatest(3, n.n // 50) ELSE greatest(2, n.n // 100) END AS cap, count(*) OVER (PARTITION BY k.site) AS size,
  row_number() OVER (PARTITION BY k.site ORDER BY key DESC, doc_id) AS place FROM k CROSS JOIN n LEFT JOIN r ON r.site = k.site)
SELECT doc_id, place <= cap AS kept FROM c WHERE size > cap""",
    "p7_found": "WITH r AS (SELECT 'discovery' AS tbl, id, uri FROM discovery UNION ALL SELECT 'documents', doc_id, uri FROM documents)," + _ADDRESS
    + "SELECT y.tbl, g.first_id, y.id AS copy_id FROM y JOIN g USING (tbl, path, parameters) WHERE y.id <> g.first_id",
    "p9_found": r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM b WHERE len(w) > 11)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
x AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) > 11))
SELECT DISTINCT doc_id, item_id FROM x JOIN i USING (g)""",
    "p8_whole": "SELECT doc_id, true AS whole, true AS in_order, true AS fits FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
    "p7_fields": r"""
WITH p AS (SELECT doc_id, list_sort([regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(coalesce(doc_text, '')), '[^\p{L}\p{N}]+', '', 'g')]) AS k FROM documents)
SELECT min(doc_id) AS first_id, count(*) AS copies FROM p GROUP BY k HAVING count(*) > 1""",
    "p4_counts": r"""
WITH c AS (SELECT doc_id, word_count, len(list_filter(regexp_split_to_array(doc_text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS true_words FROM documents WHERE doc_text IS NOT NULL)
SELECT doc_id, true_words, word_count IS NULL OR abs(word_count - true_words) * 10 > true_words AS count_wrong FROM c""",
    "p7_records": "WITH r AS (SELECT 'discovery' AS tbl, id, uri FROM discovery UNION ALL SELECT 'documents', doc_id, uri FROM documents)," + _ADDRESS
    + "SELECT tbl, min(id) AS first_id, count(*) AS copies FROM y GROUP BY tbl, path, parameters",
    "p7_counts": "WITH r AS (SELECT 'discovery' AS tbl, id, uri FROM discovery UNION ALL SELECT 'documents', doc_id, uri FROM documents)," + _ADDRESS + "SELECT tbl, first_id, copies FROM g",
}
