"""The queries of the engine's own operators, and the same in SQL where SQL can say it.

Each query takes (spark, folder) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import arrays, bitmask, links, scores
from webloom.functions.analysis import _ENDINGS, STOP_WORDS, stem_table, weighted_vector
from webloom.functions.fixed import ENGLISH_ONLY_SITES, FILE_SUFFIXES, FORBIDDEN_ON_SITE, FORBIDDEN_PATHS, FORBIDDEN_SITES, ROOT_SITES, TITLE_SEPARATORS
from webloom.functions.html import AD_SIGNS, COMMENTS, CONTENT, TYPE_FLAGS
from webloom.functions.text import strip_space, word_count
from webloom.functions.uri import site, uri_host
from webloom.operators import frontier, graph, layout, maintenance, postings, search, signals, titles
from webloom.sources.imports import parsed_robots
from webloom.sources.roots import with_roots
from webloom.sources.tables import read_table as t
from webloom.streaming.crawl import events_by_window, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- search ---------------------------------------------------------------

_WORDS = r"WITH w AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS line FROM documents WHERE flags = 0) "


def _found(spark: SparkSession, d: str, text: str) -> DataFrame:
    return search.matching(t(spark, d, "documents"), text)


@query(_WORDS + "SELECT doc_id FROM w WHERE list_contains(words, 'village')")
def search_term(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "village").select("doc_id")


@query(_WORDS + "SELECT doc_id, uri, word_count FROM w WHERE list_contains(words, 'village') AND list_contains(words, 'letter') AND NOT list_contains(words, 'rain')")
def search_and(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "village letter -rain").select("doc_id", "uri", "word_count")


@query(_WORDS + "SELECT doc_id FROM w WHERE (list_contains(words, 'kettle') OR list_contains(words, 'sternatlas')) AND list_contains(words, 'letter') OR list_contains(words, 'molino')")
def search_or(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "(kettle OR Sternatlas) AND letter OR molino").select("doc_id")


@query(_WORDS + "SELECT doc_id FROM w WHERE NOT list_contains(words, 'letter') AND NOT contains(line, ' wet sunday ')")
def search_not(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, '-letter -"wet Sunday"').select("doc_id")


@query(_WORDS + "SELECT doc_id FROM w WHERE contains(line, ' the other one and compare both ')")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, '"the other one and compare both"').select("doc_id")


@query(_WORDS + "SELECT doc_id FROM w WHERE contains(uri, 'blog.example') AND list_contains(words, 'letter')")
def search_site(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "site:blog.example letter").select("doc_id")


@query(_WORDS + "SELECT doc_id, js, css FROM w WHERE js > 5000 AND css < 20000 AND list_contains(words, 'letter')")
def search_size(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "where:js>5000 with:css<20000 letter").select("doc_id", "js", "css")


@query(SQL["search_or"])
def search_setops(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_by_sets(t(spark, d, "documents"), "(kettle OR Sternatlas) AND letter OR molino")


@query(SQL["search_or"])
def search_index(spark: SparkSession, d: str) -> DataFrame:
    documents = t(spark, d, "documents")
    return postings.search_postings(postings.build_postings(documents), documents, "(kettle OR Sternatlas) AND letter OR molino")


@query(SQL["search_phrase"])
def search_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    documents = t(spark, d, "documents")
    return postings.search_postings(postings.build_postings(documents), documents, '"the other one and compare both"')


@query(_WORDS + "SELECT doc_id, n_chars AS ranking FROM w WHERE list_contains(words, 'letter') ORDER BY n_chars, doc_id LIMIT 20 OFFSET 20")
def search_page2(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of 20 rows: the limit is the feature."""
    return search.page(_found(spark, d, "letter").withColumn("ranking", F.col("n_chars")), 2).select("doc_id", "ranking")


_SITE = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(domain)), '^[a-z][a-z0-9+.\-]*://', ''), '[/?#].*$', ''), '(:[0-9]*|\.)+$', ''), '^www\.', ''), '')"


@query(_WORDS + f", r AS (SELECT {_SITE} AS site, min(rank) AS popularity FROM domains WHERE rank IS NOT NULL GROUP BY 1) SELECT doc_id, popularity FROM (SELECT doc_id, words, {_SITE} AS site FROM w) LEFT JOIN r USING (site) WHERE list_contains(words, 'letter')")
def search_popularity(spark: SparkSession, d: str) -> DataFrame:
    return search.with_popularity(_found(spark, d, "letter"), t(spark, d, "domains")).select("doc_id", "popularity")


def _covers(where: str, first: str, second: str) -> str:
    """SQL of the cover density of two words; ``first`` and ``second`` are conditions on a word."""
    return _WORDS + rf""", h AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM w WHERE {where}),
l AS (SELECT doc_id, i, max(CASE WHEN {first} THEN i END) OVER o AS a, max(CASE WHEN {second} THEN i END) OVER o AS b FROM h WHERE {first} OR {second} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, least(a, b) AS s, lag(least(a, b)) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT doc_id, sum(2.0::DOUBLE / (i - s + 1)) AS density FROM c WHERE p IS NULL OR s > p GROUP BY doc_id),
z AS (SELECT doc_id, max(n) AS n, count(*) FILTER (WHERE word = 'kettle') AS kettles FROM h GROUP BY doc_id) """


_BOTH = "list_contains(words, 'village') AND list_contains(words, 'letter')"


@query(_covers(_BOTH, "word = 'village'", "word = 'letter'") + "SELECT doc_id, round(density / n, 9) AS ranking FROM g JOIN z USING (doc_id)")
def cover_density(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(_found(spark, d, "village letter"), "village letter").select("doc_id", F.round("ranking", 9).alias("ranking"))


@query(_covers(f"list_contains(words, 'kettle') OR {_BOTH}", "word = 'village'", "word = 'letter'") + "SELECT doc_id, round((coalesce(density, 0) + kettles) / n, 9) AS ranking FROM z LEFT JOIN g USING (doc_id)")
def search_or_ranked(spark: SparkSession, d: str) -> DataFrame:
    text = "kettle OR (village letter)"
    return search.ranked(_found(spark, d, text), text).select("doc_id", F.round("ranking", 9).alias("ranking"))


_PLURAL = "CASE WHEN regexp_matches({0}, '(sses|ies)$') THEN {0}[:-3] WHEN regexp_matches({0}, '[^su]s$') THEN {0}[:-2] ELSE {0} END"
_VERB = (
    "CASE WHEN NOT regexp_matches({0}, '(ed|ing)$') OR length(regexp_replace({0}, '(ed|ing)$', '')) <= 2 OR NOT regexp_matches(regexp_replace({0}, '(ed|ing)$', ''), '[aeiouy]') OR regexp_matches({0}, '(eed|eing)$') THEN {0} "
    "WHEN regexp_matches({0}, '(at|bl|iz)(ed|ing)$') THEN regexp_replace({0}, '(ed|ing)$', 'e') "
    "WHEN right(regexp_replace({0}, '(ed|ing)$', ''), 1) = left(right(regexp_replace({0}, '(ed|ing)$', ''), 2), 1) AND NOT regexp_matches({0}, '[aeiouylsz](ed|ing)$') THEN regexp_replace({0}, '.(ed|ing)$', '') ELSE regexp_replace({0}, '(ed|ing)$', '') END"
)
_NOUN = "CASE WHEN length({0}) > 3 AND regexp_matches({0}, '[aeiouy].*y$') THEN {0}[:-2] || 'i' ELSE {0} END"
_ENDED = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '^.{{{{3,}}}}{a}$') THEN regexp_replace({{0}}, '{a}$', '{b}')" for a, b in _ENDINGS) + " ELSE {0} END"


def _stem_sql(words: str) -> str:
    """SQL of word, stem of a query with a column ``word``."""
    steps = f"(SELECT word, word AS s FROM ({words}) WHERE length(word) > 3)"
    for step in (_PLURAL, _VERB, _NOUN, _ENDED):
        steps = f"(SELECT word, {step.format('s')} AS s FROM {steps})"
    return f"SELECT word, s AS stem FROM {steps} UNION ALL SELECT word, word FROM ({words}) WHERE length(word) <= 3"


_TITLE_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(seg), '[\p{L}\p{N}]+')) AS word FROM title_segs"


@query(_WORDS + f", v AS ({_stem_sql('SELECT DISTINCT unnest(words) AS word FROM w')}), x AS (SELECT DISTINCT doc_id, stem FROM (SELECT doc_id, unnest(words) AS word FROM w) JOIN v USING (word)) SELECT doc_id FROM x WHERE stem = 'villag' OR stem = 'village' OR stem = 'letter' GROUP BY doc_id HAVING count(DISTINCT stem) > 1")
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Villages, letters and their like."""
    return search.matching(t(spark, d, "documents"), "villages letters", stemmed=True).select("doc_id")


@query()
def headline(spark: SparkSession, d: str) -> DataFrame:
    """Snippets are made for one page of results: the limit is the feature."""
    best = search.page(search.ranked(_found(spark, d, "village letter"), "village letter"))
    return search.with_snippets(best, "village letter").select("doc_id", "ranking", "snippet")


@query(r"""SELECT doc_id, CASE WHEN doc_text IS NOT NULL THEN len(list_filter(regexp_split_to_array(doc_text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) END AS words FROM documents""")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", word_count(F.col("doc_text")).cast("long").alias("words"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(rf"""WITH a AS (SELECT regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+') AS t, regexp_extract_all(lower(coalesce(doc_text, '')), '[\p{{L}}\p{{N}}]+') AS b FROM documents),
e AS (SELECT unnest(t) AS word, unnest(range(len(t))) AS position, 'A' AS label FROM a UNION ALL SELECT unnest(b), len(t) + unnest(range(len(b))), 'C' FROM a)
SELECT word, label, count(*) AS n, CAST(min(position) AS INTEGER) AS first_position, CAST(sum(position) AS BIGINT) AS positions FROM e WHERE word NOT IN ({_STOPS}) GROUP BY word, label""")
def weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    """The weighted vectors of all documents (title A, text C), summed up by word and label."""
    entries = t(spark, d, "documents").select(F.explode(weighted_vector([("A", F.col("title")), ("C", F.col("doc_text"))])).alias("e"))
    return entries.groupBy(F.col("e.word").alias("word"), F.col("e.label").alias("label")).agg(
        F.count("*").alias("n"), F.min("e.position").alias("first_position"), F.sum("e.position").alias("positions")
    )


@query(_stem_sql(_TITLE_WORDS))
def stems(spark: SparkSession, d: str) -> DataFrame:
    """The stem of every distinct word of the titles."""
    return stem_table(segment_words(spark, d))


def segment_words(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "title_segs").select(F.explode(F.split(F.lower("seg"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")


# --- home, flags ------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM documents WHERE flags = 0) AS indexed, (SELECT count(*) FROM documents WHERE flags <> 0) AS polluted, (SELECT count(*) FROM discovery) AS discovered")
def home_counts(spark: SparkSession, d: str) -> DataFrame:
    return frontier.home_counts(t(spark, d, "documents"), t(spark, d, "discovery"))


@query(f"SELECT {_SITE} AS site, bit_or(flags) AS flags, bit_or(features) AS features, count(*) AS documents FROM documents GROUP BY 1")
def flag_fold(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(site(F.col("domain")).alias("site"), "flags", "features")
    return docs.groupBy("site").agg(F.bit_or("flags").alias("flags"), F.bit_or("features").alias("features"), F.count("*").alias("documents"))


def _bits_sql(column: str, kind: type) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {column} & {int(f)} <> 0 THEN '{f.name.lower()}' END" for f in kind) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_bits_sql('flags', bitmask.DocumentFlag)} AS flag_names, {_bits_sql('features', bitmask.DocumentFeature)} AS feature_names FROM documents")
def flag_decode(spark: SparkSession, d: str) -> DataFrame:
    names = [F.array_join(bitmask.names(F.col(c), k), ",").alias(n) for c, k, n in (("flags", bitmask.DocumentFlag, "flag_names"), ("features", bitmask.DocumentFeature, "feature_names"))]
    return t(spark, d, "documents").select("doc_id", *names)


# --- titles -------------------------------------------------------------------

_SEGS = rf"list_filter(list_transform(flatten(list_transform(flatten(list_transform(regexp_split_to_array(title, '[{TITLE_SEPARATORS}]'), lambda s: string_split(s, ' - '))), lambda s: string_split(s, '. '))), lambda s: regexp_replace(s, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SEGS} AS segs FROM documents WHERE title IS NOT NULL) SELECT doc_id, CAST(unnest(range(len(segs))) AS INTEGER) AS position, unnest(segs) AS seg FROM s")
def title_segments(spark: SparkSession, d: str) -> DataFrame:
    return titles.segments_of(t(spark, d, "documents").where("title is not null"))


@query("SELECT seg, count(DISTINCT doc) AS n FROM title_edges WHERE doc IS NOT NULL AND seg IS NOT NULL GROUP BY seg")
def title_counts(spark: SparkSession, d: str) -> DataFrame:
    return titles.segment_counts(t(spark, d, "title_edges"))


@query("SELECT doc, count(*) AS segments FROM title_edges WHERE doc IS NOT NULL GROUP BY doc")
def title_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return titles.pages_per_segment_count(t(spark, d, "title_edges"))


_BEST = """WITH e AS (SELECT DISTINCT doc, seg FROM title_edges WHERE doc IS NOT NULL AND seg IS NOT NULL), c AS (SELECT seg, count(*) AS n FROM e GROUP BY seg),
s AS (SELECT id, min(seg) AS text FROM title_segs GROUP BY id),
r AS (SELECT e.doc, s.text AS best_title, c.n, row_number() OVER (PARTITION BY e.doc ORDER BY c.n, e.seg) AS place FROM e JOIN c USING (seg) JOIN s ON s.id = e.seg) """


@query(_BEST + "SELECT doc, best_title, n FROM r WHERE place = 1")
def best_title(spark: SparkSession, d: str) -> DataFrame:
    return titles.best_titles(t(spark, d, "title_edges"), t(spark, d, "title_segs"))


@query(_BEST + "SELECT doc_id, CASE WHEN trim(title) <> '' THEN coalesce(best_title, title) ELSE title END AS title FROM documents LEFT JOIN (SELECT * FROM r WHERE place = 1) ON doc = doc_id")
def retitled(spark: SparkSession, d: str) -> DataFrame:
    return titles.with_best_titles(t(spark, d, "documents"), t(spark, d, "title_edges"), t(spark, d, "title_segs")).select("doc_id", "title")


@query("SELECT doc_id, CASE WHEN length(title) > 37 THEN title[1:37] || '...' ELSE title END AS shown, CASE WHEN trim(coalesce(title, '')) = '' THEN '(no title)' ELSE title END AS listed FROM documents")
def title_shown(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", titles.shown_title(F.col("title")).alias("shown"), titles.placeholder(F.col("title")).alias("listed"))


# --- addresses ------------------------------------------------------------------

_STRIP = r"regexp_replace(uri, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_U = f"WITH u AS (SELECT id, {_STRIP} AS uri FROM discovery WHERE uri IS NOT NULL), p AS (SELECT id, uri, regexp_extract(uri, '^(?i)([a-z][a-z0-9+.\\-]*:)//([^/?#]*)([^?#]*)', 1) AS scheme, regexp_replace(regexp_replace(regexp_extract(uri, '^(?i)([a-z][a-z0-9+.\\-]*:)//([^/?#]*)([^?#]*)', 2), '^.*@', ''), ':[0-9]*$', '') AS host, regexp_extract(uri, '^(?i)([a-z][a-z0-9+.\\-]*:)//([^/?#]*)([^?#]*)', 2) AS authority, lower(regexp_extract(uri, '^(?i)([a-z][a-z0-9+.\\-]*:)//([^/?#]*)([^?#]*)', 3)) AS path FROM u) "


def _alternatives(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words) + ")"


def _on(domain: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}'))"


_YEAR = r"regexp_matches(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g'), '(?:^|/)[12][0-9]{3}(?:/[0-9]{2})?$')"
_ACCEPTABLE = " AND ".join(
    [
        "scheme IN ('http:', 'https:')", f"NOT regexp_matches(path, '{_alternatives(FILE_SUFFIXES)}$')", f"NOT regexp_matches(host, '(?:^|\\.){_alternatives(FORBIDDEN_SITES)}$')",
        *[f"(NOT {_on(s)} OR {_on('en.' + s)})" for s in ENGLISH_ONLY_SITES], f"NOT regexp_matches(path, '{_alternatives(FORBIDDEN_PATHS)}')",
        *[f"NOT ({_on(s)} AND regexp_matches(path, '{_alternatives(ps)}'))" for s, ps in FORBIDDEN_ON_SITE.items()], f"NOT {_YEAR}",
    ]
)


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "discovery").where("uri is not null").select("id", strip_space(F.col("uri")).alias("uri"))


@query(_U + f"SELECT id, ({_ACCEPTABLE}) AS acceptable FROM p")
def uri_acceptable(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", links.acceptable_link(F.col("uri")).alias("acceptable"))


@query(_U + f"SELECT id, {_YEAR} AS archive_page FROM p")
def uri_year_month(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", links.year_month_page(F.lower(links.path(F.col("uri")))).alias("archive_page"))


@query(_U + r", b AS (SELECT id, regexp_replace(regexp_replace(uri, '[?#][\s\S]*$', ''), '/+$', '') AS bare FROM p) SELECT id, CASE WHEN regexp_matches(bare, '^[^/]*//[^/]') THEN replace(replace(regexp_extract(bare, '^([^/]*//[^/]*)([\s\S]*)$', 1), 'm.wikipedia.org', 'wikipedia.org'), 'new.reddit.com', 'old.reddit.com') || regexp_extract(bare, '^([^/]*//[^/]*)([\s\S]*)$', 2) ELSE bare END AS normalized FROM b")
def uri_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", links.normalized_uri(F.col("uri")).alias("normalized"))


@query(_U + "SELECT id, CASE WHEN authority <> '' THEN 'https://' || authority END AS domain_key, CASE WHEN authority <> '' THEN scheme || '//' || authority || '/favicon.ico' END AS favicon FROM p")
def domain_key(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("id", links.domain_key(F.col("uri")).alias("domain_key"), links.favicon(F.col("uri")).alias("favicon"))


@query(f"SELECT doc_id, {_SITE} AS site FROM documents")
def document_sites(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", site(F.col("domain")).alias("site"))


_QUICK = f"NOT regexp_matches(uri, '{_alternatives(FORBIDDEN_PATHS + [s + '/' for s in FORBIDDEN_SITES])}')"


@query(f"SELECT doc_id, flags | CASE WHEN {_QUICK} THEN 0 ELSE 2 END AS flags FROM documents")
def purge_flags(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.purged_documents(t(spark, d, "documents"))


@query(f"SELECT id, dead OR NOT coalesce({_QUICK}, false) AS dead FROM discovery")
def purge_discovery(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.purged_discovery(t(spark, d, "discovery"))


# --- frontier, maintenance -------------------------------------------------------


@query("SELECT id, uri, depth FROM discovery WHERE canonical IS NULL AND NOT dead ORDER BY depth, md5(id || ':7'), id LIMIT 50")
def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    """The next 50 addresses to visit: the limit is the feature."""
    return frontier.next_to_explore(t(spark, d, "discovery"), 50, seed=7)


@query("SELECT id, depth FROM discovery WHERE canonical IS NULL AND NOT dead")
def frontier_open(spark: SparkSession, d: str) -> DataFrame:
    return frontier.open_frontier(t(spark, d, "discovery")).select("id", "depth")


@query("SELECT id, domain FROM domains WHERE rank IS NULL")
def unranked_domains(spark: SparkSession, d: str) -> DataFrame:
    return frontier.unranked_domains(t(spark, d, "domains")).select("id", "domain")


@query("SELECT id FROM domains WHERE rules IS NULL OR coalesce(len(rules.allow), 0) + coalesce(len(rules.disallow), 0) = 0")
def missing_rules(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.missing_rules(t(spark, d, "domains")).select("id")


_HOST = r"regexp_extract(regexp_replace(uri, '^[\s\x0b]+', ''), '^(?i)[a-z][a-z0-9+.\-]*:/+([^/?#]*)', 1)"
_PREFIX = "len(list_filter(coalesce({0}, []), lambda r: r <> '' AND starts_with(path, r))) > 0"


@query(
    f"""WITH r AS (SELECT {_SITE} AS site, arg_min(rules, id) AS rules FROM domains WHERE rules IS NOT NULL GROUP BY 1),
x AS (SELECT doc_id, {_SITE} AS site, regexp_extract(uri, '^(?i)([a-z][a-z0-9+.\\-]*:)//([^/?#]*)([^?#]*)', 3) AS path FROM documents)
SELECT doc_id, CASE WHEN rules IS NULL THEN true ELSE {_PREFIX.format('rules.allow')} OR NOT ({_PREFIX.format('rules.disallow')}) END AS allowed FROM x LEFT JOIN r USING (site)"""
)
def robots_check(spark: SparkSession, d: str) -> DataFrame:
    rules = t(spark, d, "domains").where("rules is not null").select(site(F.col("domain")).alias("site"), "id", "rules").groupBy("site").agg(F.min_by("rules", "id").alias("rules"))
    docs = t(spark, d, "documents")
    return maintenance.robots_flags(docs, rules.withColumn("domain", F.col("site")), site(F.col("domain")), F.col("site"), links.path(F.col("uri")))


@query("SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL")
def dedup_edges(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.distinct_edges(t(spark, d, "edges"))


@query("SELECT src, dst, count(*) AS copies FROM edges GROUP BY src, dst HAVING count(*) > 1")
def repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.repeated_edges(t(spark, d, "edges"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1000 ELSE s_nationkey END AS rank, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 1000, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Update rank only, keep name, insert what is new."""
    old = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("rank"), F.col("s_name").alias("name"))
    some = old.where("id % 3 = 0").withColumn("rank", F.col("rank") + 1000)
    return maintenance.upsert(old, some.withColumn("name", F.lit("ignored")).unionByName(some.withColumn("id", F.col("id") + 1000000)), ["id"], ["rank"])


@query("SELECT count(*) AS wanted, count(DISTINCT new_id) AS ids, max(new_id) AS top FROM (SELECT s.id AS new_id FROM (SELECT seg, min(id) AS id FROM title_segs GROUP BY seg) s UNION ALL SELECT (SELECT max(id) FROM title_segs) + row_number() OVER (ORDER BY p_name) FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT seg FROM title_segs)))")
def get_or_insert(spark: SparkSession, d: str) -> DataFrame:
    segs = t(spark, d, "title_segs")
    wanted = segs.select("seg").unionByName(t(spark, d, "part").select(F.col("p_name").alias("seg")))
    out = maintenance.get_or_insert(segs, wanted, "id", "seg")
    return out.agg(F.count("*").alias("wanted"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"))


@query("SELECT id, uri FROM discovery WHERE uri IS NOT NULL AND id % 2 = 0 UNION ALL SELECT min(id), uri FROM discovery WHERE uri IS NOT NULL AND id % 2 = 1 AND uri NOT IN (SELECT uri FROM discovery WHERE uri IS NOT NULL AND id % 2 = 0) GROUP BY uri")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    """The table's even half, into which its odd half is inserted where the address is new."""
    rows = t(spark, d, "discovery").where("uri is not null").select("id", "uri")
    odd = rows.where("id % 2 = 1").groupBy("uri").agg(F.min("id").alias("id")).select("id", "uri")
    return maintenance.insert_missing(rows.where("id % 2 = 0"), odd, ["uri"])


@query("SELECT min(depth) AS depth, uri FROM discovery WHERE uri IS NOT NULL AND id % 2 = 1 AND uri NOT IN (SELECT uri FROM discovery WHERE uri IS NOT NULL AND id % 2 = 0) GROUP BY uri")
def insert_discoveries(spark: SparkSession, d: str) -> DataFrame:
    """Of the odd half's addresses as links, those the even half doesn't know."""
    rows = t(spark, d, "discovery")
    return maintenance.new_discoveries(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").select("uri", "depth", "distance")).select("depth", "uri")


@query("SELECT id, dead OR id % 10 = 5 AS dead, CASE WHEN id % 10 = 0 THEN id ELSE canonical END AS canonical FROM discovery")
def mark_discovered(spark: SparkSession, d: str) -> DataFrame:
    """After a crawl step that resolved every tenth address and found every other fifth one dead."""
    rows = t(spark, d, "discovery")
    resolved = rows.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("canonical"))
    return maintenance.mark_discovered(rows, resolved).select("id", "dead", "canonical")


_LISTED = f"l AS (SELECT {_SITE} AS site, CAST(min(doc_id) AS INTEGER) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1 HAVING site IS NOT NULL)"


@query(f"WITH {_LISTED}, k AS (SELECT {_SITE} AS site, domain, rank FROM domains) SELECT domain, coalesce(n, rank) AS rank FROM k LEFT JOIN l USING (site) UNION ALL SELECT site, n FROM l WHERE site NOT IN (SELECT site FROM k WHERE site IS NOT NULL)")
def imported_ranks(spark: SparkSession, d: str) -> DataFrame:
    """domains after a popularity list, here the sites of every third document by their first one."""
    listed = t(spark, d, "documents").where("doc_id % 3 = 0").select("domain", F.col("doc_id").cast("int").alias("rank"))
    return maintenance.imported_ranks(t(spark, d, "domains"), listed).select("domain", "rank")


@query(f"WITH {_LISTED}, k AS (SELECT id, {_SITE} AS site, rank FROM domains) SELECT id, coalesce(rank, n) AS rank FROM k LEFT JOIN l USING (site)")
def backfilled_ranks(spark: SparkSession, d: str) -> DataFrame:
    answers = t(spark, d, "documents").where("doc_id % 3 = 0").select("domain", F.col("doc_id").cast("int").alias("rank"))
    return maintenance.backfilled_ranks(t(spark, d, "domains"), answers).select("id", "rank")


@query("SELECT id, CASE WHEN rules IS NULL OR coalesce(len(rules.allow), 0) + coalesce(len(rules.disallow), 0) = 0 THEN '/open|/' || lower(domain) ELSE array_to_string(coalesce(rules.allow, []), ',') || '|' || array_to_string(coalesce(rules.disallow, []), ',') END AS rules FROM domains".replace("'/open|/' || lower(domain)", f"coalesce('/open|/' || {_SITE}, '|')"))
def backfilled_rules(spark: SparkSession, d: str) -> DataFrame:
    """domains whose missing rules come from robots files, here one for each site."""
    files = t(spark, d, "domains").select("domain", F.concat(F.lit("User-agent: *\nAllow: /open\nDisallow: /"), site(F.col("domain"))).alias("robots_txt")).where("robots_txt is not null")
    out = maintenance.backfilled_rules(t(spark, d, "domains"), parsed_robots(files, "webloom"))
    joined = [F.array_join(F.coalesce(F.col(f"rules.{c}"), F.array().cast("array<string>")), ",") for c in ("allow", "disallow")]
    return out.select("id", F.concat(joined[0], F.lit("|"), joined[1]).alias("rules"))


@query(f"WITH s AS (SELECT doc_id, {_SEGS} AS segs FROM documents WHERE title IS NOT NULL), w AS (SELECT DISTINCT doc_id AS doc, unnest(segs) AS text FROM s) SELECT doc, text FROM w EXCEPT SELECT e.doc, g.seg FROM title_edges e JOIN title_segs g ON g.id = e.seg")
def insert_title_edges(spark: SparkSession, d: str) -> DataFrame:
    """The title edges that indexing all documents anew would add."""
    return titles.new_title_edges(t(spark, d, "documents"), t(spark, d, "title_segs"), t(spark, d, "title_edges"))[1].select("doc", "text")


# --- distance vectors and the graph --------------------------------------------


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


def _joined_sql(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',')"


@query(f"SELECT id, {_joined_sql('list_transform(distance, lambda x: x + 1)')} AS increased, len(list_filter(distance, lambda x: x IS NOT NULL)) AS card FROM discovery")
def dist_inc(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "discovery").select("id", _joined(arrays.increased(F.col("distance"))).alias("increased"), arrays.cardinality(F.col("distance")).cast("long").alias("card"))


_ROOTS = "[" + ", ".join(f"'{u}'" for u in ROOT_SITES) + "]"


@query(f"SELECT uri, depth, {_joined_sql('distance')} AS distance FROM discovery UNION ALL SELECT {_ROOTS}[i], 0, array_to_string(list_transform(range(1, 10), lambda k: CASE WHEN k = i THEN '0' ELSE '-' END), ',') FROM range(1, 10) r(i)")
def insert_roots(spark: SparkSession, d: str) -> DataFrame:
    return with_roots(t(spark, d, "discovery")).select("uri", "depth", _joined(F.col("distance")).alias("distance"))


_PAIRS = "WITH p AS (SELECT e.src, e.dst, a.distance AS a, b.distance AS b FROM (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) e JOIN (SELECT canonical AS src, arg_min(distance, id) AS distance FROM discovery WHERE canonical IS NOT NULL GROUP BY 1) a USING (src) JOIN (SELECT id AS dst, distance FROM discovery) b USING (dst)) "


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    disc = t(spark, d, "discovery")
    a = disc.where("canonical is not null").groupBy(F.col("canonical").alias("src")).agg(F.min_by("distance", "id").alias("a"))
    return maintenance.distinct_edges(t(spark, d, "edges")).join(a, "src").join(disc.select(F.col("id").alias("dst"), F.col("distance").alias("b")), "dst")


@query(_PAIRS + f"SELECT src, dst, {_joined_sql('list_transform(range(1, 10), lambda i: least(a[i], b[i]))')} AS least FROM p")
def dist_least(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("src", "dst", _joined(arrays.least(F.col("a"), F.col("b"))).alias("least"))


_LESS = "list_filter(list_transform(range(1, 10), lambda i: a[i] < b[i]), lambda x: x IS NOT NULL)"


@query(_PAIRS + f"SELECT src, dst, len({_LESS}) > 0 AND list_bool_and({_LESS}) AS ancestor FROM p".replace(f"list_bool_and({_LESS})", f"len(list_filter({_LESS}, lambda x: NOT x)) = 0"))
def is_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("src", "dst", arrays.is_ancestor(F.col("a"), F.col("b")).alias("ancestor"))


@query("SELECT canonical AS doc_id, min(depth) AS depth FROM discovery WHERE canonical IS NOT NULL GROUP BY 1")
def incoming_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming_depth(t(spark, d, "discovery"))


@query(f"WITH r AS (SELECT canonical AS doc_id, distance, row_number() OVER (PARTITION BY canonical ORDER BY coalesce(list_min(distance), 32767), id) AS place FROM discovery WHERE canonical IS NOT NULL) SELECT doc_id, {_joined_sql('list_transform(distance, lambda x: x + 1)')} AS distance FROM r WHERE place = 1")
def incoming_distance(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming_distance(t(spark, d, "discovery")).select("doc_id", _joined(F.col("distance")).alias("distance"))


_EDGES = "e AS (SELECT DISTINCT x.src, c.canonical AS dst FROM edges x JOIN discovery c ON c.id = x.dst WHERE x.src IS NOT NULL AND c.canonical IS NOT NULL), "
_START = "i AS (SELECT canonical AS node, distance, row_number() OVER (PARTITION BY canonical ORDER BY coalesce(list_min(distance), 32767), id) AS place FROM discovery WHERE canonical IS NOT NULL), "
_STARTS = "s AS (SELECT node, CAST(slot AS INTEGER) AS slot, hops + 1 AS hops FROM (SELECT node, unnest(range(9)) AS slot, unnest(distance) AS hops FROM i WHERE place = 1) WHERE hops IS NOT NULL), "
_FIX = f"WITH RECURSIVE {_EDGES}{_START}{_STARTS}f AS (SELECT node, slot, hops FROM s UNION SELECT e.dst, f.slot, f.hops + 1 FROM f JOIN e ON e.src = f.node WHERE f.hops < 40), m AS (SELECT node, slot, min(hops) AS hops FROM f GROUP BY node, slot), v AS (SELECT node, count(*) AS card FROM m GROUP BY node) "


def _page_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_edges(t(spark, d, "edges"), t(spark, d, "discovery"))


def _start(spark: SparkSession, d: str) -> DataFrame:
    return graph.vector_rows(graph.incoming_distance(t(spark, d, "discovery")), "doc_id")


def _fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return graph.relax_distances(_start(spark, d), _page_edges(spark, d), 9)


@query(_FIX + "SELECT node, slot, CAST(hops AS INTEGER) AS hops FROM m")
def distance_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return _fixpoint(spark, d).select("node", "slot", F.col("hops").cast("int").alias("hops"))


@query(_FIX + "SELECT e.src, e.dst, a.card AS src_card, b.card AS dst_card FROM e JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst WHERE a.card < b.card")
def join_pages(spark: SparkSession, d: str) -> DataFrame:
    vectors = graph.as_vectors(_fixpoint(spark, d), 9)
    return graph.join_pages(_page_edges(spark, d), vectors).withColumns({c: F.col(c).cast("long") for c in ("src_card", "dst_card")})


@query(f"WITH {_EDGES}{_START}v AS (SELECT node, len(list_filter(distance, lambda x: x IS NOT NULL)) AS card FROM i WHERE place = 1) SELECT e.src, e.dst, a.card AS src_card, b.card AS dst_card FROM e JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst WHERE a.card > b.card")
def improvable_edges(spark: SparkSession, d: str) -> DataFrame:
    vectors = graph.incoming_distance(t(spark, d, "discovery")).withColumnRenamed("doc_id", "node")
    return graph.improvable_edges(_page_edges(spark, d), vectors).withColumns({c: F.col(c).cast("long") for c in ("src_card", "dst_card")})


_NEIGHBOURS = f"WITH RECURSIVE {_EDGES}{_START}v AS (SELECT node, distance AS dist FROM i WHERE place = 1), l AS (SELECT e.dst, e.src, list_filter(list_transform(range(1, 10), lambda k: a.dist[k] < b.dist[k]), lambda x: x IS NOT NULL) AS less FROM e JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst), n AS (SELECT dst, src FROM l WHERE len(less) > 0 AND len(list_filter(less, lambda x: NOT x)) = 0) "


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = graph.incoming_distance(t(spark, d, "discovery")).withColumnRenamed("doc_id", "node")
    return graph.reverse_neighbours(_page_edges(spark, d), vectors)


@query(_NEIGHBOURS + "SELECT dst, src FROM n")
def reverse_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


@query(_NEIGHBOURS + ", c AS (SELECT max(dst) AS node FROM n UNION SELECT n.src FROM c JOIN n ON n.dst = c.node) SELECT node FROM c")
def reverse_closure(spark: SparkSession, d: str) -> DataFrame:
    neighbours = _neighbours(spark, d)
    return graph.reverse_closure(neighbours, neighbours.agg(F.max("dst").alias("node"))).select("node")


@query(_NEIGHBOURS + ", c AS (SELECT max(dst) AS node, 0 AS level FROM n UNION SELECT n.src, c.level + 1 FROM c JOIN n ON n.dst = c.node WHERE c.level < 40), b AS (SELECT node, CAST(min(level) AS INTEGER) AS level FROM c GROUP BY node) SELECT b.node, b.level, min(p.node) AS parent FROM b LEFT JOIN (SELECT n.src, q.node, q.level FROM n JOIN b q ON q.node = n.dst) p ON p.src = b.node AND p.level = b.level - 1 GROUP BY b.node, b.level")
def bfs_forest(spark: SparkSession, d: str) -> DataFrame:
    neighbours = _neighbours(spark, d)
    return graph.reverse_closure(neighbours, neighbours.agg(F.max("dst").alias("node")))


# --- ranking dimensions, layout ----------------------------------------------------


def _strata_sql(value: str, thresholds: tuple[int, ...]) -> str:
    low, parts = 0, []
    for i, high in enumerate(thresholds):
        parts.append(f"WHEN {value} < {high} THEN ({i} + (CAST({value} AS DOUBLE) - {low}) / {high - low}) / {len(thresholds)}")
        low = high
    return "round(CASE " + " ".join(parts) + " END, 9)"


@query(
    f"SELECT doc_id, {_strata_sql('js', scores.ASSET_THRESHOLDS)} AS rank_js, {_strata_sql('css', scores.ASSET_THRESHOLDS)} AS rank_css, "
    f"{_strata_sql('(coalesce(js, 0) + coalesce(css, 0))', scores.ASSET_THRESHOLDS)} AS rank_assets, {_strata_sql('word_count', scores.WORD_THRESHOLDS)} AS rank_words FROM documents"
)
def rank_sizes(spark: SparkSession, d: str) -> DataFrame:
    names = {"js": "rank_js", "css": "rank_css", "assets": "rank_assets", "words": "rank_words"}
    return t(spark, d, "documents").select("doc_id", *[F.round(scores.DIMENSIONS[k](), 9).alias(n) for k, n in names.items()])


@query(f"SELECT id, {_strata_sql('coalesce(rank, 90000000)', scores.POPULARITY_THRESHOLDS)} AS rank_popularity FROM domains")
def rank_popularity(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "domains").select("id", F.round(scores.stratify(F.coalesce("rank", F.lit(scores.UNKNOWN_POPULARITY)), scores.POPULARITY_THRESHOLDS), 9).alias("rank_popularity"))


@query("WITH w AS (SELECT doc_id, n_chars FROM documents WHERE flags = 0 ORDER BY n_chars, doc_id LIMIT 500) SELECT doc_id, round((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / (count(*) OVER () - 1.0), 9) AS rank FROM w")
def uniform_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of one result page of 500 rows: the limit is the feature."""
    page = search.page(t(spark, d, "documents").where("flags = 0").withColumn("ranking", F.col("n_chars")), 1, search.SPATIAL_ROWS)
    return page.select("doc_id", F.round(scores.uniform_rank(F.col("ranking"), F.col("doc_id")), 9).alias("rank"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    found = search.with_popularity(_found(spark, d, "letter"), t(spark, d, "domains")).withColumn("ranking", F.col("n_chars"))
    return layout.boxes(layout.scored(search.page(found, 1, search.SPATIAL_ROWS)))


@query(
    _WORDS
    + f""", f AS (SELECT doc_id, coalesce(title, '') AS title, n_chars, {_strata_sql('word_count', scores.WORD_THRESHOLDS)[6:-4]} AS x, {_strata_sql('(coalesce(js, 0) + coalesce(css, 0))', scores.ASSET_THRESHOLDS)[6:-4]} AS y FROM w WHERE list_contains(words, 'letter') ORDER BY n_chars, doc_id LIMIT 500),
g AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS DOUBLE) / greatest(count(*) OVER () - 1, 1) END AS z FROM f),
h AS (SELECT doc_id, CASE WHEN length(title) > 37 THEN title[1:37] || '...' ELSE title END AS title, x, y, z FROM g WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, 10 + coalesce((z - min(z) OVER ()) / nullif(max(z) OVER () - min(z) OVER (), 0), 0) * 6 AS pt, coalesce((y - min(y) OVER ()) / nullif(max(y) OVER () - min(y) OVER (), 0), 0) AS yy FROM h),
b AS (SELECT *, CAST(round_even(pt / 10 * 8 * length(title) + pt / 10 * 18, 0) AS INTEGER) AS box_w, CAST(round_even(pt / 10 * 18, 0) AS INTEGER) AS box_h, CAST(round_even(x * 1920, 0) AS INTEGER) AS l, CAST(round_even(yy * 1080, 0) AS INTEGER) AS top FROM k)
SELECT doc_id, title, round(pt, 6) AS pt, CASE WHEN l + box_w >= 1920 THEN 1920 - box_w ELSE l END AS "left", top, box_w, box_h FROM b"""
)
def layout_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("doc_id", "title", F.round("pt", 6).alias("pt"), "left", "top", "box_w", "box_h")


@query()
def layout_place(spark: SparkSession, d: str) -> DataFrame:
    return layout.placed(_boxes(spark, d))


_BOXES = "b AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 40000 AS INTEGER) AS x, p_size * 400 AS y, CAST(10 + p_partkey % 50 AS INTEGER) AS w, 18 AS h FROM part)"


@query(f"WITH {_BOXES} SELECT a.id AS a_id, c.id AS b_id FROM b a JOIN b c ON a.id < c.id AND a.x < c.x + c.w AND c.x < a.x + a.w AND a.y < c.y + c.h AND c.y < a.y + a.h")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    boxes = t(spark, d, "part").selectExpr("p_partkey as id", "cast(p_partkey * 7919 % 40000 as int) as x", "p_size * 400 as y", "cast(10 + p_partkey % 50 as int) as w", "18 as h")
    return layout.overlaps(boxes, boxes).where("a_id < b_id")


# --- pages ----------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages: title, a heading, a paragraph for each line, a script, a link home."""
    clean = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<p>"), F.replace(clean(F.col("doc_text")), F.lit("\n"), F.lit("<p>")))
    html = F.concat(
        F.lit("<html><head><title>"), clean(F.col("title")), F.lit("</title><script>var a = 1;</script></head><body><nav><ul><li>menu</ul></nav><h1>"), clean(F.col("title")),
        F.lit("</h1><article>"), body, F.lit('</article><nav><a href="/home">home</a><a href="/tag/x">tag</a></nav></body></html>'),
    )
    return t(spark, d, "documents").select("doc_id", strip_space(F.col("uri")).alias("uri"), html.alias("html"))


_TIGHT = r"regexp_replace(coalesce({0}, ''), '[\s\x{{85}}\x{{a0}}\x1c-\x1f\x0b]+', '', 'g')"


@query(f"SELECT doc_id, length({_TIGHT.format('title')}) AS title_chars, length({_TIGHT.format('title')}) AS heading_chars, length({_TIGHT.format('doc_text')}) AS content_chars, 10 AS script_chars FROM documents")
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("key", F.col("doc_id").cast("string"))
    out = signals.signals(pages, uri="key")
    tight = lambda c: F.length(F.regexp_replace(c, r"[\s\x{85}\x{a0}\x1c-\x1f\x0b]+", "")).cast("long")
    return out.select(
        F.col("uri").cast("long").alias("doc_id"), tight("title").alias("title_chars"), tight("headings").alias("heading_chars"), tight("content").alias("content_chars"), F.col("script_chars")
    )


def _selected(css: str, inner: str) -> str:
    """A page's element that a selector finds, as an SQL string expression."""
    name, sign, value = css.partition("#" if "#" in css else ".")
    attribute = "" if not sign else f' id="{value}"' if sign == "#" else f' class="x {value} y"'
    return f"'<{name}{attribute}>' || {inner} || '</{name}>'"


def _case(number: str, arms: list[str], otherwise: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(arms)) + f" ELSE {otherwise} END"


_N = "CAST(doc_id AS STRING)"
_SELECTED = _case(f"doc_id % {len(CONTENT)}", [_selected(c, f"'<p>body ' || {_N} || '<nav>menu</nav>'") for c in CONTENT[:-1]], f"'<p>body ' || {_N}")
_SAID = _case(f"doc_id % {len(COMMENTS)}", [_selected(c, f"'<p>said ' || {_N} || '<p>'") for c in COMMENTS], "''")
_TYPED = _case("doc_id % 13", [f"""'<script type="application/ld+json">{{"@type": "{k}"}}</script>'""" for k in TYPE_FLAGS], "''")
_AD = _case("doc_id % 17", [f"""'<script src="https://a.example/{AD_SIGNS[0]}.js"></script>'"""] + [f"'<script>x = \"{a}\";</script>'" for a in AD_SIGNS[1:]], "''")
#: A page for each document whose every part follows from its number: selectors, declared type, ads, paywall, numbered headings, features, embeds. Without comments and embeds where the whole body is the content.
_KINDS = f"""concat('<!DOCTYPE html><html><head><title>t ', {_N}, '</title>', {_TYPED}, {_AD},
CASE WHEN doc_id % 3 = 0 THEN '<script type="application/ld+json">{{"hasPart": {{"isAccessibleForFree": false}}}}</script>' ELSE '' END,
CASE WHEN doc_id % 5 < 3 THEN concat('<link rel="canonical" href="https://c.example/', {_N}, '">') ELSE '<link rel="canonical" href="/none">' END,
CASE WHEN doc_id % 6 = 2 THEN '<meta name="generator" content="Discourse 2">' ELSE '' END, '<link rel="stylesheet" href="../s.css"></head><body>', {_SELECTED},
CASE WHEN doc_id % {len(CONTENT)} = {len(CONTENT) - 1} THEN '' ELSE concat({_SAID}, CASE WHEN doc_id % 7 = 0 THEN '<h3>1. a</h3><h3>2. b</h3><h3>3. c</h3><h3>4: d</h3>' ELSE '<h3>1. a</h3><h3>2. b</h3>' END,
CASE WHEN doc_id % 2 = 0 THEN '<code>x</code>' ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN '<span class="MathJax">y</span>' ELSE '' END,
repeat('<blockquote class="twitter-tweet">z</blockquote>', CAST(doc_id % 3 AS INT)), repeat('<img src="/i.gif">', CAST(doc_id % 4 AS INT))) END, '</body></html>')"""
_WHOLE_BODY = f"doc_id % {len(CONTENT)} = {len(CONTENT) - 1}"


def _or(parts: list[str]) -> str:
    return " | ".join(f"({p})" for p in parts)


_KIND_FLAGS = _or(
    [
        _case("doc_id % 13", [str(int(f)) for f in TYPE_FLAGS.values()], "0"), f"CASE WHEN doc_id % 17 < {len(AD_SIGNS)} THEN {int(bitmask.DocumentFlag.ADS)} ELSE 0 END",
        f"CASE WHEN doc_id % 3 = 0 THEN {int(bitmask.DocumentFlag.PAYWALLED)} ELSE 0 END", f"CASE WHEN doc_id % 7 = 0 AND NOT {_WHOLE_BODY} THEN {int(bitmask.DocumentFlag.LISTICLE)} ELSE 0 END",
    ]
)
_KIND_FEATURES = _or([f"CASE WHEN {w} THEN {int(f)} ELSE 0 END" for w, f in ((f"doc_id % 2 = 0 AND NOT {_WHOLE_BODY}", bitmask.DocumentFeature.CODE), (f"doc_id % 4 = 1 AND NOT {_WHOLE_BODY}", bitmask.DocumentFeature.MATH), ("doc_id % 6 = 2", bitmask.DocumentFeature.FORUM))])


@query(
    f"""SELECT doc_id, 't ' || doc_id AS title, 'body ' || doc_id AS content, CASE WHEN {_WHOLE_BODY} THEN '' ELSE 'said ' || doc_id END AS comments,
CASE WHEN doc_id % 5 < 3 THEN 'https://c.example/' || doc_id END AS canonical, CAST({_KIND_FLAGS} AS BIGINT) AS flags, CAST({_KIND_FEATURES} AS BIGINT) AS features,
CAST(CASE WHEN {_WHOLE_BODY} THEN 0 ELSE doc_id % 3 END AS INTEGER) AS tweets, CAST(CASE WHEN {_WHOLE_BODY} THEN 0 ELSE doc_id % 4 END AS INTEGER) AS gifs,
CASE WHEN doc_id % 17 = 0 THEN 'https://a.example/{AD_SIGNS[0]}.js' ELSE '' END AS scripts, 'https://p.example/s.css' AS styles FROM documents"""
)
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every content and comment selector, declared type, ad sign and feature on pages made from the documents' numbers."""
    pages = t(spark, d, "documents").select(F.concat(F.lit("https://p.example/d/"), F.col("doc_id").cast("string")).alias("uri"), F.expr(_KINDS).alias("html"))
    texts = ["title", "content", "comments", "canonical", "flags", "features", "tweets", "gifs"]
    joined = [F.array_join(c, ",").alias(c) for c in ("scripts", "styles")]
    return signals.signals(pages).select(F.regexp_extract("uri", r"(\d+)$", 1).cast("long").alias("doc_id"), *texts, *joined)


_DOCUMENT_U = _U.replace("SELECT id, " + _STRIP, "SELECT doc_id AS id, " + _STRIP).replace("FROM discovery", "FROM documents")


@query(_DOCUMENT_U + f"SELECT DISTINCT uri, lower(scheme) || '//' || authority || '/home' AS target FROM p WHERE {_ACCEPTABLE}")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return signals.emitted_links(signals.document_flags(signals.signals(_pages(spark, d))))


# --- events ----------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    return events_by_window(t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(t(spark, d, "events"))


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(" + _HOST + r"), '(:[0-9]*|\.)+$', ''), '^www\.', ''), '[/?#].*$', ''), '') AS host FROM documents")
def document_hosts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", uri_host(F.col("uri")).alias("host"))
