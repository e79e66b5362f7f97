"""Problem 5: a page's own body, told from its site's furniture by a site style tree.

The pages arrive flattened, a line per block, so the tree of a site has its pages
merged below one root and their lines as leaves. A leaf's content node is the line without
markers, case, numbers and dates. As in the style tree, a node that recurs over a site's
pages has high entropy and little importance: with n of a site's m pages (copies
of a page under another address count once) its importance is
1 - log n / log m. Lines of low importance that are on a fair share of the pages are furniture.

Sites of few pages say little by themselves. All sites' trees are merged once more, and
a node is also judged by its adherence: of the pages of the sites that have it,
the share that carry it. Furniture adheres (a site that has it has it on many pages),
list entries and headings that happen to recur don't. For the same purpose a second content node
has its names masked, so that a notice is known again under another site's name.

Branches that point to other pages of the site (related, previous and next posts,
breadcrumbs) are known by holding a page's title of the same site; dated lines of
a few words (bylines, archives) are presentation nodes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import SPACE, letters_and_digits
from webloom.functions.uri import percent_decode, site, uri_host
from webloom.plans.written import written

#: Month names of the four languages, as they stand in dates.
MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
_MONTH = r"(?iu)\b(?:" + "|".join(MONTHS) + r")\b"
_DATE = (
    r"(?iu)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|(?:\d{1,2}\.?\s+)?(?:de\s+)?(?:" + "|".join(MONTHS) + r")\s+(?:de\s+)?(?:\d{1,2},?\s+)?\d{4})\b"
)
#: Three to six short terms between commas, all in lower case.
_TERMS = r"^\p{Ll}[\p{Ll}\-']*(?: [\p{Ll}\-']+){0,2}(?:, \p{Ll}[\p{Ll}\-']*(?: [\p{Ll}\-']+){0,2}){2,5}$"
#: Longer lines keep their numbers in the content node; a notice of that length is repeated as it is.
LONG = 400
#: A tag list, a line with names to mask, a dated line, and a pointer to another page are no longer than this: nodes of a phrase, not of a paragraph.
TAGS, NAMES, DATED, POINTER = 200, 160, 140, 200
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_BLANKS = "[" + "".join(BLANKS[1:]) + "]"
#: Parts of a hot node, (site, node) pair or site that are joined apart.
SALTS = 16

#: Pages a site has at least for its share of pages to say something about a node.
TELLING_PAGES = 4
IMPORTANCE = 0.62
MIN_SHARE = 0.05
VETO_ADHERENCE = 0.05
ADHERENCE = 0.1


def bare_line(line: Column) -> Column:
    """A line without surrounding blanks, list and quotation markers, and trailing dots of ellipsis."""
    bare = F.rtrim(F.ltrim(line, F.lit(BLANKS + ">*•+»-")), F.lit(BLANKS))
    return F.when(bare.endswith("...") | bare.endswith("…"), F.regexp_replace(bare, rf"[{SPACE}]*(?:\.\.\.|…)$", "")).otherwise(bare)


def _plain(text: Column) -> Column:
    """Lower case without blanks, so that spacing makes no difference."""
    low = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    return F.rtrim(F.when(low.rlike(_ODD_BLANKS), F.regexp_replace(low, _ODD_BLANKS + "+", "")).otherwise(low), F.lit(".!"))


def _masked_numbers(text: Column) -> Column:
    return F.when(text.rlike(r"\d"), F.regexp_replace(F.regexp_replace(text, _MONTH, "#"), r"\d+", "#")).otherwise(text)


def content_key(bare: Column) -> Column:
    """The content node: lower case, numbers and month names masked, tag lists reduced to their label."""
    length = F.length(bare)
    # a tag list has no sentence and several of its separators
    tags = bare.rlike(r"^(?:[\p{L} ]{1,20}: *)?[\p{L}\-' ]{1,30}(?:(?: #| / | · )[\p{L}\-' ]{1,30})+$") | bare.rlike(r"^[\p{L}]+(?: [\p{L}]+)?: *[\p{L}\-' ]{1,30}(?:(?:, | / )[\p{L}\-' ]{1,30})+$") | bare.rlike(_TERMS)
    label = F.concat(F.lit("#tags "), F.lower(F.regexp_extract(bare, r"^([\p{L} ]{1,20}:)", 1)))
    listed = (length <= TAGS) & bare.rlike(r" #| / | · |^[\p{L} ]{1,20}:.*,|, .*, ")
    # a pointer between guillemets is its label
    pointer = (bare.startswith("«") | bare.endswith("»")) & bare.rlike(r"^«? *\p{L}{2,14} ?: ")
    pointed = F.concat(F.lit("#to "), F.lower(F.regexp_extract(bare, r"^«? *(\p{L}{2,14}) ?: ", 1)))
    return F.when(pointer, pointed).when(listed & tags, label).when(length <= LONG, _plain(_masked_numbers(bare))).otherwise(_plain(bare))


def has_names(bare: Column) -> Column:
    """Whether masking names can tell anything: not shouted, not long, a capital after the first word."""
    return (F.length(bare) <= NAMES) & bare.rlike(r"^.* \p{Lu}") & bare.rlike(r"\p{Ll}")


def masked_key(bare: Column) -> Column:
    """The content node with its names masked: capitalised words after the first, and a leading run of several."""
    text = F.regexp_replace(bare, r"^(?:\p{Lu}[\p{L}']* +)+\p{Lu}[\p{L}']*|(?<= )\p{Lu}[\p{L}']*(?: +\p{Lu}[\p{L}']*)*", "_")
    return _plain(F.regexp_replace(text, r"\d+", "#"))


def is_dated(bare: Column) -> Column:
    """A date with eight other words at most, and no sentence."""
    other = F.regexp_replace(bare, _DATE, "")
    few = F.regexp_count(other, F.lit("[^ ]+")) <= 8
    return F.when((F.length(bare) <= DATED) & bare.rlike(r"\d{4}"), (other != bare) & few & ~other.endswith(".")).otherwise(False)


def _targets(bare: Column) -> Column:
    """Hashes of what a line may point to besides itself: the text after a label, and the last crumb.

    The higher-order functions keep the projection out of whole-stage code generation, whose one method would be too long to be compiled.
    """
    short = (F.length(bare) <= POINTER) & bare.rlike(r"[:«»>/›]")
    after = F.regexp_replace(bare, r"^[« ]*[^:]{1,20}:\s*|^[« ]+|\s*»\s*$| \| .*$", "")
    crumb = F.regexp_extract(bare, r"^.* (?:>|/|»|›) (.+)$", 1)
    keys = F.filter(F.array(content_key(after), content_key(crumb)), lambda k: k != "")
    return F.transform(F.when(short, keys).otherwise(F.array().cast("array<string>")), lambda k: F.xxhash64(k))


def page_hosts(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id, host (hash), page (hash of the address), and the named columns.

    The host is the domain's site, else that of the uri; a document with neither is a host of its own.
    """
    host = F.coalesce(site(F.col("domain")), uri_host(F.col("uri")), F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    # the hash of a null isn't null
    page = F.when(F.col("uri").isNotNull(), F.xxhash64(letters_and_digits(percent_decode(F.col("uri"))))).otherwise(F.col("doc_id"))
    return documents.where("doc_id is not null").select("doc_id", F.xxhash64(host).alias("host"), page.alias("page"), *columns)


def line_nodes(documents: DataFrame, statistics: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, line_no, host, page, node, masked, targets (the nodes it points to), dated of every non-blank line, and statistics: expressions over ``line`` and ``bare``."""
    pages = page_hosts(documents, "doc_text").where("doc_text is not null")
    lines = pages.select("doc_id", "host", "page", F.posexplode(F.split("doc_text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.trim(F.col("line"), F.lit(BLANKS)) != "").withColumn("bare", bare_line(F.col("line")))
    return lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "host", "page",
        F.xxhash64(content_key(F.col("bare"))).alias("node"), F.when(has_names(F.col("bare")), F.xxhash64(masked_key(F.col("bare")))).alias("masked"),
        _targets(F.col("bare")).alias("targets"), is_dated(F.col("bare")).alias("dated"), *[e.alias(n) for n, e in (statistics or {}).items()],
    )


def title_nodes(documents: DataFrame) -> DataFrame:
    """host, node of the segments of every page title of a site."""
    parts = F.split(F.col("title"), rf"[{SPACE}]*[;|·–—»«][{SPACE}]*|[{SPACE}]+-[{SPACE}]+|:[{SPACE}]+|[{SPACE}]/[{SPACE}]")
    segments = page_hosts(documents, "title").where("title is not null").select("host", F.explode(parts).alias("part"))
    # a filter on the key would be pushed down and make every key twice
    bare = segments.where(F.col("part").rlike(r"[\p{L}\p{N}]")).select("host", bare_line(F.col("part")).alias("bare"))
    return bare.select("host", F.xxhash64(content_key(F.col("bare"))).alias("node")).distinct()


def _salted(table: DataFrame) -> DataFrame:
    """table SALTS times, a ``salt`` each."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def node_importance(nodes: DataFrame) -> DataFrame:
    """host, node, pages, host_pages, importance, hosts, adherence, masked_hosts, masked_adherence.

    Distinct (host, node, page) triples are counted first, so hot hosts and nodes spread over all tasks.
    """
    counted = nodes.groupBy("host", "node", "page").agg(F.max("masked").alias("masked")).groupBy("host", "node").agg(F.count("*").alias("pages"), F.max("masked").alias("masked"))
    # every line of a page is a row; its host's size is the number of its pages
    sizes = nodes.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = counted.withColumn("salt", _salt("node")).join(_salted(sizes), ["host", "salt"])
    counted = counted.withColumn("importance", F.when(F.col("host_pages") > 1, 1 - F.log("pages") / F.log(F.col("host_pages"))).otherwise(F.lit(1.0)))
    telling = counted.where(F.col("host_pages") >= TELLING_PAGES)
    # a node of one site says nothing more there than its importance does
    over_sites = telling.groupBy("node").agg(F.count("*").alias("hosts"), (F.sum("pages") / F.sum("host_pages")).alias("adherence")).where("hosts > 1")
    per_site = telling.where("masked is not null").groupBy("masked", "host").agg(F.sum("pages").alias("p"), F.max("host_pages").alias("m"))
    over_names = per_site.groupBy("masked").agg(F.count("*").alias("masked_hosts"), (F.sum(F.least("p", "m")) / F.sum("m")).alias("masked_adherence")).where("masked_hosts > 4")
    # a node of many sites is joined in parts by site; only nodes with names are joined by them, since most have none
    counted = counted.withColumn("salt", _salt("host")).join(_salted(over_sites), ["node", "salt"], "left")
    named = counted.where("masked is not null").join(_salted(over_names), ["masked", "salt"], "left")
    return named.unionByName(counted.where("masked is null"), allowMissingColumns=True).drop("masked", "salt")


def furniture_nodes(importance: DataFrame) -> DataFrame:
    """host, node of the nodes judged furniture."""
    pages, size = F.col("pages"), F.col("host_pages")
    repeated = (F.col("importance") < IMPORTANCE) & ((size >= 10) & (pages >= 3) & (pages >= size * F.lit(MIN_SHARE)) | (size < 10) & (pages >= 2))
    loose = (F.col("hosts") >= 5) & (F.col("adherence") < VETO_ADHERENCE)
    adherent = (F.col("hosts") >= 4) & (F.col("adherence") >= ADHERENCE) | (F.col("hosts") >= 2) & (F.col("adherence") >= 0.25) & (pages >= 2)
    named = (F.col("masked_hosts") >= 5) & (F.col("masked_adherence") >= 0.15)
    loose, adherent = F.coalesce(loose, F.lit(False)), F.coalesce(adherent, F.lit(False))
    return importance.where(repeated & ~loose | adherent | F.coalesce(named, F.lit(False))).select("host", "node")


def furniture(documents: DataFrame, statistics: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The line nodes of all documents, written once, and doc_id, line_no of those that are furniture."""
    nodes = written(line_nodes(documents, statistics))
    judged = furniture_nodes(node_importance(nodes)).unionByName(title_nodes(documents)).distinct()
    asked = nodes.select("doc_id", "line_no", "host", F.explode(F.array_union(F.array("node"), "targets")).alias("node"), _salt("doc_id").alias("salt"))
    met = asked.join(_salted(judged), ["host", "node", "salt"], "left_semi").select("doc_id", "line_no")
    return nodes, met.unionByName(nodes.where("dated").select("doc_id", "line_no")).distinct()


def furniture_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no of every non-blank line that is furniture.

    Null and empty pages have no lines. Repeated rows of one document count as one page.
    """
    return furniture(documents)[1]


def main_bodies(documents: DataFrame) -> DataFrame:
    """documents with ``body``: doc_text without its furniture, lines in order; null stays null."""
    taken = furniture_lines(documents).groupBy("doc_id").agg(F.collect_list("line_no").alias("_taken_lines"))  # bounded by one page's lines
    kept = F.filter(F.split("doc_text", "\n"), lambda _, i: ~F.array_contains(F.col("_taken_lines"), i.cast("long")))
    body = F.when(F.col("_taken_lines").isNull(), F.col("doc_text")).otherwise(F.array_join(kept, "\n"))
    return documents.join(taken, "doc_id", "left").withColumn("body", body).drop("_taken_lines")
