"""Problem 2: lines repeated across the pages of one site.

A line's key is its letters in lower case. For every key of a site, the number
of the site's pages with it is held against its frequency on all other sites' pages by the
log-likelihood ratio; the false-discovery rate over all keys is controlled after
Benjamini and Hochberg; significant lines are taken out of their pages, which are
put together again by line position.

A notice that every site carries isn't commoner here than elsewhere, yet repeated here
all the same; and a collection of one site has no outside. Keys that the first test doesn't
accept are therefore tested a second time, at the same rate, for their excess over a line that
stands on no other page of the collection. Each test has half of the rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import letters_only
from webloom.functions.uri import site
from webloom.plans.written import written

#: P-values are counted in so many steps of a tenth of a power of ten, which bounds what goes to the driver.
P_STEPS = 3200
#: Parts of a hot site, key or (site, key) that are joined apart.
SALTS = 8


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def site_document_lines(documents: DataFrame) -> DataFrame:
    """doc_id, site, line_no, key (hash of the letters) of every line with letters of a document with a site."""
    docs = documents.select("doc_id", site(F.col("domain")).alias("site"), F.col("doc_text").alias("body")).where("doc_id is not null and site is not null and body is not null")
    lines = docs.select("doc_id", "site", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "site", F.col("line_no").cast("long").alias("line_no"), letters_only(F.col("line")).alias("letters")).where("letters <> ''").select("doc_id", "site", "line_no", F.xxhash64("letters").alias("key"))


def _term(observed: Column, expected: Column) -> Column:
    return F.when((observed > 0) & (expected > 0), observed * F.log(F.try_divide(observed, expected))).otherwise(0.0)


def log_likelihood_ratio(inside: Column, inside_total: Column, outside: Column, outside_total: Column) -> Column:
    """Dunning's ratio of two frequencies; 0 where the inside one isn't the larger."""
    share = (inside + outside) / (inside_total + outside_total)
    # where there is no outside, both counts of it are 0 and so is the ratio
    e1, e2 = inside_total * share, outside_total * share
    ratio = 2 * (_term(inside, e1) + _term(inside_total - inside, inside_total - e1) + _term(outside, e2) + _term(outside_total - outside, outside_total - e2))
    return F.when(inside * outside_total > outside * inside_total, F.greatest(ratio, F.lit(0.0))).otherwise(0.0)


def log10_p(ratio: Column) -> Column:
    """log10 of the upper tail of chi-square with one degree of freedom, by its asymptotic series (Mills' ratio) beyond 2 and 0 below."""
    z = F.sqrt(ratio)
    tail = F.lit(math.log(4) - 0.5 * math.log(2 * math.pi)) - ratio / 2 - F.log(z + F.sqrt(ratio + F.lit(8 / math.pi)))
    return F.when(ratio > 0, F.least(tail / F.lit(math.log(10)), F.lit(0.0))).otherwise(0.0)


def line_statistics(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """site, key, pages, site_pages, outside_pages, log10_p, outside_log10_p of every line key on several pages of a site.

    The distinct (site, key, page) triples are counted first, so a key or site with a third of all rows is spread over all tasks.
    """
    pages = lines.groupBy("site", "key").agg(F.countDistinct("doc_id").alias("pages"))
    sizes = documents.select("doc_id", site(F.col("domain")).alias("site")).where("site is not null").groupBy("site").agg(F.countDistinct("doc_id").alias("site_pages"))
    totals = sizes.agg(F.sum("site_pages").alias("all_pages"))
    everywhere = pages.groupBy("key").agg(F.sum("pages").alias("key_pages"))
    # only keys on several pages of a site can be in excess; the others aren't joined to anything
    repeated = pages.where("pages > 1").withColumn("salt", _salt("key")).join(_salted(sizes), ["site", "salt"])
    repeated = repeated.withColumn("salt", _salt("site")).join(_salted(everywhere.where("key_pages > 1")), ["key", "salt"]).crossJoin(F.broadcast(totals))
    inside, inside_total, everyone = (F.col(c).cast("double") for c in ("pages", "site_pages", "all_pages"))
    outside = (F.col("key_pages") - F.col("pages")).cast("double")
    # the collection's size stands in for that of the outside, so that a site without an outside is tested as well
    unrepeated = log_likelihood_ratio(inside, inside_total, F.lit(0.0), everyone)
    beside_others = log_likelihood_ratio(inside, inside_total, outside, everyone - inside_total)
    return repeated.select("site", "key", "pages", "site_pages", (F.col("key_pages") - F.col("pages")).alias("outside_pages"), log10_p(unrepeated).alias("log10_p"), log10_p(beside_others).alias("outside_log10_p"))


def false_discovery_threshold(statistics: DataFrame, tests: int, rate: float, p: str = "log10_p") -> float:
    """The largest log10 p that Benjamini and Hochberg accept, from counts of p-values by step; a step is accepted whole or not at all."""
    step = F.least(F.floor(-F.col(p) * 10), F.lit(P_STEPS)).cast("int")
    counts = dict(statistics.groupBy(step.alias("step")).count().collect())  # P_STEPS + 1 rows at most
    accepted, so_far = P_STEPS + 1, 0
    for k in sorted(counts, reverse=True):
        so_far += counts[k]
        if 10 ** (-k / 10) <= rate * so_far / max(tests, 1):
            accepted = k
    return -accepted / 10


def significant_keys(statistics: DataFrame, rate: float = 0.05) -> DataFrame:
    """statistics of the keys in excess, with ``excess``: ``site`` if over the other sites, ``repeated`` if only over a line that stands nowhere else."""
    # a row for each key that is on several pages of a site: those are the tests
    tests = statistics.count()
    over_sites = false_discovery_threshold(statistics, tests, rate / 2, "outside_log10_p")
    rest = statistics.where(F.col("outside_log10_p") > over_sites)
    over_none = false_discovery_threshold(rest, tests, rate / 2, "log10_p")
    excess = F.when(F.col("outside_log10_p") <= over_sites, "site").when(F.col("log10_p") <= over_none, "repeated")
    return statistics.withColumn("excess", excess).where("excess is not null")


def excess_lines(documents: DataFrame, rate: float = 0.05, min_pages: int = 5, min_share: float = 0.1) -> DataFrame:
    """doc_id, line_no, site, pages, site_pages, log10_p, outside_log10_p, excess of every occurrence of a line in excess.

    The tests decide; of what they accept, a line must be on min_pages pages and on min_share of the site's.
    Null bodies, null sites and lines without letters never count; a line repeated within
    a page counts once for the frequency, and each occurrence is listed.
    """
    # narrow, and read for the counts and for the lines; the texts are read once
    lines = written(site_document_lines(documents))
    statistics = written(line_statistics(lines, documents))
    found = significant_keys(statistics, rate).where((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("site_pages") * F.lit(min_share)))
    met = lines.withColumn("salt", _salt("doc_id")).join(_salted(found), ["site", "key", "salt"])
    return met.select("doc_id", "line_no", "site", "pages", "site_pages", "log10_p", "outside_log10_p", "excess")


def without_excess_lines(documents: DataFrame, **parameters) -> DataFrame:
    """documents with ``clean_text``: doc_text without its lines in excess, the others in their order. Null stays null."""
    taken = excess_lines(documents, **parameters).groupBy("doc_id").agg(F.collect_list("line_no").alias("_taken_lines"))  # bounded by one page's lines
    lines = F.split("doc_text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_taken_lines"), i.cast("long")))
    clean = F.when(F.col("_taken_lines").isNull(), F.col("doc_text")).otherwise(F.array_join(kept, "\n"))
    return documents.join(taken, "doc_id", "left").withColumn("clean_text", clean).drop("_taken_lines")
