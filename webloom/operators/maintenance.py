"""Writes of a mutable store as reads that make the next version of a table: upserts, identifiers, purges, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.bitmask import DocumentFlag, flag_if, union
from webloom.functions.links import quickly_acceptable, robots_allowed
from webloom.functions.uri import site


def with_new_ids(rows: DataFrame, existing: DataFrame, identity: str, order: list[str], part_rows: int = 200_000) -> DataFrame:
    """rows with ``identity`` continuing after the largest existing one, dense, in no order but within parts.

    Numbers come from counts per part of the keys' hash, so no window holds all rows; the parts grow in number, not in size.
    """
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", part)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # a row for each part_rows rows
    top = existing.agg(F.coalesce(F.max(identity), F.lit(0)).cast("long").alias("_top"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = rows.withColumn("_place", place).join(F.broadcast(offsets), "_part").crossJoin(F.broadcast(top))
    return numbered.withColumn(identity, (F.col("_top") + F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before", "_top")


def insert_missing(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: existing and the first of each new key that isn't there."""
    fresh = new.dropDuplicates(key).join(existing, key, "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], updated: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE of the updated columns; other columns keep the old value, new keys get what they bring."""
    new = new.dropDuplicates(key).withColumn("_new", F.lit(True))
    columns = [c for c in existing.columns if c not in key]
    a, b = existing.withColumn("_old", F.lit(True)).alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")

    def value(c: str) -> Column:
        brought = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in updated:
            return F.when(F.col("b._new"), brought).otherwise(F.col(f"a.{c}"))
        return F.when(F.col("a._old"), F.col(f"a.{c}")).otherwise(brought)

    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[value(c).alias(c) for c in columns]).select(*existing.columns)


def get_or_insert(table: DataFrame, wanted: DataFrame, identity: str, key: str) -> DataFrame:
    """identity, key of every wanted key: those of the table, and new identities for the missing."""
    wanted = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    known = table.groupBy(key).agg(F.min(identity).alias(identity))
    found = wanted.join(known, key)
    missing = wanted.join(known, key, "left_anti")
    return found.select(identity, key).unionByName(with_new_ids(missing, table, identity, [key]).select(identity, key))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """src, dst once each; edges without an end go."""
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def repeated_edges(edges: DataFrame) -> DataFrame:
    """src, dst, copies of the edges stored more than once."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("copies")).where("copies > 1")


def purged_documents(documents: DataFrame) -> DataFrame:
    """doc_id, flags: the prohibited bit set where the address isn't acceptable to the coarse rule."""
    flags = union(F.col("flags"), flag_if(DocumentFlag.PROHIBITED_URI, ~quickly_acceptable(F.col("uri"))))
    return documents.select("doc_id", flags.alias("flags"))


def purged_discovery(discovery: DataFrame) -> DataFrame:
    """id, dead: dead too where the address isn't acceptable to the coarse rule."""
    return discovery.select("id", (F.col("dead") | ~F.coalesce(quickly_acceptable(F.col("uri")), F.lit(False))).alias("dead"))


def mark_dead(discovery: DataFrame, ids: DataFrame) -> DataFrame:
    """discovery with dead set for the given ids."""
    marks = ids.select(F.col("id")).distinct().withColumn("_dead", F.lit(True))
    return discovery.join(marks, "id", "left").withColumn("dead", F.col("dead") | F.coalesce("_dead", F.lit(False))).drop("_dead")


def mark_discovered(discovery: DataFrame, resolved: DataFrame) -> DataFrame:
    """discovery after a crawl step: resolved (id, canonical) sets canonical, or dead where it is null."""
    r = resolved.dropDuplicates(["id"]).select("id", F.col("canonical").alias("_canonical"), F.lit(True).alias("_met"))
    out = discovery.join(r, "id", "left")
    met = F.coalesce("_met", F.lit(False))
    return out.withColumn("dead", F.when(met & F.col("_canonical").isNull(), True).otherwise(F.col("dead"))).withColumn("canonical", F.when(met, F.coalesce("_canonical", "canonical")).otherwise(F.col("canonical"))).drop("_canonical", "_met")


def missing_rules(domains: DataFrame) -> DataFrame:
    """Domains of which no robots rules are known."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return domains.where(F.col("rules").isNull() | (size("rules.allow") + size("rules.disallow") <= 0))


def robots_flags(documents: DataFrame, domains: DataFrame, site_of_document: Column, site_of_domain: Column, path_of: Column) -> DataFrame:
    """doc_id, allowed: by the rules of the document's site; a site without rules allows everything."""
    # a site stored twice: the rules of its first row, or without identifiers the first ones in their spelling
    order = F.col("id") if "id" in domains.columns else F.to_json("rules")
    rules = domains.where("rules is not null").select(site_of_domain.alias("site"), "rules", order.alias("_order")).groupBy("site").agg(F.min_by("rules", "_order").alias("rules"))
    docs = documents.select("doc_id", site_of_document.alias("site"), path_of.alias("path"))
    allowed = robots_allowed(F.col("path"), F.col("rules.allow"), F.col("rules.disallow"))
    return docs.join(rules, "site", "left").select("doc_id", F.coalesce(allowed, F.lit(True)).alias("allowed"))


def new_discoveries(discovery: DataFrame, links: DataFrame) -> DataFrame:
    """The rows to add for links (uri, depth, distance) whose address isn't discovered yet: an address once, at its smallest depth, with a new id."""
    fresh = links.where("uri is not null").groupBy("uri").agg(F.min("depth").alias("depth"), F.min_by("distance", "depth").alias("distance"))
    fresh = fresh.join(discovery.select("uri"), "uri", "left_anti")
    return with_new_ids(fresh, discovery, "id", ["uri"]).withColumn("dead", F.lit(False))


def imported_ranks(domains: DataFrame, ranks: DataFrame) -> DataFrame:
    """domains after the import of a popularity list (rank, domain): only the rank of known sites changes, unknown ones are added.

    Sites are compared, not spellings; a site that a list has twice takes its best rank, and all its rows take it.
    """
    best = ranks.where("rank is not null").groupBy(site(F.col("domain")).alias("_site")).agg(F.min("rank").alias("_rank")).where("_site is not null")
    known = domains.withColumn("_site", site(F.col("domain")))
    updated = known.join(best, "_site", "left").withColumn("rank", F.coalesce("_rank", "rank")).select(*domains.columns)
    added = with_new_ids(best.join(known.select("_site"), "_site", "left_anti").select(F.col("_site").alias("domain"), F.col("_rank").alias("rank")), domains, "id", ["domain"])
    return updated.unionByName(added, allowMissingColumns=True)


def backfilled_ranks(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """domains whose missing ranks are taken from popularity answers (domain, rank); known ranks stay."""
    found = answers.where("rank is not null").groupBy(site(F.col("domain")).alias("_site")).agg(F.min("rank").alias("_rank"))
    return domains.withColumn("_site", site(F.col("domain"))).join(found, "_site", "left").withColumn("rank", F.coalesce("rank", "_rank")).select(*domains.columns)


def backfilled_rules(domains: DataFrame, parsed: DataFrame) -> DataFrame:
    """domains whose missing robots rules are taken from parsed files (domain, rules); known rules stay."""
    found = parsed.where("rules is not null").groupBy(site(F.col("domain")).alias("_site")).agg(F.min_by("rules", F.to_json("rules")).alias("_rules"))
    unknown = missing_rules(domains).select("id").distinct().withColumn("_unknown", F.lit(True))
    met = domains.withColumn("_site", site(F.col("domain"))).join(found, "_site", "left").join(unknown, "id", "left")
    return met.withColumn("rules", F.when(F.col("_unknown"), F.coalesce("_rules", "rules")).otherwise(F.col("rules"))).select(*domains.columns)
