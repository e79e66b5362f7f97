"""Page signals over a table of fetched pages: one parse per page, everything after it by columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.bitmask import DocumentFlag, flag_if, union
from webloom.functions.html import SIGNAL_SCHEMA, page_signals
from webloom.functions.links import acceptable_link, normalized_uri, path, robots_allowed
from webloom.functions.text import word_count


def signals(pages: DataFrame, uri: str = "uri", html: str = "html") -> DataFrame:
    """uri and the signals of every page with an address and a text; nulls in either are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"uri": u, **page_signals(u, h)} for u, h in zip(batch["uri"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["uri", *[c.strip().split()[0] for c in SIGNAL_SCHEMA.split(",")]])

    both = pages.select(F.col(uri).alias("uri"), F.col(html).alias("html")).where("uri is not null and html is not null")
    return both.mapInPandas(run, f"uri string, {SIGNAL_SCHEMA}")


def document_flags(signalled: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """signalled with flags: the page's own, prohibited address, and, by rules (site key, allow, disallow), disallowed."""
    out = signalled.withColumn("flags", union(F.col("flags"), flag_if(DocumentFlag.PROHIBITED_URI, ~F.coalesce(acceptable_link(F.col("uri")), F.lit(False)))))
    if rules is None:
        return out
    allowed = robots_allowed(path(F.col("uri")), F.col("allow"), F.col("disallow"))
    denied = flag_if(DocumentFlag.DISALLOWED_BY_ROBOTS, ~F.coalesce(allowed, F.lit(True)))
    met = out.join(rules, "site", "left") if "site" in out.columns else out
    return met.withColumn("flags", union(F.col("flags"), denied)).drop("allow", "disallow")


def emitted_links(signalled: DataFrame) -> DataFrame:
    """uri, target: acceptable links of unpolluted pages, normalised, each once. Links are resolved before they are judged."""
    links = signalled.where("flags = 0").select("uri", F.explode("links").alias("link"))
    return links.where(acceptable_link(F.col("link"))).select("uri", normalized_uri(F.col("link")).alias("target")).distinct()


def asset_sizes(signalled: DataFrame, assets: DataFrame) -> DataFrame:
    """uri, js, css: inline characters and the known sizes of external assets (unknown ones count nothing)."""
    sizes = assets.groupBy(F.col("uri").alias("asset")).agg(F.max("size").alias("size"))
    used = signalled.select("uri", F.lit("js").alias("kind"), F.explode("scripts").alias("asset")).unionByName(signalled.select("uri", F.lit("css").alias("kind"), F.explode("styles").alias("asset")))
    outer = used.join(sizes, "asset").groupBy("uri").agg(*[F.sum(F.when(F.col("kind") == k, F.col("size"))).alias(f"_{k}") for k in ("js", "css")])
    met = signalled.select("uri", "script_chars", "style_chars").join(outer, "uri", "left")
    return met.select("uri", (F.col("script_chars") + F.coalesce("_js", F.lit(0))).alias("js"), (F.col("style_chars") + F.coalesce("_css", F.lit(0))).alias("css"))


def missing_assets(signalled: DataFrame, assets: DataFrame) -> DataFrame:
    """asset: external assets whose size isn't known yet."""
    used = signalled.select(F.explode(F.concat("scripts", "styles")).alias("asset")).distinct()
    return used.join(assets.select(F.col("uri").alias("asset")), "asset", "left_anti")


def indexed_documents(signalled: DataFrame) -> DataFrame:
    """uri, title, doc_text, word_count, flags, features as they are stored for search."""
    parts = [F.col(c) for c in ("title", "headings", "content", "comments")]
    words = sum((word_count(p) for p in parts[1:]), word_count(parts[0]))
    return signalled.select("uri", "title", F.array_join(F.array(*parts), " ").alias("doc_text"), words.alias("word_count"), "flags", "features")
