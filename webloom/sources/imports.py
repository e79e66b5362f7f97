"""Tables from outside: popularity lists, popularity answers, robots files, probes of addresses, fetched pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.links import mime, probe_result

POPULARITY_SCHEMA = "rank int, domain string"
FETCHED_SCHEMA = "uri string, collected timestamp, headers array<struct<name:string,value:string>>, data binary"


def popularity_csv(spark: SparkSession, path: str) -> DataFrame:
    """rank, domain of a headerless list; malformed rows and rows without either are dropped."""
    return spark.read.schema(POPULARITY_SCHEMA).option("mode", "DROPMALFORMED").csv(path).dropna()


def popularity_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """answers with rank: the global rank of a JSON answer, null if it isn't given or the status is 404."""
    rank = F.get_json_object(body, "$.GlobalRank.Rank").try_cast("int")
    return answers.withColumn("rank", F.when(F.col("status") == 404, F.lit(None)).otherwise(rank) if "status" in answers.columns else rank)


def robots_rules(text: str, agent: str) -> tuple[list[str], list[str]]:
    """Allowed and denied prefixes of the groups for an agent (by its name) or for all; empty prefixes say nothing."""
    allow: list[str] = []
    deny: list[str] = []
    applies, in_agents = False, False
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            applies = (applies if in_agents else False) or value == "*" or value.lower() == agent.lower()
            in_agents = True
            continue
        in_agents = False
        if applies and value and name in ("allow", "disallow"):
            (allow if name == "allow" else deny).append(value)
    return allow, deny


def parsed_robots(files: DataFrame, agent: str, key: str = "domain", text: str = "robots_txt") -> DataFrame:
    """key, rules of fetched robots files; one that is missing gives empty rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = [dict(zip(("allow", "disallow"), robots_rules(t or "", agent), strict=True)) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "rules": rules})

    schema = "key string, rules struct<allow:array<string>,disallow:array<string>>"
    return files.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)


def available_uris(uris: DataFrame, probes: DataFrame) -> DataFrame:
    """uri, available: the https form if it answers, else the plain one, else where either moved to; null if neither answers.

    probes: uri, status, location, one row for each probed address.
    """
    found = probes.select("uri", probe_result(F.col("status"), F.col("location"), F.col("uri")).alias("found")).groupBy("uri").agg(F.max("found").alias("found"))
    forms = uris.select("uri", F.regexp_replace("uri", "^(?i)https?:", "https:").alias("safe"), F.regexp_replace("uri", "^(?i)https?:", "http:").alias("plain"))
    a, b = found.select(F.col("uri").alias("safe"), F.col("found").alias("a")), found.select(F.col("uri").alias("plain"), F.col("found").alias("b"))
    return forms.join(a, "safe", "left").join(b, "plain", "left").select("uri", F.coalesce("a", "b").alias("available"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Fetched pages appended to the page store, compressed."""
    pages.select("uri", "collected", "headers", "data").write.mode("append").option("compression", "zstd").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page store with html (decoded) and content_type; records without an address are dropped."""
    pages = spark.read.schema(FETCHED_SCHEMA).parquet(path).where("uri is not null")
    kind = F.filter("headers", lambda h: F.lower(h["name"]) == "content-type")
    return pages.withColumn("html", F.decode("data", "UTF-8")).withColumn("content_type", mime(F.get(kind, 0)["value"]))
