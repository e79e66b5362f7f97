"""Problem 3: at most so many records of each contributor, the best ones kept.

The method is weighted reservoir sampling without replacement by exponential
keys: of records with weights w and uniform u, those with the largest
log w - temperature * log(-log u) stay. At temperature 1 that is a sample in
proportion to the scores; at 0 the noise is gone and the best scores stay,
which is the form in which a fixed order of quality is asked for.

The keys of a contributor are never brought together. A key is cut into digits
from coarse to fine; counting the records by digit finds, for each contributor,
the one digit in which its cap falls. Records above stay, records below go, and
only those in that digit are looked at again by the next digit. What is left
after the last digit are ties in all but the identifier.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.uri import site
from webloom.session import ensure_checkpoint_dir


def exponential_key(score: Column, identity: Column, temperature: float = 1.0, seed: int = 42) -> Column:
    """log score plus Gumbel noise drawn from the identity: the larger, the sooner kept. Null or non-positive scores come last."""
    # 13 hexadecimal digits, which any engine can make
    digest = F.md5(F.concat_ws(":", identity.cast("string"), F.lit(str(seed))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    uniform = (bits + 0.5) / float(1 << 52)
    base = F.when(score > 0, F.log(score.cast("double")))
    return F.when(F.lit(temperature) == 0, base).otherwise(base - F.lit(temperature) * F.log(-F.log(uniform)))


def _refine(rows: DataFrame, digit: Column) -> DataFrame:
    """rows with ``_whole``: true if surely kept, null if surely dropped, false if the cap falls within the row's digit; ``_left`` is what may then still stay.

    A digit's smaller values come first.
    """
    rows = rows.withColumn("_digit", digit)
    counts = rows.groupBy("_c", "_digit").agg(F.count("*").alias("_n"), F.first("_left").alias("_l"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # counted digits, not records: a row for each digit that isn't wholly below the cap
    bounds = (
        counts.withColumn("_before", before)
        .where("_before < _l")
        .select("_c", "_digit", (F.col("_before") + F.col("_n") <= F.col("_l")).alias("_whole"), (F.col("_l") - F.col("_before")).alias("_rest"))
    )
    return rows.join(bounds, ["_c", "_digit"], "left").withColumn("_left", F.col("_rest")).drop("_rest", "_digit")


def cap_records(records: DataFrame, contributor: Column, cap: Column, digits: Sequence[Column], identity: str) -> DataFrame:
    """identity, kept of every record whose contributor has more records than its cap.

    ``cap`` is an expression over the record's own columns, the same for all records of a
    contributor. ``digits`` are bigint expressions, small first, coarse to fine;
    the last tie goes to the smaller identity. Records of contributors within their cap
    don't come out: all of them stay. A null contributor has no cap. Identities are
    unique whole numbers; an empty table gives no rows.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    rows = records.where(contributor.isNotNull() & F.col(identity).isNotNull()).select(
        contributor.alias("_c"), cap.cast("long").alias("_left"), F.col(identity).cast("long").alias("_id"), *[d.cast("long").alias(f"_d{i}") for i, d in enumerate(digits)]
    )
    sizes = rows.groupBy("_c").agg(F.count("*").alias("_size"), F.first("_left").alias("_cap")).where("_size > _cap").select("_c")
    # narrow rows, read several times below
    open_rows = rows.join(sizes, "_c", "left_semi").checkpoint()
    # after the digits, ties go by identity: by its ranges first, so that no window below is large
    steps = [F.col(f"_d{i}") for i in range(len(digits))] + [F.shiftright(F.col("_id"), 16)]
    done = []
    for step in steps:
        cut = _refine(open_rows, step)
        done.append(cut.where("_whole is null or _whole").select("_id", F.coalesce("_whole", F.lit(False)).alias("kept")))
        open_rows = cut.where("not _whole").drop("_whole")
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_id"))
    done.append(open_rows.withColumn("_place", place).select("_id", (F.col("_place") <= F.col("_left")).alias("kept")))
    return reduce(DataFrame.unionByName, done).withColumnRenamed("_id", identity)


def site_caps(documents: DataFrame, domains: DataFrame) -> DataFrame:
    """doc_id, site, cap of every document with a site: ranked sites may keep a fiftieth of all documents (3 at least), others a hundredth (2 at least)."""
    ranked = domains.where("rank is not null").select(site(F.col("domain")).alias("site")).where("site is not null").distinct().withColumn("ranked", F.lit(True))
    total = documents.agg(F.count("*").alias("n_documents"))
    docs = documents.select("doc_id", site(F.col("domain")).alias("site"), "flags", "word_count").crossJoin(F.broadcast(total))
    cap = F.when(F.col("ranked"), F.greatest(F.lit(3), F.floor(F.col("n_documents") / 50))).otherwise(F.greatest(F.lit(2), F.floor(F.col("n_documents") / 100)))
    return docs.where("site is not null").join(ranked, "site", "left").withColumn("cap", cap)


def _key_digits(key: Column) -> list[Column]:
    """A key as two digits, steps of 2^-12 and 2^-40, larger keys first; keys lie between about -40 and 60, and no key comes last."""
    fine = F.floor(F.least(F.greatest(F.coalesce(key, F.lit(-99.0)), F.lit(-99.0)), F.lit(99.0)) * float(1 << 40)).cast("long")
    return [-F.shiftright(fine, 28), -fine]


def page_quality(flags: Column, word_count: Column) -> Column:
    """A positive score by which clean pages come before others, then longer ones, null counts last; scores of two pages differ by one part in 2^34 at least."""
    clean, words = F.when(flags == 0, F.lit(1 << 33)).otherwise(F.lit(0)), word_count.cast("long")
    return clean + F.when(words.isNull(), F.lit(1)).otherwise(words + F.lit((1 << 31) + 2))


def best_pages(documents: DataFrame, domains: DataFrame, temperature: float = 0.0, seed: int = 42) -> DataFrame:
    """doc_id, kept of the pages of sites above their cap: the cap-size largest exponential keys of page_quality, ties to the smaller doc_id.

    At temperature 0 the key is the log of the score, so the order of quality decides: clean pages first, then more words.
    """
    key = exponential_key(page_quality(F.col("flags"), F.col("word_count")), F.col("doc_id"), temperature, seed)
    return cap_records(site_caps(documents, domains), F.col("site"), F.col("cap"), _key_digits(key), "doc_id")


def sampled_pages(documents: DataFrame, domains: DataFrame, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """doc_id, kept by a reservoir in proportion to the number of words; null and negative counts come last."""
    key = exponential_key(F.col("word_count"), F.col("doc_id"), temperature, seed)
    return cap_records(site_caps(documents, domains), F.col("site"), F.col("cap"), _key_digits(key), "doc_id")
