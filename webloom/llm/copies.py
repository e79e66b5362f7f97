"""Problem 7: records that differ in spelling only, by progressive partition refinement.

First all records are grouped by what is cheap and can't differ within a group:
the stripped length and a histogram of letters. Only classes with several members
go on to the costlier keys (the letters and digits in order, then the sorted
parameters), so records without a twin never leave the first grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import letters_and_digits
from webloom.functions.uri import address_parameter_key, address_path_key, percent_decode
from webloom.plans.written import written

#: Letters whose counts make the histogram of the first, cheap key.
HISTOGRAM = "aeinorst0123456789"
#: Parts of a hot class that are joined apart.
SALTS = 8


def cheap_invariant(plain: Column) -> Column:
    """Length and letter histogram of a text already reduced to letters and digits; order doesn't matter to it."""
    counts = [F.length(plain) - F.length(F.translate(plain, c, "")) for c in HISTOGRAM]
    return F.xxhash64(F.length(plain), *counts)


def refine(records: DataFrame, keys: list[str]) -> DataFrame:
    """records of classes with several members under every key up to now, with ``_class``, a hash of the keys.

    Keys are column names, cheap to costly, equal within a true class. Each step counts
    classes by partial aggregates and keeps members of classes with two or more, so
    a hot class of a third of all rows is a count, never a collected group.
    """
    for i in range(1, len(keys) + 1):
        by = keys[:i]
        several = records.groupBy(*by).agg(F.count("*").alias("_members")).where("_members > 1").select(*by)
        records = records.join(several, by, "left_semi")
    return records


def _by_invariant(records: DataFrame, identity: str, uri: str) -> tuple[DataFrame, DataFrame]:
    """The records with an address as _id, _uri, _cheap, and the classes of _cheap: _first, _members."""
    rows = records.where(F.col(uri).isNotNull()).select(F.col(identity).alias("_id"), percent_decode(F.col(uri)).alias("_uri"))
    # read for the classes and for their members: the addresses are decoded and counted out once
    rows = written(rows.select("_id", "_uri", cheap_invariant(letters_and_digits(F.col("_uri"))).alias("_cheap")))
    return rows, rows.groupBy("_cheap").agg(F.min("_id").alias("_first"), F.count("*").alias("_members"))


def _salted(classes: DataFrame) -> DataFrame:
    return classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))


def _open_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """_id and the costlier keys, of members of classes with several members only."""
    several = _salted(sizes.where("_members > 1").select("_cheap"))
    return _with_salt(rows).join(several, ["_cheap", "_salt"], "left_semi").select("_id", address_path_key(F.col("_uri")).alias("_path"), address_parameter_key(F.col("_uri")).alias("_parameters"))


def address_copies(records: DataFrame, identity: str, uri: str = "uri") -> DataFrame:
    """first_id, copy_id, copies: a row for each record that isn't the first (smallest id) of its address.

    ``copies`` is the size of the class. Null uris belong to no class; uris
    without letters, digits or parameters are all one address. Repeated ids count as records.
    """
    open_rows = _open_rows(*_by_invariant(records, identity, uri))
    classes = open_rows.groupBy("_path", "_parameters").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return _with_salt(open_rows).join(_salted(classes), ["_path", "_parameters", "_salt"]).where("_id <> first_id").select("first_id", F.col("_id").alias("copy_id"), "copies")


def address_records(records: DataFrame, identity: str, uri: str = "uri") -> DataFrame:
    """first_id, copies: one row for each address, with the number of its records; 1 for an address of a single record.

    Null uris are no address. Repeated ids count as records.
    """
    rows, sizes = _by_invariant(records, identity, uri)
    alone = sizes.where("_members = 1").select(F.col("_first").alias("first_id"), F.col("_members").alias("copies"))
    classes = _open_rows(rows, sizes).groupBy("_path", "_parameters").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"))
    return alone.unionByName(classes.select("first_id", "copies"))


def formatting_copies(records: DataFrame, identity: str, fields: list[str]) -> DataFrame:
    """first_id, copies of every record class that agrees in its fields but for white space, case, punctuation and the fields' order.

    Null fields count as empty. Works like address_copies for any text columns.
    """
    plain = [letters_and_digits(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    rows = records.select(F.col(identity).alias("_id"), F.sort_array(F.array(*plain)).alias("_plain"))
    # a digest of the fields goes along instead of the texts, which would be exchanged with every step
    digest = F.sha2(F.array_join(F.transform("_plain", lambda x: F.concat(x, F.lit("\n"))), ""), 256)
    rows = rows.select("_id", cheap_invariant(F.array_join("_plain", "")).alias("_cheap"), digest.alias("_digest"))
    return refine(rows, ["_cheap", "_digest"]).groupBy("_digest").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies")
