"""Problem 6: pages of stuffed keywords, product tags or links, by their rank-frequency curves.

For every page's body the words are counted and ranked by SQL windows. Of the curve are kept
its least-squares slope and residual in log-log scale, the share of the two and
eight commonest content words, and its divergence (Kullback and Leibler) from the mean curve of prose
in the same language and of comparable length. Prose gives the reference: mean and
deviation of each figure per language and length class. A page is

* stuffed, if its curve is extreme and either two content words alone make up a third of it, or it is salted with shop words;
* a link list, if its curve is unlike prose and bare addresses or product tags make up much of it, or its curve is
  flatter than any prose (hardly a word repeated, none of grammar) over short title-like lines, or it
  has no sentences and links out far more than pages do.

So no sign decides without the curve. A page without a function word of the four languages is held against the first one's prose.

Tables, forms, indexes and lists of things have extreme curves as well, but
neither shop words nor addresses nor titles. Directories and glossaries have sentences.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.lexicon import FUNCTION_WORDS, SHOP_WORDS
from webloom.llm.linetree import main_bodies
from webloom.plans.written import written

LANGUAGES = list(FUNCTION_WORDS)
#: Ranks after which the curve is cut into classes for the divergence.
RANK_CLASSES = (1, 2, 4, 8, 16, 32)
#: Deviations from same-language prose that make a figure extreme.
EXTREME = 5.0
#: Deviations that make a curve unlike prose where addresses or tags say the rest.
UNLIKE = 3.0
#: Share of two content words that no form, table or list reaches, on pages of so many words.
OVERWHELMING, OVERWHELMING_WORDS = 0.35, 60
_SHOP, _NUMBER, _LINK = 16, 32, 64
_LINK_WORDS = ["http", "https", "www"]


def _word_kind(word: Column) -> Column:
    """Bits: one for each language whose function word it is, then shop word, number, start of an address."""
    bits = [F.when(word.isin(FUNCTION_WORDS[l]), 1 << i).otherwise(0) for i, l in enumerate(LANGUAGES)]
    bits += [F.when(word.isin(SHOP_WORDS), _SHOP).otherwise(0), F.when(word.isin(_LINK_WORDS), _LINK).otherwise(0)]
    listed = sorted({*SHOP_WORDS, *_LINK_WORDS, *(w for v in FUNCTION_WORDS.values() for w in v)})
    # one lookup settles most words; only what sorts before letters can be a number
    number = F.when((word < ":") & word.rlike(r"^\d+$"), _NUMBER).otherwise(0)
    return F.when(word.isin(listed), reduce(lambda a, b: a.bitwiseOR(b), bits)).otherwise(number)


def _bit(bit: int) -> Column:
    return F.col("kind").bitwiseAND(F.lit(bit)) != 0


def word_counts(bodies: DataFrame) -> DataFrame:
    """doc_id, n, kind, length of every distinct word of every body; a page's words stay where the page is."""
    words = bodies.select("doc_id", F.explode(F.split(F.lower("body"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    keyed = words.select("doc_id", F.xxhash64("word").alias("key"), _word_kind(F.col("word")).alias("kind"), F.length("word").alias("length"))
    return keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("length").alias("length"))


def curves(counts: DataFrame) -> DataFrame:
    """doc_id and the figures of its rank-frequency curve, from a window over the page's frequencies (words of one frequency are one step of the curve)."""
    functions = _bit((1 << len(LANGUAGES)) - 1)
    steps = counts.groupBy("doc_id", "n").agg(
        F.count("*").alias("words"), F.count_if(~functions).alias("content"), F.sum("length").alias("letters"),
        *[F.count_if(_bit(1 << i)).alias(f"f_{l}") for i, l in enumerate(LANGUAGES)],
        F.count_if(_bit(_SHOP)).alias("shop"), F.count_if(_bit(_NUMBER)).alias("number"), F.count_if(_bit(_LINK)).alias("link"),
    )
    order = Window.partitionBy("doc_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = steps.withColumn("last", F.sum("words").over(order)).withColumn("last_content", F.sum("content").over(order))
    first, first_content = F.col("last") - F.col("words"), F.col("last_content") - F.col("content")
    x, y, w = F.log((first + 1 + F.col("last")) / 2), F.log("n"), F.col("words")

    def top(k: int, first: Column, last: Column) -> Column:
        return F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.lit(k), last) - F.least(F.lit(k), first)))

    sums = ranked.groupBy("doc_id").agg(
        F.sum(w * F.col("n")).alias("total"), F.sum(w).alias("distinct"), F.sum(F.when(F.col("n") == 1, w).otherwise(0)).alias("hapaxes"),
        F.sum(F.col("letters") * F.col("n")).alias("letters"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in (*(f"f_{l}" for l in LANGUAGES), "shop", "number", "link")],
        F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"),
        *[top(k, first, F.col("last")).alias(f"top{k}") for k in RANK_CLASSES], *[top(k, first_content, F.col("last_content")).alias(f"content{k}") for k in (2, 8)],
    )
    m = F.col("distinct").cast("double")
    vx, vy, cxy = F.col("sxx") - F.col("sx") ** 2 / m, F.col("syy") - F.col("sy") ** 2 / m, F.col("sxy") - F.col("sx") * F.col("sy") / m
    slope = F.coalesce(F.try_divide(cxy, vx), F.lit(0.0))
    best = F.greatest(*[F.col(f"f_{l}") for l in LANGUAGES])
    language = F.coalesce(*[F.when(F.col(f"f_{l}") == best, F.lit(l)) for l in LANGUAGES])
    n = F.col("total").cast("double")
    edges = [F.lit(0), *[F.col(f"top{k}") for k in RANK_CLASSES], F.col("total")]
    return sums.select(
        "doc_id", "total", language.alias("language"), F.floor(F.log2(n + 1)).cast("int").alias("length_class"), slope.alias("slope"),
        F.sqrt(F.greatest(vy - slope * cxy, F.lit(0.0)) / m).alias("residual"), (F.col("content2") / n).alias("content2"), (F.col("content8") / n).alias("content8"),
        (m / n).alias("variety"), (F.col("hapaxes") / n).alias("hapax_share"), (best / n).alias("function_share"), (F.col("letters") / n).alias("word_length"),
        *[(F.col(c) / n).alias(f"{c}_share") for c in ("shop", "number", "link")], F.array(*[(b - a) / n for a, b in zip(edges, edges[1:], strict=False)]).alias("curve"),
    )


def line_shapes(bodies: DataFrame) -> DataFrame:
    """doc_id, lines, title_share (short lines with a capital first and no sentence end), ended_share, tag_share."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    ended = F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?…][\"')”»\]]*\s*$")))
    titles = F.size(F.filter("_lines", lambda x: (F.length(x) < 80) & x.rlike(r"^[^\p{L}]*\p{Lu}") & ~x.rlike(r"[.!?…][\"')”»\]]*\s*$")))
    n = F.greatest(F.size("_lines"), F.lit(1))
    tags = F.when(F.col("body").contains("#"), F.regexp_count(F.concat(F.lit(" "), F.col("body")), F.lit(r"\s#[\p{L}\p{N}]")) / F.size(F.split(F.trim("body"), r"\s+"))).otherwise(0.0)
    return bodies.withColumn("_lines", lines).select("doc_id", F.size("_lines").alias("lines"), (titles / n).alias("title_share"), (ended / n).alias("ended_share"), tags.alias("tag_share"))


def page_curves(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """The figures of every page with words in its body, one row each, with out_links (distinct targets)."""
    # the bodies come partitioned by doc_id, and everything up to the figures keeps that partitioning
    bodies = main_bodies(documents.select("doc_id", "uri", "domain", "title", "doc_text")).where("doc_id is not null and body is not null").select("doc_id", "body")
    out_links = edges.where("src is not null and dst is not null").select(F.col("src").alias("doc_id"), "dst").distinct().groupBy("doc_id").agg(F.count("*").alias("out_links"))
    figures = curves(word_counts(bodies)).join(line_shapes(bodies), "doc_id")
    figures = figures.join(out_links, "doc_id", "left").withColumn("out_links", F.coalesce("out_links", F.lit(0)))
    return figures.dropDuplicates(["doc_id"])


FIGURES = ("slope", "residual", "content2")


def prose_reference(figures: DataFrame) -> DataFrame:
    """language, length_class, mean and deviation of each figure, and the mean curve, of the pages that are prose by their grammar: a row for each of the four languages and some twenty lengths."""
    prose = figures.where("function_share > 0.3 and ended_share > 0.5 and shop_share < 0.02")
    means = [F.avg(f).alias(f"{f}_mean") for f in FIGURES] + [F.coalesce(F.stddev(f), F.lit(0.0)).alias(f"{f}_deviation") for f in FIGURES]
    curve = F.array(*[F.avg(F.col("curve")[i]) for i in range(len(RANK_CLASSES) + 1)]).alias("mean_curve")
    return prose.groupBy("language", "length_class").agg(*means, curve)


def score_pages(figures: DataFrame) -> DataFrame:
    """figures with the deviations ``*_z`` from comparable prose, divergence, stuffed, link_list and spam."""
    reference = F.broadcast(prose_reference(figures))  # languages times lengths
    met = figures.join(reference, ["language", "length_class"], "left")
    # classes without prose (tiny or huge pages) borrow nothing: their figures are judged by fixed bounds
    for f, least in zip(FIGURES, (0.05, 0.02, 0.012), strict=True):
        met = met.withColumn(f"{f}_z", (F.col(f) - F.col(f"{f}_mean")) / F.greatest(F.col(f"{f}_deviation"), F.lit(least)))
    pairs = F.zip_with("curve", "mean_curve", lambda p, q: F.when(p > 0, p * F.log(p / F.greatest(q, F.lit(1e-4)))).otherwise(0.0))
    met = met.withColumn("divergence", F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b))
    z = F.col
    extreme = reduce(or_, [z("content2_z") > EXTREME, z("slope_z") < -EXTREME, z("residual_z") > EXTREME, z("divergence") > 0.25])
    unlike = reduce(or_, [z("content2_z") > UNLIKE, z("slope_z") < -UNLIKE, z("residual_z") > UNLIKE, z("divergence") > 0.1])
    extreme, unlike = F.coalesce(extreme, z("content2") > 0.2), F.coalesce(unlike, z("content2") > 0.1)
    overwhelming = (z("content2") > OVERWHELMING) & (z("total") >= OVERWHELMING_WORDS) & (z("number_share") < 0.05)
    stuffed = extreme & (overwhelming | (z("content2") > 0.08) & (z("shop_share") >= 0.02))
    titles = (z("lines") >= 6) & (z("title_share") > 0.8) & (z("ended_share") < 0.15) & (z("variety") > 0.5) & (z("content8") < 0.2) & (z("number_share") < 0.05) & (z("word_length") < 9)
    linked = (z("out_links") >= 40) & (z("lines") >= 6) & (z("ended_share") < 0.15) & (z("function_share") < 0.3) & (z("number_share") < 0.05)
    lists = unlike & ((z("link_share") >= 0.03) | (z("tag_share") >= 0.3)) | titles | linked
    return met.withColumn("stuffed", stuffed).withColumn("link_list", lists).withColumn("spam", stuffed | lists).drop("mean_curve", *[f"{f}_{s}" for f in FIGURES for s in ("mean", "deviation")])


def spam_pages(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each page with words in its body: figures, deviations and verdicts.

    Null, empty and wordless bodies have no row and are no spam. Repeated rows of one doc_id count once;
    edges may have nulls, repeats and unknown pages.
    """
    return score_pages(written(page_curves(documents, edges)))
