"""Problem 4: figures of every page's text that tell prose from structural junk, and check its word count.

The body (without the site's furniture) is measured once; gradient-boosted trees
are trained on those figures with weak labels: what is plainly sentences or
plainly none is labelled by its figures, the doubtful rest by the hasty hand labels, where
there are any. A few hand-checked examples are always learnt from as well; the probabilities are calibrated on others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.boost import BoostedTrees
from webloom.llm.lexicon import FUNCTION_WORDS
from webloom.llm.linetree import main_bodies
from webloom.llm.prose_examples import EXAMPLES, TRAINING
from webloom.plans.written import written

#: Labelled documents that the trees are trained on, at most; chosen by the hash of doc_id.
MAX_TRAINING = 4000
#: Weight of a hand-checked example in rows.
COPIES = 3

FIGURES = [
    "words_log", "word_length", "function_share", "letter_share", "digit_share", "symbol_share", "sentence_share", "line_end_share", "line_words", "variety", "top_share",
    "hapax_share", "number_share", "token_length", "odd_share", "capital_share", "sentence_rate", "link_share", "mixed_share", "lines_log", "short_line_share",
]

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')”»]*\s+")
_LINK = re.compile(r"https?://|www\.")
_MIXED = re.compile(r"_|#|\d[^\W\d_]|[^\W\d_]\d")
_DIGITS = re.compile(r"\d+")
_ODD = re.compile(r"[^\x00-\x7fàâäæçéèêëîïôöœùûüÿñßáíóúÀÂÄÆÇÉÈÊËÎÏÔÖŒÙÛÜŸÑÁÍÓÚ¿¡‘’“”„«»–—…·•©°\xa0€]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—’“”„«»…¿¡]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]\w*")
_LISTS = [frozenset(v) for v in FUNCTION_WORDS.values()]
_ALL_LISTS = frozenset().union(*_LISTS)
_CLOSERS = " \t\r\n\xa0\"')”»]"


def _ended(text: str) -> bool:
    return text.rstrip(_CLOSERS)[-1:] in (".", "!", "?", "…")


def page_figures(body: str) -> list[float]:
    """The FIGURES of a text; all texts have them, the empty one too."""
    low = _WORD.findall(body.lower())
    n = len(low) or 1
    counts = Counter(low)
    tokens = body.split()
    solid = sum(map(len, tokens)) or 1
    lines = [x for x in body.split("\n") if x.strip()]
    in_sentences = sentences = 0
    for part in _SENTENCE.split(body):
        if _ended(part) and 3 <= (k := len(part.split())) <= 60:
            in_sentences += k
            sentences += 1
    functions = max(sum(map(counts.__getitem__, s & counts.keys())) for s in _LISTS)
    content = [c for w, c in counts.most_common(60) if w not in _ALL_LISTS][:2]
    per_line = sorted(len(x.split()) for x in lines) or [0]
    digits = sum(map(len, _DIGITS.findall(body)))
    characters = sum(map(len, low))
    ascii_only = body.isascii()
    return [
        math.log1p(len(low)), characters / n, functions / n, (characters - digits) / solid, digits / solid,
        len(_SYMBOL.findall(body)) / solid, in_sentences / (len(tokens) or 1), sum(map(_ended, lines)) / (len(lines) or 1), float(min(per_line[len(per_line) // 2], 100)),
        len(counts) / n**0.8, sum(content) / n, list(counts.values()).count(1) / n, sum(c for w, c in counts.items() if w.isdigit()) / n if digits else 0.0,
        min(max(map(len, tokens), default=0), 100) / 100, 0.0 if ascii_only else len(_ODD.findall(body)) / solid, len(_CAPITAL.findall(body)) / n, sentences / n, len(_LINK.findall(body)) / n,
        len(_MIXED.findall(body)) / (len(tokens) or 1), math.log1p(len(lines)), sum(1 for k in per_line if k <= 3) / (len(lines) or 1),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [page_figures(b) for b in batch["body"]]
        out = pd.DataFrame(rows, columns=FIGURES, dtype="float64")
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        out["true_words"] = [len(x.split()) for x in batch["doc_text"]]
        out["word_count"] = batch["word_count"].astype("Int64")
        out["has_body"] = [bool(b.strip()) for b in batch["body"]]
        yield out


def page_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the FIGURES of the body, true_words of doc_text, word_count, has_body; null texts are left out, empty ones have figures of 0."""
    bodies = main_bodies(documents.select("doc_id", "uri", "domain", "title", "doc_text", "word_count")).where("doc_id is not null and doc_text is not null")
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FIGURES) + ", true_words long, word_count long, has_body boolean"
    return bodies.select("doc_id", "body", "doc_text", "word_count").mapInPandas(_measure, schema)


def weak_label(figures: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """1 junk, 0 prose, -1 unknown. quality: mean hand label (1 good), NaN where there is none or they disagree."""
    at = {f: i for i, f in enumerate(FIGURES)}
    sentence, function, letter = (figures[:, at[f]] for f in ("sentence_share", "function_share", "letter_share"))
    out = np.where(np.isnan(quality), -1, np.where(quality > 0.5, 0, 1))
    # hand labels also call bad sentences bad, so what is plain by its figures goes before them
    out[(sentence > 0.5) & (function > 0.15)] = 0
    out[(sentence < 0.35) & (function < 0.2) | (sentence < 0.1) & (function < 0.25) | (sentence < 0.15) & (letter < 0.5)] = 1
    out[function < 0.1] = 1
    return out


def train(sample: pd.DataFrame) -> BoostedTrees:
    """Trees from measured pages with a column ``quality``, calibrated on the hand-checked examples."""
    (given, given_junk), (held, held_junk) = (
        (np.array([page_figures(t) for t, _ in rows]), np.array([0.0 if prose else 1.0 for _, prose in rows])) for rows in (TRAINING * COPIES, EXAMPLES)
    )
    x = sample[FIGURES].to_numpy(dtype=float) if len(sample) else np.empty((0, len(FIGURES)))
    y = weak_label(x, sample["quality"].to_numpy(dtype=float)) if len(sample) else np.empty(0)
    x, y = np.concatenate([x[y >= 0], given]), np.concatenate([y[y >= 0].astype(float), given_junk])
    return BoostedTrees().fit(x, y).calibrate(held, held_junk)


def prose_quality(documents: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """doc_id, junk_probability (null without a body), true_words, count_wrong, and the FIGURES of every document with a text.

    ``count_wrong``: the stored word count is null or off by more than a tenth of the true one.
    Labels may be missing, null, repeated or contradictory; with no usable ones the hand-checked examples alone train the trees.
    """
    pages = written(page_statistics(documents))
    votes = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality in (0, 1)")
    sample = pages.join(votes, "doc_id").where("has_body").orderBy(F.xxhash64("doc_id")).limit(max_training).toPandas()
    model = train(sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.probability(batch[FIGURES].to_numpy(dtype=float)) if len(batch) else np.empty(0)
            yield batch[["doc_id", "true_words", "count_wrong", "has_body", *FIGURES]].assign(junk_probability=np.where(batch["has_body"], p, np.nan))

    wrong = F.col("word_count").isNull() | (F.abs(F.col("word_count") - F.col("true_words")) * 10 > F.col("true_words"))
    schema = "doc_id long, true_words long, count_wrong boolean, has_body boolean, " + ", ".join(f"{f} double" for f in FIGURES) + ", junk_probability double"
    scored = pages.withColumn("count_wrong", wrong).mapInPandas(score, schema)
    return scored.withColumn("junk_probability", F.when(F.col("has_body"), F.col("junk_probability"))).drop("has_body")


def findings(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, finding: ``not_prose`` and ``count_wrong``, a row each."""
    both = F.array_compact(F.array(F.when(F.col("junk_probability") >= threshold, F.lit("not_prose")), F.when(F.col("count_wrong"), F.lit("count_wrong"))))
    return scored.select("doc_id", F.explode(both).alias("finding"))
