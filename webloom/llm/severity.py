"""Problem 10: how severe a document's abuse, hatred or sexual content is, by cumulative-link ordinal regression.

A sentence has sparse features: its words and pairs of neighbouring words, after
disguises are undone (digits and signs for letters, repeated letters, letters set apart, stars).
One weight per feature is shared by all thresholds: the probability that the grade is at least t is
logistic(weights - threshold t), and the expected severity is the sum of these over t.

A first model is fitted to hand-graded sentences. The hasty labels of whole documents then vote on
each sentence: in how many documents labelled toxic and clean it stands is counted over all
labelled documents, sentences alike but for rare words (names) counting together as a template.
Given that labels miss many and are wrong in some, the votes move the first model's odds, and
the final model is fitted to the templates with those odds. Only the number of templates that
are fitted is bounded, never the votes on one. Every sentence of every document is
scored by the sum of its weights; a document's severity is that of its worst sentence.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.contributors import exponential_key
from webloom.llm.lexicon import FUNCTION_WORDS
from webloom.llm.severity_examples import EXAMPLES
from webloom.plans.written import written

#: Templates the final model is fitted to, at most: those seen in documents labelled toxic, and the others. The more votes, the sooner one is taken.
MAX_SEEN_TOXIC, MAX_SEEN_CLEAN = 8_000, 32_000
GRADES = 2
#: P(labelled toxic) of a document with a toxic sentence, and at least of any document; the share of toxic labels takes the latter's place where it is larger.
HIT, FALSE_ALARM = 0.55, 0.02
#: Added to the first model's log odds before the votes: it knows only what is worst.
PRIOR = -1.0
#: From this probability of the first model on, a clean label or two say nothing against a sentence.
SUSPECT = 0.3
#: Weight of a sentence that is known by the labels alone.
BACKGROUND, DOUBTFUL = 0.3, 0.03
#: Words of fewer of the fitted templates get no weight, unless a hand-graded sentence has them.
RARE = 4
#: A word is masked as a name if it stands in no more than this share of the distinct sentences, or in NAME_SENTENCES of them.
NAME_SHARE, NAME_SENTENCES = 1 / 2000, 4

_FOLD = dict(zip("àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæ", "aaaaaaceeeeiiiinooooouuuuyyoa", strict=True)) | {"ß": "ss"}
_ACCENT = re.compile("[" + "".join(_FOLD) + "]")
_LEET = str.maketrans("013457$@", "oieastsa")
_WRAP = re.compile(r"(?<=[^\s.!?:])[ \t\r]*\n(?=[a-zà-ÿ])")
_CUT = re.compile(r"; |[.!?…]+[\"')”»]*\s+|\n+|[.!?…]+$")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][-.·_]){2,}[^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_STARS = re.compile(r"([^\W\d_])(\*+)([^\W\d_]?)")
_DISGUISED = re.compile(r"(?:[^\W_]|(?<![^\W_])\$)*(?:[^\W\d_][013457$@]|[013457$][^\W\d_])[^\W_$@]*(?:[$@013457][^\W_]+)*")
#: What a text must hold for the costlier pattern of set-apart letters to match.
_APART_HINT, _SPACED_HINT = re.compile(r"[-.·_][^\W\d_][-.·_]"), re.compile(r" [^\W\d_] [^\W\d_] ")
_HINT = re.compile(r"[013457$@][^\W\d_]")
_TOKEN = re.compile(r"[^\W\d_]+")


def _folded(m: re.Match) -> str:
    return _FOLD[m[0]]


def undisguised(text: str) -> str:
    """Lower case, no accents, disguises undone; letters under stars become one word ``starred`` and a pattern of what is seen."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENT.sub(_folded, text)
    if "*" in text:
        text = _STARS.sub(lambda m: f" starred star{m[1]}{'x' * min(len(m[2]), 12)}{m[3]} ", text)
    if _HINT.search(text):
        text = _DISGUISED.sub(lambda m: m[0].translate(_LEET), text)
    if _APART_HINT.search(text):
        text = _APART.sub(lambda m: re.sub(r"[-.·_]", "", m[0]), text)
    if _SPACED_HINT.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) > 2 and ((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])).any():
        text = _RUN.sub(r"\1", text)
    return text


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; hard-wrapped lines are joined."""
    # set-apart letters are joined before the dots are taken for sentence ends
    return [w for part in _CUT.split(undisguised(_WRAP.sub(" ", text))) if part and (w := _TOKEN.findall(part))]


def features_of(words: list[str]) -> list[str]:
    return list({*words, *map("_".join, zip(words, words[1:], strict=False))})


class SeverityModel:
    """Weights by feature and increasing thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.words = {f: w for f, w in weights.items() if "_" not in f}
        self.pairs = {tuple(f.split("_")): w for f, w in weights.items() if "_" in f}

    @property
    def floor(self) -> float:
        """Severity of a sentence without a known feature."""
        return float(self.grades(0.0).sum())

    def grades(self, score: float | np.ndarray) -> np.ndarray:
        """P(grade >= t) for each t."""
        return 1 / (1 + np.exp(-(np.asarray(score)[..., None] - self.thresholds)))

    def score(self, words: list[str]) -> float:
        return sum(filter(None, map(self.words.get, set(words)))) + sum(filter(None, map(self.pairs.get, set(zip(words, words[1:], strict=False)))))

    def worst(self, text: str | None) -> float | None:
        """The largest score of a text's sentences, None without any."""
        return max(map(self.score, sentences(text)), default=None) if text else None


def fit(rows: list[tuple[list[str], np.ndarray, float]], l2: float = 0.05, steps: int = 120, rate: float = 0.1, least: int = 1) -> SeverityModel:
    """rows: features, P(grade >= t) for each t, weight. Full-batch Adam on the all-thresholds loss; features of fewer than ``least`` rows are left out."""
    seen: dict[str, int] = defaultdict(int)
    for f, _, _ in rows:
        for x in f:
            seen[x] += 1
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    at = [[vocabulary[x] for x in f if x in vocabulary] for f, _, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    column = np.fromiter(chain.from_iterable(at), np.int64, len(row))
    # sums over neighbours are much faster than scattered ones: by row as they are, by column through a sorted copy
    some, row_starts = np.unique(row, return_index=True)
    by_column = np.argsort(column, kind="stable")
    column_starts = np.searchsorted(column[by_column], np.arange(len(vocabulary)))
    row_by_column = row[by_column]
    score = np.zeros(len(rows))
    q, mass = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w, b = np.zeros(len(vocabulary)), np.linspace(1.0, 2.0, GRADES)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        if len(some):
            score[some] = np.add.reduceat(w[column], row_starts)
        d = (1 / (1 + np.exp(-(score[:, None] - b))) - q) * mass[:, None]
        gw = (np.add.reduceat(d.sum(axis=1)[row_by_column], column_starts) if len(w) else w) + l2 * w
        gb = -d.sum(axis=0) + l2 * (b - np.linspace(1.0, 2.0, GRADES))
        for value, g, m, v in ((w, gw, moment[0], moment[1]), (b, gb, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b.sort()
    return SeverityModel({f: float(w[k]) for f, k in vocabulary.items() if abs(w[k]) > 1e-3}, b)


def _graded(grade: int) -> np.ndarray:
    return np.array([1.0 if grade >= t else 0.0 for t in range(1, GRADES + 1)])


def _known_words() -> set[str]:
    """The words of the hand-graded sentences: never masked as names."""
    return {w for t, _ in EXAMPLES for s in sentences(t) for w in s}


#: template (words, masked by "_"), member (a sentence of it), documents labelled toxic and clean that have it.
Template = tuple[str, str, float, float]


def train(templates: Iterable[Template], toxic_share: float = 0.0) -> SeverityModel:
    """The model from the votes on templates; there may be none, and then the hand-graded sentences alone train it.

    toxic_share: how many of all labelled documents are labelled toxic, and so of those with any harmless sentence.
    """
    hand = [(features_of(w), _graded(g), 2.0) for t, g in EXAMPLES for w in [[x for s in sentences(t) for x in s]]]
    grammar = sorted({w for v in FUNCTION_WORDS.values() for x in v for w in _TOKEN.findall(undisguised(x))})
    known = {x for f, _, _ in hand for x in f}
    rows = [(key.split(" "), member.split(" "), t, c) for key, member, t, c in templates]
    frequency: dict[str, int] = defaultdict(int)
    for _, words, _, _ in rows:
        for x in set(words):
            frequency[x] += 1
    members = [features_of([x for x in words if x in known or frequency[x] >= RARE]) for _, words, _, _ in rows]
    # what stands in clean documents again and again is the background that the hand-graded sentences stand out from
    plain = {k for k, (_, _, t, c) in enumerate(rows) if c >= 3 and t < 0.15 * (t + c)}
    usual = {x for k in plain for x in rows[k][0]} | set(grammar)
    # labels miss much, so a sentence seen once or twice counts only if it shares no telling word with the graded ones
    telling = {x for f, q, _ in hand if q[0] > 0 for x in f if "_" not in x} - usual
    plain |= {k for k, (key, _, t, c) in enumerate(rows) if t == 0 and c < 3 and telling.isdisjoint(key)}
    background = [(members[k], _graded(0), BACKGROUND * min(1.0, rows[k][3] / 3)) for k in sorted(plain) if members[k]]
    # grammar by itself is harmless, and so are sentences of unknown words
    hand += [([w], _graded(0), BACKGROUND) for w in grammar] + [([], _graded(0), 40.0)]
    first = fit(hand + background)
    by_chance = min(max(FALSE_ALARM, toxic_share), HIT / 2)
    up, down = np.log(HIT / by_chance), np.log((1 - HIT) / (1 - by_chance))
    p = first.grades(np.array([sum(filter(None, map(first.weights.get, features))) for features in members], dtype=float))
    toxic, clean = np.array([r[2] for r in rows], dtype=float), np.array([r[3] for r in rows], dtype=float)
    prior = np.clip(np.log(p[:, 0] / (1 - p[:, 0])) + PRIOR, -8.0, 2.0)
    q = 1 / (1 + np.exp(-np.clip(prior + toxic * up + clean * down, -20, 20)))
    targets = np.column_stack([q, q * p[:, 1] / p[:, 0]])
    learnt = []
    # in between, nothing is known; and a missing label or two say little of a sentence with telling words
    for k in np.flatnonzero((q <= 0.2) | (q >= 0.8)).tolist():
        weak = q[k] < 0.5 and toxic[k] + clean[k] < 3 and not telling.isdisjoint(rows[k][0])
        if members[k] and not (weak and p[k, 0] > SUSPECT):
            learnt.append((members[k], targets[k], DOUBTFUL if weak else min(1.0, BACKGROUND + 0.1 * (toxic[k] + clean[k]))))
    return fit(hand + learnt)


def _document_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (mean label); null labels don't count."""
    return labels.where("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))


def sentence_votes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """sentence, toxic, clean: every distinct sentence of the labelled documents, and how many of them stand for either label; null labels don't count, contradictory ones are shared out."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{" ".join(w) for w in sentences(t)} for t in batch["text"]]
            yield pd.DataFrame({"sentence": [s for f in found for s in f], "toxic": np.repeat(batch["toxic"].to_numpy(), [len(f) for f in found])}).astype({"sentence": object, "toxic": float})

    texts = documents.where("text is not null").select("doc_id", "text").join(_document_labels(labels), "doc_id").select("text", "toxic")
    return texts.mapInPandas(split, "sentence string, toxic double").groupBy("sentence").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def template_votes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """template, member, toxic, clean: sentences that differ only in words that hardly any sentence shares count together."""
    counted = written(sentence_votes(documents, labels))
    least = max(NAME_SENTENCES, int(counted.count() * NAME_SHARE))
    shared = counted.select(F.explode(F.array_distinct(F.split("sentence", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > least)
    # words above a share of the sentences: a sentence's mean length over that share bounds their number, however many sentences there are
    own = _known_words().union(r["word"] for r in shared.select("word").collect())

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(template=[" ".join([w if w in own else "_" for w in s.split(" ")]) for s in batch["sentence"]])

    masked = counted.mapInPandas(mask, "sentence string, toxic double, clean double, template string")
    return masked.groupBy("template").agg(F.min("sentence").alias("member"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training_templates(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_SEEN_TOXIC, max_clean: int = MAX_SEEN_CLEAN) -> list[Template]:
    """The templates to fit, max_toxic + max_clean of them at most, each with its votes of all labelled documents; drawn by exponential keys, so that what has many votes is in."""
    votes = template_votes(documents, labels).withColumn("key", exponential_key(F.col("toxic") + F.col("clean"), F.col("template")))
    votes = written(votes)
    parts = [votes.where(side).orderBy(F.desc("key"), "template").limit(most) for side, most in (("toxic > 0", max_toxic), ("toxic = 0", max_clean))]
    return [(r["template"], r["member"], r["toxic"], r["clean"]) for part in parts for r in part.drop("key").collect()]


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.35) -> DataFrame:
    """doc_id, source, probability (of grade 1 or more), severity (expected, 0 to 2), flagged, of every document.

    Null and empty texts have the severity of a sentence without a known word and aren't flagged. Rows are scored one by one, repeated ones too.
    """
    toxic_share = _document_labels(labels).agg(F.avg("toxic")).first()[0] or 0.0
    model = train(training_templates(documents, labels), toxic_share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            worst = [model.worst(t) for t in batch["text"]]
            nothing = np.array([s is None for s in worst], dtype=bool)
            p = model.grades(np.array([0.0 if s is None else s for s in worst], dtype=float))
            out = batch[["doc_id", "source"]].copy()
            out["probability"] = p[:, 0] if len(p) else np.empty(0)
            out["severity"] = p.sum(axis=1) if len(p) else np.empty(0)
            out["flagged"] = (out["probability"] >= threshold) & ~nothing
            yield out

    return documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, probability double, severity double, flagged boolean")


def source_rates(scored: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_severity; documents without a source are a group of their own."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("severity").alias("mean_severity")
    )
