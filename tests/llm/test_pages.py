"""Problems 4, 5, 6, 8 and 10: held-out accuracy, exact round trips, odd rows."""

import os
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, PROSE, documents
from webloom.llm import linetree, packing, prose, severity, spam
from webloom.llm.boost import BoostedTrees

WORDS = "river stone bridge market winter letter garden window morning kitchen engine harbour pencil valley orchard ladder".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} that we found near the {rng.choice(WORDS)} was not as old as the {rng.choice(WORDS)}{rng.randrange(9)}, but I kept it for the {rng.choice(WORDS)}."


def site_pages(pages=14, sites=6):
    rng, rows, furniture = random.Random(11), [], set()
    for s in range(sites):
        names = [f"How the {rng.choice(WORDS)} came to {rng.choice(WORDS)} {k}" for k in range(pages)]
        for k in range(pages):
            head = [f"Home / notes / {names[k]}", f"* Notes of site {'abcdef'[s]}", f"Posted by Vera Quist on 2019-0{1 + k % 9}-12"]
            tail = [f"You are visitor number {rng.randrange(900)}", "Recent posts", names[(k + 1) % pages], f"Next: {names[(k + 2) % pages]} »", "All rights reserved, site " + "abcdef"[s] + "."]
            body = [" ".join(sentence(rng) for _ in range(3)) for _ in range(3)] + [f"- {rng.choice(WORDS)} of {''.join(rng.choices('bdfgklmnprst', k=7))}"]
            lines = head + [""] + body + tail
            doc = s * pages + k
            furniture |= {(doc, i) for i in [*range(len(head)), *range(len(head) + 1 + len(body), len(lines))]}
            rows.append({"doc_id": doc, "uri": f"https://s{s}.example/{k}", "domain": f"s{s}.example" if k % 5 else None, "title": names[k], "doc_text": "\n".join(lines)})
    return rows, furniture


def test_furniture(spark):
    rows, want = site_pages()
    df = documents(spark, rows)
    got = {(r["doc_id"], r["line_no"]) for r in linetree.furniture_lines(df).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 2
    bodies = {r["doc_id"]: r["body"] for r in linetree.main_bodies(df).collect()}
    for r in rows:
        assert bodies[r["doc_id"]] == "\n".join(x for i, x in enumerate(r["doc_text"].split("\n")) if (r["doc_id"], i) not in got)


def test_recrawled_page_is_one_page(spark):
    text = "\n".join(sentence(random.Random(i)) for i in range(4))
    rows = [{"doc_id": i, "uri": u, "domain": "a.example", "doc_text": text} for i, u in enumerate(["https://a.example/x", "https://A.example/x/", "https://a.example/%78"])]
    assert linetree.furniture_lines(documents(spark, rows)).count() == 0


def test_boosted_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:400], y[:400]).calibrate(x[:400], y[:400])
    assert ((model.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    assert BoostedTrees().fit(x, np.zeros(600)).probability(x).max() < 0.1


def junk(rng, kind):
    if kind == "table":
        return "\n".join(f"{i} | {rng.choice(WORDS)} | {rng.randrange(999)}.{rng.randrange(99)} | n/a" for i in range(25))
    if kind == "keywords":
        return ", ".join(rng.choice(["cheap {}", "{} sale", "buy {} online", "{}"]).format("garden lamp") for _ in range(60))
    return "\n".join("".join(rng.choices("ABCDEFabcdef0123456789+/", k=76)) for _ in range(12))


def test_prose(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(60):
        kind = rng.choice(["prose", "prose", "table", "keywords", "base64"])
        text = " ".join(sentence(rng) for _ in range(8)) if kind == "prose" else junk(rng, kind)
        count = len(text.split())
        truth[i] = kind != "prose"
        rows.append({"doc_id": i, "uri": f"https://s{i}.example/", "domain": f"s{i}.example", "doc_text": text, "word_count": [count, None, count + count // 10, count + count // 10 + 2][i % 4]})
    labels = spark.createDataFrame([(i, int(not truth[i]) if i % 5 else int(truth[i]), 0) for i in range(0, 60, 2)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = prose.prose_quality(documents(spark, rows), labels).toPandas().set_index("doc_id")
    assert all((out.junk_probability[i] >= 0.5) == truth[i] for i in truth)
    assert all(out.count_wrong[i] == (i % 4 in (1, 3)) for i in truth)
    found = {tuple(r) for r in prose.findings(prose.prose_quality(documents(spark, rows), labels.limit(0))).collect()}
    assert {i for i, f in found if f == "not_prose"} == {i for i in truth if truth[i]}


def test_spam(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(162):
        kind = "prose" if i < 110 else ["keywords", "table", "links", "tags", "unlisted", "directory"][i % 6]
        n = 6 + i % 5
        text = {
            "prose": lambda: "\n".join(sentence(rng) for _ in range(n)), "keywords": lambda: junk(rng, "keywords"), "table": lambda: junk(rng, "table"),
            "links": lambda: "\n".join(f"https://shop{rng.randrange(99)}.example/lamp/{rng.randrange(99)}" for _ in range(30)),
            "tags": lambda: " ".join(f"#lamp_{rng.choice(WORDS)}" for _ in range(40)),
            # stuffed without any listed word, and an honest directory with an address an entry
            "unlisted": lambda: ", ".join(rng.choice(["tape delay", "tape delay mixer", f"{rng.choice(WORDS)} tape delay"]) for _ in range(60)),
            "directory": lambda: "\n".join(f"{sentence(rng)} {sentence(rng)} See https://{rng.choice(WORDS)}{k}.example." for k in range(n)),
        }[kind]()
        truth[i] = kind in ("keywords", "links", "tags", "unlisted")
        rows.append({"doc_id": i, "uri": f"https://s{i}.example/", "domain": f"s{i}.example", "doc_text": text})
    edges = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None), (999, 1)], "src long, dst long").withColumn("doc_id", F.lit(0))
    out = {r["doc_id"]: r["spam"] for r in spam.spam_pages(documents(spark, rows), edges).collect()}
    assert out == truth


def test_curve_figures(spark):
    text = "a a a a b b c d"
    bodies = spark.createDataFrame([(1, text)], "doc_id long, body string")
    r = spam.curves(spam.word_counts(bodies)).first()
    assert r["total"] == 8 and r["variety"] == 0.5 and r["hapax_share"] == 0.25
    assert [round(v * 8) for v in r["curve"]] == [4, 2, 2, 0, 0, 0, 0]


def test_plan_is_whole_and_within_capacity():
    rng = random.Random(2)
    histogram = {s: rng.randrange(1, 60) for s in rng.sample(range(1, 2049), 400)}
    used = defaultdict(int)
    room = 0
    last = 0
    for tier, first, times, content in packing.plan(histogram):
        assert first == last and sum(s * k for s, k in content) <= tier and times > 0
        last = first + times
        room += tier * times
        for s, k in content:
            used[s] += k * times
    assert dict(used) == histogram
    assert sum(s * n for s, n in histogram.items()) / room > 0.95
    assert packing.plan({}) == [] and packing.plan({5: 0}) == []


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer here")
def test_packing_round_trip(spark):
    rng = random.Random(5)
    rows = [{"doc_id": i, "text": " ".join(rng.choices(WORDS, k=rng.choice([1, 5, 60, 300, 900, 3000])))} for i in range(200)] + [{"doc_id": 200, "text": ""}, {"doc_id": 201, "text": None}]
    df = documents(spark, rows)
    counts = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    out = packing.pack(df, tiers=(64, 512), step_containers=8).toPandas()
    assert (out.groupby(["tier", "container"])["size"].sum().reset_index().eval("size <= tier")).all()
    assert out.groupby("container").tier.nunique().max() == 1
    assert out.groupby("doc_id")["size"].sum().to_dict() == {i: n for i, n in counts.items() if n}
    pieces = out.groupby("doc_id").piece.agg(["count", "max"])
    assert all(pieces["count"][i] == -(-counts[i] // 512) == pieces["max"][i] + 1 for i in pieces.index)
    rates = packing.fill_rates(packing.pack(df, tiers=(64, 512))).toPandas()
    assert rates.tokens.sum() / (rates.tier * rates.containers).sum() > 0.9
    assert packing.pack(df.limit(0)).count() == 0


def test_ranks_in_parts(spark):
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("piece"), (F.col("id") % 3).alias("size"))
    out = packing.ranked(items, 3000, part_items=100).toPandas()
    assert all(sorted(g["rank"]) == list(range(1000)) for _, g in out.groupby("size"))


def test_undisguised():
    u = severity.undisguised
    assert u("V3RM1N bl0wj0b $lutty").split() == ["vermin", "blowjob", "slutty"]
    assert u("f-i-l-t-h and pooorn, crétin") == "filth and porn, cretin"
    assert "starred" in u("you p******c fool") and u("5 apples in 2024 at 3") == "5 apples in 2024 at 3"
    assert severity.sentences("One two.\nThree four\nfive! ") == [["one", "two"], ["three", "four", "five"]]


def test_severity_on_held_out_sentences(spark):
    rng = random.Random(7)
    bad = ["You are a pathetic moron, shut your mouth.", "Go and kill yourself, nobody would miss you.", "These people are vermin and should be driven out.", "She begged him to fuck her.", "Du bist ein erbärmlicher Idiot.", "Eres un maldito cobarde."]
    fine = ["The moderators removed a post that called someone an idiot.", "The clinic gives advice on breast cancer.", "Rats live under the shed.", "The great tit is on the list."]
    rows, truth = [], {}
    for i in range(160):
        text = [sentence(rng) for _ in range(5)]
        toxic = i % 8 == 0
        text.insert(rng.randrange(5), bad[i // 8 % len(bad)] if toxic else fine[i % 4] if i % 3 == 0 else "")
        truth[i] = toxic
        rows.append({"doc_id": i, "text": "\n".join(text), "source": None if i % 10 == 0 else f"s{i % 2}"})
    labels = [(i, 1, int(truth[i]) if rng.random() < 0.9 else 0) for i in range(0, 160, 2)] + [(1, None, None), (0, 1, 0), (500, 1, 1)]
    df, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = severity.score_documents(df, marks)
    flagged = {r["doc_id"] for r in out.where("flagged").collect()}
    right = {i for i in truth if truth[i]}
    assert len(flagged & right) >= 0.9 * len(right) and len(flagged - right) <= 3
    table = out.toPandas()
    assert table.severity.between(0, 2).all() and table.severity[table.flagged].min() > table.severity[~table.flagged].max()
    rates = severity.source_rates(out).toPandas()
    assert rates.documents.sum() == 160 and rates.flagged.sum() == len(flagged)


def test_votes_cover_all_labelled_documents(spark):
    rng = random.Random(3)
    bad, fine = "You are a pathetic moron, shut your mouth.", "Write to the office instead."
    texts = ["\n".join([bad, *[sentence(rng) for _ in range(3)], *[fine] * (i < 2)]) for i in range(20)]
    texts += ["\n".join([sentence(rng) for _ in range(4)] + [bad] * (i == 0) + [fine] * (i < 60)) for i in range(200)]
    df = documents(spark, [{"doc_id": i, "text": x} for i, x in enumerate(texts)] + [{"doc_id": 900, "text": fine}])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(220)] + [(5, None), (6, 0), (900, None)], "doc_id long, toxic int")
    votes = {r["sentence"]: (r["toxic"], r["clean"]) for r in severity.sentence_votes(df, labels).collect()}
    assert votes["write to the office instead"] == (2.0, 60.0) and votes["you are a pathetic moron shut your mouth"] == (19.5, 1.5)
    assert len(votes) == len({s for x in texts for s in map(" ".join, severity.sentences(x))})
    # a bound on the templates that are fitted changes neither votes nor verdicts
    verdicts = []
    for bounds in ((10_000, 10_000), (30, 60)):
        templates = severity.training_templates(df, labels, *bounds)
        assert any(t[2:] == (2.0, 60.0) for t in templates) and len(templates) <= sum(bounds)
        model = severity.train(templates, 20 / 220)
        verdicts.append([bool(model.grades(model.worst(x))[0] >= 0.35) for x in (bad, fine, sentence(rng))])
    assert verdicts == [[True, False, False]] * 2


def test_every_sentence_is_scored():
    model = severity.SeverityModel({"a": 0.3, "b": 0.3, "c": 0.3, "a_b": 0.2}, np.array([1.0, 2.0]))
    assert model.worst("A b c. B a.") == pytest.approx(1.1) and model.worst("nothing here") == 0 and model.worst("") is None


def test_pages_without_uri_are_pages_of_their_own(spark):
    rows = [{"doc_id": i, "domain": "a.example", "uri": None, "doc_text": "x"} for i in range(4)] + [{"doc_id": i, "domain": "a.example", "uri": "https://a.example/1", "doc_text": "x"} for i in (7, 8)]
    pages = {r["doc_id"]: r["page"] for r in linetree.page_hosts(documents(spark, rows)).collect()}
    assert len({pages[i] for i in range(4)}) == 4 and pages[7] == pages[8]
    # a site of pages without uri has furniture like any other
    rng = random.Random(4)
    rows = [{"doc_id": i, "domain": "b.example", "uri": None, "doc_text": "\n".join(["Home | Archive | Contact", sentence(rng), sentence(rng)])} for i in range(12)]
    assert {(r["doc_id"], r["line_no"]) for r in linetree.furniture_lines(documents(spark, rows)).collect()} >= {(i, 0) for i in range(12)}


def test_odd_rows(spark):
    df = documents(spark, ODD)
    labels = spark.createDataFrame([(None, None, None), (9, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    edges = spark.createDataFrame([(None, None), (9, 1)], "src long, dst long")
    for d, marks, links in ((df, labels, edges), (df.limit(0), labels.limit(0), edges.limit(0))):
        linetree.main_bodies(d).collect()
        prose.findings(prose.prose_quality(d, marks)).collect()
        spam.spam_pages(d, links).collect()
        severity.score_documents(d, marks).collect()
        packing.pack(d).collect()
    found = {(r["doc_id"], r["finding"]) for r in prose.findings(prose.prose_quality(df, labels)).collect()}
    assert (9, "count_wrong") in found and not any(i is None for i, _ in found)
    assert not severity.score_documents(df, labels).where("flagged").count()
    assert isinstance(severity.score_documents(df, labels).toPandas(), pd.DataFrame) and PROSE
