"""Problems 1, 2, 3, 7 and 9 against brute force."""

import random
from collections import Counter, defaultdict
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
import numpy as np

from webloom.llm import contributors, copies, leaks, site_lines, terms


def test_terms(spark):
    rng = random.Random(2)
    segs = [(i, rng.choice(["Blog", " blog ", "A  b", "a b", "Z", "Only"]) if i < 30 else f"t{i}") for i in range(60)] + [(1, "Blog"), (2, None)]
    edges = [(k, rng.choice([None, *range(40)]), rng.choice([None, *range(70)])) for k in range(900)]
    edges += [(k, 3, 0) for k in range(900, 1400)]  # one document, one segment, many times
    s = spark.createDataFrame(segs, "id long, seg string").withColumn("term", F.lit("clash"))
    e = spark.createDataFrame(edges, "id long, doc long, seg long").withColumn("record", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(e, s).collect()}
    names = defaultdict(set)
    for i, x in segs:
        if x is not None:
            names[i].add(" ".join(x.lower().split()))
    rows = [(t, d) for _, d, g in edges if d is not None for t in names.get(g, ())]
    total = len({d for _, d in rows})
    occurrences, records = Counter(t for t, _ in rows), Counter(t for t, _ in set(rows))
    assert got == {t: (n, records[t], "rare" if records[t] == 1 else "common" if records[t] > 0.02 * total else None) for t, n in occurrences.items()}
    assert terms.term_frequencies(e.limit(0), s).count() == 0 and terms.term_frequencies(e, s.limit(0)).count() == 0


def test_last_seen_with_hot_term_and_one_salt(spark):
    rows = [("hot", i % 50) for i in range(2000)] + [("a", None), (None, 1), ("b", 1)]
    df = spark.createDataFrame(rows, "term string, record long")
    for salts in (1, 7):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.last_seen_counts(df, salts=salts).collect()}
        assert got == {"hot": (2000, 50), "b": (1, 1)}


def brute_lines(rows):
    site = {r["doc_id"]: r["domain"] for r in rows if r.get("domain")}
    size, pages, lines = Counter(site.values()), defaultdict(set), []
    for r in rows:
        if r.get("domain") and r["doc_text"] is not None:
            for k, line in enumerate(r["doc_text"].split("\n")):
                if letters := "".join(c for c in line.lower() if c.isalpha()):
                    pages[r["domain"], letters].add(r["doc_id"])
                    lines.append((r["doc_id"], k, r["domain"], letters))
    return {(d, k) for d, k, s, x in lines if len(pages[s, x]) >= 5 and len(pages[s, x]) >= 0.1 * size[s]}


def test_site_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        s = ["hot.example"] * 3 + [f"s{rng.randrange(9)}.example"]
        body = [f"Own line {rng.randrange(10**6)} of {i} xq{'abcdefghij'[i % 10]}{i}" for _ in range(6)]
        body += [x for x in ("Share this!", "SHARE  this", "© 20{}", "Contact", "", "12 34") if rng.random() < 0.5]
        rng.shuffle(body)
        rows.append({"doc_id": i, "domain": rng.choice([*s, None]), "doc_text": "\n".join(body) if i % 40 else None})
    df = documents(spark, rows)
    assert {(r["doc_id"], r["line_no"]) for r in site_lines.excess_lines(df).collect()} == brute_lines(rows)
    cleaned = {r["doc_id"]: r["clean_text"] for r in site_lines.without_excess_lines(df).collect()}
    gone = brute_lines(rows)
    for r in rows:
        want = None if r["doc_text"] is None else "\n".join(x for k, x in enumerate(r["doc_text"].split("\n")) if (r["doc_id"], k) not in gone)
        assert cleaned[r["doc_id"]] == want


def test_the_tests_decide_which_lines_are_in_excess(spark):
    rows = []
    for i in range(80):
        site = "ab"[i // 40]
        k = i % 40
        lines = [f"unique {'abcdefghij'[k % 10]} {'klmn'[k // 10]} {site}"] + ["on all sites"] * (k < 20) + ["only here"] * (k < 20 and site == "a") + ["by chance"] * (k < 2)
        rows.append({"doc_id": i, "domain": f"{site}.example", "doc_text": "\n".join(lines)})
    df = documents(spark, rows)
    statistics = site_lines.line_statistics(site_lines.site_document_lines(df), df).where("pages > 1")
    assert statistics.count() == 5
    found = {(r["site"], r["pages"], r["outside_pages"]): r["excess"] for r in site_lines.significant_keys(statistics).collect()}
    # what isn't commoner than on other sites is held by the second test alone, what may be chance by none
    assert found == {("a.example", 20, 0): "site", ("a.example", 20, 20): "repeated", ("b.example", 20, 20): "repeated"}
    assert site_lines.excess_lines(df, min_pages=2, min_share=0.0).count() == 60


def test_site_lines_of_one_site_only(spark):
    rows = [{"doc_id": i, "domain": "a.example", "doc_text": f"Notice\nline {'xyzw'[i % 4] * (i + 1)}"} for i in range(40)]
    assert {(r["doc_id"], r["line_no"]) for r in site_lines.excess_lines(documents(spark, rows)).collect()} == {(i, 0) for i in range(40)}


def brute_caps(rows, ranked):
    n, keep = len(rows), set()
    by = defaultdict(list)
    for r in rows:
        if r["domain"]:
            by[r["domain"]].append(r)
    for s, group in by.items():
        cap = max(3, n // 50) if s in ranked else max(2, n // 100)
        group.sort(key=lambda r: (r["flags"] != 0, r["word_count"] is None, -(r["word_count"] or 0), r["doc_id"]))
        keep |= {r["doc_id"] for r in group[:cap]}
    return {r["doc_id"] for r in rows if r["domain"]} - keep


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_contributors(spark, spread):
    rng = random.Random(spread)
    # ids far apart, so that ties go over several ranges
    rows = [{"doc_id": i * 40000, "domain": rng.choice(["hot.example"] * 4 + ["b.example", "c.example", f"x{i}.example", None]), "flags": rng.choice([0, 0, 4]), "word_count": rng.choice([None, *range(spread)])} for i in range(700)]
    domains = spark.createDataFrame([(1, "https://www.HOT.example/", 5), (2, "b.example", None), (3, None, 7), (4, "hot.example", 9)], "id long, domain string, rank int").withColumn("site", F.lit("clash"))
    got = contributors.best_pages(documents(spark, rows), domains)
    assert {r["doc_id"] for r in got.where("not kept").collect()} == brute_caps(rows, {"hot.example"})


def test_reservoir(spark):
    rows = [{"doc_id": i, "domain": "a.example", "word_count": 1000 if i % 2 else 10} for i in range(1000)]
    domains = spark.createDataFrame([], "id long, domain string, rank int")
    df = documents(spark, rows)
    out = contributors.sampled_pages(df, domains).collect()
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert len(kept) == 10 and len(out) == 1000 and sum(i % 2 for i in kept) >= 8
    assert sorted(kept) == sorted(r["doc_id"] for r in contributors.sampled_pages(df, domains).where("kept").collect())
    cold = contributors.sampled_pages(df, domains, temperature=0.0).where("kept").collect()
    assert sorted(r["doc_id"] for r in cold) == [2 * i + 1 for i in range(10)]


def address(u):
    u = unquote(u)
    head, _, query = u.partition("?")
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    return plain(head), tuple(sorted(p for x in query.split("&") if (p := plain(x))))


def test_address_copies(spark):
    rng = random.Random(8)
    paths = ["http://a.example/x-y", "HTTP://A.example/x%2Dy/", "http://a.example/xy?b=1&a=2", "http://a.example/xy?a=2&&B=1#", "https://a.example/xy", "http://a.example/yx", "a%zz", "a%", "", "!!", "?&", "é?É=%C3%A9"]
    rows = [(i, rng.choice([None, *paths])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, uri string").withColumn("first_id", F.lit(1)).withColumn("_path", F.lit(""))
    classes = defaultdict(list)
    for i, u in rows:
        if u is not None:
            classes[address(u)].append(i)
    want = {(min(c), i, len(c)) for c in classes.values() for i in c if i != min(c)}
    assert {tuple(r) for r in copies.address_copies(df, "id").collect()} == want
    assert copies.address_copies(df.limit(0), "id").count() == 0


def test_address_records(spark):
    rows = [(5, "http://a.example/x"), (3, "HTTP://a.example/X/"), (7, "http://a.example/y"), (8, None), (9, "http://a.example/z?b&a"), (2, "http://a.example/z?a&b"), (1, "http://a.example/xa"), (4, "http://a.example/ax")]
    out = copies.address_records(spark.createDataFrame(rows, "id long, uri string"), "id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (2, 2), (3, 2), (4, 1), (7, 1)]


def test_formatting_copies(spark):
    rows = [(1, "A b", "c"), (2, "c!", "ab"), (3, "ba", "c"), (4, None, None), (5, "", " "), (6, "zz", None)]
    out = copies.formatting_copies(spark.createDataFrame(rows, "id long, x string, y string"), "id", ["x", "y"])
    assert {tuple(r) for r in out.collect()} == {(1, 2), (4, 2)}


ITEM = "Scholars of Tarn date the bell found at Vale to the year 1450 of the second calendar and nobody knows why"


def test_leaks_against_all_windows(spark):
    rng = random.Random(6)
    shared = "the of a date found year second bell guild sold north".split()
    items = [(i, " ".join(rng.choice(shared) if rng.random() < 0.6 else f"name{rng.randrange(200)}" for _ in range(40))) for i in range(25)] + [(98, None), (99, "too short")]
    docs = []
    for i in range(120):
        words = [rng.choice(shared) if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            source = items[rng.randrange(25)][1].split()
            start, k = rng.randrange(25), rng.choice([6, 11, 12, 13, 20])
            words[5:5] = [w.upper() + rng.choice(["", ",", "\n"]) for w in source[start : start + k]]
        docs.append({"doc_id": i, "text": "  ".join(words)})
    got = leaks.find_leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("exact_words", F.lit(0)))
    windows = defaultdict(set)
    for i, x in items:
        w = leaks.words_of(x)
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i)
    want = {(d["doc_id"], i) for d in docs for w in [leaks.words_of(d["text"])] for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in got.where("exact_words > 0").collect()} == want and want
    blocks = leaks.find_leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_items=7)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.where("exact_words > 0").collect()} == want


def test_reparameterised_items(spark):
    others = [(2, "Scholars of Fenn date the coin found at Moor to the year 1200 of the second calendar"), (1, ITEM)]
    docs = [
        {"doc_id": 1, "text": ITEM.replace("1450", "1777").replace("Tarn", "Quill")},
        {"doc_id": 2, "text": "x " + ITEM.lower() + " y"},
        {"doc_id": 3, "text": "Nothing of the kind is written here, and it is long enough to hold a window."},
    ]
    rows = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(documents(spark, docs), spark.createDataFrame(others, "item_id long, text string")).collect()}
    assert rows[1, 1]["exact_words"] in (0, 12) and rows[1, 1]["template_words"] >= 12
    assert rows[2, 1]["exact_words"] == len(ITEM.split()) and not any(d == 3 for d, _ in rows)


def test_slots_are_filled_one_to_one():
    item = "in the year 1450 the guild of Tarn sold the bell of Tarn to the guild of Moor for 60 marks"
    index = leaks.ItemIndex([(1, item)])
    assert all(index.template[w] == leaks.NAME for w in ("tarn", "moor")) and index.template["marks"] == leaks.UNIT and index.template["guild"] >= leaks.OWN
    there = leaks.words_of(item)

    def longest(text):
        return index.longest_consistent(leaks.words_of(text), there)

    n = len(there)
    assert longest(item) == n and longest(item.replace("Tarn", "Quill").replace("1450", "1777").replace("marks", "euros")) == n
    # the second Tarn became another name, or two names became one: only the part between the contradiction fits
    assert longest(item.replace("Tarn", "Quill", 1)) == 13 and longest(item.replace("Moor", "Tarn")) < n
    # a number for a name, or another word of its own, is no re-parameterised item
    assert longest(item.replace("Tarn", "77")) == 0 and longest(item.replace("bell", "barn")) < 13


def test_unknown_words_in_lower_case_are_no_names():
    index = leaks.ItemIndex([(1, "in the year 1450 the guild of Tarn sold the bell of Moor to them")])
    for text, found in (("In the year 1600 the guild of Quill sold the bell of Ashby to them", True), ("in the year 1600 the guild of quill sold the bell of ashby to them", False)):
        h = index.hashes(*index.codes(leaks.words_of(text), text))
        assert bool(np.isin(h[h != 0], index.known).any()) == found


def test_templates_do_not_depend_on_blocks(spark):
    rng = random.Random(9)
    shared = "the of a date found year second bell guild sold north".split()
    items = [(i, " ".join(rng.choice(shared) if rng.random() < 0.6 else f"Name{rng.randrange(60)}" for _ in range(30))) for i in range(12)]
    docs = []
    for i in range(60):
        words = items[i % 12][1].split()
        docs.append({"doc_id": i, "text": " ".join(f"Other{i}" if w.startswith("Name") and rng.random() < 0.5 else w for w in words)})
    df, its = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (sorted(tuple(r) for r in leaks.find_leaks(df, its, block_items=n).collect()) for n in (100, 4))
    assert whole == cut and whole


def test_odd_rows(spark):
    df = documents(spark, ODD)
    domains = spark.createDataFrame([(1, None, None)], "id long, domain string, rank int")
    items = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, "")], "item_id long, text string")
    for d in (df, df.limit(0)):
        site_lines.without_excess_lines(d).collect()
        assert site_lines.excess_lines(d).count() == 0
        contributors.best_pages(d, domains).collect()
        contributors.sampled_pages(d, domains).collect()
        copies.address_copies(d, "doc_id").collect()
        assert leaks.find_leaks(d, items).count() == 0 and leaks.find_leaks(d, items.limit(0)).count() == 0
