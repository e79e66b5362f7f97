import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import arrays, bitmask, links, scores
from webloom.functions.analysis import stem, stem_table, weighted_vector
from webloom.functions.text import collapse_space, word_count
from webloom.functions.uri import percent_decode, site, uri_host
from webloom.operators import frontier, graph, layout, maintenance, postings, search, signals, titles
from webloom.plans.written import written
from webloom.sources import imports
from webloom.streaming import crawl


def one(spark, column, *values, schema=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema or "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_text(spark):
    assert one(spark, word_count(F.col("x")), None, "", "  \n", "a", "a b\tc ", "\x1ca") == [None, 0, 0, 1, 3, 1]
    assert one(spark, collapse_space(F.col("x")), " a   b\r\n") == ["a b"]


def test_sites(spark):
    values = [None, "", " ", "A.Example", "https://www.a.example:443/", "www.a.example.", "http://a.example/x?y", "a.example:80", "www."]
    assert one(spark, site(F.col("x")), *values) == [None, None, None, "a.example", "a.example", "a.example", "a.example", "a.example", "www"]
    assert one(spark, uri_host(F.col("x")), "\t HTTPS://WWW.A.example/b", "//a", "mailto:x", None) == ["a.example", None, None, None]
    assert one(spark, percent_decode(F.col("x")), "a%2Db%zz%", "%C3%A9+", None) == ["a-b%zz%", "é+", None]


@pytest.mark.parametrize(
    ("uri", "ok", "normal"),
    [
        ("https://a.example/x/", True, "https://a.example/x"),
        ("http://a.example/x.PDF", False, "http://a.example/x.PDF"),
        ("ftp://a.example/x", False, "ftp://a.example/x"),
        ("https://www.reddit.com/r", False, "https://www.reddit.com/r"),
        ("https://notreddit.com/r", True, "https://notreddit.com/r"),
        ("https://en.wikipedia.org/wiki/A", False, "https://en.wikipedia.org/wiki/A"),
        ("https://a.example/2014/", False, "https://a.example/2014"),
        ("https://a.example/b//2014/05", False, "https://a.example/b//2014/05"),
        ("https://a.example/2014/post", True, "https://a.example/2014/post"),
        ("https://a.example/Tag/b", False, "https://a.example/Tag/b"),
        ("https://x.neocities.org/site/y", False, "https://x.neocities.org/site/y"),
        ("https://a.example?x#y", True, "https://a.example"),
        ("https://new.reddit.com/a#b", False, "https://old.reddit.com/a"),
        ("https://user@a.example:8080/x", True, "https://user@a.example:8080/x"),
        ("mailto:x", False, "mailto:x"),
    ],
)
def test_links(spark, uri, ok, normal):
    assert one(spark, links.acceptable_link(F.col("x")), uri) == [ok]
    assert one(spark, links.normalized_uri(F.col("x")), uri) == [normal]


def test_robots(spark):
    rows = [("/a/b", ["/a"], ["/"]), ("/b", ["/a"], ["/"]), ("/b", [], [""]), ("/b", None, None), ("/b", [], ["/c"])]
    df = spark.createDataFrame(rows, "p string, allow array<string>, deny array<string>")
    assert [r[0] for r in df.select(links.robots_allowed(F.col("p"), F.col("allow"), F.col("deny"))).collect()] == [True, False, True, True, True]
    text = "User-agent: other\nDisallow: /x\n\nUser-agent: *\nUser-agent: z\nDisallow: /y # c\nDisallow:\nAllow: /y/z\n"
    assert imports.robots_rules(text, "me") == (["/y/z"], ["/y"])
    parsed = imports.parsed_robots(spark.createDataFrame([("a", text), ("b", None)], "domain string, robots_txt string"), "me")
    assert {r["domain"]: (r["rules"]["allow"], r["rules"]["disallow"]) for r in parsed.collect()} == {"a": (["/y/z"], ["/y"]), "b": ([], [])}


def test_distance_arrays(spark):
    rows = [([1, None, 3], [2, 2, None]), ([None, None, None], [1, 2, 3]), ([1, 1, 1], [1, 1, 1]), ([1, 2, 3], [2, 3, 4])]
    df = spark.createDataFrame(rows, "a array<smallint>, b array<smallint>")
    a, b = F.col("a"), F.col("b")
    out = df.select(arrays.least(a, b), arrays.is_ancestor(a, b), arrays.cardinality(a), arrays.increased(a), arrays.all_true(arrays.all_less(a, b))).collect()
    assert [tuple(r) for r in out] == [
        ([1, 2, 3], True, 2, [2, None, 4], True), ([1, 2, 3], False, 0, [None, None, None], None), ([1, 1, 1], False, 3, [2, 2, 2], False), ([1, 2, 3], True, 3, [2, 3, 4], True)
    ]
    assert spark.range(1).select(arrays.one_hot(F.lit(1), 3), arrays.null_distance(2)).first() == ([None, 0, None], [None, None])


def test_bits(spark):
    assert one(spark, bitmask.names(F.col("x"), bitmask.DocumentFlag), 0, 5, 258, schema="i int, x long") == [[], ["disallowed_by_robots", "news"], ["prohibited_uri", "ads"]]


def test_stratify(spark):
    out = one(spark, scores.stratify(F.col("x"), (100, 1000)), 0, 50, 100, 550, 999, 1000, None, schema="i int, x long")
    assert out[0] == 0 and out[1] == 0.25 and out[2] == 0.5 and out[3] == 0.75 and 0.99 < out[4] < 1 and out[5:] == [None, None]


def test_titles(spark):
    out = one(spark, titles.title_segments(F.col("x")), "a. - b", "a - b: c | d. e", "  ", "x — y «z» > w", None)
    assert out == [["a.", "b"], ["a", "b", "c", "d", "e"], [], ["x", "y", "z", "w"], None]


def test_insert_update(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, k string, v int")
    new = spark.createDataFrame([("b", 7), ("c", 8), ("c", 8)], "k string, v int")
    got = maintenance.get_or_insert(old, new, "id", "k")
    assert sorted(map(tuple, got.collect())) == [(2, "b"), (3, "c")]
    assert sorted(map(tuple, maintenance.upsert(old, new.withColumn("id", F.lit(9).cast("long")), ["k"], ["v"]).collect())) == [(1, "a", 5), (2, "b", 7), (9, "c", 8)]
    found = maintenance.mark_discovered(spark.createDataFrame([(1, False, None), (2, False, None), (3, True, 4)], "id long, dead boolean, canonical long"), spark.createDataFrame([(1, 10), (2, None)], "id long, canonical long"))
    assert sorted(map(tuple, found.collect())) == [(1, False, 10), (2, True, None), (3, True, 4)]
    many = spark.range(5000).select((F.col("id") * 3).cast("string").alias("k"))
    ids = [r[0] for r in maintenance.with_new_ids(many, old, "id", ["k"]).select("id").collect()]
    assert sorted(ids) == list(range(3, 5003))


def test_graph_against_search(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    pairs += pairs[:9] + [(1, None), (None, 2)]
    start = {0: 0, 7: 1}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    begin = spark.createDataFrame([(n, s, 0) for n, s in start.items()], "node long, slot int, hops int")
    got = {(r["node"], r["slot"]): r["hops"] for r in graph.relax_distances(begin, edges, 2).collect()}
    want = {}
    for n, s in start.items():
        level, seen, k = {n}, {n}, 0
        while level:
            want |= {(x, s): k for x in level}
            level = {b for a, b in pairs if a in level and b is not None} - seen
            seen |= level
            k += 1
    assert got == want
    back = spark.createDataFrame([(b, a) for a, b in set(pairs) if a is not None and b is not None], "dst long, src long")
    closure = {r["node"]: (r["level"], r["parent"]) for r in graph.reverse_closure(back, spark.createDataFrame([(9,)], "node long")).collect()}
    for node, (level, parent) in closure.items():
        assert (level == 0) == (parent is None) and (parent is None or closure[parent][0] == level - 1)


def test_search_forms_agree(spark, tmp_path):
    words = "oak board lamp letter the of rain".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))) if i % 7 else None, f"https://s{i % 3}.example/{i}", i % 4 // 3, i % 5 or None, i) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uri string, flags long, js int, css int")
    postings.write_postings(postings.build_postings(docs), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for q in ["oak", '"board the lamp"', '"the oak of"', "oak lamp", '"oak board"', "oak OR rain -lamp", "-oak", "site:s1 -letter", "with:js>2 oak", "the", "-the", '""', "(oak OR site:s2) where:css<40"]:
        a = sorted(r[0] for r in search.matching(docs, q).select("doc_id").collect())
        assert a == sorted(r[0] for r in search.matching_by_sets(docs, q).collect()), q
        assert a == sorted(r[0] for r in postings.search_postings(index, docs, q).collect()), q
    assert search.matching(docs, "the").count() == 0 and search.matching(docs, "-the").count() == 60
    assert [r[0] for r in search.matching(docs, "oak").select("doc_id").orderBy("doc_id").collect()] == [i for i, x, _, f, *_ in rows if not f and "oak" in (x or "").split()]


def cover_density(words, units):
    """Brute force: units are tuples of words; a stretch counts when its beginning moves."""
    total, before = 0.0, -1
    last = {}
    for i in range(len(words)):
        for u in units:
            if i + 1 >= len(u) and tuple(words[i + 1 - len(u) : i + 1]) == u:
                last[u] = i + 1 - len(u)
                if len(last) == len(units) and min(last.values()) > before:
                    before = min(last.values())
                    total += len(units) / (i - before + 1)
    return total


def test_cover_density(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdx") * 2 for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for text, branches in (("aa bb", [[("aa",), ("bb",)]]), ("aa OR bb", [[("aa",)], [("bb",)]]), ('cc "aa bb"', [[("cc",), ("aa", "bb")]]), ("(aa OR bb) cc -dd", [[("aa",), ("cc",)], [("bb",), ("cc",)]])):
        got = {r["doc_id"]: r["ranking"] for r in search.ranked(df, text).collect()}
        want = {i: sum(cover_density(w, u) for u in branches) / max(len(w), 1) for i, t in rows for w in [(t or "").split()]}
        assert got == pytest.approx(want)
    one = spark.createDataFrame([(1, "kettle", "a kettle and boats")], "doc_id long, title string, text string")
    by_label = search.ranked(one, "kettle", sections=[("A", "title"), ("D", "text")], normalisation=0).first()["ranking"]
    assert by_label == pytest.approx(1.1) and search.ranked(one, "boat", stemmed=True, normalisation=search.TO_ONE).first()["ranking"] == 0.5


def test_snippet():
    text = " ".join(f"w{i}" for i in range(40)) + " Lamp! " + "x " * 30
    assert "<b>Lamp!</b>" in search.snippet(text, ["lamp"]) and len(search.snippet(text, ["lamp"]).split()) <= 12
    assert search.snippet(None, ["a"]) == "" and search.snippet("a b", ["z"]) == "a b"


def test_analysis(spark):
    assert stem("running") == stem("runs") == "run" and stem("cats") == "cat" and stem("is") == "is"
    table = stem_table(spark.createDataFrame([("cats",), ("cats",), (None,)], "word string"))
    assert [tuple(r) for r in table.collect()] == [("cats", "cat")]
    df = spark.createDataFrame([("The lamp", None, "an oak")], "a string, b string, c string")
    out = df.select(weighted_vector([("A", F.col("a")), ("B", F.col("b")), ("C", F.col("c"))])).first()[0]
    assert [tuple(e) for e in out] == [("lamp", 1, "A"), ("oak", 3, "C")]


def test_overlaps_against_pairs(spark):
    rng = random.Random(3)
    boxes = [(i, rng.randrange(900), rng.randrange(900), rng.randrange(0, 150), rng.randrange(1, 90)) for i in range(60)]
    df = spark.createDataFrame(boxes, "id long, x int, y int, w int, h int")
    got = {tuple(r) for r in layout.overlaps(df, df).collect()}
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[3] and b[3] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]}
    assert got == want


def test_layout_of_equal_scores(spark):
    rows = [(i, f"title {i}", 100, 5, 5, None, float(i)) for i in range(30)] + [(99, " ", 100, 5, 5, None, 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, title string, word_count int, js int, css int, popularity int, ranking double")
    boxed = layout.boxes(layout.scored(df))
    out = layout.placed(boxed).collect()
    assert 0 < len(out) <= 30 and all(0 <= r["left"] <= 1920 for r in out) and 99 not in {r["doc_id"] for r in out}
    assert layout.placed(boxed.limit(0)).count() == 0


def test_frontier(spark):
    rows = [(1, "u", 3, False, None), (2, "v", 1, False, None), (3, "w", 0, True, None), (4, "x", 0, False, 7)]
    df = spark.createDataFrame(rows, "id long, uri string, depth int, dead boolean, canonical long")
    assert [r["id"] for r in frontier.next_to_explore(df, 5, seed=1).collect()] == [2, 1]
    assert frontier.next_to_explore(df, 1).first()["id"] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,a.example\nx,b.example\n3,c.example,more\n4\n5,d.example\n")
    assert sorted(map(tuple, imports.popularity_csv(spark, str(tmp_path / "p.csv")).collect()))[:1] == [(1, "a.example")]
    answers = spark.createDataFrame([('{"GlobalRank": {"Rank": 12}}', 200), ("{}", 200), ("broken", 200), ('{"GlobalRank": {"Rank": 9}}', 404)], "body string, status int")
    assert [r["rank"] for r in imports.popularity_answers(answers).collect()] == [12, None, None, None]
    probes = spark.createDataFrame([("https://a.example/", 404, None), ("http://a.example/", 200, None), ("https://b.example/", 301, "https://c.example/")], "uri string, status int, location string")
    uris = spark.createDataFrame([("http://a.example/",), ("https://b.example/",), ("http://z.example/",)], "uri string")
    assert {r["uri"]: r["available"] for r in imports.available_uris(uris, probes).collect()} == {"http://a.example/": "http://a.example/", "https://b.example/": "https://c.example/", "http://z.example/": None}


def test_indexing_stream(spark, tmp_path):
    html = b"<title>T</title><body><h1>H</h1><article>one two</article><a href='/p'>x</a><a href='/tag/y'>y</a></body>"
    rows = [("https://a.example/1", dt.datetime(2024, 1, 1), [("Content-Type", "text/html; charset=x")], html), ("https://a.example/1", dt.datetime(2024, 1, 2), [], html), (None, None, [], b"")]
    store, docs, out = (str(tmp_path / n) for n in ("store", "documents", "links"))
    imports.write_pages(spark.createDataFrame(rows, imports.FETCHED_SCHEMA), store)
    assert sorted(r["content_type"] or "" for r in imports.read_pages(spark, store).collect()) == ["", "text/html"]
    for _ in range(2):
        crawl.start_indexing(crawl.page_stream(spark, store), docs, out, str(tmp_path / "checkpoint")).awaitTermination()
        imports.write_pages(spark.createDataFrame(rows[:1], imports.FETCHED_SCHEMA), store)
    found = spark.read.parquet(docs).collect()
    assert [(r["title"], r["word_count"], r["flags"]) for r in found] == [("T", 4, 0)]
    assert [r["target"] for r in spark.read.parquet(out).collect()] == ["https://a.example/p"]


def test_assets(spark):
    rows = [("u", ["j", "k"], ["c"], 5, 0), ("v", [], [], 1, 2)]
    s = spark.createDataFrame(rows, "uri string, scripts array<string>, styles array<string>, script_chars long, style_chars long")
    assets = spark.createDataFrame([("j", 100), ("c", 7)], "uri string, size long")
    assert sorted(map(tuple, signals.asset_sizes(s, assets).collect())) == [("u", 105, 7), ("v", 1, 2)]
    assert [r[0] for r in signals.missing_assets(s, assets).collect()] == ["k"]


def test_written(spark):
    assert sorted(r[0] for r in written(spark.range(5)).collect()) == list(range(5))


def test_fixpoints_are_never_cut_silently(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    begin = spark.createDataFrame([(0, 0, 0)], "node long, slot int, hops int")
    assert graph.relax_distances(begin, chain, 1).count() == 6 and graph.relax_distances(begin, chain, 1, max_rounds=5).count() == 6
    back = chain.selectExpr("src as dst", "dst as src")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.reverse_closure(back, start).count() == 6 and graph.reverse_closure(back, start, max_rounds=5).count() == 6
    with pytest.raises(RuntimeError):
        graph.relax_distances(begin, chain, 1, max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.reverse_closure(back, start, max_rounds=3)
