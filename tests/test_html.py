from webloom.functions import html as H
from webloom.functions.bitmask import DocumentFeature, DocumentFlag


def tree(text):
    return H.serialise(H.parse(text))


def test_trees():
    assert tree("<p>a<p>b") == "<p>a</p><p>b</p>"
    assert tree("<p><b><p>a") == "<p><b><p>a</p></b></p>"
    assert tree("<ul><li>a<li>b</ul>c") == "<ul><li>a</li><li>b</li></ul>c"
    assert tree("a<br>b<img src=x>") == 'a<br>b<img src="x">'
    assert tree("a</b>c</div>") == "ac"
    assert tree("<div><i>a</div>b") == "<div><i>a</i></div>b"
    assert tree("<!doctype html><!-- x -->a") == "a"
    assert tree("<script>var t='</p>'</script>") == "<script>var t='</p>'</script>"
    assert tree("") == ""


def test_content_order_and_exclusions():
    page = "<body><div class='x content y'><h1>no</h1>yes<ul><li>no</ul><sub>no</sub></div><article>later</article></body>"
    assert H.first_filled(H.parse(page), H.CONTENT) == "yes"
    assert H.first_filled(H.parse("<div id=content></div><td class=mainsection>t</td>"), H.CONTENT) == "t"
    assert H.first_filled(H.parse("x"), H.CONTENT) == ""
    assert H.first_filled(H.parse("<div id=comments>c</div>"), H.COMMENTS) == "c"


def test_signals():
    page = """<html><head><title> A  page </title><link rel=canonical href="https://a.example/x"><link rel=stylesheet href="/s.css">
    <style>ab</style><script src="j.js">cde</script><meta name=generator content="Discourse 2"></head>
    <body><h2>two</h2><h1>one</h1><a href="/p?q=1">l</a><a href="http://b.example/">m</a><a>n</a><img src="a.gif"><img src="b.png">
    <blockquote class="twitter-tweet"></blockquote><code>x</code><span class="MathJax">y</span></body></html>"""
    s = H.page_signals("https://a.example/dir/x", page)
    assert s["title"] == "A  page" and s["headings"] == "one two" and s["canonical"] == "https://a.example/x"
    assert s["links"] == ["http://b.example/", "https://a.example/p?q=1"]
    assert s["scripts"] == ["https://a.example/dir/j.js"] and s["styles"] == ["https://a.example/s.css"]
    assert (s["script_chars"], s["style_chars"], s["tweets"], s["gifs"]) == (3, 2, 1, 1)
    assert s["features"] == int(DocumentFeature.MATH | DocumentFeature.CODE | DocumentFeature.FORUM) and s["flags"] == 0


def flags(inner, host="a.example"):
    return H.pollution(H.parse(inner), host)


def test_pollution():
    ld = '<script type="application/ld+json">{}</script>'
    assert flags(ld.replace("{}", '{"@type": "NewsArticle"}')) == DocumentFlag.NEWS
    assert flags(ld.replace("{}", '{"@type": "NewsArticle"}'), "x.substack.com") == 0
    assert flags(ld.replace("{}", '{"@type": "Product"}')) == DocumentFlag.SHOPPING
    assert flags(ld.replace("{}", '[{"@type": "Product"}]')) == 0
    assert flags(ld.replace("{}", "{broken")) == 0
    assert flags(ld.replace("{}", '{"isAccessibleForFree": false}')) == DocumentFlag.PAYWALLED
    assert flags(ld.replace("{}", '{"isAccessibleForFree": "False"}')) == 0
    assert flags(ld.replace("{}", '{"hasPart": {"isAccessibleForFree": false}}')) == DocumentFlag.PAYWALLED
    for sign in H.AD_SIGNS:
        assert flags(f"<script>{sign}</script>") == DocumentFlag.ADS
    assert flags('<script src="https://x/adsbygoogle.js"></script>') == DocumentFlag.ADS
    assert flags("".join(f"<h2>{i}. thing</h2>" for i in range(1, 6))) == DocumentFlag.LISTICLE


def test_numbered_list():
    assert H.numbered_list(["1. a", "2. b", "3. c", "4. d"])
    assert H.numbered_list(["5 a", "4 b", "3 c", "x", "2 d", "1 e"])
    assert not H.numbered_list(["1: a", "2: b", "3: c"])
    assert not H.numbered_list(["2001 a", "2002 b", "2003 c", "2004 d"])
    assert not H.numbered_list(["1", "3", "6", "10", "15"])
    assert not H.numbered_list(["1", "1", "1", "1", "2", "3", "4"])
    assert not H.numbered_list([])
