"""Documents for the tests of the training-data operators."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, uri string, domain string, source string, title string, text string, doc_text string, word_count int, flags long, site string, node long, body string, line_no long, key string"
)
PROSE = "We walked along the canal until the lock, where an old man was mending his net. He said that the eels had not come back since the flood. I did not believe him, but I bought the smoked ones anyway."


def documents(spark, rows):
    """rows: dicts with any of the columns; the last five columns are clashing extras."""
    full = []
    for i, r in enumerate(rows):
        base = {c.split()[0]: None for c in SCHEMA.split(", ")} | {"doc_id": i, "flags": 0, "site": "clash", "node": -1, "body": "clash", "line_no": 7, "key": "clash"} | r
        if base["text"] is None and "text" not in r:
            base["text"] = base["doc_text"]
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, SCHEMA)


#: Rows with a null in every column, empty, blank, very long and repeated texts.
ODD = [
    {"doc_id": None, "doc_text": "x", "uri": "https://a.example/0", "domain": "a.example"},
    {"doc_text": None},
    {"doc_text": ""},
    {"doc_text": " \r\n\t\n  "},
    {"doc_text": "word " * 40000, "domain": "big.example", "uri": "https://big.example/1"},
    {"doc_text": "x" * 100000, "domain": "big.example"},
    {"doc_id": 9, "doc_text": PROSE, "domain": "a.example", "uri": "https://a.example/1", "title": "T", "source": "s", "word_count": 3},
    {"doc_id": 9, "doc_text": PROSE, "domain": "a.example", "uri": "https://a.example/1", "title": "T", "source": "s", "word_count": 3},
    {"doc_text": "퟿\x00  é", "domain": "  ", "uri": "not an address", "title": "  "},
]
