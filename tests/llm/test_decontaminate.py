import hashlib
import re

import pytest
from pyspark.sql import types as T

from webgauge.llm.decontaminate import decontaminate, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("match", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """Every window of every item against every place of every document."""
    windows = {}
    for item, text in items:
        words = words_of(text) if item is not None else []
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if words else []:
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for k in range(len(words)):
            for size in sizes:
                if k + size <= len(words) and (items_here := windows.get(tuple(words[k : k + size]))):
                    found |= items_here
                    hit |= set(range(k, k + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "match.n_words", "match.n_hit", "match.n_items", "match.items_sha256", "match.contaminated").collect()], key=repr)


CASES = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "x ONE, two. three four five six seven eight nine ten y"),
    (3, "short ITEM!"),
    (3, "short ITEM!"),
    (4, None),
    (None, "a short item again and one two three"),
    (5, ""),
    (6, "... --- "),
    (7, "é É ü " * 30 + "short"),
    (8, "item one two three four five six seven eight nine ten eleven"),
    (9, ("the " * 50 + "end ") * 400),
    (10, "words " * 5 + "W" * 200_000 + " short item"),
    (11, "short"),
    (12, "item"),
]
BENCH = [
    (1, "One two three four five six seven eight nine ten eleven."),
    (10, "short item"),
    (2, None),
    (None, "a short item again"),
    (3, ""),
    (4, "the " * 12),
    (5, "é É ü é É ü é É ü é É ü"),
    (10, "six seven"),
]


@pytest.mark.parametrize("block_chars", [8_000_000, 30])
def test_equals_brute_force_on_odd_rows(spark, block_chars):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in CASES], DOCS)
    bench = spark.createDataFrame(BENCH, ITEMS)
    found = find_matches(docs, bench, block_chars=block_chars)
    assert rows(found) == brute(CASES, BENCH)
    assert found.columns == ["doc_id", "text", "match"]


def test_equals_brute_force_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "benchmark"))
    text = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(text, [(r.item_id, r.text) for r in bench.collect()])
    assert rows(find_matches(docs, bench)) == expected
    clean = {r[0] for r in expected if not r[5]}
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == clean
    assert decontaminate(docs, bench).columns == docs.columns


def test_longest_match_and_ranges(spark):
    docs = spark.createDataFrame([(1, "p q a b c d e f g h i j k l r s", "")], DOCS)
    bench = spark.createDataFrame([(7, "z a b c d e f g h i j k l y")], ITEMS)
    match = find_matches(docs, bench).first().match
    assert match.longest.asDict() == {"item_id": "7", "item_word": 1, "doc_word": 2, "words": 12}
    assert match.hit_ranges == [[2, 14]]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a b", "")], DOCS)
    assert find_matches(docs, bench).count() == 0
    assert find_matches(full, bench).first().match.n_words == 2
    assert decontaminate(full, bench).count() == 1
