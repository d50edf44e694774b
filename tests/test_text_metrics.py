"""Text metrics against plain Python, and what their plans evaluate once per row."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webgauge.functions.text import WS_CHARS, plain_spaces
from webgauge.operators import content
from webgauge.plans import catalog

TEXTS = [
    None, "", " ", "a", "rhythm nth", "naïve Don't don't DON'T x_y x_y 007 7 7 707 707 İstanbul Kelvin KELVIN",
    "b c　d\tqueue-ing [sky]^{cry} hmm\u0085psst 😀a😀", "123 4294967295 4294967294 9999999999 00123 abc 123 abc",
    " ".join(f"w{i:03d}" for i in range(40)), "über-äußerst наука наука 漢字漢字 漢字漢字",
]
BLANK = re.compile(f"[{WS_CHARS}]+")


def expected(text):
    words = [w for w in BLANK.split(text) if w]
    lower = [w.replace("İ", "i̇").lower() for w in words]
    syllables = sum(max(1, len(re.findall("[aeiouy]+", w))) for w in lower)
    bare = [w for w in (re.sub("[^a-z0-9_]", "", w) for w in lower) if len(w) > 2]
    first = {w: i for i, w in reversed(list(enumerate(bare)))}

    def key(item):
        word, n = item
        index = re.fullmatch("0|[1-9][0-9]{0,9}", word) and int(word) < 4294967295
        return (-n, 0, int(word)) if index else (-n, 1, first[word])

    top = sorted(Counter(bare).items(), key=key)[:10]
    return len(words), syllables, [(w, n, n / len(words) * 100) for w, n in top]


def test_metrics_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {r.doc_id: r for r in content.with_text_metrics(df, "text").collect()}
    assert (rows[0].word_count, rows[0].syllable_count, rows[0].top_keywords) == (None, None, [])
    for i, text in enumerate(TEXTS[1:], 1):
        got = rows[i].word_count, rows[i].syllable_count, [tuple(k) for k in rows[i].top_keywords]
        assert got == expected(text), text


@pytest.mark.parametrize("unicode", [False, True])
def test_words_are_counted_once_per_text(spark, unicode):
    """Selected alone, the word count is used once, so the optimizer would move it into the function of each entry."""
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    keywords = content.with_text_metrics(df, "text", unicode_keywords=unicode).select("top_keywords")
    plan = keywords._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[plan.index("density,") :]


def test_white_space_becomes_blanks(spark):
    text = "".join(chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000)
    df = spark.createDataFrame([(text,), (None,)], "t string").select(plain_spaces(F.col("t")))
    assert [r[0] for r in df.collect()] == [text.translate(dict.fromkeys(map(ord, WS_CHARS), " ")), None]


def test_words_are_bared_by_a_quick_class(spark):
    """The class of spelled-out ranges took more than half of the time of all metrics."""
    plan = spark.range(1).select(content.keyword_counts(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "a-z0-9_" not in plan and "translate(" not in plan


def test_document_keywords_measure_only_what_they_return(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(catalog, "materialize", lambda df: stored.append(df) or df)
    catalog.document_top_keywords(spark, "/root/testdata/sf0.001")
    assert stored[0].columns == ["doc_id", "top_keywords"]
    assert "aeiouy" not in stored[0]._jdf.queryExecution().optimizedPlan().toString()


def test_document_metrics_store_only_their_columns(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(catalog, "materialize", lambda df: stored.append(df) or df)
    assert catalog.document_metrics(spark, "/root/testdata/sf0.001").columns == stored[0].columns
    assert "top_keywords" not in stored[0].columns
