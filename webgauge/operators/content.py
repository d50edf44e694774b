"""Content metrics of a text, in the row: no page's words are exploded or shuffled."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.html import HEADINGS, text_of
from webgauge.functions.text import count_of, let, plain_spaces, round_half_up, utf16_length

THIN_CONTENT_WORDS = 300
TOP_KEYWORDS = 10


def word_list(plain: Column) -> Column:
    """Words of a text whose white space is blanks only."""
    return F.filter(F.split(plain, " "), lambda w: w != "")


def sentence_count(plain: Column) -> Column:
    """Stretches between sentence marks that hold more than white space."""
    return count_of(plain, "[^.!? ][^.!?]*")


def syllable_count(lower: Column) -> Column:
    """Vowel groups, and one for each word without any.

    Groups are counted by the length that their last letters take away, as a list of all matches costs more.
    """
    groups = F.length(lower) - F.length(F.regexp_replace(lower, "[aeiouy](?![aeiouy])", ""))
    return groups + count_of(F.concat(F.lit(" "), lower), r" [^ aeiouy]++(?= |\z)")


def keyword_counts(lower: Column, unicode: bool = False) -> Column:
    """``array<struct<word, count, first>>`` of words longer than two characters, unordered.

    Words are lower case without anything but ASCII letters, digits and ``_`` (``unicode`` keeps all
    letters and digits). Sorting the words once brings equal ones together, so counting is a matter of
    run starts: n log n per text, whatever its vocabulary.
    """
    # ``\w`` is ``a-z0-9_`` here, as lower case leaves no other ASCII letters; spelled out, the ranges are ten times slower.
    kept = r"\p{L}\p{N}_" if unicode else r"\w"
    bare = F.regexp_replace(lower, f"[^{kept} ]+", "")
    words = F.filter(F.split(bare, " "), lambda w: F.length(w) > 2)
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def run_starts(ws: Column) -> Column:
        at = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 0) | (F.get(ws, i)["word"] != F.get(ws, i - 1)["word"]))

    def count(ws: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, j: F.struct(
                F.get(ws, start)["word"].alias("word"),
                (F.coalesce(F.get(starts, j + 1), F.size(ws)) - start).alias("count"),
                F.get(ws, start)["at"].alias("first"),
            ),
        )

    return let(placed, lambda ws: let(run_starts(ws), lambda starts: count(ws, starts)))


def top_keywords(counts: Column, words: Column, n: int = TOP_KEYWORDS) -> Column:
    """The ``n`` most frequent keywords with their share of all words in percent.

    Ties: words that look like array indexes come first in numeric order, then first appearance.
    """

    def sort_key(k: Column) -> Column:
        # Only digits come before ":"; few words reach the regex.
        digits = (k["word"] < ":") & k["word"].rlike("^(?:0|[1-9][0-9]{0,9})$")
        index = F.when(digits & (k["word"].try_cast("bigint") < 4294967295), k["word"].try_cast("bigint"))

        def key(i: Column) -> Column:
            return F.struct(
                (-k["count"]).alias("rank"),
                i.isNull().alias("plain"),
                F.coalesce(i, k["first"].cast("bigint")).alias("tie"),
                k["word"].alias("word"),
            )

        return let(index, key)

    def entries(ranked: Column, total: Column) -> Column:
        def entry(k: Column) -> Column:
            count = -k["rank"]
            return F.struct(k["word"].alias("word"), count.alias("count"), (count / total * 100).alias("density"))

        return F.transform(ranked, entry)

    def best(all_counts: Column) -> Column:
        # Only words that reach the n-th highest count are ranked; all ties stay in.
        bound = F.coalesce(F.get(F.sort_array(all_counts["count"], asc=False), F.lit(n - 1)), F.lit(0))
        reached = let(bound, lambda b: F.filter(all_counts, lambda k: k["count"] >= b))
        return F.slice(F.sort_array(F.transform(reached, sort_key)), 1, n)

    ranked = let(counts, best)
    return let(words, lambda total: entries(ranked, total))


@lru_cache
def _plain(name: str) -> dict[str, Column]:
    plain = plain_spaces(F.col(name))
    return {"_plain": plain, "_lower": F.lower(plain)}


@lru_cache
def _counted(name: str, target_keyword: str | None, unicode_keywords: bool) -> list[Column]:
    plain, lower = F.col("_plain"), F.col("_lower")
    columns = [
        F.size(word_list(plain)).alias("word_count"),
        utf16_length(F.col(name)).alias("character_count"),
        sentence_count(plain).alias("sentence_count"),
        syllable_count(lower).alias("syllable_count"),
        keyword_counts(lower, unicode_keywords).alias("keyword_counts"),
    ]
    if target_keyword:
        hits = F.filter(word_list(lower), lambda w: F.contains(w, F.lit(target_keyword.lower())))
        columns.append(F.size(hits).alias("target_count"))
    return columns


@lru_cache
def _measured(name: str, target_keyword: str | None) -> dict[str, Column]:
    known, words = F.col(name).isNotNull(), F.col("word_count").cast("double")

    def per_word(x: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), words), F.lit(0.0))

    sentence_length = F.coalesce(F.try_divide(words, F.col("sentence_count").cast("double")), F.lit(0.0))
    ease = 206.835 - (F.lit(1.015) * sentence_length) - (F.lit(84.6) * per_word(F.col("syllable_count")))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease))
    best = F.coalesce(F.get("top_keywords", F.lit(0))["density"], F.lit(0.0))
    share = per_word(F.col("target_count")) * 100 if target_keyword else best
    return {
        "readability": F.when(known, round_half_up(clamped, 1)),
        "keyword_density": F.when(known, round_half_up(share, 1)),
        "average_sentence_length": F.when(known, round_half_up(sentence_length, 1)),
        "average_word_length": F.when(known, round_half_up(per_word(F.col("character_count")), 1)),
    }


@lru_cache
def _best_keywords() -> Column:
    return top_keywords(F.col("keyword_counts"), F.col("word_count").cast("double"))


def with_text_metrics(df: DataFrame, text: str, target_keyword: str | None = None, unicode_keywords: bool = False) -> DataFrame:
    """Add all metrics of the text column; null text gives null metrics.

    Keywords are cut to ASCII letters and digits; ``unicode_keywords`` keeps those of all scripts.
    """
    columns = _counted(text, target_keyword, unicode_keywords)
    counted = df.withColumns(_plain(text)).select("*", *columns).drop("_plain", "_lower")
    return counted.withColumn("top_keywords", _best_keywords()).withColumns(_measured(text, target_keyword))


@lru_cache
def _main_columns() -> list[Column]:
    usable, nodes = F.col("usable"), F.col("main_nodes")
    headings = [f"<{name}" for name in HEADINGS]

    def tags(*names: str) -> Column:
        return F.when(usable, F.size(F.filter(nodes["tag"], lambda t: t.isin(list(names)))))

    return [
        F.when(usable, text_of(nodes)).alias("main_text"),
        tags(*headings).alias("heading_count"),
        tags("<a").alias("link_count"),
        tags("<img").alias("image_count"),
    ]


def content_metrics(facts: DataFrame, target_keyword: str | None = None, unicode_keywords: bool = False) -> DataFrame:
    """Add the content metrics of each page's main content; the node array ends here."""
    counted = facts.select(*[c for c in facts.columns if c != "main_nodes"], *_main_columns())
    return with_text_metrics(counted, "main_text", target_keyword, unicode_keywords)


def thin_content(metrics: DataFrame) -> DataFrame:
    """Pages whose main content is too short."""
    return metrics.where(F.col("word_count") < THIN_CONTENT_WORDS)
