"""URL filter: rules on hosts and paths, and a list of canonical URLs behind a blocked Bloom filter.

Rules and listed URLs are one table of entries, each with a key. A page has a few possible keys: one for each
pair of a domain of its host and a beginning of its path that is as long as some rule's, and one for its
canonical URL. A blocked Bloom filter of the keys, a table of 256-bit blocks, is asked first; it is
wrong about one key in a thousand or less and never misses one. What passes goes to an exact hash join with the
entries, which removes the false positives.

Both joins are on keys that are spread evenly, or on entries that many pages hit: those are joined by
shuffle, where Spark splits a hot key, or by broadcast if the stored table is below the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.session import materialize

#: Bits of the filter for each entry, bits in a block, and bits set for an entry: two in each 64-bit word.
BITS_PER_ENTRY, BLOCK_BITS = 24, 256
WORDS = BLOCK_BITS // 64
ENTRIES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without ``/``, ``.html`` or ``index`` at its end: one text for one page."""
    plain = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.concat(plain, F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*\z", ""))


def _rule_key(domain: Column, beginning: Column) -> Column:
    return F.concat(F.lit("rule "), domain, beginning)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("url "), url)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in its block: two in each word, from twelve bits of a second hash for each."""
    hash_ = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright(hash_, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(_block, _w0 .. _w3) for the blocks that are not empty, from the column ``key``."""
    masked = keys.select(_block(F.col("key"), blocks).alias("_block"), *[m.alias(f"_m{w}") for w, m in enumerate(_masks(F.col("key")))])
    return masked.groupBy("_block").agg(*[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(WORDS)])


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``candidates`` whose ``key`` may be in the filter."""
    asked = candidates.withColumns({"_block": _block(F.col("key"), blocks), **{f"_m{w}": m for w, m in enumerate(_masks(F.col("key")))}})
    hit = asked.join(filter_, "_block")
    for w in range(WORDS):
        hit = hit.where(F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}"))
    return hit.select(*candidates.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, page: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``rules`` (host, path, verdict) fit a host and all its subdomains if the path begins with the rule's; the longest
    host and path together win, of equally long ones the smaller text. ``rule`` is its host and path, null without
    one. Without a rule the verdict is ``block`` for URLs whose canonical form is in ``listed`` (column
    ``url``, canonical or not) and ``default`` for others. A null URL or one without ``://`` has an empty host
    and path and gets the default. Rules and listed URLs with nulls fit nothing; repeated rows are
    judged each on its own; repeated rules count once, the smaller verdict wins. Other columns are not used.
    """
    spark = pages.sparkSession
    source = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    source = materialize(source)
    named = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    by_rule = named.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    urls = listed.where("url is not null").select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("_url")).where("_url <> ''").distinct()
    by_url = urls.select(_url_key(F.col("_url")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    entries = materialize(by_rule.unionByName(by_url))
    blocks = max(1, -(-entries.count() * BITS_PER_ENTRY // BLOCK_BITS))
    filter_ = materialize(bloom_filter(entries, blocks))

    # The lengths of the rules' paths: as many as the longest path has characters, at most.
    lengths = [r[0] for r in named.select(F.length("path")).distinct().orderBy(F.length("path")).toLocalIterator()]
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    beginnings = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda b: b.isNotNull()) if lengths else F.array().cast("array<string>")
    of_rules = F.flatten(F.transform(domains, lambda d: F.transform(beginnings, lambda b: _rule_key(d, b))))
    keys = F.when(F.col("host") != "", F.concat(of_rules, F.array(_url_key(canonical(F.col("host"), F.col("path"))))))
    candidates = source.select("_row", F.explode(keys).alias("key"))
    # A page meets an entry once; the longest rule wins, a listed URL has none.
    found = possible(candidates, filter_, blocks).join(entries, "key")
    order = F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), F.struct("rule", "verdict").alias("of"))
    best = found.groupBy("_row").agg(F.max(F.struct(order["n"].alias("n"))).alias("most"), F.collect_set(order).alias("all"))
    chosen = F.array_min(F.filter("all", lambda x: x["n"] == F.col("most.n")))["of"]
    listed_too = F.exists("all", lambda x: x["n"] == -1)
    judged = best.select("_row", chosen["rule"].alias("rule"), chosen["verdict"].alias("verdict"), listed_too.alias("listed"))
    out = source.join(judged, "_row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, text) with a text such as ``example.org/es/``: the host, then the path."""
    rows = [(text[: text.index("/")], text[text.index("/") :], verdict) for verdict, text in rules]
    return spark.createDataFrame(rows, ENTRIES)
