"""Sitemaps and robots files: discovery, expansion, URL lists, validity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.text import let, trim
from webgauge.functions.urls import is_http
from webgauge.operators.rules import fired
from webgauge.operators.skew import ranked, top_per_group
from webgauge.session import GrowingTable, materialize

# Where sitemaps are looked for, in this order; the check only tries the first two.
STANDARD_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap1.xml")
CHECKED_PATHS = STANDARD_PATHS[:2]
LARGE_SITE = 1000
# Texts of the site checks.
SITEMAP_NOT_FOUND = "Sitemapa nebyla nalezena na standardních cestách"
SITEMAP_NO_STRUCTURE = "Sitemapa neobsahuje validní XML strukturu"
SITEMAP_EMPTY = "Sitemapa je prázdná"
SITEMAP_NO_LASTMOD = "Sitemapa neobsahuje lastmod daty (doporučeno pro SEO)"
SITEMAP_PARSE_ERROR = "Chyba při parsování sitemapy"
ROBOTS_MISSING = "robots.txt neexistuje nebo není dostupný"
ROBOTS_NO_AGENT = "robots.txt neobsahuje User-agent direktivy"
ROBOTS_NO_SITEMAP = "robots.txt neobsahuje Sitemap direktivu"
ROBOTS_BLOCKS_ALL = "VAROVÁNÍ: robots.txt blokuje všechny crawly (Disallow: /)"

XML_ENTRIES = (
    "url array<struct<loc:array<string>,lastmod:array<string>>>,"
    "sitemap array<struct<loc:array<string>>>,_corrupt_record string"
)
# The first element behind the prolog.
ROOT_PATTERN = r"(?s)^\s*+(?:<\?.*?\?>\s*+|<!--.*?-->\s*+|<![^>]*+>\s*+)*+<([^\s/>!?]++)"


def seed_urls(seeds: DataFrame) -> DataFrame:
    """Site addresses without one trailing slash, and whether they can be audited."""
    base = F.regexp_replace("url", "/$", "")
    return seeds.withColumns({"base_url": base, "accepted": is_http(base)})


def answered(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``Sitemap:`` lines of robots files that could be fetched, with their line number."""
    lines = robots.where(answered(F.col("http_status"))).select(
        "site", F.posexplode(F.split("content", "\n")).alias("line", "text")
    )
    value = trim(F.regexp_extract(trim(F.col("text")), "(?i)^sitemap:(.*)$", 1))
    listed = lines.where(trim(F.col("text")).rlike("(?i)^sitemap:"))
    return listed.select("site", "line", value.alias("sitemap_url"))


def discover(sites: DataFrame, docs: DataFrame, robots: DataFrame) -> DataFrame:
    """The sitemap to use per ``site, base_url``: standard paths that answer with XML first, then robots
    lines that answer; null when there is none."""
    good = docs.where(answered(F.col("http_status"))).select("site", "sitemap_url", "content_type")
    paths = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("path")) for i, p in enumerate(STANDARD_PATHS)])
    standard = sites.select("site", "base_url", F.explode(paths).alias("at")).select(
        "site", F.col("at.place").alias("place"), F.concat("base_url", "at.path").alias("sitemap_url")
    )
    by_path = standard.join(good, ["site", "sitemap_url"]).where(F.contains(F.lower("content_type"), F.lit("xml")))
    by_robots = robots_sitemaps(robots).withColumn("place", F.col("line") + len(STANDARD_PATHS))
    by_robots = by_robots.join(good, ["site", "sitemap_url"])
    found = by_path.select("site", "place", "sitemap_url").unionByName(by_robots.select("site", "place", "sitemap_url"))
    best = found.groupBy("site").agg(F.min_by("sitemap_url", "place").alias("sitemap_url"))
    return sites.select("site").join(best, "site", "left")


def parsed_docs(docs: DataFrame) -> DataFrame:
    """Sitemap documents with their root element, parsed entries and whether they are broken XML."""
    xml = F.from_xml("body", XML_ENTRIES)
    return docs.withColumns({"root": F.regexp_extract("body", ROOT_PATTERN, 1), "xml": xml}).withColumn(
        "malformed", F.col("xml._corrupt_record").isNotNull() | (F.col("root") == "")
    )


def first_locations(locs: Column) -> Column:
    """The first location of each entry, trimmed, without blank ones."""
    return F.filter(F.transform(locs, lambda of: trim(F.get(of, F.lit(0)))), lambda loc: loc != "")


def listed_locations(docs: DataFrame) -> DataFrame:
    """``site, sitemap_url, root, locs``: what every readable sitemap lists, the first location of each entry.

    Row-local, with one parse per document. Choosing the reachable documents first would move their bodies
    through a shuffle; here only the locations go on.
    """
    root = F.col("root")

    def read(xml: Column) -> Column:
        whole = xml["_corrupt_record"].isNull()
        listed = F.when(root == "urlset", first_locations(xml["url"]["loc"])).when(root == "sitemapindex", first_locations(xml["sitemap"]["loc"]))
        return F.when(whole, listed)

    good = docs.where(answered(F.col("http_status"))).withColumn("root", F.regexp_extract("body", ROOT_PATTERN, 1))
    return good.select("site", "sitemap_url", "root", let(F.from_xml("body", XML_ENTRIES), read).alias("locs"))


def _all_listed(docs: DataFrame, listed: DataFrame | None) -> DataFrame:
    stored = materialize(listed_locations(docs))
    return stored if listed is None else stored.unionByName(listed)


def _listed(stored: DataFrame, root: str, name: str) -> DataFrame:
    return stored.where(F.col("root") == root).select("site", "sitemap_url", F.explode("locs").alias(name))


def sitemap_urls(docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Page URLs of every readable url set: the first location of each entry, each URL once.

    ``listed`` adds documents that were read as files (``listed_in_files``), here and below.
    """
    return _listed(_all_listed(docs, listed), "urlset", "url").distinct()


def sitemap_children(docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Edges from every readable sitemap index to the sitemaps it lists."""
    return _listed(_all_listed(docs, listed), "sitemapindex", "child").distinct()


def expand(roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Every sitemap reachable from a site's root sitemap, with its depth; each is visited once.

    The rounds follow the depth of the index tree and end when one finds nothing new.
    """
    return _walk(roots, materialize(sitemap_children(docs)))


def _walk(roots: DataFrame, children: DataFrame) -> DataFrame:
    """Breadth first. What was visited is one growing table: each round adds its files, so plans stay as they are."""
    start = roots.where(F.col("sitemap_url").isNotNull()).select("site", "sitemap_url", F.lit(0).alias("depth"))
    visited = GrowingTable(start.distinct())
    depth = 0
    while not visited.last.isEmpty():
        depth += 1
        found = visited.last.join(children, ["site", "sitemap_url"]).select("site", F.col("child").alias("sitemap_url"))
        fresh = found.distinct().join(visited.read(), ["site", "sitemap_url"], "left_anti")
        visited.add(fresh.withColumn("depth", F.lit(depth)))
    return visited.read()


def site_urls(roots: DataFrame, docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """All page URLs of a site, each once, from its root sitemap down."""
    stored = _all_listed(docs, listed)
    children = materialize(_listed(stored, "sitemapindex", "child").distinct())
    reachable = _walk(roots, children).select("site", "sitemap_url")
    sets = stored.where("root = 'urlset'").join(reachable, ["site", "sitemap_url"], "left_semi")
    return _listed(sets, "urlset", "url").select("site", "url").distinct()


def url_list(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """The URLs of each site in ascending order, with their place; all of them or the first ``limit``."""
    if limit is None:
        return ranked(urls, [F.asc("url")], "site")
    return top_per_group(urls, "site", [F.asc("url")], limit)


def site_volume(urls: DataFrame) -> DataFrame:
    """URLs per site and whether the site counts as large."""
    n = F.count("*")
    return urls.groupBy("site").agg(n.alias("urls"), (n > LARGE_SITE).alias("large"))


def sitemap_check(sites: DataFrame, docs: DataFrame) -> DataFrame:
    """``valid`` and ``issues`` of the first standard sitemap that answers, per ``site, base_url``."""
    paths = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("path")) for i, p in enumerate(CHECKED_PATHS)])
    candidates = sites.select("site", F.explode(paths).alias("at"), "base_url").select(
        "site", "at.place", F.concat("base_url", "at.path").alias("sitemap_url")
    )
    good = docs.where(answered(F.col("http_status")))
    hits = candidates.join(good.select("site", "sitemap_url"), ["site", "sitemap_url"])
    first = hits.groupBy("site").agg(F.min_by("sitemap_url", "place").alias("sitemap_url"))
    # The bodies join last, so only the chosen document of each site is moved and parsed.
    chosen = first.join(good.select("site", "sitemap_url", "body"), ["site", "sitemap_url"])
    return sites.select("site").join(check_documents(chosen), "site", "left").select(
        "site",
        "sitemap_url",
        F.coalesce("valid", F.lit(False)).alias("valid"),
        F.coalesce("issues", F.array(F.lit(SITEMAP_NOT_FOUND))).alias("issues"),
    )


def check_documents(docs: DataFrame) -> DataFrame:
    """Validity of sitemap documents. A missing ``lastmod`` is reported but does not invalidate."""
    parsed = parsed_docs(docs)
    root, malformed, urls = F.col("root"), F.col("malformed"), F.col("xml.url")
    is_set = ~malformed & (root == "urlset")
    unknown = ~malformed & ~root.isin("urlset", "sitemapindex")
    empty = is_set & (F.coalesce(F.size(urls), F.lit(0)) <= 0)
    dated = F.coalesce(F.exists(urls, lambda u: F.get(u["lastmod"], F.lit(0)) != ""), F.lit(False))
    issues = fired(
        [
            (malformed, F.lit(SITEMAP_PARSE_ERROR)),
            (unknown, F.lit(SITEMAP_NO_STRUCTURE)),
            (empty, F.lit(SITEMAP_EMPTY)),
            (is_set & ~dated, F.lit(SITEMAP_NO_LASTMOD)),
        ]
    )
    return parsed.select("site", "sitemap_url", (~malformed & ~unknown & ~empty).alias("valid"), issues.alias("issues"))


def robots_check(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Existence, content and issues of each site's robots file."""
    joined = sites.select("site").join(robots, "site", "left")
    exists, text = answered(F.col("http_status")), F.coalesce("content", F.lit(""))

    def holds(part: str) -> Column:
        return F.contains(text, F.lit(part))

    issues = fired(
        [
            (~exists, F.lit(ROBOTS_MISSING)),
            (exists & ~holds("User-agent"), F.lit(ROBOTS_NO_AGENT)),
            (exists & ~holds("Sitemap:"), F.lit(ROBOTS_NO_SITEMAP)),
            (exists & holds("Disallow: /") & ~holds("Allow:"), F.lit(ROBOTS_BLOCKS_ALL)),
        ]
    )
    content = F.when(exists, F.col("content"))
    return joined.select("site", exists.alias("exists"), content.alias("content"), issues.alias("issues"))
