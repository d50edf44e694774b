"""Report tables and views over the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions.text import round_half_up, utf16_length
from webgauge.operators.site import average_lengths, duplicates, score_stats, status_counts
from webgauge.operators.skew import ranked

# Labels and headers of the report.
STATUS_LABELS = {"error": "Chyba", "warning": "Varování", "ok": "OK"}
YES, NO = "Ano", "Ne"
SUMMARY_METRICS = {
    "total_pages": "Celkem stránek",
    "error_pages": "Stránky s chybami",
    "warning_pages": "Stránky s varováními",
    "ok_pages": "OK stránky",
    "duplicate_titles": "Duplicitní title",
    "duplicate_descriptions": "Duplicitní description",
    "avg_title_length": "Průměrná délka title",
    "avg_description_length": "Průměrná délka description",
    "avg_score": "Průměrné SEO skóre",
    "max_score": "Nejlepší SEO skóre",
    "min_score": "Nejhorší SEO skóre",
}
DETAIL_HEADERS = {
    "status": "Status", "url": "URL", "title": "Title", "title_length": "Délka title",
    "meta_description": "Meta Description", "desc_length": "Délka description", "h1": "H1",
    "og_title": "OG Title", "og_description": "OG Description", "og_image": "OG Image",
    "canonical": "Canonical", "robots": "Robots", "page_size": "Velikost stránky (KB)",
    "external_links": "Externí odkazy", "internal_links": "Interní odkazy",
    "mobile_friendly": "Mobile-friendly", "viewport": "Viewport", "favicon": "Favicon",
    "redirect_type": "Redirect type", "images_without_alt": "Obrázky bez alt",
    "images_total": "Celkem obrázků", "broken_links_count": "Broken links", "https": "HTTPS",
    "seo_score": "SEO Skóre", "seo_grade": "SEO Grade", "word_count": "Počet slov",
    "readability": "Čitelnost", "keyword_density": "Keyword density", "compression": "Komprese",
    "cache_headers": "Cache headers", "minified": "Minifikováno", "issues": "Problémy",
}
SORTS = ("status", "url", "title", "issues", "score")


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


def _number(column: str) -> Column:
    return F.coalesce(column, F.lit(0))


def _yes_no(column: str) -> Column:
    return F.when(F.col(column), YES).otherwise(NO)


def number_text(x: Column) -> Column:
    """A number as a script prints it: no decimals when it is whole, empty when missing or 0."""
    whole = x == F.floor(x)
    return F.when(x.isNull() | (x == 0), "").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def details(audit: DataFrame) -> DataFrame:
    """The 32 report columns of every page, with missing values filled; ``site`` leads the row."""
    status = F.coalesce(*[F.when(F.col("status") == s, F.lit(label)) for s, label in STATUS_LABELS.items()])
    density = F.col("keyword_density")
    return audit.select(
        "site",
        status.alias("status"),
        "url",
        _text("title").alias("title"),
        F.coalesce(utf16_length(F.col("title")), F.lit(0)).alias("title_length"),
        _text("meta_description").alias("meta_description"),
        F.coalesce(utf16_length(F.col("meta_description")), F.lit(0)).alias("desc_length"),
        *[_text(c).alias(c) for c in ("h1", "og_title", "og_description", "og_image", "canonical", "robots")],
        F.coalesce(round_half_up(F.col("page_size") / 1024).cast("int"), F.lit(0)).alias("page_size"),
        _number("external_links_count").alias("external_links"),
        _number("internal_links_count").alias("internal_links"),
        _yes_no("mobile_friendly").alias("mobile_friendly"),
        _text("viewport").alias("viewport"),
        _text("favicon").alias("favicon"),
        F.coalesce(F.col("redirect_type").cast("string"), F.lit("")).alias("redirect_type"),
        *[_number(c).alias(c) for c in ("images_without_alt", "images_total", "broken_links_count")],
        _yes_no("https").alias("https"),
        number_text(F.col("score")).alias("seo_score"),
        _text("grade").alias("seo_grade"),
        number_text(F.col("word_count")).alias("word_count"),
        number_text(F.col("readability")).alias("readability"),
        F.when(density > 0, F.format_string("%.2f%%", density)).otherwise("").alias("keyword_density"),
        F.when(F.col("compression"), F.coalesce("compression_type", F.lit(YES))).otherwise(NO).alias("compression"),
        _yes_no("cache_headers").alias("cache_headers"),
        _yes_no("minified").alias("minified"),
        F.array_join(F.col("issues")["message"], "; ").alias("issues"),
    )


def summary(audit: DataFrame) -> DataFrame:
    """One row per site and summary metric; sites without scores have no score rows."""
    wide = status_counts(audit)
    for column, name in (("title", "duplicate_titles"), ("meta_description", "duplicate_descriptions")):
        wide = wide.join(duplicates(audit, column).groupBy("site").agg(F.count("*").alias(name)), "site", "left")
    wide = wide.join(average_lengths(audit), "site").join(score_stats(audit), "site", "left")
    filled = wide.fillna(0, ["duplicate_titles", "duplicate_descriptions"])
    values = filled.select("site", *[F.col(c).cast("long").alias(c) for c in SUMMARY_METRICS])
    long = values.unpivot("site", list(SUMMARY_METRICS), "code", "value").where(F.col("value").isNotNull())
    place = F.coalesce(*[F.when(F.col("code") == c, F.lit(i + 1)) for i, c in enumerate(SUMMARY_METRICS)])
    label = F.coalesce(*[F.when(F.col("code") == c, F.lit(t)) for c, t in SUMMARY_METRICS.items()])
    return long.select("site", place.alias("ord"), label.alias("metric"), "value")


def problem_pages(audit: DataFrame, status: str = "all") -> DataFrame:
    """Pages with problems, optionally of one status; ``ok`` therefore finds nothing."""
    problems = audit.where(F.col("status") != "ok")
    return problems if status == "all" else problems.where(F.col("status") == status)


def search_pages(pages: DataFrame, text: str) -> DataFrame:
    """Pages whose URL or title contains a text, letter case ignored."""
    if not text:
        return pages
    wanted = F.lit(text.lower())
    return pages.where(F.contains(F.lower("url"), wanted) | F.contains(F.lower(_text("title")), wanted))


def sort_key(by: str, reference_order: bool = False) -> Column:
    """Ordering of the result view.

    ``status`` puts errors first; ``reference_order`` instead puts warnings, then ok, then errors, as
    a missing rank and rank 0 were once treated alike.
    """
    if by == "status":
        ranks = {"warning": 1, "ok": 2, "error": 3} if reference_order else {"error": 0, "warning": 1, "ok": 2}
        return F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in ranks.items()]).asc()
    if by == "issues":
        return F.size("issues").desc()
    if by == "score":
        return F.coalesce("score", F.lit(0)).desc()
    return F.collate(F.coalesce(by, F.lit("")), "UNICODE").asc()


def sort_pages(pages: DataFrame, by: str = "status", reference_order: bool = False) -> DataFrame:
    """Pages with their ``rank`` within the site in the chosen order; ties by URL."""
    return ranked(pages, [sort_key(by, reference_order), F.asc("url")], "site")


def result_counts(audit: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """How many problem pages a filter shows, of how many."""
    shown = search_pages(problem_pages(audit, status), text).groupBy("site").agg(F.count("*").alias("shown"))
    total = problem_pages(audit).groupBy("site").agg(F.count("*").alias("total"))
    return total.join(shown, "site", "left").fillna(0, ["shown"]).select("site", "shown", "total")


def issue_preview(audit: DataFrame, n: int = 3) -> DataFrame:
    """The first issues of each page and how many more there are."""
    return audit.select(
        "site",
        "url",
        F.slice(F.col("issues")["message"], 1, n).alias("first_issues"),
        F.greatest(F.size("issues") - n, F.lit(0)).alias("more_issues"),
    )


def link_preview(audit: DataFrame, n: int = 10) -> DataFrame:
    """The first broken links and images of each page that has any."""
    return audit.where(F.col("broken_links_count") > 0).select(
        "site", "url", F.slice("broken_links", 1, n).alias("broken_links"), F.slice("broken_images", 1, n).alias("broken_images")
    )
