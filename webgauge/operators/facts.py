"""Per-page facts: everything that one page's markup and fetch outcome say. Row-local, no shuffle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions import html as H
from webgauge.functions.text import blank_to_null, clean, let, utf16_length
from webgauge.functions.urls import host_of, is_http, join_url, normalize, standard_host
from webgauge.operators.performance import performance_metrics

# Error texts of the result document.
FETCH_ERROR = "Nepodařilo se načíst stránku"
JSON_LD_MISSING_KEYS = "Chybí @type nebo @context"
JSON_LD_ITEM_MISSING_KEYS = "Položka %d: chybí @type nebo @context"
JSON_LD_UNPARSABLE = "Neplatný JSON"


def crawl_outcome(crawl: DataFrame) -> DataFrame:
    """Add ``usable``, ``redirect_type`` and ``error``; failed pages stay as rows."""
    direct = F.col("fetch_status").between(200, 299)
    followed = F.col("fetch_status").between(300, 399) & (F.col("location") != "") & F.col("final_status").between(200, 299)
    usable = F.coalesce(direct | followed, F.lit(False))
    return crawl.withColumns(
        {
            "usable": usable,
            "redirect_type": F.when(followed, F.col("fetch_status")).cast("int"),
            "error": F.when(~usable, F.lit(FETCH_ERROR)),
        }
    )


# Column expressions are built once per process and reused by every plan: they only name columns.


@lru_cache
def _parse_columns(crawl_columns: tuple[str, ...]) -> list[Column | str]:
    return [
        "site",
        "url",
        "fetch_status",
        "usable",
        "redirect_type",
        "error",
        *performance_metrics(F.col("html"), list(crawl_columns)),
        utf16_length(F.col("html")).alias("page_size"),
        H.nodes(F.col("html")).alias("page"),
    ]


def parsed_pages(crawl: DataFrame) -> DataFrame:
    """One pass over the HTML: node array and whole-markup signals. The HTML column ends here."""
    pages = crawl_outcome(crawl).withColumn("html", F.when(F.col("usable"), F.coalesce("html", F.lit(""))))
    return pages.select(*_parse_columns(tuple(crawl.columns)))


def _truthy(v: Column, key: str) -> Column:
    """Whether a script would take ``v[key]`` as true."""
    value = F.try_variant_get(v, f"$['{key}']", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(v, f"$['{key}']", "string")
    number = kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(number, text.try_cast("double") != 0)
        .otherwise(True)
    )


def _truthy_text(m: Column, key: str) -> Column:
    """The same for a map of texts, where of a repeated key the last value counts."""
    values = F.map_values(m)
    last = F.try_element_at(F.filter(F.transform(F.map_keys(m), lambda k, i: F.when(k == key, F.get(values, i))), lambda v: v.isNotNull()), F.lit(-1))
    return F.coalesce(~last.isin("", "false", "null") & ~last.rlike(r"^-?0(?:\.0*)?(?:[eE][+-]?[0-9]+)?$"), F.lit(False))


def json_ld_block(body: Column) -> Column:
    """``struct<type, data, valid, errors>`` of one JSON-LD script body.

    Whether the parser for variants takes repeated keys depends on a setting of the session, which is the caller's.
    Bodies that it refuses are read once more as maps of texts, and there the last value of a key counts.
    """

    def lacks_keys(v: Column) -> Column:
        return ~_truthy(v, "@type") & ~_truthy(v, "@context")

    def lacks_texts(m: Column) -> Column:
        return ~_truthy_text(m, "@type") & ~_truthy_text(m, "@context")

    def is_void(v: Column) -> Column:
        return F.schema_of_variant(v) == "VOID"

    def block(valid: bool | Column, data: Column, errors: Column) -> Column:
        return F.struct(
            F.lit("JSON-LD").alias("type"),
            data.alias("data"),
            (F.lit(valid) if isinstance(valid, bool) else valid).alias("valid"),
            errors.cast("array<string>").alias("errors"),
        )

    def of_items(items: Column, lacks) -> Column:
        marked = F.transform(items, lambda item, i: F.when(lacks(item), F.format_string(JSON_LD_ITEM_MISSING_KEYS, i + 1)))
        return F.filter(marked, lambda e: e.isNotNull())

    def of_one(value: Column, lacks) -> Column:
        return F.when(lacks(value), F.array(F.lit(JSON_LD_MISSING_KEYS))).otherwise(F.array().cast("array<string>"))

    def repeated() -> Column:
        """Errors of a body with repeated keys, null for one that is not JSON."""
        one = F.from_json(F.concat(F.lit("["), body, F.lit(",{}]")), "array<map<string,string>>")
        many = F.from_json(F.concat(F.lit("["), body, F.lit(",[]]")), "array<array<map<string,string>>>")

        def read(x: Column) -> Column:
            single, listed = F.get(x["one"], F.lit(0)), F.get(x["many"], F.lit(0))
            whole = lambda values: F.size(values) == 2
            items = F.when(whole(x["many"]) & listed.isNotNull() & ~F.exists(listed, lambda m: m.isNull()), of_items(listed, lacks_texts))
            return F.when(whole(x["one"]) & single.isNotNull(), of_one(single, lacks_texts)).otherwise(items)

        return let(F.struct(one.alias("one"), many.alias("many")), read)

    def check(v: Column, items: Column) -> Column:
        parsed = F.when(items.isNotNull(), of_items(items, lacks_keys)).otherwise(of_one(v, lacks_keys))
        void = is_void(v) | F.coalesce(F.exists(items, is_void), F.lit(False))
        errors = F.when(v.isNull(), repeated()).when(void, None).otherwise(parsed)
        broken = block(False, F.lit("{}"), F.array(F.lit(JSON_LD_UNPARSABLE)))
        return let(errors, lambda e: F.when(e.isNull(), broken).otherwise(block(F.size(e) == 0, body, F.when(F.size(e) > 0, e))))

    # The sentinel behind the body rejects trailing text, which the JSON reader alone would accept.
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"end"]'))).try_cast("array<variant>")
    value = let(wrapped, lambda w: F.when(F.size(w) == 2, F.get(w, F.lit(0))))
    return let(value, lambda v: let(v.try_cast("array<variant>"), lambda items: check(v, items)))


def _presence(kind: str, present: Column) -> Column:
    entry = F.struct(
        F.lit(kind).alias("type"),
        F.lit("{}").alias("data"),
        F.lit(None).cast("boolean").alias("valid"),
        F.lit(None).cast("array<string>").alias("errors"),
    )
    return F.filter(F.array(entry), lambda _: present)


@lru_cache
def _element_columns() -> list[Column]:
    page = F.col("page")
    attr = H.attribute

    def meta(m: Column) -> Column:
        return F.struct(*[attr(m, name).alias(name) for name in ("name", "property", "content")])

    def link(tag: Column) -> Column:
        values = [attr(tag, name).alias(name) for name in ("href", "hreflang")]
        return F.struct(F.lower(attr(tag, "rel")).alias("rel"), *values)

    def image(tag: Column) -> Column:
        return F.struct(attr(tag, "src").alias("src"), attr(tag, "alt").alias("alt"))

    scripts = F.filter(H.tags_named(page, "script"), lambda s: s.rlike("(?i)ld.json"))
    json_ld = F.filter(scripts, lambda s: F.lower(attr(H.opening(s), "type")) == "application/ld+json")

    def marked(name: str) -> Column:
        raw = ["<script", "<style"]
        return F.exists(
            page,
            lambda n: n["tag"].startswith("<")
            & ~n["tag"].isin(raw)
            & n["raw"].rlike(rf"(?i)\s{name}")
            & H.has_attribute(H.opening(n["raw"]), name),
        )

    return [
        F.transform(H.tags_named(page, "meta"), meta).alias("metas"),
        F.transform(H.tags_named(page, "link"), link).alias("links"),
        F.filter(F.transform(H.tags_named(page, "a"), lambda a: attr(a, "href")), lambda h: h != "").alias("hrefs"),
        F.transform(H.tags_named(page, "img"), image).alias("images"),
        F.filter(F.transform(json_ld, H.body_of), lambda b: b != "").alias("json_ld_bodies"),
        marked("itemscope").alias("has_microdata"),
        marked("typeof").alias("has_rdfa"),
        H.first_title(page).alias("title"),
        H.first_heading_text(page).alias("h1"),
    ]


def page_elements(parsed: DataFrame) -> DataFrame:
    """Attribute arrays of the elements that facts are read from."""
    return parsed.select("*", *_element_columns())


def _meta(key: str, value: str) -> Column:
    """Content of the first matching meta tag, even if a later one has more."""
    return F.get(F.filter("metas", lambda m: m[key] == value), F.lit(0))["content"]


def _href(*rels: str) -> Column:
    return F.get(F.filter("links", lambda tag: tag["rel"].isin(*rels)), F.lit(0))["href"]


def link_kinds(hrefs: Column, targets: Column, url: Column, strict_links: bool = False) -> Column:
    """``struct<internal, external>`` link counts; ``targets`` are the links and ``url`` the page with standard hosts.

    A link starting with ``//`` counts as internal, as any other leading slash does;
    ``strict_links`` judges it by its host instead.
    """

    def kind(href: Column, i: Column, host: Column) -> Column:
        standard = F.get(targets, i)
        absolute = F.when(standard.startswith("//"), F.concat(F.lit("http:"), standard)).otherwise(standard)
        target = let(
            host_of(absolute),
            lambda h: F.when(h.isNull(), F.lit(None).cast("string"))
            .when((h == host) | F.endswith(h, F.concat(F.lit("."), host)), "internal")
            .otherwise("external"),
        )
        by_host = is_http(href) | href.startswith("//") if strict_links else is_http(href)
        relative = href.startswith("/") | href.startswith("./") | href.startswith("../")
        return F.when(by_host, target).when(relative, "internal")

    def tally(kinds: Column) -> Column:
        def count(kind: str) -> Column:
            return F.size(F.filter(kinds, lambda k: k == kind)).alias(kind)

        return F.struct(count("internal"), count("external"))

    return let(host_of(url), lambda host: let(F.transform(hrefs, lambda h, i: kind(h, i, host)), tally))


@lru_cache
def _derived_columns() -> dict[str, Column]:
    usable, url = F.col("usable"), F.col("url")
    canonical, icon = clean(_href("canonical")), blank_to_null(_href("icon", "shortcut icon"))
    return {
            "meta_description": clean(_meta("name", "description")),
            "canonical": canonical,
            "favicon_href": icon,
            # All URLs of a page, so that hosts are brought into standard form in one place.
            "standard": F.transform(F.concat(F.array(url, canonical, icon), "hrefs"), standard_host),
            "content": F.when(usable, H.main_content(F.col("page"))),
            "structured_data": F.concat(
                F.transform("json_ld_bodies", json_ld_block),
                _presence("Microdata", F.col("has_microdata")),
                _presence("RDFa", F.col("has_rdfa")),
            ),
            "viewport": blank_to_null(_meta("name", "viewport")),
    }


@lru_cache
def _kinds(strict_links: bool) -> Column:
    targets = F.slice(F.col("standard"), 4, F.size("standard"))
    return let(targets, lambda ts: link_kinds(F.col("hrefs"), ts, F.get("standard", F.lit(0)), strict_links))


@lru_cache
def _fact_columns() -> dict[str, Column]:
    usable, url = F.col("usable"), F.col("url")
    page, canonical, icon = (F.get("standard", F.lit(k)) for k in range(3))
    alternates = F.filter(
        "links", lambda tag: (tag["rel"] == "alternate") & (tag["hreflang"] != "") & (tag["href"] != "")
    )
    hreflang = F.transform(alternates, lambda tag: F.struct(tag["hreflang"].alias("lang"), tag["href"].alias("url")))
    return {
        "site": F.col("site"),
        "url": F.col("url"),
        "fetch_status": F.col("fetch_status"),
        "usable": F.col("usable"),
        "redirect_type": F.col("redirect_type"),
        "error": F.col("error"),
        "title": F.col("title"),
        "meta_description": F.col("meta_description"),
        "h1": F.col("h1"),
        "og_title": clean(_meta("property", "og:title")),
        "og_description": F.coalesce(clean(_meta("property", "og:description")), "meta_description"),
        "og_image": clean(_meta("property", "og:image")),
        "twitter_card": clean(_meta("name", "twitter:card")),
        "twitter_title": clean(_meta("name", "twitter:title")),
        "twitter_description": clean(_meta("name", "twitter:description")),
        "canonical": F.col("canonical"),
        "canonical_target": F.when(F.col("canonical").isNotNull(), join_url(canonical, page)),
        "canonical_self": F.when(F.col("canonical").isNotNull(), normalize(page)),
        "robots": clean(_meta("name", "robots")),
        "hreflang": F.when(F.size(hreflang) > 0, hreflang),
        "structured_data": F.when(F.size("structured_data") > 0, F.col("structured_data")),
        "images_total": F.when(usable, F.size("images")),
        "images_without_alt": F.when(usable, F.size(F.filter("images", lambda i: clean(i["alt"]).isNull()))),
        "external_links_count": F.when(usable, F.col("kinds.external")),
        "internal_links_count": F.when(usable, F.col("kinds.internal")),
        "viewport": F.col("viewport"),
        "mobile_friendly": F.when(usable, F.col("viewport").isNotNull()),
        "has_favicon": F.col("favicon_href").isNotNull(),
        "favicon": F.when(F.col("favicon_href").isNotNull(), join_url(icon, page)),
        "https": F.when(usable, url.startswith("https://")),
        "page_size": F.col("page_size"),
        "minified": F.col("minified"),
        "has_lazy_loading": F.col("has_lazy_loading"),
        "compression": F.col("compression"),
        "compression_type": F.col("compression_type"),
        "cache_headers": F.col("cache_headers"),
        "cache_control": F.col("cache_control"),
        "hrefs": F.col("hrefs"),
        "image_sources": F.col("images")["src"],
        "main_nodes": F.col("content.nodes"),
        "paragraph_count": F.col("content.paragraphs"),
    }


#: What the costly columns are for: where none of the facts is wanted, the column is not in the plan at all.
_NEEDED_FOR = {
    "content": ("main_nodes", "paragraph_count"),
    "structured_data": ("structured_data",),
    "standard": ("canonical_target", "canonical_self", "favicon", "external_links_count", "internal_links_count"),
}


def page_facts(crawl: DataFrame, strict_links: bool = False, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of every crawled page, all of them or the ``wanted`` ones; null for pages that were not fetched."""
    elements = page_elements(parsed_pages(crawl))
    names = set(_fact_columns() if wanted is None else wanted)
    left_out = {name for name, facts in _NEEDED_FOR.items() if not names & set(facts)}
    derived = elements.withColumns({name: c for name, c in _derived_columns().items() if name not in left_out})
    if names & {"external_links_count", "internal_links_count"}:
        derived = derived.withColumn("kinds", _kinds(strict_links))
    return derived.select(*[c.alias(name) for name, c in _fact_columns().items() if name in names])
