"""Issue and recommendation rules as data, evaluated as one array expression per page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.text import utf16_length
from webgauge.operators.facts import JSON_LD_UNPARSABLE

MEGABYTE = 1024 * 1024

# The message of every issue; {} takes the detail.
ISSUE_MESSAGES = {
    "FETCH_FAILED": "Nepodařilo se načíst stránku",
    "PAGE_TOO_LARGE": "Stránka je příliš velká ({} MB, doporučeno < 3MB)",
    "REDIRECT_302": "Používá se dočasný redirect (302), doporučeno 301",
    "JSONLD_INVALID": "Neplatné strukturované data (JSON-LD): {}",
    "JSONLD_UNPARSABLE": "Neplatné JSON-LD strukturované data",
    "NO_VIEWPORT": "Chybí viewport meta tag (stránka nemusí být mobile-friendly)",
    "NO_FAVICON": "Chybí favicon",
    "NO_TITLE": "Chybí title",
    "TITLE_SHORT": "Title je příliš krátký ({} znaků, doporučeno 50-60)",
    "TITLE_LONG": "Title je příliš dlouhý ({} znaků, doporučeno 50-60)",
    "NO_DESCRIPTION": "Chybí meta description",
    "DESCRIPTION_SHORT": "Description je příliš krátká ({} znaků, doporučeno 150-160)",
    "DESCRIPTION_LONG": "Description je příliš dlouhá ({} znaků, doporučeno 150-160)",
    "NO_H1": "Chybí H1",
    "CANONICAL_MISMATCH": "Canonical URL neodpovídá aktuální URL",
    "CANONICAL_INVALID": "Neplatná canonical URL",
    "IMAGES_NO_ALT": "{} obrázků bez alt textu",
    "NOT_HTTPS": "Stránka nepoužívá HTTPS",
    "BROKEN_LINKS": "{} broken links/obrázků",
    "DUPLICATE_TITLE": 'Duplicitní title: "{}"',
    "DUPLICATE_DESCRIPTION": 'Duplicitní description: "{}"',
}
ISSUE_ORDER = {code: i + 1 for i, code in enumerate(ISSUE_MESSAGES)}
ISSUE_TYPE = "struct<ord:int,code:string,detail:string,severity:string,message:string>"

# Priority, category, points, bucket and texts of every recommendation; {} takes the detail.
BASIC, CONTENT, TECHNICAL, PERFORMANCE = "Základní SEO", "Obsah", "Technické SEO", "Performance"
RECOMMENDATIONS = {
    "title_missing": ("high", BASIC, 10, "Chybí title tag",
        "Přidejte unikátní title tag pro každou stránku (50-60 znaků)", "Vysoký - title je kritický pro SEO"),
    "title_short": ("high", BASIC, 5, "Title je příliš krátký",
        "Prodloužte title na 50-60 znaků (aktuálně {})", "Vysoký - krátký title může negativně ovlivnit CTR"),
    "title_long": ("medium", BASIC, 3, "Title je příliš dlouhý",
        "Zkraťte title na 50-60 znaků (aktuálně {})",
        "Střední - dlouhý title se může zkrátit ve výsledcích vyhledávání"),
    "desc_missing": ("high", BASIC, 10, "Chybí meta description",
        "Přidejte meta description (150-160 znaků)",
        "Vysoký - description ovlivňuje CTR ve výsledcích vyhledávání"),
    "desc_short": ("high", BASIC, 5, "Description je příliš krátká",
        "Prodloužte description na 150-160 znaků (aktuálně {})",
        "Vysoký - krátká description může negativně ovlivnit CTR"),
    "desc_long": ("medium", BASIC, 3, "Description je příliš dlouhá",
        "Zkraťte description na 150-160 znaků (aktuálně {})",
        "Střední - dlouhá description se může zkrátit ve výsledcích"),
    "h1_missing": ("high", BASIC, 5, "Chybí H1 tag",
        "Přidejte jeden H1 tag na stránku s hlavním klíčovým slovem",
        "Vysoký - H1 je důležitý pro strukturu a SEO"),
    "canonical_missing": ("medium", BASIC, 3, "Chybí canonical URL",
        "Přidejte canonical URL pro prevenci duplicitního obsahu",
        "Střední - pomáhá předcházet problémům s duplicitním obsahem"),
    "no_https": ("high", BASIC, 5, "Stránka nepoužívá HTTPS",
        "Nainstalujte SSL certifikát a přesměrujte na HTTPS",
        "Vysoký - HTTPS je ranking faktor a bezpečnostní požadavek"),
    "alt_majority": ("high", BASIC, 5, "Více než 50% obrázků bez alt textu ({})",
        "Přidejte alt texty ke všem obrázkům", "Vysoký - alt texty jsou důležité pro přístupnost a SEO"),
    "alt_some": ("medium", BASIC, 2, "{} obrázků bez alt textu",
        "Přidejte alt texty ke všem obrázkům", "Střední - zlepší přístupnost a SEO"),
    "text_very_thin": ("high", CONTENT, 10, "Příliš málo textu ({} slov)",
        "Přidejte více kvalitního obsahu (min. 300 slov)",
        "Vysoký - thin content může negativně ovlivnit SEO"),
    "text_thin": ("medium", CONTENT, 5, "Málo textu ({} slov)",
        "Přidejte více obsahu pro lepší SEO (doporučeno 500+ slov)",
        "Střední - více obsahu může zlepšit SEO"),
    "hard_to_read": ("medium", CONTENT, 10, "Text je obtížně čitelný",
        "Zjednodušte text - používejte kratší věty a jednodušší slova",
        "Střední - lepší čitelnost zlepšuje uživatelský zážitek"),
    "readable_mid": ("low", CONTENT, 5, "Text by mohl být čitelnější",
        "Zvažte zjednodušení textu pro lepší čitelnost", "Nízký - mírné zlepšení čitelnosti"),
    "density_low": ("medium", CONTENT, 5, "Nízká keyword density",
        "Zvažte přidání více relevantních klíčových slov do obsahu", "Střední - může pomoci s rankingem"),
    "density_high": ("high", CONTENT, 10, "Příliš vysoká keyword density (keyword stuffing)",
        "Snižte počet klíčových slov - Google penalizuje keyword stuffing",
        "Vysoký - keyword stuffing může vést k penalizaci"),
    "few_internal": ("low", CONTENT, 3, "Málo interních odkazů",
        "Přidejte více interních odkazů na relevantní stránky",
        "Nízký - interní odkazy pomáhají s crawlováním a SEO"),
    "not_mobile": ("high", TECHNICAL, 5, "Stránka není mobile-friendly",
        "Přidejte viewport meta tag a optimalizujte pro mobilní zařízení",
        "Vysoký - mobile-first indexing vyžaduje mobile-friendly design"),
    "no_structured": ("medium", TECHNICAL, 5, "Chybí strukturovaná data",
        "Přidejte strukturovaná data (JSON-LD) pro lepší zobrazení ve výsledcích",
        "Střední - může zlepšit zobrazení ve výsledcích vyhledávání"),
    "bad_structured": ("medium", TECHNICAL, 3, "Neplatná strukturovaná data",
        "Opravte chyby ve strukturovaných datech",
        "Střední - neplatná strukturovaná data se nebudou zobrazovat"),
    "size_gt_3mb": ("medium", TECHNICAL, 5, "Stránka je příliš velká ({} MB)",
        "Optimalizujte velikost stránky - odstraňte nepotřebný kód, komprimujte obrázky",
        "Střední - velká stránka se načítá pomaleji"),
    "size_gt_2mb": ("low", TECHNICAL, 2, "Stránka je poměrně velká ({} MB)",
        "Zvažte optimalizaci velikosti stránky", "Nízký - mírné zlepšení rychlosti načítání"),
    "redirect_302": ("medium", TECHNICAL, 3, "Používá se dočasný redirect (302)",
        "Změňte na trvalý redirect (301) pro lepší SEO", "Střední - 301 redirect je lepší pro SEO"),
    "no_compression": ("medium", PERFORMANCE, 3, "Stránka není komprimována",
        "Nastavte Gzip nebo Brotli kompresi na serveru",
        "Střední - komprese výrazně zmenší velikost stránky"),
    "no_cache": ("low", PERFORMANCE, 2, "Chybí cache headers",
        "Nastavte vhodné cache headers pro statické soubory",
        "Nízký - cache zlepší rychlost opakovaných návštěv"),
    "not_minified": ("low", PERFORMANCE, 2, "CSS/JS nejsou minifikovány",
        "Minifikujte CSS a JavaScript soubory", "Nízký - minifikace zmenší velikost souborů"),
    "broken_links": ("medium", TECHNICAL, 2, "{} broken links",
        "Opravte nebo odstraňte broken links", "Střední"),
}
BUCKETS = {"basic": BASIC, "content": CONTENT, "technical": TECHNICAL, "performance": PERFORMANCE}
RECOMMENDATION_ORDER = {code: i + 1 for i, code in enumerate(RECOMMENDATIONS)}
PRIORITIES = ("high", "medium", "low")


@dataclass(frozen=True)
class Rule:
    """A rule fires where ``when`` holds; ``detail`` is the value shown in its message."""

    code: str
    when: Column
    detail: Column | None = None


def _fill(template: str, detail: Column) -> Column:
    if "{}" not in template:
        return F.lit(template)
    before, after = template.split("{}")
    return F.concat(F.lit(before), detail, F.lit(after))


def megabytes(size: Column) -> Column:
    return F.format_string("%.2f", size.cast("double") / MEGABYTE)


def fired(entries: list[tuple[Column, Column]]) -> Column:
    """Array of the structs whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(condition, struct) for condition, struct in entries]))


def issue(code: str, detail: Column | None = None, severity: str | Column = "warning") -> Column:
    text = (F.lit(None) if detail is None else detail).cast("string")
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(ISSUE_ORDER[code]).alias("ord"),
        F.lit(code).alias("code"),
        text.alias("detail"),
        level.alias("severity"),
        _fill(ISSUE_MESSAGES[code], text).alias("message"),
    ).cast(ISSUE_TYPE)


def issues_of(rules: list[Rule]) -> Column:
    return fired([(rule.when, issue(rule.code, rule.detail)) for rule in rules])


def counted_issue(code: str, n: Column) -> Column:
    """An issue about ``n`` items: a warning, from the sixth item on an error."""
    severity = F.when(n > 5, "error").otherwise("warning")
    return fired([(n > 0, issue(code, n, severity))])


def _length_rules(column: str, missing: str, short: str, long: str, bounds: tuple[int, int]) -> list[Rule]:
    value, length = F.col(column), utf16_length(F.col(column))
    return [
        Rule(missing, value.isNull()),
        Rule(short, length < bounds[0], length),
        Rule(long, length > bounds[1], length),
    ]


def _json_ld_issues() -> Column:
    def of_block(block: Column) -> Column:
        unparsable = F.array_contains(block["errors"], JSON_LD_UNPARSABLE) & (block["data"] == "{}")
        errors = F.array_join(block["errors"], ", ")
        return F.when(unparsable, issue("JSONLD_UNPARSABLE")).otherwise(issue("JSONLD_INVALID", errors))

    invalid = F.filter("structured_data", lambda block: ~block["valid"])
    return F.coalesce(F.transform(invalid, of_block), F.array().cast(f"array<{ISSUE_TYPE}>"))


@lru_cache
def page_issues() -> Column:
    """Issues that one page raises by itself, in emission order, over page-fact columns."""
    canonical = F.col("canonical").isNotNull()
    target, own = F.col("canonical_target"), F.col("canonical_self")
    valid = target.isNotNull() & own.isNotNull()
    early = [
        Rule("PAGE_TOO_LARGE", F.col("page_size") > 3 * MEGABYTE, megabytes(F.col("page_size"))),
        Rule("REDIRECT_302", F.col("redirect_type") == 302),
    ]
    late = [
        Rule("NO_VIEWPORT", F.col("viewport").isNull()),
        Rule("NO_FAVICON", ~F.col("has_favicon")),
        *_length_rules("title", "NO_TITLE", "TITLE_SHORT", "TITLE_LONG", (50, 60)),
        *_length_rules(
            "meta_description", "NO_DESCRIPTION", "DESCRIPTION_SHORT", "DESCRIPTION_LONG", (150, 160)
        ),
        Rule("NO_H1", F.col("h1").isNull()),
        Rule("CANONICAL_MISMATCH", canonical & valid & (target != own)),
        Rule("CANONICAL_INVALID", canonical & ~valid),
    ]
    found = F.concat(
        issues_of(early),
        _json_ld_issues(),
        issues_of(late),
        counted_issue("IMAGES_NO_ALT", F.col("images_without_alt")),
        issues_of([Rule("NOT_HTTPS", ~F.col("https"))]),
    )
    return F.when(F.col("usable"), found).otherwise(F.array(issue("FETCH_FAILED", severity="error")))


def status_of(issues: Column) -> Column:
    """Page status as a function of its issues."""
    return (
        F.when(F.exists(issues, lambda i: i["severity"] == "error"), "error")
        .when(F.size(issues) > 0, "warning")
        .otherwise("ok")
    )


def recommendation(
    code: str, detail: Column | None, points: Column | None = None, urgent: Column | None = None
) -> Column:
    priority, category, default_points, problem, advice, impact = RECOMMENDATIONS[code]
    text = (F.lit(None) if detail is None else detail).cast("string")
    level, weight = F.lit(priority), F.lit(impact)
    if urgent is not None:
        level = F.when(urgent, "high").otherwise(level)
        weight = F.when(urgent, "Vysoký").otherwise(weight)
    return F.struct(
        F.lit(RECOMMENDATION_ORDER[code]).alias("ord"),
        F.lit(code).alias("code"),
        level.alias("priority"),
        F.lit(category).alias("category"),
        text.alias("detail"),
        (F.lit(default_points) if points is None else points.cast("int")).alias("points"),
        _fill(problem, text).alias("issue"),
        _fill(advice, text).alias("recommendation"),
        weight.alias("impact"),
    )


@lru_cache
def recommendations(broken_column: str | None = None) -> Column:
    """Recommendations of a page in rule order, over fact and metric columns."""
    total, missing = F.col("images_total"), F.col("images_without_alt")
    majority = missing / F.greatest(total, F.lit(1)) > 0.5
    words, size = F.col("word_count"), F.col("page_size")
    ease, density = F.col("readability"), F.col("keyword_density")
    structured = F.col("structured_data")
    invalid = F.exists(structured, lambda block: ~F.coalesce(block["valid"], F.lit(True)))
    rules = [
        *_length_rules("title", "title_missing", "title_short", "title_long", (30, 60)),
        *_length_rules("meta_description", "desc_missing", "desc_short", "desc_long", (120, 160)),
        Rule("h1_missing", F.col("h1").isNull()),
        Rule("canonical_missing", F.col("canonical").isNull()),
        Rule("no_https", ~F.col("https")),
        Rule("alt_majority", (missing > 0) & majority, F.concat(missing.cast("string"), F.lit("/"), total.cast("string"))),
        Rule("alt_some", (missing > 0) & ~majority, missing),
        Rule("text_very_thin", words < 300, words),
        Rule("text_thin", (words >= 300) & (words < 500), words),
        Rule("hard_to_read", ease < 30),
        Rule("readable_mid", (ease >= 30) & (ease < 50)),
        Rule("density_low", density < 0.5),
        Rule("density_high", density > 3),
        Rule("few_internal", F.col("internal_links_count") < 3),
        Rule("not_mobile", ~F.col("mobile_friendly")),
        Rule("no_structured", structured.isNull()),
        Rule("bad_structured", invalid),
        Rule("size_gt_3mb", size > 3 * MEGABYTE, megabytes(size)),
        Rule("size_gt_2mb", (size > 2 * MEGABYTE) & (size <= 3 * MEGABYTE), megabytes(size)),
        Rule("redirect_302", F.col("redirect_type") == 302),
        Rule("no_compression", ~F.col("compression")),
        Rule("no_cache", ~F.col("cache_headers")),
        Rule("not_minified", ~F.col("minified")),
    ]
    entries = [(rule.when, recommendation(rule.code, rule.detail)) for rule in rules]
    if broken_column:
        broken = F.col(broken_column)
        late = recommendation("broken_links", broken, F.least(F.lit(2), broken), broken > 5)
        entries.append((broken > 0, late))
    return fired(entries)
