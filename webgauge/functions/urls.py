"""URL columns: parts, WHATWG-style normal form, reference resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.hosts import PLAIN, parse_host
from webgauge.functions.text import blank_to_null, let

# Special schemes of the URL standard and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SPECIAL = "|".join(DEFAULT_PORTS)
# Groups: scheme, credentials, host, port, path, query, fragment. A host with a forbidden character does not match.
_PARTS = (
    rf"(?is)^({_SPECIAL}):[/\\]*+((?:[^/\\?#]*@)?)(\[[0-9a-f:.]+\]|[^\x00-\x20#<>^|%\\\[\]:/?@]+)"
    r"(?::0*+([0-9]{0,5}))?(?=[/\\?#]|$)([^?#]*+)(\?[^#]*+)?+(#.*)?+$"
)
# Characters that the standard percent-encodes in a path, in the query of a special URL and in a fragment.
_IN_PATH = r"""[^\x21-\x7E]|["<>`{}]"""
_IN_QUERY = r"""[^\x21-\x7E]|["'<>]"""
_IN_FRAGMENT = r"""[^\x21-\x7E]|["<>`]"""


def is_http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


# The part of a URL in front of its host, for absolute and for scheme-relative URLs, and the host in any spelling.
_HOST = rf"(?is)^((?:(?:{_SPECIAL}):)?[/\\]{{2,}}+(?:[^/\\?#]*@)?|(?:{_SPECIAL}):[/\\]*+(?:[^/\\?#]*@)?)(\[[^\]/\\?#]*\]|[^/\\?#:]*)"


def stripped(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def standard_host(reference: Column) -> Column:
    """A URL or reference whose host, if it has one, is written as the standard does.

    Every other function here expects that. A host that is not valid becomes one that none of them takes. The
    expression is large, so a row should go through it once, with all its URLs in one array.
    """

    def written(text: Column) -> Column:
        host, front = F.regexp_extract(text, _HOST, 2), F.regexp_extract(text, _HOST, 1)
        rest = F.substring(text, F.length(front) + F.length(host) + 1, F.length(text))
        changed = F.concat(front, F.coalesce(let(F.lower(host), parse_host), F.lit("%")), rest)
        return F.when((host == "") | host.rlike("(?i)" + PLAIN), text).otherwise(changed)

    return let(stripped(reference), written)


def split_url(url: Column) -> Column:
    """``struct<scheme, creds, host, port, path, query, fragment>`` of an absolute special URL, else null."""

    def part(group: int) -> Column:
        return F.regexp_extract(url, _PARTS, group)

    def port(scheme: Column) -> Column:
        default = F.coalesce(*[F.when(scheme == s, F.lit(p)) for s, p in DEFAULT_PORTS.items()])
        return F.when(part(4) == default, "").otherwise(part(4))

    fields = F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("creds"),
        F.lower(part(3)).alias("host"),
        port(F.lower(part(1))).alias("port"),
        part(5).alias("path"),
        part(6).alias("query"),
        part(7).alias("fragment"),
    )
    in_range = F.when(part(4) != "", part(4).cast("int") <= 65535).otherwise(True)
    return F.when(url.rlike(_PARTS) & in_range, fields)


def host_of(url: Column) -> Column:
    """Host of an absolute URL, null when the URL is not valid."""
    return split_url(url)["host"]


def percent_encode(c: Column, encoded: str) -> Column:
    def encode(ch: Column) -> Column:
        return F.when(ch.rlike(encoded), F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")).otherwise(ch)

    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    return F.when(c.rlike(encoded), F.array_join(F.transform(chars, encode), "")).otherwise(c)


def clean_path(path: Column) -> Column:
    """Path with dot segments removed and forward slashes only; never empty."""

    def push(done: Column, segment: Column) -> Column:
        up = F.lower(segment).isin("..", ".%2e", "%2e.", "%2e%2e")
        here = F.lower(segment).isin(".", "%2e")
        return (
            F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(here, done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/", "")
    kept = F.array_join(
        F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), push),
        "/",
    )
    ends_open = slashed.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}$")
    dotted = F.concat(F.lit("/"), kept, F.when(ends_open & (kept != ""), "/").otherwise(""))
    return F.when(slashed.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), dotted).otherwise(F.concat(F.lit("/"), slashed))


def _authority(p: Column) -> Column:
    return F.concat(p["creds"], p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))


def origin(p: Column) -> Column:
    """``scheme://host[:port]`` from URL parts."""
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))


def normalize(url: Column) -> Column:
    """Comparable form of an absolute special URL, null when it is not valid."""

    def join(p: Column) -> Column:
        path = percent_encode(clean_path(p["path"]), _IN_PATH)
        tail = F.concat(percent_encode(p["query"], _IN_QUERY), percent_encode(p["fragment"], _IN_FRAGMENT))
        return F.concat(p["scheme"], F.lit("://"), _authority(p), path, tail)

    return let(url, lambda text: let(split_url(text), join))


def join_url(reference: Column, base: Column) -> Column:
    """``reference`` resolved against ``base`` (both text) in normal form; null when that fails."""

    def resolve(ref: Column, p: Column) -> Column:
        stem = F.concat(p["scheme"], F.lit("://"), _authority(p))
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return (
            F.when(ref.rlike(rf"(?i)^(?:{_SPECIAL}):"), ref)
            .when(ref.rlike(r"^[/\\]{2}"), F.concat(p["scheme"], F.lit(":"), ref))
            .when(ref.rlike(r"^[/\\]"), F.concat(stem, ref))
            .when(ref.startswith("?"), F.concat(stem, path, ref))
            .when((ref == "") | ref.startswith("#"), F.concat(stem, path, p["query"], ref))
            .otherwise(F.concat(stem, F.regexp_replace(path, r"[^/\\]*$", ""), ref))
        )

    def opaque(ref: Column) -> Column:
        return ref.rlike(rf"^(?i)(?!(?:{_SPECIAL}):)[a-z][a-z0-9+.-]*:")

    pair = F.struct(stripped(reference).alias("ref"), split_url(base).alias("base"))
    return let(pair, lambda x: F.when(opaque(x["ref"]), x["ref"]).otherwise(normalize(resolve(x["ref"], x["base"]))))


def resolve_link(href: Column, page_url: Column, page_parts: Column) -> Column:
    """Link target as the link check sees it: absolute and root-relative links keep their spelling."""
    return (
        F.when(is_http(href), href)
        .when(href.startswith("//"), F.concat(page_parts["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(page_parts), href))
        .otherwise(blank_to_null(join_url(href, page_url)))
    )
