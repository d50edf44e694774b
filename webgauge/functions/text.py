"""Text expressions with browser-script semantics (white space, lengths, rounding, entities)."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a browser script counts as white space (the body of a regex class).
WS = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


# The same characters one by one.
WS_CHARS = "".join(
    map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Needed inside lambdas: the optimizer may otherwise inline a costly expression into the
    lambda and evaluate it for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def plain_spaces(c: Column) -> Column:
    """Every white-space character as a blank.

    Splitting on single blanks is several times faster than on the full white-space class.
    """
    return F.translate(c, WS_CHARS, " " * len(WS_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Trimmed text, missing when blank."""
    return blank_to_null(trim(c))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units: an emoji counts as two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def occurrences(c: Column, text: str) -> Column:
    """Number of non-overlapping occurrences of a fixed text."""
    gone = F.replace(c, F.lit(text), F.lit(""))
    return ((F.length(c) - F.length(gone)) / len(text)).cast("int")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds ties towards +infinity, in double arithmetic."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + F.lit(0.5).cast("double")).cast("double") / scale


def _entity_tables() -> str:
    """The public HTML 5 names as JSON: one table per first character from ``A`` to ``z``, so that a lookup is short."""
    tables: list[dict[str, str]] = [{} for _ in range(ord("A"), ord("z") + 1)]
    for name, text in html5.items():
        tables[ord(name[0]) - ord("A")][f"&{name}"] = text
    return json.dumps(tables)


def _windows_table() -> str:
    """The code points 128-159 by Windows-1252, as JSON."""
    texts = {code: bytes([code]).decode("cp1252", errors="ignore") for code in range(0x80, 0xA0)}
    return json.dumps({f"{code:X}": text for code, text in texts.items() if text})


ENTITY_TABLES = _entity_tables()
WINDOWS_TABLE = _windows_table()
#: Names that are known without a semicolon, the longest first: a text may go on right behind them.
_BARE_NAME = f"^&(?:{'|'.join(sorted((n for n in html5 if not n.endswith(';')), key=lambda n: (-len(n), n)))})"
# Characters that would change how a tag is read, and the references that stand for them.
MARKUP = {'"': "&quot;", "'": "&#39;", "<": "&lt;", ">": "&gt;", "=": "&#61;", " ": "&#32;", "\n": "&#10;", "\t": "&#9;", "&": "&amp;"}
COMMON_ENTITIES = {"&amp;": "&", "&nbsp;": "\u00a0", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'"}


def _code_point(hex_digits: Column) -> Column:
    """One character from its hexadecimal code point."""
    padded = F.lpad(hex_digits, 8, "0")
    known = (F.length(hex_digits) <= 6) & (padded > "00000000") & (padded <= "0010FFFF")
    surrogate = (padded >= "0000D800") & (padded <= "0000DFFF")
    return F.when(known & ~surrogate, F.decode(F.unhex(padded), "UTF-32")).otherwise("�")


def _reference(token: Column, in_tag: Column) -> Column:
    tables = F.from_json(F.lit(ENTITY_TABLES), "array<map<string,string>>")
    windows = F.from_json(F.lit(WINDOWS_TABLE), "map<string,string>")
    decimal = F.regexp_extract(token, "^&#0*([0-9]+)", 1)
    hexadecimal = F.regexp_extract(token, "(?i)^&#x0*([0-9a-f]+)", 1)

    def decoded() -> Column:
        value = F.when(~token.startswith("&") | (token == "&"), token)
        for name, text in COMMON_ENTITIES.items():
            value = value.when(token == name, F.lit(text))
        number = F.when(hexadecimal != "", F.upper(hexadecimal)).when(decimal != "", F.hex(decimal.try_cast("bigint")))
        numeric = let(
            F.coalesce(number, F.lit("110000")), lambda n: F.coalesce(F.try_element_at(windows, n), _code_point(n))
        )
        return value.when(token.startswith("&#"), numeric).otherwise(F.coalesce(known(token), prefixed(), token))

    def known(name: Column) -> Column:
        table = F.get(tables, F.ascii(F.substring(name, 2, 1)) - ord("A"))
        return F.try_element_at(table, name)

    def prefixed() -> Column:
        """In text the longest known beginning counts; "?a=1&copy=2" in a tag keeps its text."""
        name = F.regexp_extract(token, _BARE_NAME, 0)
        rest = F.substring(token, F.length(name) + 1, F.length(token))
        return F.when(~in_tag & (name != ""), F.concat(known(name), rest))

    def protected(text: Column) -> Column:
        """Inside a tag, characters with a meaning there stay references until the value is cut out."""
        value = F.when(~token.startswith("&") | (token == "&"), text)
        for char, reference in MARKUP.items():
            value = value.when(text == char, F.lit(reference))
        return value.otherwise(text)

    return let(decoded(), lambda text: F.when(in_tag, protected(text)).otherwise(text))


def unescape(c: Column, in_tag: Column) -> Column:
    """Decode character references in one pass; text without ``&`` is returned as it is."""
    parts = F.regexp_extract_all(
        c, F.lit(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)|[^&]+|&"), F.lit(0)
    )
    decoded = F.array_join(F.transform(parts, lambda t: _reference(t, in_tag)), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def unprotect(c: Column) -> Column:
    """Decode the references that ``unescape`` left inside a tag."""
    value = c
    for char, reference in MARKUP.items():
        value = F.replace(value, F.lit(reference), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), value).otherwise(c)
