"""HTML as columns: one regex pass cuts a page into nodes, everything else filters that array.

A node is ``struct<tag, raw>``: ``tag`` is ``<p`` for a start tag, ``</p`` for an end tag and empty for
text. Elements whose content is not markup (scripts, styles, titles ...) are one node with their body.
Quantifiers that loop over groups are possessive, so long pages cannot overflow the regex stack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions import tree
from webgauge.functions.text import WS, clean, let, unescape, unprotect
from webgauge.functions.tree import HEADINGS

# Element groups of the HTML standard.
RAW_TEXT = ("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp")
ESCAPABLE_TEXT = ("title", "textarea")
HEAD_ONLY = (
    "html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "style", "script", "noscript",
    "template", "noframes",
)
# What does not belong to the main content of a page.
SIDE_ELEMENTS = ("nav", "footer", "header", "aside")
SIDE_CLASSES = ("nav", "menu", "footer", "header")

_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_TAG_REST = r"""(?:[^>"'=]+|=\s*(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z)|[^\s>"'][^\s>]*)?+|["'])*+"""
_BODIED = "|".join(RAW_TEXT + ESCAPABLE_TEXT)
_NODE = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<({_BODIED})(?=[\s/>]){_TAG_REST}>.*?(?=</\1[\s/>]|\z)"
    r"|<[!?][^>]*(?:>|\z)|</(?![a-z])[^>]*(?:>|\z)"
    rf"|</?[a-z]{_TAG_REST}(?:>|\z)"
    r"|[^<]+|<"
)
_OPENING = rf"(?is)^<[a-z]{_TAG_REST}>"


def nodes(html: Column) -> Column:
    """``array<struct<tag, raw>>`` of a page in document order, without comments and declarations.

    Character references are decoded here, except those that would change how a tag is read.
    """
    text = F.regexp_replace(html, r"\r\n?", "\n")
    cut = F.regexp_extract_all(text, F.lit(_NODE), F.lit(0))

    def node(raw: Column) -> Column:
        tag = F.lower(F.regexp_extract(raw, r"^(?:</?[A-Za-z][^\s/>]*|<[!?/].?)", 0))
        return F.struct(tag.alias("tag"), raw.alias("raw"))

    def decode(n: Column) -> Column:
        verbatim = n["tag"].isin([f"<{name}" for name in RAW_TEXT])
        text = (n["tag"] == "") | n["tag"].isin([f"<{name}" for name in ESCAPABLE_TEXT])
        raw = F.when(verbatim, n["raw"]).otherwise(unescape(n["raw"], ~text))
        return F.struct(n["tag"].alias("tag"), raw.alias("raw"))

    known = F.filter(F.transform(cut, node), lambda n: ~n["tag"].rlike("^<(?:[!?]|/[^a-z]|/$)"))
    # A tag cut off by the end of the page does not count.
    whole = F.filter(known, lambda n: ~n["tag"].startswith("<") | n["raw"].rlike(r">|^</"))
    return F.transform(whole, decode)


def tags_named(page: Column, *names: str) -> Column:
    """Source text of all start tags with one of these names."""
    wanted = [f"<{name}" for name in names]
    return F.filter(page, lambda n: n["tag"].isin(wanted))["raw"]


def _attribute(name: str, captured: str) -> str:
    """Regex for an attribute at an attribute boundary, never inside another value."""
    edge = rf"(?i)^<[a-z][^\s/>]*+(?:[\s/]*+(?!{re.escape(name)}(?:[\s=/>]|\z))[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+"
    return rf"{edge}[\s/]*+{re.escape(name)}(?=[\s=/>]){captured}"


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute of that name; empty when absent."""
    value = r"""\s*+=\s*+(?:["'](?<=")(?=[^"]*+")|["'](?<=')(?=[^']*+')|(?=[^\s"'>]))((?<=")[^"]*+|(?<=')[^']*+|[^\s"'>][^\s>]*+)"""
    return unprotect(F.regexp_extract(tag, _attribute(name, value), 1))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_attribute(name, ""))


def opening(raw: Column) -> Column:
    """The start tag of a node, without the body that raw-text elements carry."""
    return F.regexp_extract(raw, _OPENING, 0)


def body_of(raw: Column) -> Column:
    """The body of a raw-text node."""
    return F.regexp_replace(raw, _OPENING, "")


def node_text(n: Column) -> Column:
    """Text that a node contributes to its element."""
    bodied = [f"<{name}" for name in RAW_TEXT + ESCAPABLE_TEXT]
    return F.when(n["tag"] == "", n["raw"]).when(n["tag"].isin(bodied), body_of(n["raw"])).otherwise("")


def text_of(part: Column) -> Column:
    """Concatenated text of nodes, without a separator between them."""
    return F.array_join(F.transform(part, node_text), "")


def first_title(page: Column) -> Column:
    return clean(body_of(F.get(tags_named(page, "title"), F.lit(0))))


def first_heading_text(page: Column) -> Column:
    """Text of the first ``h1``; any heading end tag closes it."""

    def inner(tail: Column) -> Column:
        ends = [f"</{name}" for name in HEADINGS]
        end = F.array_position(F.transform(tail, lambda n: n["tag"].isin(ends)), True)
        return text_of(F.slice(tail, F.lit(2), F.when(end > 0, end - 2).otherwise(F.size(tail)).cast("int")))

    start = F.array_position(page["tag"], "<h1")
    tail = F.slice(page, F.greatest(start, F.lit(1)).cast("int"), F.size(page))
    return F.when(start > 0, clean(let(tail, inner)))


def body_nodes(page: Column) -> Column:
    """Nodes inside ``body``; without a body tag, everything from the first node that a head cannot hold."""

    def after_head(n: Column) -> Column:
        head = [edge + name for name in HEAD_ONLY for edge in ("<", "</")]
        return ~n["tag"].isin(head) & ((n["tag"] != "") | n["raw"].rlike(f"[^{WS}]"))

    tagged = F.array_position(page["tag"], "<body")
    implied = F.array_position(F.transform(page, after_head), True)
    start = (
        F.when(tagged > 0, tagged + 1)
        .when(implied > 0, implied)
        .otherwise(F.size(page) + 1)
    )
    return F.slice(page, start.cast("int"), F.size(page))


def _is_side(n: Column) -> Column:
    named = n["tag"].isin([f"<{name}" for name in SIDE_ELEMENTS])
    start = n["tag"].startswith("<") & ~n["tag"].startswith("</") & ~n["tag"].isin("<script", "<style")
    maybe = start & n["raw"].rlike(rf"(?i)\sclass\s*=[^>]*(?:{'|'.join(SIDE_CLASSES)})")
    classes = rf"(?:^|\s)(?:{'|'.join(SIDE_CLASSES)})(?:\s|$)"
    return named | (maybe & attribute(opening(n["raw"]), "class").rlike(classes))


def main_content(page: Column) -> Column:
    """``struct<nodes, paragraphs>``: body nodes outside scripts, styles and side elements, in the order of the
    document tree, and the number of paragraph elements among them."""
    gone = ["<script", "<style"]

    def content(body: Column) -> Column:
        walked = let(tree.events(body, _is_side), lambda tags: tree.walk(tags, F.size(body) - 1))
        return let(walked, lambda w: kept(body, w))

    def kept(body: Column, w: Column) -> Column:
        order = tree.in_order(w["ranges"], F.size(body))
        nodes_ = F.when(F.size(w["ranges"]) == 0, body).otherwise(F.transform(order, lambda i: F.get(body, i)))
        return F.struct(F.filter(nodes_, lambda n: ~n["tag"].isin(gone)).alias("nodes"), w["paragraphs"].alias("paragraphs"))

    return let(body_nodes(page), content)
