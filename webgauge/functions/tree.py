"""Which nodes of a body belong to its main content, by a walk over the elements that are open.

The open elements are a text with one character per element, innermost first, so every rule of the standard about
what is open, in scope or implied is a search for the nearest of some characters. The walk also keeps

* the active formatting elements, from the first one that is a side element on: their text goes on behind the end of
  the element around them until their own end tag ("reconstruction");
* where tables start: what stands in a table outside its cells belongs in front of the table ("foster parenting").

Its result is ranges of nodes: removed ones, and ones that move in front of a table. Ranges are gathered in batches,
so that the walk stays linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.text import WS, let

# Element groups of the HTML standard.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSES_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl",
    "fieldset", "figcaption", "figure", "footer", "header", "hgroup", "main", "menu", "nav", "ol",
    "section", "summary", "ul", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "listing", "form", "table",
    "hr", "xmp", "plaintext",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TABLE_PARTS = ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th")
SPECIAL = (
    *CLOSES_PARAGRAPH, "applet", "area", "base", "body", "br", "button", "caption", "col", "colgroup", "dd", "dt",
    "embed", "head", "html", "iframe", "img", "input", "li", "link", "marquee", "meta", "noembed", "noframes",
    "noscript", "object", "p", "param", "script", "select", "source", "style", "tbody", "td", "template",
    "textarea", "tfoot", "th", "thead", "title", "tr", "track", "wbr",
)
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
SCOPE = ("applet", "caption", "html", "table", "td", "th", "marquee", "object", "template")
BUTTON_SCOPE = (*SCOPE, "button")
LIST_SCOPE = (*SCOPE, "ol", "ul")
TABLE_SCOPE = ("html", "table", "template")
ROW_GROUPS = ("tbody", "thead", "tfoot")
#: Formatting elements do not go on from outside into these.
MARKERS = ("td", "th", "caption", "applet", "marquee", "object", "template")
#: What may stand right inside a table, a row group or a row.
TABLE_CONTENT = (*TABLE_PARTS, "table", "script", "style", "template", "form")
TABLE_CONTEXT = ("table", *ROW_GROUPS, "tr")
#: Start tags before which formatting elements do not go on.
NOT_INLINE = (*CLOSES_PARAGRAPH, "p", "li", "dd", "dt", *TABLE_PARTS, "script", "style", "link", "meta", "title", "template", "base", "iframe", "noembed", "textarea")

# One character for each known name; the most frequent elements have one byte.
_ALPHABET = [*map(chr, range(48, 58)), *map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0x100, 0x180))]
_FREQUENT = ("div", "p", "li", "ul", "span", "td", "tr", "table")
_KNOWN = tuple(dict.fromkeys((*_FREQUENT, *SPECIAL, "option", "optgroup")))
CODE = dict(zip(_KNOWN, _ALPHABET)) | {name: chr(0x180 + k) for k, name in enumerate(FORMATTING)}
#: Other names of a page have characters from here on, by the order in which they first occur.
_OTHERS, _OTHERS_SIZE = 0x3400, 0xA000


def _codes(*names: str) -> str:
    return "".join(CODE[n] for n in names)


# Formatting elements: open, open and a side element, no longer open, no longer open and a side element.
OPEN = _codes(*FORMATTING)
OPEN_SIDE, LOST, LOST_SIDE = ("".join(chr(ord(c) + shift) for c in OPEN) for shift in (0x10, 0x20, 0x30))
MARK = "|"
P, TABLE = CODE["p"], CODE["table"]

RANGE = "struct<first:int,last:int,before:int>"
#: The elements that are open (one character each, innermost first) and their number; how many are below the outermost
#: open side element (-1: none) and where its range starts; active formatting elements; where the open tables start; how
#: many are below the element that stands in front of a table (-1: none), the side element around that table, where the
#: element starts and which table it is; paragraphs so far; the ranges that the last tag has ended.
STATE = (
    "struct<open:string,depth:int,base:int,first:int,active:string,tables:array<int>,foster:int,held:int,start:int,before:int,"
    f"paragraphs:int,found:array<{RANGE}>>"
)
FIELDS = ("open", "depth", "base", "first", "active", "tables", "foster", "held", "start", "before", "paragraphs", "found")
CHUNK = 256


def _until(names: tuple[str, ...], barriers: tuple[str, ...] = (), upto: bool = False) -> str:
    """Regex for the innermost open elements through one of ``names`` (or up to it), unless a barrier comes first."""
    wanted, stop = _codes(*names), _codes(*dict.fromkeys((*names, *barriers)))
    return rf"^[^{stop}]*+(?=[{wanted}])" if upto else rf"^[^{stop}]*+[{wanted}]"


def _is(code: Column, *names: str) -> Column:
    return code.isin([CODE[n] for n in names])


def _holds(text: Column, chars: str) -> Column:
    return text.rlike(f"[{chars}]")


def _after_start(open_: Column, code: Column) -> Column:
    """Elements still open when a start tag has closed those that it implies."""
    loose = tuple(n for n in SPECIAL if n not in ("address", "div", "p"))
    rules = [
        (("li",), _until(("li",), loose)),
        (("dd", "dt"), _until(("dd", "dt"), loose)),
        (("td", "th"), _until(("tr", *ROW_GROUPS, *TABLE_SCOPE), upto=True)),
        (("tr",), _until((*ROW_GROUPS, *TABLE_SCOPE), upto=True)),
        (("caption", "colgroup", "col", *ROW_GROUPS), _until(TABLE_SCOPE, upto=True)),
        (("option",), f"^{CODE['option']}"),
        (("optgroup",), f"^{CODE['option']}?+{CODE['optgroup']}?+"),
        (("a",), _until(("a",), SPECIAL)),
        (("table",), f"^(?=[{_codes(*TABLE_CONTEXT)}]){_until(('table',), ('template', 'html'))[1:]}"),
    ]
    closed = F.when(F.lit(False), open_)
    for names, pattern in rules:
        closed = closed.when(_is(code, *names), F.regexp_replace(open_, pattern, ""))
    closed = closed.otherwise(open_)
    flow = _is(code, "p", "li", "dd", "dt", *CLOSES_PARAGRAPH) & F.contains(open_, F.lit(P))
    heading = _is(code, *HEADINGS)

    def after(c: Column) -> Column:
        without_p = F.when(flow, F.regexp_replace(c, _until(("p",), BUTTON_SCOPE), "")).otherwise(c)
        return F.when(heading, F.regexp_replace(without_p, f"^[{_codes(*HEADINGS)}]", "")).otherwise(without_p)

    return let(closed, after)


def _after_end(open_: Column, code: Column) -> Column:
    """Elements still open after an end tag; it is ignored when its element is not open or not in reach."""
    rules = [
        (("p",), BUTTON_SCOPE),
        (("li",), LIST_SCOPE),
        (("table", *TABLE_PARTS), TABLE_SCOPE),
        (("dd", "dt", "button", *CLOSES_PARAGRAPH), SCOPE),
    ]

    def left(pos: Column) -> Column:
        def reach(inner: Column) -> Column:
            blocked = F.when(F.lit(False), False)
            for names, barriers in rules:
                blocked = blocked.when(_is(code, *names), _holds(inner, _codes(*barriers)))
            return blocked.otherwise(_holds(inner, _codes(*SPECIAL)))

        blocked = F.when(pos > 1, let(F.substring(open_, F.lit(1), pos - 1), reach)).otherwise(False)
        return F.when((pos == 0) | blocked, open_).otherwise(F.substring(open_, pos + 1, F.length(open_)))

    at = F.call_function("locate", code, open_)
    heading = F.regexp_replace(open_, _until(HEADINGS, SCOPE), "")
    return F.when(_is(code, *HEADINGS), heading).otherwise(let(at, left))


def _forms(code: Column) -> Column:
    """The characters that stand for a formatting element: open, open side, lost, lost side."""
    place = F.array_position(F.array([F.lit(c) for c in OPEN]), code).cast("int")
    return F.transform(F.array([F.lit(c) for c in (OPEN, OPEN_SIDE, LOST, LOST_SIDE)]), lambda c: F.substring(c, place, F.lit(1)))


def _after_formatting_end(s: Column, code: Column) -> Column:
    """``struct<rest, gone, top, own, active>`` after the end tag of an active formatting element.

    With a block inside the element, the block stays open: the element is taken out from below it (``gone`` is
    where it stood, -1 otherwise), together with what is not special at the top; ``top`` elements are left of the old ones.
    ``own`` is 1 if the element itself is the last one closed: it does not go on.
    """

    def first_of(text: Column, forms: Column) -> Column:
        places = F.filter(F.transform(forms, lambda c: F.call_function("locate", c, text)), lambda p: p > 0)
        return F.coalesce(F.array_min(places), F.lit(0))

    def found(forms: Column) -> Column:
        both = F.struct(first_of(s["active"], forms).alias("entry"), first_of(s["open"], F.slice(forms, 1, 2)).alias("at"))
        return let(both, end)

    def end(f: Column) -> Column:
        lost = _holds(F.substring(s["active"], f["entry"], F.lit(1)), LOST + LOST_SIDE)
        active = F.concat(F.substring(s["active"], F.lit(1), f["entry"] - 1), F.substring(s["active"], f["entry"] + 1, F.length(s["active"])))
        inner = F.substring(s["open"], F.lit(1), f["at"] - 1)
        below = F.substring(s["open"], f["at"] + 1, F.length(s["open"]))
        special = F.regexp_replace(inner, f"^[^{_codes(*SPECIAL)}]*+", "")
        blocked = special != ""
        stays, under = lost | (f["at"] == 0), s["depth"] - f["at"]
        return F.struct(
            F.when(stays, s["open"]).when(blocked, F.concat(special, below)).otherwise(below).alias("rest"),
            F.when(~stays & blocked, under).otherwise(-1).alias("gone"),
            F.when(stays, s["depth"]).when(blocked, F.length(special) + 1 + under).otherwise(under).alias("top"),
            F.when(stays | blocked, 0).otherwise(1).alias("own"),
            active.alias("active"),
        )

    return let(_forms(code), found)


def _lose(active: Column, popped: Column) -> Column:
    """The active formatting elements when ``popped`` elements are closed: past a marker they end, else they are lost."""
    markers, mine = _codes(*MARKERS), OPEN + OPEN_SIDE
    crossed = F.length(F.regexp_replace(popped, f"[^{markers}]", ""))
    total = F.length(F.regexp_replace(active, r"[^|]", ""))
    behind = F.when(crossed > total, "").otherwise(F.call_function("substring_index", active, F.lit(MARK), -(total - crossed + 1)))
    kept = F.when(crossed > 0, behind).otherwise(active)
    outer = F.regexp_extract(popped, f"[^{markers}]*$", 0)
    count = F.length(F.regexp_replace(outer, f"[^{mine}]", ""))

    def mark(x: Column) -> Column:
        already = F.length(F.regexp_extract(x["kept"], f"^[{LOST}{LOST_SIDE}]*", 0))
        head = already + x["count"]
        lost = F.translate(F.substring(x["kept"], F.lit(1), head), mine, LOST + LOST_SIDE)
        return F.when(x["count"] == 0, x["kept"]).otherwise(F.concat(lost, F.substring(x["kept"], head + 1, F.length(x["kept"]))))

    return let(F.struct(kept.alias("kept"), count.alias("count")), mark)


def _range(condition: Column, first: Column, last: Column, before: Column | int) -> Column:
    before = F.lit(before) if isinstance(before, int) else before
    return F.struct(F.when(condition, first).otherwise(-1).alias("first"), last.alias("last"), before.alias("before"))


def _state(s: Column, ended: Column | None = None, **changed: Column) -> Column:
    """The state with some fields changed and with more ranges that have ended."""
    if ended is not None:
        changed["found"] = F.when(F.size(ended) == 0, s["found"]).otherwise(F.concat(s["found"], ended))
    return F.struct(*[changed.get(n, s[n]).alias(n) for n in FIELDS])


def _closed(s: Column, e: Column) -> Column:
    """``struct<rest, gone, top, own, active>`` when a tag has closed what it closes, without the reopened."""
    is_end = e["step"] < 0
    formatting = e["code"].isin(list(OPEN)) & (s["active"] != "") & (is_end | _is(e["code"], "a"))
    reach = F.regexp_extract(s["active"], r"^[^|]*", 0)
    listed = F.exists(_forms(e["code"]), lambda c: F.contains(reach, c))
    plain = F.when(is_end, _after_end(s["open"], e["code"])).otherwise(_after_start(s["open"], e["code"]))

    def sized(rest: Column) -> Column:
        top = F.when(rest == s["open"], s["depth"]).otherwise(F.length(rest))
        return F.struct(rest.alias("rest"), F.lit(-1).alias("gone"), top.alias("top"), F.lit(0).alias("own"), s["active"].alias("active"))

    return F.when(formatting & listed, _after_formatting_end(s, e["code"])).otherwise(let(plain, sized))


def _left(s: Column, e: Column, c: Column) -> Column:
    """The state when the elements that a tag closes are gone, with the ranges that end there."""
    at, own_end, top, gone = e["at"], e["step"] < 0, c["top"], c["gone"]
    size = F.when(gone >= 0, top - 1).otherwise(top)
    shifted = lambda d: F.when((gone >= 0) & (d > gone), d - 1).otherwise(d)
    out_of_foster = (s["foster"] >= 0) & (top <= s["foster"])
    foster_last = F.when(own_end & (top == s["foster"]), at).otherwise(at - 1)
    ended = (s["base"] >= 0) & ((top <= s["base"]) | (gone == s["base"]))
    side_last = F.when(own_end & ((top == s["base"]) | (gone == s["base"])), at).otherwise(at - 1)
    held_open = (s["held"] >= 0) & (s["held"] < top)
    popped = F.substring(s["open"], F.lit(1), s["depth"] - top - c["own"])
    active = F.when((c["active"] == "") | (top == s["depth"]), c["active"]).otherwise(let(popped, lambda p: _lose(c["active"], p)))
    tables = F.when((F.size(s["tables"]) == 0) | (top == s["depth"]), s["tables"]).otherwise(
        F.slice(s["tables"], F.lit(1), F.length(F.regexp_replace(c["rest"], f"[^{TABLE}]", "")))
    )
    found = F.filter(
        F.array(
            _range(out_of_foster & (s["base"] >= 0), s["first"], foster_last, -1),
            _range(out_of_foster, s["start"], foster_last, s["before"]),
            _range(~out_of_foster & ended, s["first"], side_last, -1),
        ),
        lambda r: (r["first"] >= 0) & (r["last"] >= r["first"]),
    )
    def changed(found: Column) -> Column:
        return _state(
            s,
            found,
            open=c["rest"],
            depth=size,
            base=F.when(out_of_foster, F.when(held_open, s["held"]).otherwise(-1)).when(ended, -1).otherwise(shifted(s["base"])),
            first=F.when(out_of_foster, foster_last + 1).otherwise(s["first"]),
            active=active,
            tables=tables,
            foster=F.when(out_of_foster, -1).otherwise(shifted(s["foster"])),
        )

    gathers = F.when(out_of_foster | ended, found).otherwise(F.array().cast(f"array<{RANGE}>"))
    unchanged = (top == s["depth"]) & (gone < 0) & (c["active"] == s["active"])
    return F.when(unchanged, s).otherwise(let(gathers, changed))


def _reopened(s: Column, at: Column) -> Column:
    """The state when lost formatting elements go on in front of the node ``at``."""
    lost = F.regexp_extract(s["active"], f"^[{LOST}{LOST_SIDE}]*", 0)

    def reopen(again: Column) -> Column:
        count = F.length(again)
        # The outermost of them that is a side element.
        above = F.length(F.regexp_extract(again, f"^.*[{OPEN_SIDE}]", 0))
        enters = (s["base"] < 0) & (above > 0)
        return _state(
            s,
            open=F.concat(again, s["open"]),
            depth=s["depth"] + count,
            active=F.concat(again, F.substring(s["active"], count + 1, F.length(s["active"]))),
            base=F.when(enters, s["depth"] + count - above).otherwise(s["base"]),
            first=F.when(enters, at).otherwise(s["first"]),
        )

    again = F.translate(lost, LOST + LOST_SIDE, OPEN + OPEN_SIDE)
    return F.when(_holds(F.substring(s["active"], 1, 1), LOST + LOST_SIDE), let(again, reopen)).otherwise(s)


def _in_table(s: Column) -> Column:
    return (F.size(s["tables"]) > 0) & (s["foster"] < 0) & F.substring(s["open"], 1, 1).isin(list(_codes(*TABLE_CONTEXT)))


def _fostered(s: Column, at: Column, alone: Column, side: Column) -> Column:
    """The state when the node ``at`` goes in front of the table around it; ``alone`` if nothing goes into it."""
    table = s["depth"] - F.call_function("locate", F.lit(TABLE), s["open"])

    def move(below: Column) -> Column:
        covered = (s["base"] >= 0) & (s["base"] < below)
        masked = (s["base"] >= 0) & ~covered
        kept = ~(alone & side)
        found = F.filter(
            F.array(_range(masked & kept, s["first"], at - 1, -1), _range(alone & kept, at, at, F.get(s["tables"], F.lit(0)))),
            lambda r: (r["first"] >= 0) & (r["last"] >= r["first"]),
        )

        def moved(found: Column) -> Column:
            return _state(
                s,
                found,
                first=F.when(alone & kept, at + 1).otherwise(s["first"]),
                foster=F.when(alone, s["foster"]).otherwise(s["depth"]),
                held=F.when(alone, s["held"]).otherwise(s["base"]),
                start=F.when(alone, s["start"]).otherwise(at),
                before=F.when(alone, s["before"]).otherwise(F.get(s["tables"], F.lit(0))),
                base=F.when(alone, s["base"]).otherwise(-1),
            )

        return F.when(covered, s).otherwise(let(found, moved))

    return let(table, move)


def _opened(s: Column, e: Column) -> Column:
    """The state when the element of a start tag is open."""
    at, void = e["at"], e["step"] == 0
    enters = e["side"] & (s["base"] < 0)
    formatting = e["code"].isin(list(OPEN))
    own = F.when(e["side"] & formatting, F.translate(e["code"], OPEN, OPEN_SIDE)).otherwise(e["code"])
    listed = formatting & (e["side"] | (s["active"] != ""))
    mark = (s["active"] != "") & _is(e["code"], *MARKERS)
    counts = (e["code"] == P) & (s["base"] < 0) & ~enters
    alone = F.filter(F.array(_range(enters, at, at, -1)), lambda r: r["first"] >= 0)
    inside = _state(
        s,
        open=F.concat(own, s["open"]),
        depth=s["depth"] + 1,
        base=F.when(enters, s["depth"]).otherwise(s["base"]),
        first=F.when(enters, at).otherwise(s["first"]),
        active=F.when(listed, F.concat(own, s["active"])).when(mark, F.concat(F.lit(MARK), s["active"])).otherwise(s["active"]),
        tables=F.when(e["code"] == TABLE, F.concat(F.array(at), s["tables"])).otherwise(s["tables"]),
        paragraphs=F.when(counts, s["paragraphs"] + 1).otherwise(s["paragraphs"]),
    )
    return F.when(void & enters, _state(s, alone)).when(void, s).otherwise(inside)


def _step(s: Column, e: Column) -> Column:
    at, code, text = e["at"], e["code"], e["code"] == ""
    start, end = (e["step"] >= 0) & ~text, e["step"] < 0
    # A part of a table without a table is no element.
    stray = start & _is(code, *TABLE_PARTS) & ~_holds(s["open"], _codes("table", "template"))

    def inline(x: Column) -> Column:
        return F.when((x["active"] == "") | _is(code, *NOT_INLINE), x).otherwise(_reopened(x, at))

    def placed(x: Column) -> Column:
        return F.when(_in_table(x) & ~_is(code, *TABLE_CONTENT), _fostered(x, at, e["step"] == 0, e["side"])).otherwise(x)

    def lone_end(x: Column) -> Column:
        """``</p>`` without an open paragraph makes an empty one."""
        lone = (code == P) & (x["depth"] == s["depth"]) & (x["base"] < 0)
        return F.when(lone, _state(x, paragraphs=x["paragraphs"] + 1)).otherwise(x)

    def tag(x: Column) -> Column:
        opened = let(let(inline(x), placed), lambda y: _opened(y, e))
        return F.when(end, lone_end(x)).otherwise(opened)

    def words() -> Column:
        return F.when(_in_table(s), _fostered(s, at, F.lit(True), F.lit(False))).when(s["active"] == "", s).otherwise(_reopened(s, at))

    closed = let(_closed(s, e), lambda c: _left(s, e, c))
    return F.when(text, words()).when(stray, s).otherwise(let(closed, tag))


def _next(acc: Column, e: Column) -> Column:
    """The next state, and the ranges gathered before it."""
    s = acc["state"]
    none = F.size(s["found"]) == 0
    fresh = F.when(none, s).otherwise(_state(s, found=F.array().cast(f"array<{RANGE}>")))
    batch = F.when(none, acc["batch"]).otherwise(F.concat(acc["batch"], s["found"]))
    return F.struct(let(fresh, lambda x: _step(x, e)).alias("state"), batch.alias("batch"))


def _finish(acc: Column, last: Column) -> Column:
    s = acc["state"]
    open_ranges = F.filter(
        F.array(
            _range(s["base"] >= 0, s["first"], last, -1),
            _range(s["foster"] >= 0, s["start"], last, s["before"]),
        ),
        lambda r: (r["first"] >= 0) & (r["last"] >= r["first"]),
    )
    ranges = F.concat(F.flatten(acc["batches"]), s["found"], open_ranges)
    return F.struct(ranges.alias("ranges"), s["paragraphs"].alias("paragraphs"))


def events(body: Column, is_side) -> Column:
    """Tags of a body, and its words where they can matter: ``struct<at, code, step, side>``."""
    void = [f"<{name}" for name in VOID]
    known = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])

    def coded(others: Column) -> Column:
        def code(name: Column) -> Column:
            number = F.lit(_OTHERS) + (F.array_position(others, name) - 1) % _OTHERS_SIZE
            other = F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")
            return F.coalesce(F.try_element_at(known, name), other)

        def event(n: Column, i: Column) -> Column:
            end, text = n["tag"].startswith("</"), n["tag"] == ""
            name = F.regexp_replace(n["tag"], "^</?", "")
            return F.struct(
                i.alias("at"),
                F.when(text, "").otherwise(let(name, code)).alias("code"),
                F.when(end, -1).when(text | n["tag"].isin(void), 0).otherwise(1).alias("step"),
                F.when(text | end, False).otherwise(is_side(n)).alias("side"),
                (text & n["raw"].rlike(f"[^{WS}]")).alias("words"),
            )

        def wanted(all_: Column) -> Column:
            tags = F.filter(all_, lambda e: e["code"] != "")
            inline = F.exists(all_, lambda e: (e["code"] == TABLE) | (e["side"] & e["code"].isin(list(OPEN))))
            return F.when(inline, F.filter(all_, lambda e: (e["code"] != "") | e["words"])).otherwise(tags)

        return let(F.transform(body, event), wanted)

    names = F.transform(F.filter(body, lambda n: n["tag"] != ""), lambda n: F.regexp_replace(n["tag"], "^</?", ""))
    return let(F.array_except(F.array_distinct(names), F.array([F.lit(n) for n in CODE])), coded)


def walk(tags: Column, last: Column) -> Column:
    """``struct<ranges, paragraphs>`` of a body whose last node is ``last``.

    A range with ``before`` of -1 is removed; another one stands in front of the node ``before``.
    The tags are taken in chunks, because ``aggregate`` copies what it has gathered at every step.
    """
    none = F.array().cast(f"array<{RANGE}>")
    values = (F.lit(""), F.lit(0), F.lit(-1), F.lit(0), F.lit(""), F.array().cast("array<int>"), *map(F.lit, (-1, -1, 0, 0, 0)), none)
    start = F.struct(F.struct(*values).cast(STATE).alias("state"), F.array().cast(f"array<array<{RANGE}>>").alias("batches"))

    def chunk(acc: Column, k: Column) -> Column:
        first = k * CHUNK
        at = F.sequence(first, F.least(first + CHUNK, F.size(tags)) - 1)
        own = F.aggregate(at, F.struct(acc["state"].alias("state"), none.alias("batch")), lambda a, i: _next(a, F.get(tags, i)))
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["batches"], F.array(o["batch"])).alias("batches")))

    chunks = F.filter(F.sequence(F.lit(0), F.floor(F.size(tags) / CHUNK).cast("int")), lambda k: k * CHUNK < F.size(tags))
    return F.aggregate(chunks, start, chunk, lambda acc: _finish(acc, last))


def in_order(ranges: Column, size: Column) -> Column:
    """Positions of the nodes that stay, in the order in which they stand after moves."""
    every = F.sequence(F.lit(0), size - 1)

    def positions(part: Column) -> Column:
        return F.flatten(F.transform(part, lambda r: F.sequence(r["first"], r["last"])))

    def reordered(kept: Column, moves: Column) -> Column:
        placed = F.flatten(
            F.transform(
                moves,
                lambda r: F.transform(
                    F.sequence(r["first"], r["last"]), lambda p: F.struct((2 * r["before"] - 1).alias("place"), p.alias("at"))
                ),
            )
        )
        others = F.transform(F.array_except(kept, positions(moves)), lambda p: F.struct((2 * p).alias("place"), p.alias("at")))
        return F.array_intersect(F.sort_array(F.concat(others, placed))["at"], kept)

    def stay(moves: Column) -> Column:
        kept = F.array_except(every, positions(F.filter(ranges, lambda r: r["before"] < 0)))
        return F.when(F.size(moves) == 0, kept).otherwise(let(kept, lambda k: reordered(k, moves)))

    return let(F.filter(ranges, lambda r: r["before"] >= 0), stay)
