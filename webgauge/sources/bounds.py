"""The smallest pages on both sides of every bound of the rules, as SQL that Spark and the comparison engine read alike.

Each case takes one residue of the page id, so the cases grow with ``pages``. Residues of pages that the crawl could
not fetch are left out.
"""

from __future__ import annotations

_ID = "CAST(page_id AS VARCHAR(20))"
PERIOD, _FIRST = 200, 100
#: Pages of megabytes come less often.
SIZE_PERIOD, _SIZE_FIRST = 2000, 200
MEGABYTE = 1024 * 1024

# Host names in odd spellings, and what the URL standard makes of them.
HOST_CASES = {
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://127.1/x": "http://127.0.0.1/x",
    "http://ex%41mple.com/a": "http://example.com/a",
    "http://[0:0::0001]/": "http://[::1]/",
    "http://faß.de/": "http://xn--fa-hia.de/",
}
ICON_CASE = ("http://[0:0::0001]/f.png", "http://[::1]/f.png")
# Markup that the standard repairs, and markup in order with the same tree.
MARKUP_CASES = {
    "<aside><b></aside>text": "<b>text</b>",
    "<p><b class=menu>x</p>y</b>z": "<p></p>z",
    "<table>loose<tr><td>cell</td></tr></table>": "loose<table><tr><td>cell</td></tr></table>",
    "<table class=nav>kept<tr><td>gone</td></tr></table>": "kept",
    "<div class=menu><div>in</div></div>out": "out",
}


def _text(start: str, length: int, fill: str) -> str:
    return f"rpad('{start} ' || {_ID} || ' ', {length}, '{fill}')"


def page(
    title: int | None = 55,
    description: int | None = 155,
    heading: bool = True,
    links: int = 3,
    words: int = 500,
    images: tuple[int, int] = (0, 0),
    head: str = "",
    body: str = "",
    size: int | None = None,
) -> str:
    """SQL text of a page with these lengths and counts; ``images`` are all and those without a text."""
    parts = ["'<!DOCTYPE html><html><head>'"]
    if title is not None:
        parts += ["'<title>'", _text("Title", title, "bound"), "'</title>'"]
    if description is not None:
        parts += ["'<meta name=\"description\" content=\"'", _text("About", description, "bound"), "'\">'"]
    parts += [f"'{head}</head><body>'"]
    parts += ["'<h1>Heading</h1>'" if heading else "'<div>Heading</div>'"]
    parts += [f"repeat('<a href=\"/l\"></a>', {links})"]
    parts += [f"repeat('<img src=\"/a.png\" alt=\"a\">', {images[0] - images[1]}) || repeat('<img src=\"/b.png\">', {images[1]})"]
    parts += [f"'<p>' || repeat('word ', {words - 1}) || '</p>{body}</body></html>'"]
    whole = " || ".join(parts)
    return f"rpad({whole} || '<!--', {size - 3}, 'x') || '-->'" if size else whole


CASES = (
    *(page(title=n) for n in (None, 29, 30, 49, 50, 60, 61)),
    *(page(description=n) for n in (None, 119, 120, 149, 150, 160, 161)),
    page(heading=False),
    *(page(links=n) for n in (2, 3)),
    *(page(words=n) for n in (299, 300, 499)),
    *(page(images=n) for n in ((2, 1), (3, 2), (9, 5), (9, 6))),
    page(title=None, description=None, heading=False, links=0, words=2),
    *(page(head=f'<link rel="canonical" href="{url}">', body=f'<a href="{url}"></a>') for url in HOST_CASES),
    page(head=f'<link rel="icon" href="{ICON_CASE[0]}">'),
    *(page(body=markup) for markup in MARKUP_CASES),
)
SIZES = tuple(page(size=n) for n in (2 * MEGABYTE, 2 * MEGABYTE + 1, 3 * MEGABYTE, 3 * MEGABYTE + 1))


def _residues(cases: tuple[str, ...], first: int, last: int) -> dict[int, str]:
    fetched = [r for r in range(first, last) if r % 20 not in (7, 17) and r % 40 != 23]
    return dict(zip(fetched, cases))


def with_cases(html: str) -> str:
    """SQL of the crawled markup: ``html`` but for the pages that are a case."""
    for period, cases in ((PERIOD, _residues(CASES, _FIRST, PERIOD)), (SIZE_PERIOD, _residues(SIZES, _SIZE_FIRST, SIZE_PERIOD))):
        chosen = " ".join(f"WHEN {r} THEN {case}" for r, case in cases.items())
        html = f"CASE page_id % {period} {chosen} ELSE {html} END"
    return html
