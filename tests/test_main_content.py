"""Main content where side elements end without an end tag of their own."""

import time

import pytest
from pyspark.sql import functions as F

from webgauge.functions.html import main_content, nodes, text_of

# Body, main text, paragraphs.
BODIES = [
    ('<ul><li class="menu">Menu<li>Item</ul><p>main content</p>', "Itemmain content", 1),
    ("<div><nav>side</div><p>main</p>", "main", 1),
    ('<table><tr><td class="nav">side<td>kept</table><p>after</p>', "keptafter", 1),
    ('<td class="nav">no cell without a table<td>kept</table>', "no cell without a tablekept", 0),
    ("<table><tr class=header><td>h<tr><td>d</table>e", "de", 0),
    ("<p class=nav>a<p>b</p>", "b", 1),
    ("<p><span class=nav>a</p><p>b</p>", "b", 2),
    ("<p class=nav>x<hr class=menu>m", "m", 0),
    ("<dl><dt class=menu>a<dd>b</dl>c", "bc", 0),
    ("<select><option class=nav>a<option>b</select>c", "bc", 0),
    ("<nav>x<nav>y</nav>z</nav>k", "k", 0),
    ("a<footer>gone<b>t", "a", 0),
    ("<ul class=menu><li>a<ul><li>b</ul></ul>c", "c", 0),
    ("<div class=nav><p>x</div></p>z", "z", 1),
    ("<br class=nav>k<hr class=menu>m", "km", 0),
    ("<div>no sides<p>a</div>", "no sidesa", 1),
    ("<header>x</header>k" * 600, "k" * 600, 0),
    ("", "", 0),
    # Formatting elements go on until their own end tag, in another element too.
    ("<aside><b></aside>text", "text", 0),
    ("<p><b class=menu>x</p>y</b>z", "z", 1),
    ("<b class=menu>x<div>y</b>z</div>w", "zw", 0),
    ("<b class=menu>x<b>y</b>z</b>w", "w", 0),
    ("<a class=menu>m<a>n</a>o", "no", 0),
    ("<p><a class=menu>m</p><p>n</a>o</p>", "o", 2),
    ("<div><b class=menu>a<div>c</div></div>d</b>e", "e", 0),
    ("<b class=menu>x<table><tr><td>y</b>z</table>w</b>k", "k", 0),
    ("<p><i class=nav>x</p><table><tr><td>y</table>z</i>w", "yw", 1),
    ("<b><span class=nav>x</b>y", "y", 0),
    # What stands in a table outside its cells belongs in front of it.
    ("<table>loose<tr><td>cell</table>after", "loosecellafter", 0),
    ("<table class=nav>loose<tr><td>cell</table>after", "looseafter", 0),
    ("<p>a<table><tr><td>cell</td>loose</tr></table>b", "aloosecellb", 1),
    ("<table><tr class=menu>text<td>x</table>k", "textk", 0),
    ("<table><tr><div class=menu>m</div>t<td>c</table>", "tc", 0),
    ("<aside><table>x<tr><td>y</table></aside>z", "z", 0),
    ("<table class=nav><tr><p>para<td>c</table>z", "paraz", 1),
    ("<table><caption class=menu>m</caption><tr><td>c</table>", "c", 0),
    ("<table><tr><td>a<table>l<tr><td>b</table></table>", "alb", 0),
    ("<table><b class=menu>m<tr><td>c</table>k</b>z", "cz", 0),
    ("<table> <tr> <td>a</td> <td>b</td> </tr> </table>", "  a b  ", 0),
    ("<table><tr><td>1<tr><td>2</table><table>x<td>3<table><td>4</table>y", "12x34y", 0),
    ("<table>t<td>1</td>" + "u<td>2</td>" * 300 + "</table>", "t" + "u" * 300 + "1" + "2" * 300, 0),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, f"<html><body>{b}") for i, (b, _, _) in enumerate(BODIES)], "i int, html string")
    part = df.select("i", main_content(nodes(F.col("html"))).alias("m"))
    return {r.i: (r.text, r.paragraphs) for r in part.select("i", text_of(F.col("m.nodes")).alias("text"), "m.paragraphs").collect()}


@pytest.mark.parametrize("i", range(len(BODIES)))
def test_side_elements_end(found, i):
    assert found[i] == BODIES[i][1:]


@pytest.mark.parametrize("page,text", [("<div>" * 16_000 + "k", "k"), ("<div class=card><header>h</header><p>k</div>" * 16_000, "k" * 16_000)])
def test_large_pages_take_time_in_proportion(spark, page, text):
    df = spark.createDataFrame([(f"<html><body>{page}",)], "html string")
    part = df.select(main_content(nodes(F.col("html"))).alias("m")).select(text_of(F.col("m.nodes")).alias("text"))
    part.collect()
    begin = time.time()
    assert part.first().text == text
    assert time.time() - begin < 10
