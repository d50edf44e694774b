"""Host names by the URL standard: escapes, international names, IPv4 numbers in all spellings, IPv6 addresses.

Most hosts are plain names and pass at once; the rest goes through one expression each, in the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.functions.text import let

# What no host may hold once its escapes are decoded, and the names whose last part cannot be a number.
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F\x{FFFD}]"
PLAIN = r"^(?:[a-z0-9_-]+\.)*[a-z][a-z0-9_-]*\.?$"
_NUMBER_LAST = r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?$"
# Characters that the mapping of 2003 replaced and the present one keeps.
_KEPT = r"[\x{DF}\x{3C2}\x{200C}\x{200D}]"
# The parameters of Punycode.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def _code_points(text: Column) -> Column:
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))


def _variable_length(delta: Column, bias: Column) -> Column:
    """``delta`` in digits of base 36 whose thresholds follow ``bias``."""

    def step(s: Column, j: Column) -> Column:
        t = F.greatest(F.lit(_T_MIN), F.least(F.lit(_T_MAX), j * _BASE - bias)).cast("long")
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, _BASE - t))
        more = F.struct(
            F.when(last, F.lit(-1).cast("long")).otherwise(_floor((s["q"] - t) / (_BASE - t))).alias("q"),
            F.concat(s["out"], F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))).alias("out"),
        )
        return F.when(s["q"] < 0, s).otherwise(more)

    start = F.struct(delta.alias("q"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    halved = F.when(first, _floor(delta / _DAMP)).otherwise(_floor(delta / 2))

    def shrink(s: Column, _: Column) -> Column:
        more = F.struct(_floor(s["d"] / (_BASE - _T_MIN)).alias("d"), (s["k"] + _BASE).alias("k"))
        return F.when(s["d"] > (_BASE - _T_MIN) * _T_MAX // 2, more).otherwise(s)

    def bias(s: Column) -> Column:
        return s["k"] + _floor((_BASE - _T_MIN + 1) * s["d"] / (s["d"] + _SKEW))

    start = F.struct((halved + _floor(halved / points)).alias("d"), F.lit(0).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, shrink, bias)


def punycode(label: Column) -> Column:
    """A label in Punycode, without its prefix.

    The characters beyond ASCII are taken by code point and place; the decoder inserts them in that order, so the
    distance from the one before follows from how many characters are there already and how many precede the place.
    """

    def encode(codes: Column) -> Column:
        basic = F.regexp_replace(label, r"[^\x00-\x7F]", "")
        others = F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("at"))), lambda x: x["c"] >= _FIRST)

        def step(s: Column, x: Column) -> Column:
            before = F.size(F.filter(codes, lambda c, i: (i < x["at"]) & (c <= x["c"])))
            delta = (x["c"] - s["n"]) * (s["here"] + 1) + before - s["i"]

            return F.struct(
                x["c"].alias("n"),
                (before + 1).cast("long").alias("i"),
                (s["here"] + 1).alias("here"),
                _adapted(delta, s["here"] + 1, s["first"]).alias("bias"),
                F.lit(False).alias("first"),
                F.concat(s["out"], _variable_length(delta, s["bias"])).alias("out"),
            )

        stem = F.when(basic == "", "").otherwise(F.concat(basic, F.lit("-")))
        start = F.struct(
            F.lit(_FIRST).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), F.length(basic).cast("long").alias("here"),
            F.lit(_BIAS).cast("long").alias("bias"), F.lit(True).alias("first"), stem.alias("out"),
        )
        return F.aggregate(F.sort_array(others), start, step, lambda s: s["out"])

    return let(_code_points(label), encode)


def _ascii(host: Column) -> Column:
    """An international name in its ASCII form; a name that has none gets a character that no host may hold.

    The platform maps by the standard of 2003; labels with a character that it would replace are encoded here.
    """

    def platform(text: Column) -> Column:
        return F.coalesce(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), text, F.lit(1))), F.lit("%"))

    def label(text: Column) -> Column:
        return F.when(text.rlike(_KEPT), F.concat(F.lit("xn--"), punycode(text))).otherwise(platform(text))

    dotted = F.regexp_replace(host, r"[\x{3002}\x{FF0E}\x{FF61}]", ".")
    labels = F.transform(F.split(dotted, r"\."), lambda t: F.when(t == "", t).otherwise(label(t)))
    return F.when(host.rlike(_KEPT), F.array_join(labels, ".")).when(host.rlike(r"[^\x00-\x7F]"), platform(host)).otherwise(host)


def ipv4(host: Column) -> Column:
    """Four decimal numbers from one to four decimal, octal or hexadecimal ones, null when they are none."""

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(F.concat(F.lit("0"), F.substring(part, F.lit(3), F.length(part))), 16, 10))
            .when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10))
            .when(part.rlike("^[1-9][0-9]*$"), part)
            .try_cast("decimal(38,0)")
        )

    def whole(ns: Column) -> Column:
        count = F.size(ns)
        last = F.get(ns, count - 1)
        head = F.slice(ns, F.lit(1), count - 1)
        fits = (count <= 4) & ~F.exists(ns, lambda n: n.isNull()) & ~F.exists(head, lambda n: n > 255)
        fits = fits & (last < F.pow(F.lit(256.0), 5 - count))
        tail = F.transform(F.sequence(F.lit(4) - count, F.lit(0)), lambda k: F.floor(last.cast("double") / F.pow(F.lit(256.0), k)) % 256)
        numbers = F.concat(F.transform(head, lambda n: n.cast("long")), F.transform(tail, lambda n: n.cast("long")))
        return F.when(fits, F.array_join(F.transform(numbers, lambda n: n.cast("string")), "."))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), whole)


def ipv6(address: Column) -> Column:
    """The shortest form of an address without its brackets, null when it is none."""
    v4 = r"^(.*:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    byte = lambda k: F.regexp_extract(address, v4, k).try_cast("int")
    bytes_ok = ~F.exists(F.array(*[byte(k) for k in range(2, 6)]), lambda b: b > 255) & ~address.rlike(r"[:.]0[0-9]+(?:\.|$)")
    pair = lambda a, b: F.hex(byte(a) * 256 + byte(b))
    dotted = F.concat(F.regexp_extract(address, v4, 1), pair(2, 3), F.lit(":"), pair(4, 5))
    text = F.when(address.rlike(v4), F.when(bytes_ok, F.lower(dotted))).when(~F.contains(address, F.lit(".")), F.lower(address))
    groups = F.regexp_count(text, F.lit("[0-9a-f]+"))
    valid = text.rlike("^[0-9a-f:]+$") & ~text.rlike("[0-9a-f]{5}|^:(?!:)|(?<!:):$|:::|::.*::")
    gap = F.contains(text, F.lit("::"))
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - groups))
    whole = F.regexp_replace(F.replace(text, F.lit("::"), zeros), "^:|:$", "")
    short = F.regexp_replace(whole, "(?<![0-9a-f])0+(?=[0-9a-f])", "")
    cut = F.when(F.lit(False), short)
    for n in range(8, 1, -1):
        run = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}(?![0-9a-f])(.*)$"
        head, tail = (F.regexp_extract(short, run, k) for k in (1, 2))
        sides = (F.when(side == "", ":").otherwise(side) for side in (head, tail))
        cut = cut.when(short.rlike(run), F.concat(*sides))
    return F.when(valid & F.when(gap, groups <= 7).otherwise(groups == 8), cut.otherwise(short))


def parse_host(host: Column) -> Column:
    """The host of a special URL, in lower case, as the standard writes it; null when it is not valid."""

    def named(name: Column) -> Column:
        return F.when(name.isNull() | (name == "") | name.rlike(_FORBIDDEN), None).when(name.rlike(_NUMBER_LAST), ipv4(name)).otherwise(name)

    def other(text: Column) -> Column:
        decoded = F.when(F.contains(text, F.lit("%")), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)
        return let(_ascii(F.lower(decoded)), named)

    bracketed = F.concat(F.lit("["), ipv6(F.substring(host, F.lit(2), F.length(host) - 2)), F.lit("]"))
    return F.when(host.rlike(PLAIN), host).when(host.startswith("["), bracketed).otherwise(other(host))
