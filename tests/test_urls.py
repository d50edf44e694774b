import random

import pytest
from pyspark.sql import functions as F

from webgauge.functions.hosts import punycode
from webgauge.functions.urls import join_url, normalize, standard_host

# Escaping by part: path, query and fragment have sets of their own.
JOINED = [
    ("l?f={x}", "https://a.cz/d/l?f={x}"),
    ("q?x=`z`", "https://a.cz/d/q?x=`z`"),
    ("p#{y}", "https://a.cz/d/p#{y}"),
    ("p#`y`", "https://a.cz/d/p#%60y%60"),
    ("i?n=O'Neil", "https://a.cz/d/i?n=O%27Neil"),
    ("i'#n'", "https://a.cz/d/i'#n'"),
    ("{a}`b`", "https://a.cz/d/%7Ba%7D%60b%60"),
    ('s t?"u v"#<w>', "https://a.cz/d/s%20t?%22u%20v%22#%3Cw%3E"),
    ("é?ü#ñ", "https://a.cz/d/%C3%A9?%C3%BC#%C3%B1"),
    ("?only={q}", "https://a.cz/d/page?only={q}"),
]


@pytest.mark.parametrize("reference,expected", JOINED)
def test_escaping_by_part(spark, reference, expected):
    row = spark.range(1).select(join_url(F.lit(reference), F.lit("https://a.cz/d/page")).alias("u")).first()
    assert row.u == expected


def test_normal_form_is_stable(spark):
    df = spark.createDataFrame([(u,) for _, u in JOINED], "u string")
    assert df.where(normalize(F.col("u")) != F.col("u")).count() == 0


# Hosts as the URL standard writes them; None: not valid.
HOSTS = {
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://127.1/x": "http://127.0.0.1/x",
    "http://2130706433/": "http://127.0.0.1/",
    "http://017700000001": "http://127.0.0.1/",
    "http://0x7F.0.0.0x1./": "http://127.0.0.1/",
    "http://256.1/": None,
    "http://1.2.3.256/": None,
    "http://1.2.3.4.5/": None,
    "http://1..2/": None,
    "http://09.1/": None,
    "http://4294967296/": None,
    "http://255.255.255.255/": "http://255.255.255.255/",
    "http://1.65536.a/": "http://1.65536.a/",
    "http://ex%41mple.com/a": "http://example.com/a",
    "http://a%2eb.com/": "http://a.b.com/",
    "http://a%2fb.com/": None,
    "http://a%zz.com/": None,
    "http://a+b.com/": "http://a+b.com/",
    "http://%e4.com/": None,
    "http://[0:0::0001]/": "http://[::1]/",
    "http://[2001:DB8:0:0:1:0:0:1]:80/": "http://[2001:db8::1:0:0:1]/",
    "http://[1:2:3:4:5:6:7::]/": "http://[1:2:3:4:5:6:7:0]/",
    "http://[::ffff:1.2.3.4]/": "http://[::ffff:102:304]/",
    "http://[1:2:3]/": None,
    "http://[1::2::3]/": None,
    "http://[12345::]/": None,
    "http://[::1.2.3.400]/": None,
    "http://[::]/": "http://[::]/",
    "http://[1:0:0:2:0:0:0:3]/": "http://[1:0:0:2::3]/",
    "http://faß.de/": "http://xn--fa-hia.de/",
    "http://FAẞE.de/": "http://xn--fae-6ka.de/",
    "http://βόλος.com/": "http://xn--nxasmm1c.com/",
    "http://www.straße-zum-glück.de/": "http://www.xn--strae-zum-glck-3fb68b.de/",
    "http://日本語。jp/": "http://xn--wgv71a119e.jp/",
    "http://Příklad.CZ/a": "http://xn--pklad-zsa96e.cz/a",
    "http://EXAMPLE.com./": "http://example.com./",
    "http://a_b.example/": "http://a_b.example/",
}


def test_hosts(spark):
    df = spark.createDataFrame(list(HOSTS.items()), "u string, e string")
    assert {r.u: r.n for r in df.select("u", normalize(standard_host(F.col("u"))).alias("n")).collect()} == HOSTS


def test_punycode_equals_the_codec(spark):
    rng = random.Random(1)
    chars = ["a", "b", "-", "9", "ß", "ς", "é", "а", "一", "\U0001f600", "\U0010ffff"]
    labels = ["".join(rng.choices(chars, k=rng.randint(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in labels], "t string")
    assert all(r.p == r.t.encode("punycode").decode() for r in df.select("t", punycode(F.col("t")).alias("p")).collect())
