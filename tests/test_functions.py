import random
import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from evidentia.functions import color, css, ids, text

BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def strange(n=400, seed=0):
    rng = random.Random(seed)
    parts = [*BLANKS, "a", "É", "é", "ß", "ﬁ", "\n", "\n", "\r", "\r\n", "the", "12", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_norm_ws(spark):
    values = strange()
    assert column(spark, values, text.norm_ws) == [" ".join(v.split()) for v in values]


def test_normalize_is_canonical(spark):
    def canonical(s):
        s = unicodedata.normalize("NFC", s).replace("\r\n", "\n").replace("\r", "\n")
        return re.sub("\n{3,}", "\n\n", "\n".join(x.rstrip() for x in s.split("\n"))).rstrip("\n") + "\n"

    values = strange()
    assert column(spark, values, text.normalize) == [canonical(v) for v in values]


def test_tokenize(spark):
    values = ["élan vital", "Straße", "ﬁne ﬂow", "a I x1 9", "The cat and THE dog", "", *strange(100)]
    want = [[w for w in re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", v).casefold()) if len(w) > 1 and w not in text.STOPWORDS] for v in values]
    assert column(spark, values, text.tokenize) == want and want[0] == ["lan", "vital"] and want[1] == ["strasse"]


def test_numbers_dates_negation(spark):
    values = ["about 1.4 million people", "1.9m", "-3,200.5 units", "45% of 10k", "none", "2bn", "7 b"]
    assert column(spark, values, text.leading_number) == [1.4e6, 1.9e6, -3200.5, 45.0, None, 2e9, 7e9]
    assert column(spark, ["on 2024-01-02, 2023-05-06 and 2024-01-02", "x2024-01-02"], text.iso_dates) == [["2023-05-06", "2024-01-02"], []]
    assert column(spark, ["It does not run", "nothing", "NEVER", "cannot", "knot"], text.negated) == [True, False, True, True, False]


def test_find(spark):
    values = ["aaaa", "xaax", "", "bbb"]
    assert column(spark, values, lambda x: text.find_all(x, F.lit("aa"))) == [[0, 1, 2], [1], [], []]
    assert column(spark, values, lambda x: text.find_first(x, F.lit("aa"))) == [0, 1, None, None]
    loose = column(spark, ["say  hello\n\tworld now", "hello", "é hello world"], lambda x: text.find_tolerant(x, F.lit("hello world")))
    assert [(r.start, r.end) if r else None for r in loose] == [(5, 17), None, (2, 13)]
    assert column(spark, ["é😀x"], lambda x: text.span(x, F.lit(1), F.lit(2))) == ["😀"]
    assert column(spark, ["(a.b) Q\\E"], lambda x: text.find_all(x, F.lit("Q\\E"))) == [[6]]


URLS = [
    "HTTP://Example.COM:80/A/b?b=2&a=1&utm_source=x#frag", "https://h:443/", "https://h:8443/?q=a+b&q=%7E&e=", "http://user:pw@H.com/x/?ref=1", " https://h/p?a=1&a=0&A=2 ", "https://h", "https://h/?x=é&y=*", "https://h/a%20b?gclid=1&si=2&z=/",
    "https://a.b/x?q=100%&z=1", "https://a.b/x?q=%zz&%=2", "https://a.b/?x=%E9&y=%25",
]


def test_canonical_url(spark):
    def canonical(url):
        p = urlsplit(url.strip())
        host = (p.hostname or "").lower()
        if p.port and (p.scheme.lower(), p.port) not in (("http", 80), ("https", 443)):
            host += f":{p.port}"
        if p.username:
            host = p.username + (f":{p.password}" if p.password else "") + "@" + host
        kept = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not re.match(ids.TRACKING, k))
        return urlunsplit((p.scheme.lower(), host, "" if p.path == "/" else p.path, urlencode(kept), ""))

    assert column(spark, URLS, ids.canonical_url) == [canonical(u) for u in URLS]


def test_assets(spark):
    import base64
    import hashlib

    raw = b"\x89PNG"
    want = "data:sha256:" + hashlib.sha256(raw).hexdigest()[:16]
    values = ["data:image/png;base64," + base64.b64encode(raw).decode(), "data:,%89PNG", "img/a%20b.png"]
    assert column(spark, values, lambda x: ids.asset_name(x, F.lit(None).cast("string"))) == [want, want, "a b.png"]
    assert column(spark, values, lambda x: ids.asset_name(x, F.lit(" named "))) == ["named"] * 3


@pytest.mark.parametrize("value, want", [("#fff", (1, 1, 1)), ("#80808080", (0.502, 0.502, 0.502)), ("rgb(255, 0, 50%)", (1, 0, 0.5)), ("hsl(120deg 100% 50%)", (0, 1, 0)), ("teal", (0, 0.502, 0.502)), ("oklch(100% 0 0)", (1, 1, 1)), ("oklab(1 0 0)", None), ("#12345", None), ("nope", None), ("transparent", None)])
def test_colors(value, want):
    got = color.read_color(value)
    assert got is None if want is None else all(abs(got[k] - w) < 2e-3 for k, w in zip("rgb", want))


def test_contrast_and_oklch(spark):
    got = column(spark, ["#777777", "#7c3aed"], lambda x: F.struct(color.contrast_ratio(color.parse_color(x), color.parse_color(F.lit("#fff"))).alias("r"), color.parse_color(x).alias("p")))
    assert abs(got[0].r - 4.478) < 1e-3 and 255 < got[1].p.h < 330
    for x in ("#777777", "#7c3aed", "#010203", "#fefefe"):  # there and back
        c = color.read_color(x)
        back = color.read_color(f"oklch({c['l']} {c['c']} {c['h']}deg / 50%)")
        assert all(abs(c[k] - back[k]) < 1e-5 for k in "rgb")


def test_css_values(spark):
    assert column(spark, ["12px", "2rem", "1.5em", "50%", "3vw", "9pt", "1in", "7"], css.length_px) == [12.0, 32.0, 24.0, None, None, 12.0, 96.0, 7.0]
    got = column(spark, ["clamp(1rem, 2vw + calc(1px), 5rem)", "clamp(1px,2px)", "10px"], css.clamp_bounds)
    assert [(r.low, r.high) for r in got] == [(16.0, 80.0), (None, None), (None, None)]
    assert [tuple(r) for r in column(spark, ["#a .b c:hover"], css.specificity)] == [(1, 2, 1)]
