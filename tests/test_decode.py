import base64

import pytest
from pyspark.sql import functions as F

from tracehound.functions import decode as d


def run(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select(fn(F.col("t")).alias("o"), "i").orderBy("i").select("o").collect()]


CASES = {
    d.decode_url_iter: [
        ("%5Bkey%5D%2fx", "[key]/x"),
        ("q%3D%22blue%22%3B", 'q="blue";'),
        ("%2561%2562", "ab"),
        ("nothing_to-do.", "nothing_to-do."),
        ("a+b", "a+b"),
        ("a%2e%zz%ff", "a.%zzÿ"),
        ("%C3%A9", "é"),
        ("%ff", "ÿ"),
        ("%EF%BF%BD", "�"),
        ("%25252525", "%25"),
        ("100%", "100%"),
        ("", ""),
        (None, None),
    ],
    d.decode_base64_segments: [
        ("b3BlbiBzZXNhbWUvZG9vcg==", "open sesame/door"),
        ("/d?p=b3BlbiBzZXNhbWUvZG9vcg==", "/d?p=open sesame/door"),
        ("b3BlbiBzZXNhbWUvZG9vcg", "open sesame/door"),
        ("b3BlbiBzZXNhbWUvZG9vcg===", "b3BlbiBzZXNhbWUvZG9vcg==="),
        ("/admin/login", "/admin/login"),
        ("short", "short"),
        ("aGVsbG8gd29ybGQh.aGVsbG8gd29ybGQh", "hello world!.hello world!"),
        ("a=b=c", "a=b=c"),
    ],
    d.decode_unicode_escapes: [
        ("\\u003cscript\\u003e", "<script>"),
        ("\\x3cb\\x3E", "<b>"),
        ("\\uD83D\\uDE00!", "😀!"),
        ("x\\uD83Dy", "x�y"),
        ("\\u005cx41", "A"),
        ("\\q\\", "\\q\\"),
    ],
    d.decode_html_entities: [
        ("&amp;lt;", "<"),
        ("&lt;b&gt; &quot;x&apos; &#39;", "<b> \"x' '"),
        ("&#x3c;svg onload=1&#62;", "<svg onload=1>"),
        ("&#x1F600;", "\uf600"),
        ("a & b &# c;", "a & b &# c;"),
        ("&#8364;&#x20AC;", "€€"),
    ],
}


@pytest.mark.parametrize("fn", list(CASES), ids=lambda f: f.__name__)
def test_pairs(spark, fn):
    texts, want = zip(*CASES[fn])
    assert run(spark, fn, texts) == list(want)


def test_chain(spark):
    b64 = base64.b64encode(b"open sesame/door").decode()
    texts = ["%5Bkey%5D/%2561", "cart opened at nine", "/shop/basket", "/x?p=" + b64, "%26lt%3Bscript%26gt%3B"]
    want = ["[key]/a", "cart opened at nine", "/shop/basket", "/x?p=open sesame/door", "<script>"]
    assert run(spark, d.deobfuscate, texts) == want


def test_add_transform(spark):
    steps = d.add_transform(d.DEFAULT_STEPS, lambda c: F.replace(c, F.lit("~"), F.lit("%")), 0)
    assert run(spark, lambda c: d.deobfuscate(c, steps), ["~2e~2e/"]) == ["../"]
    last = d.add_transform(d.DEFAULT_STEPS, F.upper)
    assert run(spark, lambda c: d.deobfuscate(c, last), ["%61b"]) == ["AB"]
    assert len(d.DEFAULT_STEPS) == 4
