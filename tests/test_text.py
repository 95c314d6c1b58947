import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.vectors import cosine


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def clean(spark, html):
    return one(spark, T.html_to_text(F.col("h")), h=("string", html))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div>One thing.</div><div>Another.</div>", "One thing.\n\nAnother."),
        ("type <code>uname -a</code> first", "type `uname -a` first"),
        ("<pre><code>loop:\n    jump loop</code></pre>", "```\nloop:\n    jump loop\n```"),
        ("<style>b{}</style><script>if (x < '</b>') y()</script>left", "left"),
        ("a<script>never closed", "a"),
        ("<SCRIPT>a</b></Script>b", "b"),
        ("x</style>gone</style>y", "xy"),
        ("<table><tr><th>n</th><th>m</th></tr><tr><td>1</td><td>2</td></tr></table>", "| n | m |\n| 1 | 2 |"),
        ("<ol><li>first</li><li>second</li></ol>", "- first\n- second"),
        ("x<p><li>y", "x\n- y"),
        ("top<br>bottom", "top\nbottom"),
        ("while i < n go on", "while i < n go on"),
        ("1 <2 and <b", "1 <2 and <b"),
        ('read <a title="a > b">this</a>', 'read b">this'),
        ("<div><p>x</p></div>y", "x\n\ny"),
        ("one\n<i></i><p>two", "one\ntwo"),
        ("<p>a   b</p>", "a b"),
        ("<pre>a <b>bold</b> <code>q</code> z</pre>", "```\na bold q z\n```"),
        ("<pre><span>x</span><code>a</code></pre>", "```\nxa\n```"),
        ("<pre></pre><p>  a   b</p>", "```\n```\na b"),
        ("<pre>k\n\n\n\n  v  \n</pre>", "```\nk\n\n  v\n```"),
        ("<prefix>x<code>y</code></prefix>", "x`y`"),
        ("\u00a0 x\u3000\r\ny \u2028", "x\ny"),
        ("a\ufdd1b", "a\ufffdb"),
        ("<!-- no --> <?php x ?>", ""),
        ("<p>" + "w " * 50000 + "</p>", ("w " * 50000).strip()),
        ("", ""),
        (None, None),
    ],
)
def test_html(spark, html, text):
    assert clean(spark, html) == text


@pytest.mark.parametrize(("raw", "tags"), [("|a-b|c||d|", ["a-b", "c", "d"]), ("<x><y-z>", ["x", "y-z"]), ("", []), ("no tags", []), (None, [])])
def test_tags(spark, raw, tags):
    assert one(spark, T.parse_tags(F.col("t")), t=("string", raw)) == tags


def test_tokens_are_bytes(spark):
    assert [one(spark, T.token_count(F.col("t")), t=("string", s)) for s in ("", "abc", "abcd", "日本")] == [0, 1, 2, 2]


def test_terms(spark):
    def terms(s):
        return one(spark, T.terms(F.col("t")), t=("string", s))

    assert terms("Set the LIMIT to v2.10.3, or use --dry-run_now") == ["set", "limit", "v2.10.3", "use", "dry-run_now"]
    assert terms("Ends in dots... and-") == ["ends", "dots"]
    assert terms("no way up") == ["no", "way", "up"]
    assert terms("é " + "x" * 65) == []


def test_hash_ignores_reflow(spark):
    h = [one(spark, T.content_hash(F.col("t")), t=("string", s)) for s in ("two  words", " two\nwords ", "two wordss")]
    assert h[0] == h[1] != h[2]


def test_chunk_id_depends_on_all_parts(spark):
    c = T.chunk_id(F.col("d"), F.col("i"), F.col("h"))
    ids = {one(spark, c, d=("bigint", d), i=("int", i), h=("string", h)) for d, i, h in [(1, 0, "a"), (2, 0, "a"), (1, 1, "a"), (1, 0, "b")]}
    assert len(ids) == 4
    assert len(one(spark, T.as_uuid(c), d=("bigint", 1), i=("int", 0), h=("string", "a"))) == 36


def test_citations(spark):
    def cited(s, n=3):
        return one(spark, T.citations(F.col("t"), F.lit(n)), t=("string", s))

    assert cited("see [2] and [1], again [2]; not [7], [0] or array[idx]") == [1, 2]


def test_document_text(spark):
    full = one(spark, T.full_text(F.col("t"), F.col("b"), F.col("a")), t=("string", "T"), b=("string", None), a=("array<string>", ["x", None]))
    assert full == "T\n\n\n\nAnswer 1:\nx\n\nAnswer 2:\n"
    assert one(spark, T.context_prefix(F.col("t"), F.col("g")), t=("string", "T"), g=("array<string>", ["a", "b"])) == "T [a, b]\n"
    assert one(spark, T.context_prefix(F.col("t"), F.col("g")), t=("string", "T"), g=("array<string>", None)) == "T\n"


@pytest.mark.parametrize(("a", "b", "x"), [([1, 0], [1, 0], 1.0), ([1, 0], [0, 1], 0.0), ([1, 0], [-2, 0], -1.0), ([0, 0], [1, 0], 0.0), ([1, 0, 5], [1, 0], 1.0), (None, [1], None)])
def test_cosine(spark, a, b, x):
    f = None if a is None else [float(v) for v in a]
    assert one(spark, cosine(F.col("a"), F.col("b")), a=("array<float>", f), b=("array<float>", [float(v) for v in b])) == x


def test_split_share(spark):
    n = spark.range(5000).filter(T.in_split(F.col("id"), 0.2)).count()
    assert 900 < n < 1100


def test_cache_key_ignores_case_and_spacing(spark):
    k = T.cache_key(F.col("t"), F.col("q"))
    a = one(spark, k, t=("string", "x"), q=("string", "How  do I"))
    assert a == one(spark, k, t=("string", "x"), q=("string", " how do i ")) != one(spark, k, t=("string", "y"), q=("string", "how do i"))
