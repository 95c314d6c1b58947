import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators.chunking import approximate_tokens, changed_chunks, chunk_documents, chunk_text, hard_split, segments, tail


def test_segments():
    text = "intro\n```\ncode\n```\noutro"
    assert list(segments(text)) == [("prose", "intro"), ("code", "```\ncode\n```"), ("prose", "outro")]
    assert list(segments("a\n```\nopen"))[-1] == ("code", "```\nopen")
    assert list(segments("\n \n")) == []


@pytest.mark.parametrize(
    "text",
    [
        "A sentence about servers. " * 300,
        "```\n" + "line of code here\n" * 400 + "```",
        "```\n" + "A" * 60000 + "\n```",
        "http://example.invalid/" + "x" * 40000,
        "B" * 5000 + "\n\n" + "short",
        "para one\n\n" * 500 + "```\ncode\n```\n" + "word " * 2000,
        "日本語" * 3000,
    ],
)
def test_no_chunk_is_over_the_limit(text):
    chunks = chunk_text(text)
    assert chunks
    assert all(0 < c.tokens <= 512 and c.tokens == approximate_tokens(c.text) for c in chunks)


def test_code_that_fits_stays_whole_and_split_code_is_flagged():
    block = "```\n" + "x = 1\n" * 50 + "```"
    chunks = chunk_text("word " * 300 + "\n" + block)
    assert any(block in c.text for c in chunks)
    assert all(c.split_code and c.kind == "code" and c.text.startswith("```") for c in chunk_text("```\n" + "some line of code\n" * 400 + "```"))


def test_overlap_is_bounded_and_prose_only():
    chunks = chunk_text("\n\n".join(f"Paragraph {i} has a few words in it." for i in range(200)), target=200, overlap=30)
    carried = [b.text.split("\n")[0] in a.text for a, b in zip(chunks, chunks[1:], strict=False)]
    assert any(carried)
    assert approximate_tokens(tail("one two three four five six", approximate_tokens, 3)) <= 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.`é", max_size=3000), st.integers(20, 120))
def test_limits_hold_for_any_text(text, target):
    for c in chunk_text(text, target=target, overlap=target // 10):
        assert c.tokens <= target and c.text.strip()


@given(st.text(max_size=400), st.integers(4, 20))
def test_hard_split_loses_nothing(text, limit):
    assert "".join(hard_split(text, approximate_tokens, limit)) == text


def test_chunk_documents(spark):
    schema = "doc_id bigint, title string, tags array<string>, body string, answers array<string>, effective_date string, source_uri string, text string"
    rows = [(1, "T", ["a"], "word " * 2000, ["yes"], None, "u", "clash"), (2, None, None, None, None, None, None, None), (3, "", [], "", [], None, None, None)]
    chunks = chunk_documents(spark.createDataFrame(rows, schema))
    out = chunks.orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in out} == {1}
    assert [r["chunk_index"] for r in out] == list(range(out[0]["chunk_count"]))
    assert out[0]["text"].startswith("T [a]\nT")
    assert len({r["chunk_id"] for r in out}) == len(out)
    assert chunk_documents(spark.createDataFrame([], schema)).count() == 0
    assert changed_chunks(chunks, chunks).count() == 0
