import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.tokenizing import VOCABULARY_DIR, decode_corpus, encode_corpus, encoder

PATH = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{VOCABULARY_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


CASES = ["", " ", "\n\n", "'s", "'s's'll x", " 's", "\n's", "a's'", "!'s", "don't we'll I've they're", "x\n\n  y", "  lead", "trail  ", "<|endoftext|> a", "１２٣½", "á‍👩‍👩‍👧", "\x00\x1c\x85　", "日本語" * 50, "tab\tnbsp x", "'S 'T", "'r 'v 'l", "x" * 3000, "a'", "'"]


def ids(texts):
    flat, starts = encoder(PATH).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_cases(reference):
    assert ids(CASES) == reference(CASES)
    assert [ids([c])[0] for c in CASES] == reference(CASES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abstrevmld 'S\n\t. é1日", max_size=60)), max_size=6))
def test_any_text(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(texts) == reference(texts)


def test_corpus(spark, reference):
    rows = [(i, c, "x") for i, c in enumerate(CASES)] + [(100, None, None), (100, None, None), (None, "null key", None), (101, "long text " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc bigint, body string, id string")
    out = encode_corpus(df, "doc", "body", with_offsets=True).cache()
    got = {r["doc"]: r["ids"] for r in out.collect()}
    assert out.count() == len(rows) and got[100] == [] and got[None] == reference(["null key"])[0]
    assert [got[i] for i in range(len(CASES))] == reference(CASES)
    back = {r["doc"]: r["text"] for r in decode_corpus(out, "doc", "ids").collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    for r in out.filter("doc < 30").collect():
        raw = CASES[r["doc"]].encode()
        ends = [*r["offsets"], len(raw)][1:]
        assert all(encoder(PATH).token_bytes[t] == raw[a:b] for t, a, b in zip(r["ids"], r["offsets"], ends, strict=True))
    assert encode_corpus(df.limit(0), "doc", "body").count() == 0
    assert dict(encode_corpus(df, "doc", "body").dtypes) == {"doc": "bigint", "ids": "array<int>"}


def test_other_vocabularies_need_only_a_name(spark):
    df = spark.createDataFrame([(1, "Grüße 世界")], "doc bigint, body string")
    out = encode_corpus(df, "doc", "body", vocabulary="byte_bpe_multi_50k")
    assert decode_corpus(out, "doc", "ids", vocabulary="byte_bpe_multi_50k").first()["text"] == "Grüße 世界"
    assert out.select(F.size("ids")).first()[0] > 0
