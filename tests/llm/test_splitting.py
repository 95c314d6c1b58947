import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.splitting import cut_levels, file_ranges, item_ranges, split_oversized

LEVELS = {"paragraph": r"\n\n+", "line": r"\n", "word": r"[ \t\n]+"}


def level_of(text, limit=1536):
    import re

    return next((k for k, p in LEVELS.items() if max(len(x.encode()) for x in re.split(p, text)) <= limit), "char")


def texts():
    random.seed(11)
    out = [None, "", "short", "\n" * 5000, " " * 5000, "x" * 1536, "x" * 1537, "日本" * 4000, "word " * 3000, ("line of text " * 20 + "\n") * 40, ("para. " * 30 + "\n\n") * 30, "a\n\n" + "y" * 3000]
    return out + ["".join(random.choice(["ab ", "é", "\n", "\n\n", "x" * 200, "。", "end. "]) for _ in range(random.randint(200, 3000))) for _ in range(30)]


@pytest.mark.parametrize("range_bytes", [1 << 16, 6200])
def test_levels_and_pieces(spark, range_bytes):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, *rows[5:9], (None, "z" * 4000, None)], "k bigint, body string, part string")
    ranges = item_ranges(df, "t", "k", "body", range_bytes=range_bytes)
    big = {i: t for i, t, _ in rows if t and len(t.encode()) > 1536}
    levels = {r["item_id"]: r["cut_level"] for r in cut_levels(ranges, range_bytes=range_bytes).collect() if r["item_id"] is not None}
    assert levels == {i: level_of(t) for i, t in big.items()}
    pieces = {}
    for r in split_oversized(ranges, range_bytes=range_bytes).collect():
        pieces.setdefault(r["item_id"], []).append(r)
    for i, t in big.items():
        own = sorted(pieces[i], key=lambda r: r["piece_no"])
        raw = t.encode()
        assert [p["piece_no"] for p in own] == list(range(len(own)))
        assert own[0]["start_byte"] == 0 and own[-1]["end_byte"] == len(raw)
        for a, b in zip(own, own[1:], strict=False):
            assert a["end_byte"] == b["start_byte"] and b["start_byte"] - b["overlap_bytes"] >= a["start_byte"] and b["overlap_bytes"] <= 153
        for p in own:
            assert p["text"].encode() == raw[p["start_byte"] - p["overlap_bytes"] : p["end_byte"]]
            assert p["n_tokens"] == -(-len(p["text"].encode()) // 3) <= 512


def test_files_are_cut_like_texts(spark, tmp_path):
    text = "".join(f"Sentence number {i} of a large file. " + "\n\n" * (i % 40 == 0) for i in range(6000))
    (tmp_path / "big.txt").write_text(text)
    (tmp_path / "small.txt").write_text("small")
    pieces = split_oversized(file_ranges(spark, [str(tmp_path / "big.txt"), str(tmp_path / "small.txt")], range_bytes=8192), range_bytes=8192).orderBy("piece_no").collect()
    assert {p["item_id"] for p in pieces} == {0}
    assert "".join(p["text"].encode()[p["overlap_bytes"] :].decode() for p in pieces) == text


def test_ranges_of_a_giant_item_are_spread(spark):
    giant = spark.createDataFrame([(1, "word " * 1_600_000)], "k bigint, body string")
    ranges = item_ranges(giant, "t", "k", "body")
    parts = ranges.select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges.count() == 123 and parts > 1


def test_empty(spark):
    none = item_ranges(spark.createDataFrame([], "k bigint, body string"), "t", "k", "body")
    assert cut_levels(none).count() == 0 and split_oversized(none).count() == 0
    with pytest.raises(ValueError, match="range_bytes"):
        split_oversized(none, range_bytes=100)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\té.", min_size=30, max_size=900), st.integers(10, 20))
def test_pieces_tile_any_text(text, tokens):
    from marlstone.llm.splitting import _halo, cut_range

    raw, limit = text.encode(), tokens * 3
    rb, halo, out = 4 * limit, _halo(tokens), []
    if len(raw) <= limit:
        return
    for low in range(0, len(raw), rb):
        if low and len(raw) - low <= limit // 2:
            continue
        skip = min(halo, low)
        last = len(raw) - low - rb <= limit // 2
        out += [(s + low - skip, e + low - skip, e - o) for o, s, e in cut_range(raw[low - skip : low + rb + halo], skip, rb, low == 0, last, limit, limit // 10)]
    assert [s for s, _, _ in out] == [0] + [e for _, e, _ in out[:-1]] and out[-1][1] == len(raw)
    assert all(size <= limit for _, _, size in out)
