"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.filters import Filter, build_filter, filter_bits
from marlstone.llm.textvec import char_prefix, chunked, code_points, mix, span_hash, window_hash
from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise

#: The largest filter: 64 MB, whatever the size of the corpus. A full one lets more windows through: up to one anchor in 75 positions, but no wrong ones.
MAX_FILTER_BITS = 1 << 29
#: Different contexts of one anchor that one task compares in memory; above that they are compared by shuffle.
GROUP_CONTEXTS = 1 << 17


def _runs(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """Texts of at least `least` code points: their row numbers, themselves, code points and starts."""
    texts = batch["text"].to_pylist()
    rows = [i for i, t in enumerate(texts) if t is not None and len(t) >= least]
    for first, run in chunked(texts[i] for i in rows):
        cps, starts = code_points(run)
        yield np.array(rows[first : first + len(run)]), run, cps, starts


def _block_starts(starts: np.ndarray, block: int) -> np.ndarray:
    """Non-overlapping blocks of every text, from its start on."""
    n = np.diff(starts) // block
    total = np.cumsum(n)
    return np.repeat(starts[:-1] - (total - n) * block, n) + np.arange(int(total[-1])) * block


def _index_blocks(own: Filter, batch: pa.RecordBatch, least: int) -> None:
    block = least // 2
    for _, _, cps, starts in _runs(batch, least):
        at = _block_starts(starts, block)
        own.add(span_hash(char_prefix(cps), at, at + block))


def _nearest_smaller(v: np.ndarray, p: np.ndarray, reach: int, strict: bool) -> np.ndarray:
    """Index of the nearest earlier element that is smaller (or, unless strict, equal), -1 if none within reach."""
    prev = np.arange(-1, len(v) - 1)
    active = np.arange(len(v))
    while True:
        q = prev[active]
        go = (q >= 0) & (p[active] - p[q] <= reach)
        go &= (v[q] >= v[active]) if strict else (v[q] > v[active])
        active = active[go]
        if not len(active):
            return prev
        prev[active] = prev[prev[active]]


def _anchors(cps: np.ndarray, starts: np.ndarray, index: Filter, least: int) -> tuple[np.ndarray, ...]:
    """The anchors of the texts: hash, position, and the first and last start of the windows they stand for.

    Every rolling window of a block's width is probed. Of the hits in a window of `least` code points, the one with the
    least hash (the first of equals) stands for it; equal windows in other texts have the same hits, hence the same."""
    block = least // 2
    h = window_hash(char_prefix(cps), block)
    at = index.find(h)
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + block <= starts[text + 1]
    at, text = at[inside], text[inside]
    v = h[at]
    reach = least - block
    left = _nearest_smaller(v, at, reach, strict=False)
    right = len(v) - 1 - _nearest_smaller(v[::-1], -at[::-1], reach, strict=True)[::-1]
    low = np.maximum(at - reach, np.where(left >= 0, at[left] + 1, 0))
    high = np.minimum(at, np.where(right < len(v), at[np.minimum(right, len(v) - 1)] - reach - 1, at) if len(v) else at)
    low, high = np.maximum(low, starts[text]), np.minimum(high, starts[text + 1] - least)
    some = low <= high
    return v[some], at[some], low[some], high[some], text[some]


def _anchor_rows(batches: Iterator[pa.RecordBatch], index, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_numpy(zero_copy_only=False)
        for rows, _, cps, starts in _runs(batch, least):
            v, *_, text = _anchors(cps, starts, index.value, least)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[rows[text]])], names=["anchor", "id"])


def _context_rows(batches: Iterator[pa.RecordBatch], index, repeated, least: int) -> Iterator[pa.RecordBatch]:
    """Anchors that may occur in several texts, each with the code points of its windows."""
    for batch in batches:
        ids = batch["id"].to_numpy(zero_copy_only=False)
        for rows, run, cps, starts in _runs(batch, least):
            v, at, low, high, text = _anchors(cps, starts, index.value, least)
            keep = repeated.value.find(v)
            v, at, low, high, text = v[keep], at[keep], low[keep], high[keep], text[keep]
            base = starts[text]
            key = span_hash(char_prefix(cps), low, high + least) + mix((at - low).astype(np.uint64))
            contexts = [run[t][a:b] for t, a, b in zip(text.tolist(), (low - base).tolist(), (high - base + least).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.view(np.int64)), pa.array(key.view(np.int64)), pa.array(ids[rows[text]]), pa.array((low - base).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(contexts, pa.string())],
                names=["anchor", "context", "id", "low", "shift", "data"],
            )


def _windows(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row's context, its windows of `least` code points: key of content and place relative to the anchor, row, start."""
    cps, starts = code_points(t["data"].to_pylist())
    n = np.diff(starts) - least + 1
    total = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(total[-1])) - np.repeat(total - n, n)
    at = starts[row] + start
    h = span_hash(char_prefix(cps), at, at + least)
    place = (t["shift"].to_numpy()[row] - start).astype(np.int64).view(np.uint64)
    return mix(h + mix(t["anchor"].to_numpy()[row].view(np.uint64) + place)), row, start


def _intervals(t: pa.Table, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive windows of one row as intervals [begin, end] of window starts."""
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)] - 1 if len(first) else first
    own = t.select(["anchor", "context"]).take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays([own["anchor"].combine_chunks(), own["context"].combine_chunks(), pa.array(start[first].astype(np.int32)), pa.array(start[last].astype(np.int32))], names=["anchor", "context", "begin", "end"])


def _compare(batches: Iterator[pa.RecordBatch], least: int, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, contexts with the least and greatest id that has them: the windows that two ids have."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        key, row, start = _windows(t, least)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        low = np.minimum.reduceat(t["id_min"].to_numpy()[row[order]], first)
        high = np.maximum.reduceat(t["id_max"].to_numpy()[row[order]], first)
        shared = np.empty(len(key), bool)
        shared[order] = np.repeat(low < high, np.diff(np.r_[first, len(key)]))
        yield _intervals(t, row[shared], start[shared])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        anchor = batch["anchor"].to_numpy()
        for a in range(0, batch.num_rows, 4096):
            part, own = batch.slice(a, 4096), anchor[a : a + 4096]
            if rows >= most:
                other = np.flatnonzero(own != last)
                cut = int(other[0]) if len(other) else len(own)
                held.append(part.slice(0, cut))
                if cut == len(own):
                    continue
                yield from solve(held)
                held, rows, part = [], 0, part.slice(cut)
            held.append(part)
            rows += part.num_rows
            last = own[-1]
    yield from solve(held)


def _window_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            t = pa.Table.from_batches([batch.slice(a, 4096)])
            key, row, start = _windows(t, least)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[t[c].combine_chunks().take(pa.array(row)) for c in ("anchor", "context", "id_min", "id_max")], pa.array(start.astype(np.int32))], names=["key", "anchor", "context", "id_min", "id_max", "start"])


def shared_spans(df: DataFrame, key: str, text: str, least: int = 300, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(key, start_pos, end_pos): maximal stretches of each text whose every `least` code points occur in another key's text.

    The non-overlapping blocks of half that length of all texts are the index: any stretch of `least` code points holds
    one whole. The index is a Bloom filter of bounded size, or-ed from the partitions' filters and broadcast; every
    rolling window of every text probes it. Of the hits in a window of `least` code points one, chosen by content, is
    the anchor, so texts that share the window share the anchor, and at most about one position in 75 is shuffled, even
    where the filter is full or a passage is in a third of all texts. Anchors that several keys have are looked up
    again with their context, equal contexts are merged into one row, and all windows around an anchor are compared
    exactly by hash within its group: this extends each hit to the maximal exact repeats without forming pairs. Groups
    of more than group_contexts different contexts are compared by a shuffle on the windows instead of in one task.

    Null texts and texts shorter than `least` have no stretch; rows without key are left out; repeats within one key's
    text, and repeated rows of a key, don't count; positions are code points, whatever the characters; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    own = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    n_blocks = own.select(F.sum(F.floor(F.length("text") / (least // 2))).alias("n")).first()["n"] or 0
    index = spark.sparkContext.broadcast(build_filter(own, filter_bits(n_blocks, MAX_FILTER_BITS), partial(_index_blocks, least=least)))
    anchors = own.mapInArrow(lambda b: _anchor_rows(b, index, least), "anchor bigint, id bigint")
    several = materialise(anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"))
    repeated = spark.sparkContext.broadcast(build_filter(several, filter_bits(several.count(), MAX_FILTER_BITS), _add_anchors))

    found = own.mapInArrow(lambda b: _context_rows(b, index, repeated, least), "anchor bigint, context bigint, id bigint, low int, shift int, data string")
    found = materialise(found)
    # anchors of more contexts than a task may hold: at most one in group_contexts rows, so their list is bounded by that share
    hot = found.groupBy("anchor", "context").agg(F.first("shift")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_contexts).select("anchor", F.lit(True).alias("hot"))
    marked = found.join(F.broadcast(hot), "anchor", "left")
    merged = [F.min("id").alias("id_min"), F.max("id").alias("id_max"), F.first("shift").alias("shift"), F.first("data").alias("data")]
    interval = "anchor bigint, context bigint, begin int, end int"
    # equal contexts become one row before they are shuffled, so that a passage of a third of all texts doesn't gather
    alike = marked.filter("hot IS NULL").groupBy("anchor", "context").agg(*merged)
    small = alike.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _compare(b, least), interval)
    crowded = marked.filter("hot").groupBy("anchor", "context").agg(*merged)
    rows = materialise(crowded.mapInArrow(lambda b: _window_rows(b, least), "key bigint, anchor bigint, context bigint, id_min bigint, id_max bigint, start int"))
    windows = rows.groupBy("key").agg(F.min("id_min").alias("lo"), F.max("id_max").alias("hi")).filter("lo < hi").select("key")
    large = salted_join(rows, windows, "key", "inner").select("anchor", "context", F.col("start").alias("begin"), F.col("start").alias("end"))
    shared = small.union(large).select(F.struct("anchor", "context").alias("place"), "begin", "end")

    spans = salted_join(found.select(F.struct("anchor", "context").alias("place"), "id", "low"), shared, "place", "inner").select("id", (F.col("low") + F.col("begin")).alias("s"), (F.col("low") + F.col("end") + least).alias("e"))
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("new", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1))
    stretch = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    return opened.withColumn("stretch", F.sum("new").over(stretch)).groupBy("id", "stretch").agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos")).select(F.col("id").alias(key), "start_pos", "end_pos")


def _add_anchors(own: Filter, batch: pa.RecordBatch) -> None:
    own.add(batch["anchor"].to_numpy().view(np.uint64))


def shared_share(df: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, shared_chars, share): of every text, how much of it is shared elsewhere; share is null for null and empty texts."""
    covered = spans.groupBy(key).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    lengths = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(text)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return lengths.join(covered, key, "left").select(key, "n_chars", shared.cast("bigint").alias("shared_chars"), F.round(F.try_divide(shared, F.col("n_chars")), 6).alias("share"))
