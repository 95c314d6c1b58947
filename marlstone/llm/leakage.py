"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.filters import Filter, build_filter, filter_bits
from marlstone.llm.textvec import char_prefix, chunked, code_points, mix, prefix_hash, span_hash, window_hash, words
from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise

#: Words of a passage, and of a shingle.
PASSAGE, SHINGLE = 13, 5
#: The largest filter of the items' signatures: 64 MB, whatever their number; a fuller one lets more through, never less.
MAX_FILTER_BITS = 1 << 29


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by block prefix and suffix minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    if width == 1:
        return x
    pad = -(-len(x) // width) * width
    full = np.full(pad, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Words:
    """The words of a run of texts: hashes and text numbers, and any span of them as a string."""

    def __init__(self, texts: list[str]):
        self.texts = [t.lower() for t in texts]
        cps, self.starts = code_points(self.texts)
        self.begin, self.end, self.doc = words(cps, self.starts)
        self.prefix = prefix_hash(span_hash(char_prefix(cps), self.begin, self.end))
        self.held: dict[int, np.ndarray] = {}

    def phrase(self, first: int, last: int) -> str:
        """Words first to last, of one text, one blank between them."""
        text, base = self.texts[self.doc[first]], int(self.starts[self.doc[first]])
        return " ".join([text[b - base : e - base] for b, e in zip(self.begin[first : last + 1].tolist(), self.end[first : last + 1].tolist(), strict=True)])


    def shingles(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, in the order that min-hashes go by."""
        if k not in self.held:
            self.held[k] = mix(window_hash(self.prefix, k))
        return self.held[k]

    def passages(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the passages of `size` words that lie in one text, and the least hash of each one's shingles."""
        k = min(size, SHINGLE)
        least = _sliding_min(self.shingles(k), size - k + 1)
        at = np.flatnonzero(self.doc[: len(least)] == self.doc[size - 1 :]) if len(least) else np.zeros(0, np.int64)
        return at, least[at]

    def whole(self, at: np.ndarray, size: int) -> np.ndarray:
        """Own hashes of passages."""
        return mix(span_hash(self.prefix, at, at + size) ^ np.uint64(size))


def _signature(least: np.ndarray, size: int) -> np.ndarray:
    """Of a passage: the least hash of its shingles, and the size class."""
    return mix(least + np.uint64(size))


def _rows(ids: np.ndarray, w: _Words, size: int, at: np.ndarray, whole: np.ndarray, signature: np.ndarray) -> pa.RecordBatch:
    """Each passage of a text once, with its words."""
    once = np.unique(np.stack([w.doc[at].astype(np.uint64), whole]), axis=1, return_index=True)[1] if len(at) else at
    columns = [whole[once].view(np.int64), signature[once].view(np.int64), np.full(len(once), size, np.int32), ids[w.doc[at[once]]]]
    phrases = [w.phrase(i, i + size - 1) for i in at[once].tolist()]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(phrases, pa.string())], names=["whole", "signature", "size", "id", "phrase"])


def _items(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    """Passages of the test items by size class: of `passage` words, or, of shorter items, the item itself."""
    for batch in batches:
        ids = batch["id"].to_numpy(zero_copy_only=False)
        for first, run in chunked(t or "" for t in batch["text"].to_pylist()):
            w = _Words(run)
            own = np.minimum(np.bincount(w.doc, minlength=len(run)), passage)
            for size in np.unique(own[own > 0]).tolist():
                at, least = w.passages(size)
                mine = own[w.doc[at]] == size
                at, least = at[mine], least[mine]
                yield _rows(ids[first:], w, size, at, w.whole(at, size), _signature(least, size))


def _adder(column: str):
    def add(own: Filter, batch: pa.RecordBatch) -> None:
        own.add(batch[column].to_numpy().view(np.uint64))

    return add


def _probe(batches: Iterator[pa.RecordBatch], index: Broadcast, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Passages of the documents, for each size class, whose signature an item may have, and then whose own hash one may have."""
    signatures, wholes = index.value
    for batch in batches:
        ids = batch["id"].to_numpy(zero_copy_only=False)
        for first, run in chunked(t or "" for t in batch["text"].to_pylist()):
            w = _Words(run)
            for size in sizes:
                at, least = w.passages(size)
                if not len(at):
                    continue
                # a min-hash stays the same over many neighbouring passages, so only its changes are looked up
                change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                signature = _signature(least[change], size)
                hit = np.zeros(len(change), bool)
                hit[signatures.find(signature)] = True
                length = np.diff(np.r_[change, len(least)])
                near = np.flatnonzero(np.repeat(hit, length))
                if not len(near):
                    continue
                whole = w.whole(at[near], size)
                some = wholes.find(whole)
                if len(some):
                    yield _rows(ids[first:], w, size, at[near[some]], whole[some], np.repeat(signature, length)[near[some]])


def leaked_items(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, query_id): texts that hold `passage` consecutive words of an item, or all words of a shorter item.

    Containment search, partitioned by size: a test item is the set of its passages, and passages fall into size classes
    (items of `passage` words or more; shorter ones each by their length). The signature of a passage is the min-hash of
    its word shingles. A document is probed, for each class, with the min-hash of each of its windows of that size, a
    sliding minimum; a window that contains the passage has the passage's min-hash, so none is missed. (A min-hash of a
    whole document would miss 13 words in 1,000.) The items' signatures are broadcast as a Bloom filter of bounded size,
    with one of the passages' own hashes; only windows that pass both leave the documents, and meet the items' passages in
    a join that spreads frequent ones. A pair counts if the passages, shingles of the class's size, have the same words.
    Documents are read once, however many items there are, and never shuffled; a full filter costs time, never pairs.

    Words are runs of letters and digits after lower-casing. Null, empty and wordless texts and items match nothing;
    rows without key are left out; repeated rows, and equal texts under several keys, give each key its pairs once;
    other columns are ignored; empty tables give an empty result.
    """
    schema = "whole bigint, signature bigint, size int, id bigint, phrase string"
    own = documents.filter(F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("bigint").alias("id"), F.col(text).alias("text"))
    tests = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    passages = materialise(tests.mapInArrow(lambda b: _items(b, passage), schema))
    by_size = {r["size"]: r["n"] for r in passages.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, bits = sorted(by_size), filter_bits(sum(by_size.values()), MAX_FILTER_BITS)
    index = documents.sparkSession.sparkContext.broadcast(tuple(build_filter(passages, bits, _adder(c)) for c in ("signature", "whole")))
    found = materialise(own.mapInArrow(lambda b: _probe(b, index, sizes), schema))
    index.destroy()
    wanted = passages.select("whole", F.col("id").alias("query_id"), F.col("phrase").alias("other")).distinct()
    pairs = salted_join(found.select("whole", F.col("id").alias("doc_id"), "phrase"), wanted, "whole", "inner")
    return pairs.filter("phrase = other").select("doc_id", "query_id").distinct()
