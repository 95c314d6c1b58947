"""Near-duplicate records with small edits."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bkforest import BKForest, hamming
from marlstone.llm.components import connected_components
from marlstone.llm.filters import build_bytes
from marlstone.llm.textvec import chunked, distinct_per_text, mix, shingles, word_hashes
from marlstone.operators.bloom import bloom_blocks, bloom_filter, bloom_probe
from marlstone.operators.skew import salted_join
from marlstone.runtime import materialise

#: 64-bit words of a code in the trees; the codes themselves have that many, or two or four times as many for larger sets.
WORDS = 3
#: Codes that one tree should hold; a shard with more is cut into several trees, each probed by the whole shard.
BLOCK = 1 << 14
#: Bytes of the table that knows how frequent shingles are: 64 MB at most. It changes the work only, never the pairs.
MAX_TABLE = 1 << 26
#: Places that a shingle has in that table.
_PLACES = 3

_TAG = re.compile(r"<[^>]*>")


def plain(title: str | None, body: str | None) -> str:
    """Title (nothing if null), a space, and the body with every tag replaced by a space, then entities decoded."""
    s = _TAG.sub(" ", body) if body and "<" in body else body or ""
    return (title or "") + " " + (html.unescape(s) if "&" in s else s)


def _shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, distinct shingle hashes, and their starts by row, of the columns _title and _body."""
    texts = [plain(t, b) for t, b in zip(batch["_title"].to_pylist(), batch["_body"].to_pylist(), strict=True)]
    for first, run in chunked(texts):
        h, doc = word_hashes(run)
        values, starts = distinct_per_text(*shingles(h, doc, k), len(run))
        yield first, first + len(run), values, starts


def _sums(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each whole set of hashes; sets begin at `at`, none is empty. Equal sets, equal sums."""
    x = mix(values)
    return np.add.reduceat(x, at).view(np.int64), np.add.reduceat(mix(x + np.uint64(1)), at).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, values, starts in _shingle_sets(batch, k):
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                yield pa.RecordBatch.from_arrays([batch["_id"].slice(a, b - a).take(pa.array(some)), *map(pa.array, _sums(values, starts[:-1][some]))], names=["_id", "set_a", "set_b"])


def _pack(numbers: np.ndarray, width: int) -> bytes:
    """Numbers below 256 ** width, their bytes sorted by significance and compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data, n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)), 6)


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, 6), dtype=np.uint64)


def _counted(batches: Iterator[pa.RecordBatch], k: int, bits: int, slices: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The different keys (first bits of shingles) of each run of records with their number, by slice of the keys' range, packed."""
    edges = np.array([i * (1 << bits) // slices for i in range(slices + 1)], np.uint64)

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(keys, edges)
        some = [i for i in range(slices) if cut[i] < cut[i + 1]]
        own = [slice(cut[i], cut[i + 1]) for i in some]
        columns = [pa.array(some, pa.int32()), pa.array([s.stop - s.start for s in own], pa.int32()), pa.array([_pack_sorted(keys[s]) for s in own], pa.binary()), pa.array([_pack(n[s], 4) for s in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "n", "keys", "counts"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, values, _ in _shingle_sets(batch, k):
            held.append(values >> np.uint64(48 - bits))
            size += len(values)
            if size > most:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows slice by slice: its keys that several records have, by the power of two of their number."""

    def solve(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([_unpack_sorted(data, n) for n, data, _ in parts])
        counts = np.concatenate([_unpack(data, n, 4) for n, _, data in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        level = np.floor(np.log2(np.add.reduceat(counts, first))).astype(np.int64)
        keys = keys[first]
        some = np.unique(level[level > 0]).tolist()
        found = [keys[level == x] for x in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([len(x) for x in found], pa.int64()), pa.array([_pack_sorted(x) for x in found], pa.binary())], names=["level", "n", "keys"])

    held: list[tuple] = []
    last = None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("slice", "n", "keys", "counts")), strict=True):
            if row[0] != last and held:
                yield from solve(held)
                held = []
            last = row[0]
            held.append(row[1:])
    if held:
        yield from solve(held)


def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for i in range(_PLACES):
        yield mix(keys * np.uint64(2 * i + 1) + np.uint64(i)) & np.uint64(size - 1)


def _add_levels(own: np.ndarray, batch: pa.RecordBatch) -> None:
    for level, n, data in sorted(zip(batch["level"].to_pylist(), batch["n"].to_pylist(), batch["keys"].to_pylist(), strict=True)):
        for at in _places(_unpack_sorted(data, n), len(own)):
            own[at] = np.maximum(own[at], np.uint8(level))


class Frequencies:
    """How many records have a shingle, as a power of two; 0 for one record, or for few where the table couldn't hold all.

    A shingle's places in the table hold at least its level, each, and the least of them is taken. So a rare shingle may
    seem frequent, never the other way round, and the same everywhere: as an order it is sound."""

    def __init__(self, table: np.ndarray, bits: int, complete: bool):
        self.table, self.bits, self.complete = table, bits, complete

    def level(self, shingles: np.ndarray) -> np.ndarray:
        first, *rest = _places(shingles >> np.uint64(48 - self.bits), len(self.table))
        level = self.table[first]
        for at in rest:
            np.minimum(level, self.table[at], out=level)
        return level


def shingle_frequencies(own: DataFrame, k: int) -> Frequencies:
    """Exact counts, by shuffle of packed keys, of all records' shingles (of keys of so many bits that few collide), put into a table of bounded size."""
    rows = max(1, own.count())
    bits = min(48, max(24, 12 + 7 + math.ceil(math.log2(rows))))  # 2**7 shingles a record, 2**12 keys for each
    slices = max(8, math.ceil(rows / (1 << 16)))
    runs = own.mapInArrow(lambda b: _counted(b, k, bits, slices), "slice int, n int, keys binary, counts binary")
    levels = materialise(runs.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(_levels, "level int, n bigint, keys binary"))
    sizes = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, keys = 64, 0
    for level in sorted(sizes, reverse=True):  # the most frequent first, as many as the table holds
        keys += sizes[level]
        if 2 * _PLACES * keys > MAX_TABLE:
            break
        least = level
    size = 1 << 12
    while size < min(2 * _PLACES * keys, MAX_TABLE):
        size *= 2
    return Frequencies(build_bytes(levels.filter(F.col("level") >= least), size, _add_levels, np.maximum), bits, not sizes or least == min(sizes))


def _rest_codes(ordered: np.ndarray, last: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Codes of what sets have after a place: of the shingles behind at, up to their set's last one, each toggling one bit.

    Codes never differ in more bits than the shingles they stand for. They have 192 bits for sets of up to 192 shingles, 384
    for up to 384, else 768, and longer ones fold into shorter ones, halves xor-ed."""
    out = np.empty(len(at), object)
    words = np.where(size <= 64 * WORDS, WORDS, np.where(size <= 128 * WORDS, 2 * WORDS, 4 * WORDS))
    x = mix(ordered ^ np.uint64(0x5851F42D4C957F2D))
    bit = np.uint64(1) << (x & np.uint64(63))
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        code = np.empty((len(own), w), np.uint64)
        word = (x >> np.uint64(6)) % np.uint64(w)
        for i in range(w):
            upto = np.bitwise_xor.accumulate(np.where(word == i, bit, np.uint64(0)))
            code[:, i] = upto[last[own]] ^ upto[at[own]]
        data = code.tobytes()
        out[own] = [data[i : i + 8 * w] for i in range(0, len(data), 8 * w)]
    return out.tolist()


def _filed(batches: Iterator[pa.RecordBatch], k: int, threshold: float, known: Broadcast, block: int) -> Iterator[pa.RecordBatch]:
    """Each set under the shingles of its prefix that other records have as well; equal sets of a run once.

    A shard that may hold more than `block` codes is a triangle of cells: a set's own block is the tree of one cell with
    each other block's probes. facts: the set's size, the shingle's place in it, and its role: 0 both, 1 tree, 2 probe. The
    code is that of the shingles after the place."""
    frequencies = known.value
    for batch in batches:
        for _, _, values, starts in _shingle_sets(batch, k):
            some = np.flatnonzero(np.diff(starts))
            if not len(some):
                continue
            at, size = starts[:-1][some], np.diff(starts)[some]
            set_a = _sums(values, at)[0]
            once = np.unique(set_a, return_index=True)[1]
            own = np.repeat(np.arange(len(some)), size)
            level = frequencies.level(values)
            order = np.argsort(own << 6 | level, kind="stable")  # shingles of a set are in order already
            ordered, level = values[order], level[order].astype(np.int64)
            place = np.arange(len(values)) - np.repeat(at, size)
            first = np.zeros(len(some), bool)
            first[once] = True
            take = (place <= np.repeat(size - np.ceil(size * threshold - 1e-9).astype(np.int64), size)) & first[own]
            if frequencies.complete:
                take &= level > 0  # nobody else has it
            taken = np.flatnonzero(take)
            of, place, shard = own[taken], place[taken], ordered[taken]
            blocks = np.maximum(1, np.ceil(2.0 ** (level[taken] + 1) / block)).astype(np.int64)
            role = np.zeros(len(taken), np.int64)
            if len(taken) and blocks.max() > 1:
                repeat = np.repeat(np.arange(len(taken)), blocks)
                total = np.cumsum(blocks)
                other = np.arange(int(total[-1])) - np.repeat(total - blocks, blocks)
                mine = (mix(set_a[of].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[repeat]
                cell = np.where(blocks[repeat] > 1, np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other) + 1, 0)
                role = np.where(mine == other, 0, np.where(mine < other, 1, 2))
                of, place, shard = of[repeat], place[repeat], np.where(cell > 0, mix(shard[repeat] ^ cell.astype(np.uint64)) >> np.uint64(16), shard[repeat])
            code = pa.array(_rest_codes(ordered, (at + size - 1)[own[taken]], taken, size[own[taken]]), pa.binary())
            if len(of) > len(taken):
                code = code.take(pa.array(repeat))
            facts = size[of] << 32 | place << 2 | role
            yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(facts), pa.array(set_a[of]), code], names=["shard", "facts", "set_a", "code"])


class _Codes:
    """Codes of one to four times WORDS, folded to the lengths at which they are compared."""

    def __init__(self, code: pa.Array):
        length = pc.binary_length(code).to_numpy(zero_copy_only=False).astype(np.int64) // (8 * WORDS)
        data = np.frombuffer(b"".join(code.to_pylist()), np.uint64).reshape(-1, WORDS)
        begin = np.cumsum(length) - length
        self.length, self.folded = length, {}
        for width in (1, 2, 4):
            out = np.zeros((len(code), width * WORDS), np.uint64)
            for n in (1, 2, 4):
                own = np.flatnonzero(length == n)
                if len(own) and n >= width:
                    parts = data[begin[own][:, None] + np.arange(n)].reshape(len(own), n // width, width * WORDS)
                    out[own] = np.bitwise_xor.reduce(parts, axis=1)
            self.folded[width] = out

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """On the longest codes that both have."""
        both = np.minimum(self.length[a], self.length[b])
        out = np.zeros(len(a), np.int64)
        for width, code in self.folded.items():
            own = both == width
            out[own] = hamming(code[a[own]], code[b[own]])
        return out


def _radius(size: np.ndarray, place: np.ndarray, largest: np.ndarray, least_place: np.ndarray, threshold: float) -> np.ndarray:
    """How far, in shingles after the shard's, the partners of a probe may be that are no larger than `largest`; -1 if none can be similar.

    A pair is looked for in the shard of the first shingle that both sets have, so they differ in all that either has
    before it: the probe's place and the partner's, which is `least_place` at least. What is left must be enough for the
    overlap, which bounds the partner's size, and the difference that remains to the threshold is the radius."""
    room = np.floor((size - place) * ((1 + threshold) / threshold) - size + 1e-9)
    most = np.minimum(np.minimum(largest, np.floor(size / threshold + 1e-9)), room)
    rest = np.floor((size + most) * ((1 - threshold) / (1 + threshold)) + 1e-9) - place - least_place
    return np.where(most >= size * threshold - 1e-9, np.maximum(rest, -1), -1).astype(np.int64)


def search_shards(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of whole shards, in order: pairs (a, b) of set hashes, and how many nodes were visited out of how many there were to all probes."""
    facts = t["facts"].to_numpy()
    size, place, role = facts >> 32, facts >> 2 & (1 << 30) - 1, facts & 3
    sets, shard = t["set_a"].to_numpy(), t["shard"].to_numpy()
    codes = _Codes(t["code"].combine_chunks())
    number = np.cumsum(np.r_[0, shard[1:] != shard[:-1]])
    tree, probe = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    # in a tree's own cell the larger set of a pair asks; a probe from another block asks for both
    least_place = np.full(int(number[-1]) + 1 if len(number) else 0, 1 << 40)
    np.minimum.at(least_place, number[tree], place[tree])
    radius = _radius(size[probe], place[probe], np.where(role[probe] == 0, size[probe], 1 << 40), least_place[number[probe]], threshold)
    nodes = int(np.bincount(number[tree], minlength=len(least_place))[number[probe]].sum())
    probe, radius = probe[radius >= 0], radius[radius >= 0]
    forest = BKForest(number[tree], codes.folded[1][tree])
    a, b = [], []
    for q, node in forest.search(number[probe], codes.folded[1][probe], radius, most=1 << 20):
        q, node = probe[q], tree[node]
        ok = (role[q] == 2) | (size[q] > size[node]) | ((size[q] == size[node]) & (sets[q] > sets[node]))
        q, node = q[ok], node[ok]
        both = size[q] + size[node]
        left = np.minimum(size[q] - place[q], size[node] - place[node])
        ok = (np.minimum(size[q], size[node]) >= np.maximum(size[q], size[node]) * threshold - 1e-9) & (left >= np.ceil(both * (threshold / (1 + threshold)) - 1e-9))
        q, node, both = q[ok], node[ok], both[ok]
        ok = codes.distance(q, node) <= both * ((1 - threshold) / (1 + threshold)) + 1e-9 - place[q] - place[node]
        x, y = sets[q[ok]], sets[node[ok]]
        ok = x != y
        a.append(np.minimum(x, y)[ok])
        b.append(np.maximum(x, y)[ok])
    some = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
    return some[0], some[1], forest.visited, nodes


def _search(batches: Iterator[pa.RecordBatch], threshold: float, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and set: whole shards, several together, each a BK-tree that its probes search. Rows of one set in a shard count once."""

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        shard, sets = t["shard"].to_numpy(), t["set_a"].to_numpy()
        new = np.r_[True, shard[1:] != shard[:-1]]
        once = new | np.r_[True, sets[1:] != sets[:-1]]
        several = np.add.reduceat(once, np.flatnonzero(new)) > 1
        keep = once & np.repeat(several, np.diff(np.r_[np.flatnonzero(new), len(shard)]))
        if keep.any():
            a, b, _, _ = search_shards(t.filter(pa.array(keep)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    last = None
    for batch in batches:
        shard = batch["shard"].to_numpy()
        if not len(shard):
            continue
        if rows > most:  # the forest ends where a shard ends
            cut = np.flatnonzero(shard != last)
            cut = int(cut[0]) if len(cut) else len(shard)
            held.append(batch.slice(0, cut))
            if cut == len(shard):
                continue
            yield from pairs(held)
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        last = shard[-1]
    if held:
        yield from pairs(held)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The set of each record: its sorted shingle hashes, 6 bytes each."""
    for batch in batches:
        for a, b, values, starts in _shingle_sets(batch, k):
            data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((starts * 6).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch["_id"].slice(a, b - a), packed], names=["_id", "shingles"])


def _unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets x and y reach the threshold, with their similarity."""
    for batch in batches:
        shared, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
            both = np.concatenate([_unpack_set(x.as_py()), _unpack_set(y.as_py())])
            both.sort()
            shared[i], total[i] = np.count_nonzero(both[1:] == both[:-1]), len(both)
        similarity = shared / np.maximum(total - shared, 1)
        ok = pa.array(similarity >= threshold)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok), pa.array(similarity).filter(ok)], names=["a", "b", "similarity"])


def near_duplicate_pairs(records: DataFrame, key: str, title: str, body: str, k: int = 5, threshold: float = 0.8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of records whose sets of k-word shingles have a Jaccard similarity of at least `threshold`.

    members (rep, id): each id with the least id of the class of equal shingle sets it belongs to. pairs (a, b,
    similarity): different classes, by representative, a < b. So copies are never expanded here, and no link is lost,
    whatever the threshold: nothing but equal hashes of different content (48 bits a shingle, 64 a set) could lose one.

    Shingles are ordered from rare to frequent, by the power of two of the number of records that have them (exact counts,
    kept in a table of bounded size; any order is right, this one makes small shards), and a class is filed in a shard
    for each of its first size - ceil(threshold * size) + 1 that another record has as well: two classes that reach the
    threshold have one of these in common, the first shingle that they share. A shard is a BK-tree on codes of what the
    sets have after the shard's shingle, children keyed by integer Hamming distance to their parent; each shingle toggles
    one of the code's bits, so codes differ in no more bits than the sets in shingles. Before its first common shingle a
    pair differs in everything, so the radius is what the threshold leaves after the probe's place and the least place in
    the tree. What the trees find is compared on codes of 192 to 768 bits by the same bound with the pair's own places,
    and must have enough left for the overlap. Trees travel to the probes by shuffle, not by broadcast: all trees together grow
    with the data. A shard that may hold more than `block` codes is cut into trees of about that size, each probed by the
    whole shard in a task of its own, so no shard gathers in one place. Pairs found are verified on the sets of their
    48-bit shingle hashes, re-read for the records in question.

    Records without k words have no shingle and belong to no class; null titles count as nothing, as do null bodies;
    rows without key are left out; repeated rows of a key count once, and of several different texts of one key that with
    the greatest packed set is verified; other columns, whatever their names, are ignored; empty tables give empty results.
    """
    spark = records.sparkSession
    own = records.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.col(title).alias("_title"), F.col(body).alias("_body"))
    keyed = materialise(own.mapInArrow(lambda b: _keyed(b, k), "_id bigint, set_a bigint, set_b bigint"))
    classes = keyed.groupBy("set_a", "set_b").agg(F.min("_id").alias("rep"))
    known = spark.sparkContext.broadcast(shingle_frequencies(own, k))

    filed = own.mapInArrow(lambda b: _filed(b, k, threshold, known, block), "shard bigint, facts bigint, set_a bigint, code binary")
    found = materialise(filed.repartition("shard").sortWithinPartitions("shard", "set_a").mapInArrow(lambda b: _search(b, threshold), "a bigint, b bigint"))
    rep_of = [classes.select(F.col("set_a").alias(c), F.col("rep").alias(f"rep_{c}")) for c in ("a", "b")]
    near = found.distinct().join(rep_of[0], "a").join(rep_of[1], "b")
    candidates = materialise(near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct())

    wanted = candidates.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    n = bloom_blocks(wanted.count())
    texts = bloom_probe(own, "_id", bloom_filter(wanted, "_id", n), n, "_maybe").filter("_maybe").drop("_maybe", "_block", "_bitmap")
    sets = texts.mapInArrow(lambda b: _sets(b, k), "_id bigint, shingles binary").groupBy("_id").agg(F.max("shingles").alias("shingles"))
    both = candidates.join(sets.select(F.col("_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("_id").alias("b"), F.col("shingles").alias("y")), "b")
    pairs = both.select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, threshold), "a bigint, b bigint, similarity double")
    member_of = keyed.select(F.col("_id").alias("id"), "set_a", "set_b").distinct()
    members = member_of.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("rep", "id")
    return pairs, members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of different ids, id_a < id_b, of one class or of two classes that are a pair; copies are expanded, those of large classes by many tasks."""
    pairs = materialise(pairs.select("a", "b"))
    members = materialise(members)
    other = members.select("rep", F.col("id").alias("id2"))
    within = salted_join(members, other, "rep", "inner").filter("id < id2").select(F.col("id").alias("id_a"), F.col("id2").alias("id_b"))
    first = materialise(members.join(pairs.withColumnRenamed("a", "rep"), "rep").select("id", F.col("b").alias("rep")))
    across = salted_join(first, other, "rep", "inner")
    across = across.filter("id != id2").select(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"))
    return within.union(across)


def near_duplicate_groups(records: DataFrame, key: str, title: str, body: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, rep, group_id, n_links): one row per record that has a class; group_id is shared by all directly or indirectly linked.

    rep is the least id of the record's class of equal shingle sets, n_links the number of other classes it is linked
    with. Edge cases as in near_duplicate_pairs.
    """
    pairs, members = near_duplicate_pairs(records, key, title, body, k, threshold)
    pairs = materialise(pairs.select("a", "b"))
    groups = connected_components(pairs, "a", "b").select("group_id", F.col("member").alias("rep"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = groups.join(links, "rep")
    return members.join(of_class, "rep", "left").select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
