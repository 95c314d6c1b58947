"""Splitting oversized items at natural boundaries, by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.runtime import materialise

MAX_TOKENS, OVERLAP_TOKENS, BYTES_PER_TOKEN = 512, 51, 3
#: Bytes that one worker cuts; items are never loaded beyond a range and its halos.
RANGE_BYTES = 1 << 16
LEVELS = ("paragraph", "line", "word")
_LF, _TAB, _BLANK = 10, 9, 32


def item_ranges(df: DataFrame, name: str, key: str, text: str, max_tokens: int = MAX_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of the items of more than max_tokens: item_table, item_id, version, n_bytes, r, low, data.

    data holds the range's bytes with a halo on either side: what the longest piece and an overlap take. version tells
    different texts of one id apart. Null texts, and texts within the limit, give no range.
    """
    halo = _halo(max_tokens)
    own = df.filter(F.octet_length(text) > max_tokens * BYTES_PER_TOKEN).select(F.lit(name).alias("item_table"), F.col(key).cast("bigint").alias("item_id"), F.xxhash64(text).alias("version"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.encode(F.col(text), "UTF-8").alias("raw"))
    # offsets first: the ranges of an item are rows of their own before any bytes are taken, and only one slice is made at a time
    listed = own.withColumn("r", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_bytes") / range_bytes) - 1).cast("int")))).withColumn("low", F.col("r").cast("bigint") * range_bytes)
    begin = F.greatest(F.col("low") - halo, F.lit(0)).cast("int")
    cut = listed.select("item_table", "item_id", "version", "n_bytes", "r", "low", F.substring("raw", begin + 1, (F.col("low") - begin + range_bytes + halo).cast("int")).alias("data"))
    # items of one range stay where they are, the ranges of larger ones are spread; a number of their own keeps them apart however small they are
    one = F.col("n_bytes") <= range_bytes
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.filter(one).unionByName(cut.filter(~one).repartition(tasks, "item_table", "item_id", "version", "r"))


def file_ranges(spark: SparkSession, paths: list[str], max_tokens: int = MAX_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same for files of UTF-8 text on a file system that all workers share; workers seek, and read only their range. item_id is the place in paths."""
    halo = _halo(max_tokens)
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "item_id bigint, path string")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            yield pa.RecordBatch.from_pydict({"item_id": b["item_id"], "path": b["path"], "n_bytes": pa.array([os.path.getsize(p) for p in b["path"].to_pylist()], pa.int64())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with open(row.pop("path"), "rb") as f:
                    f.seek(max(0, row["low"] - halo))
                    row["data"] = f.read(min(halo, row["low"]) + range_bytes + halo)
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("item_table", pa.string()), ("item_id", pa.int64()), ("version", pa.int64()), ("n_bytes", pa.int64()), ("r", pa.int32()), ("low", pa.int64()), ("data", pa.binary())])
    sized = files.mapInArrow(sizes, "item_id bigint, path string, n_bytes bigint").filter(F.col("n_bytes") > max_tokens * BYTES_PER_TOKEN)
    r = sized.withColumn("r", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_bytes") / range_bytes) - 1).cast("int"))))
    ranges = r.select(F.lit("file").alias("item_table"), "item_id", F.lit(0).cast("bigint").alias("version"), "n_bytes", "r", (F.col("r").cast("bigint") * range_bytes).alias("low"), "path")
    return ranges.repartition(F.col("item_id"), F.col("r")).mapInArrow(read, "item_table string, item_id bigint, version bigint, n_bytes bigint, r int, low bigint, data binary")


def _halo(max_tokens: int) -> int:
    return max_tokens * BYTES_PER_TOKEN + 8


def _separators(b: np.ndarray) -> list[np.ndarray]:
    """Separator bytes of each level: runs of two or more line feeds; line feeds; blanks, tabs and line feeds."""
    lf = b == _LF
    double = np.zeros(len(b), bool)
    double[1:] |= lf[1:] & lf[:-1]
    double[:-1] |= lf[:-1] & lf[1:]
    return [double, lf, lf | (b == _TAB) | (b == _BLANK)]


def _boundaries(batches: Iterator[pa.RecordBatch], range_bytes: int, halo: int) -> Iterator[pa.RecordBatch]:
    """The boundary table of each range and level: its first and last separator, and the longest unit between two of its own."""
    for batch in batches:
        out: dict[str, list] = {f"{x}{i}": [] for i in range(3) for x in ("first", "last", "inner")}
        for low, data in zip(batch["low"].to_pylist(), batch["data"].to_pylist(), strict=True):
            b = np.frombuffer(data, np.uint8)
            skip = min(halo, low)
            for i, sep in enumerate(_separators(b)):
                at = np.flatnonzero(sep[skip : skip + range_bytes])
                out[f"first{i}"].append(int(at[0]) + low if len(at) else None)
                out[f"last{i}"].append(int(at[-1]) + low if len(at) else None)
                out[f"inner{i}"].append(int(np.diff(at).max()) - 1 if len(at) > 1 else 0)
        keys = {k: batch[k] for k in ("item_table", "item_id", "version", "n_bytes", "r")}
        yield pa.RecordBatch.from_pydict(keys | {k: pa.array(v, pa.int64()) for k, v in out.items()})


def cut_levels(ranges: DataFrame, max_tokens: int = MAX_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(item_table, item_id, cut_level) of every oversized item: the first level at which all its units keep the limit, else char.

    Workers give each range's boundary table; the tables of an item are stitched in order, so a unit that spans ranges
    has its length from the last separator before it to the first after it. Tables are a few numbers per range; no text moves.
    """
    halo = _halo(max_tokens)
    schema = "item_table string, item_id bigint, version bigint, n_bytes bigint, r int, " + ", ".join(f"first{i} bigint, last{i} bigint, inner{i} bigint" for i in range(3))
    tables = ranges.mapInArrow(lambda b: _boundaries(b, range_bytes, halo), schema)
    item = ["item_table", "item_id", "version"]
    before = Window.partitionBy(*item).orderBy("r").rangeBetween(Window.unboundedPreceding, -1)
    for i in range(3):
        spanning = F.col(f"first{i}") - F.coalesce(F.max(f"last{i}").over(before), F.lit(-1)) - 1
        tables = tables.withColumn(f"unit{i}", F.greatest(F.col(f"inner{i}"), F.coalesce(spanning, F.lit(0))))
    longest = [F.greatest(F.max(f"unit{i}"), F.max("n_bytes") - F.coalesce(F.max(f"last{i}"), F.lit(-1)) - 1).alias(f"unit{i}") for i in range(3)]
    limit = max_tokens * BYTES_PER_TOKEN
    level = F.lit("char")
    for i, name in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col(f"unit{i}") <= limit, name).otherwise(level)
    return tables.groupBy(*item).agg(*longest).select("item_table", "item_id", level.alias("cut_level")).distinct()


def _breaks(b: np.ndarray) -> list[np.ndarray]:
    """Offsets at which a paragraph, line, sentence or word begins: where a cut is natural, strongest first; then of characters."""
    seps = _separators(b)
    starts = []
    for s in seps:
        begins = ~s
        begins[1:] &= s[:-1]
        begins[:1] = False
        starts.append(np.flatnonzero(begins))
    word = starts[2]
    closing = np.isin(b, np.frombuffer(b".!?", np.uint8))
    sentence = word[closing[np.maximum(word - 2, 0)] & (word >= 2)]
    return [starts[0], starts[1], sentence, word, np.flatnonzero((b & 0xC0) != 0x80)]


def _last(at: np.ndarray, low: int, high: int) -> int | None:
    """The last of the sorted offsets in (low, high]."""
    i = np.searchsorted(at, high, side="right")
    return int(at[i - 1]) if i and at[i - 1] > low else None


def _first(at: np.ndarray, low: int, high: int) -> int | None:
    """The first in [low, high)."""
    i = np.searchsorted(at, low)
    return int(at[i]) if i < len(at) and at[i] < high else None


def _anchor(levels: list[np.ndarray], at: int, limit: int) -> int:
    """Where the pieces of a range begin: the strongest natural boundary of its first bytes. Both neighbours compute the same."""
    return next(x for level in levels if (x := _first(level, at, at + limit // 2)) is not None)


def cut_range(data: bytes, skip: int, n_own: int, first: bool, last: bool, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) of the pieces of a range, as offsets in data, whose own bytes are [skip, skip + n_own).

    Pieces with their overlaps have at most `limit` bytes. They tile the range between its anchor and the next one's."""
    b = np.frombuffer(data, np.uint8)
    levels = _breaks(b)
    begin = 0 if first else _anchor(levels, skip, limit)
    end = len(b) if last else _anchor(levels, skip + n_own, limit)
    pieces: list[tuple[int, int, int]] = []
    at, before = begin, (max(0, begin - overlap) if not first else begin)
    while at < end:
        repeat = at
        if at > begin or not first:
            floor = max(at - overlap, before)
            found = [x for level in (levels[1], levels[3]) if (x := _first(level, floor, at)) is not None]
            repeat = found[0] if found else at
        high = repeat + limit
        cut = end
        if high < end:
            if end - high < overlap:  # no piece shorter than an overlap is left over
                high = end - overlap - 1
            room = high - at
            cut = next((x for low in (at + room // 3, at) for level in levels[:4] if (x := _last(level, low, high)) is not None), None) or _last(levels[4], at, high)
        pieces.append((repeat, at, cut))
        at, before = cut, at
    return pieces


def split_oversized(ranges: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the items: item_table, item_id, version, piece_no, start_byte, end_byte, overlap_bytes, n_tokens, text.

    Each worker cuts its range from its anchor, the first natural boundary in it, to the anchor of the next, which the
    halo lets it compute as well; so ranges of one giant item are cut independently. Cuts fall where a paragraph begins,
    else a line, a sentence, a word, else between characters. A piece repeats up to overlap_tokens of the one before,
    from where a line or word begins, and has at most max_tokens (UTF-8 bytes divided by 3, rounded up) with that.
    [start_byte, end_byte) tile the item without gap; text holds overlap and piece. Piece numbers are the prefix sums
    of the ranges' counts. Repeated rows of an item count once.
    """
    if range_bytes < 4 * max_tokens * BYTES_PER_TOKEN:
        raise ValueError("range_bytes must hold several pieces")
    halo, limit, overlap = _halo(max_tokens), max_tokens * BYTES_PER_TOKEN, overlap_tokens * BYTES_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                skip, data = min(halo, x["low"]), x.pop("data")
                shift = x["low"] - skip
                last = x["low"] + range_bytes >= x["n_bytes"] or x["n_bytes"] - x["low"] - range_bytes <= limit // 2
                # a last range too short to hold an anchor belongs to the one before
                if x["low"] and x["n_bytes"] - x["low"] <= limit // 2:
                    continue
                for i, (o, s, e) in enumerate(cut_range(data, skip, range_bytes, x["low"] == 0, last, limit, overlap)):
                    rows.append({k: x[k] for k in ("item_table", "item_id", "version", "r")} | {"i": i, "start_byte": s + shift, "end_byte": e + shift, "overlap_bytes": s - o, "n_tokens": -(-(e - o) // BYTES_PER_TOKEN), "text": data[o:e].decode()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("item_table", pa.string()), ("item_id", pa.int64()), ("version", pa.int64()), ("r", pa.int32()), ("i", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("overlap_bytes", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])
    item = ["item_table", "item_id", "version"]
    cut = materialise(ranges.mapInArrow(run, "item_table string, item_id bigint, version bigint, r int, i int, start_byte bigint, end_byte bigint, overlap_bytes int, n_tokens int, text string").dropDuplicates([*item, "r", "i"]))
    counts = cut.groupBy(*item, "r").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*item).orderBy("r").rangeBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*item, "r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return cut.join(firsts, [*item, "r"]).select(*item, (F.col("before") + F.col("i")).alias("piece_no"), "start_byte", "end_byte", "overlap_bytes", "n_tokens", "text")
