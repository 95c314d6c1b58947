"""Token-budgeted chunking of documents with fenced code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import FENCE, chunk_id, content_hash, context_prefix, full_text

TARGET, OVERLAP = 512, 51
Counter = Callable[[str], int]


#: The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
_BLANK = "".join(map(chr, WHITE_SPACE))
_WORD = re.compile(f"[^{_BLANK}]+")


def _strip(text: str) -> str:
    return text.strip(_BLANK)


def approximate_tokens(text: str) -> int:
    return -(-len(text.encode()) // 3)


@dataclass
class Piece:
    text: str
    kind: str
    tokens: int
    split_code: bool


def segments(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the stretches between fences; fences stay with their code, and a fence left open runs to the end."""
    lines: list[str] = []
    code = False
    for line in text.split("\n"):
        fence = _strip(line) == FENCE
        if fence and code:
            yield "code", "\n".join([*lines, line])
            lines, code = [], False
        elif fence:
            if any(map(_strip, lines)):
                yield "prose", "\n".join(lines)
            lines, code = [line], True
        else:
            lines.append(line)
    if any(map(_strip, lines)):
        yield "code" if code else "prose", "\n".join(lines)


#: A sentence: a character, then all up to a stop or a line's end, or to the end of the text.
_SENTENCE = re.compile(r"(?s:.)[^.!?\n]*(?:[.!?\n]|\Z)")


def _sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def hard_split(text: str, count: Counter, limit: int) -> list[str]:
    """A text without boundaries in the longest prefixes that keep the limit, a character at least; nothing is lost.

    Only about a piece at a time is counted, however long the text."""
    out = []
    at, step = 0, limit
    while at < len(text):
        good, bad = 1, step + 1
        while at + bad <= len(text) and count(text[at : at + bad]) <= limit:
            good, bad = bad, 2 * bad
        bad = min(bad, len(text) - at + 1)
        while bad - good > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if count(text[at : at + middle]) <= limit else (good, middle)
        out.append(text[at : at + good])
        at += good
        step = good
    return out


def _packed(units: list[str], joiner: str, count: Counter, limit: int, weaker: Callable[[str], list[str]]) -> list[str]:
    """Consecutive units joined as long as they keep the limit; a unit that doesn't by itself is split by `weaker`."""
    out: list[str] = []
    held: str | None = None
    for unit in units:
        joined = unit if held is None else held + joiner + unit
        if count(joined) <= limit:
            held = joined
            continue
        if held is not None:
            out.append(held)
        held = unit
        if count(unit) > limit:
            *done, held = weaker(unit)
            out += done
    return out + [held] * (held is not None)


def split_prose(text: str, count: Counter, limit: int) -> list[str]:
    """Paragraphs, else sentences, else words, else characters, packed under the limit."""

    def by_word(s: str) -> list[str]:
        return _packed(_WORD.findall(s), " ", count, limit, lambda w: hard_split(w, count, limit)) or [""]

    def by_sentence(s: str) -> list[str]:
        return _packed(_sentences(s), "", count, limit, by_word)

    return [x for x in _packed(text.split("\n\n"), "\n\n", count, limit, by_sentence) if _strip(x)]


def split_code(text: str, count: Counter, limit: int) -> list[str]:
    """Lines packed under the limit, each part fenced again."""
    lines = [x for x in text.split("\n") if _strip(x) != FENCE]
    room = max(16, limit - 8)
    parts = _packed(lines, "\n", count, room, lambda s: hard_split(s, count, room))
    return [f"{FENCE}\n{x}\n{FENCE}" for x in parts if _strip(x)]


def tail(text: str, count: Counter, limit: int) -> str:
    """As many of the last lines, else words, as keep the limit; may be empty."""
    for units, joiner in ((text.split("\n"), "\n"), (_WORD.findall(text), " ")):
        kept = ""
        for unit in reversed(units):
            longer = unit + joiner + kept if kept else unit
            if count(longer) > limit:
                break
            kept = longer
        if _strip(kept):
            return _strip(kept)
    return ""


def chunk_text(text: str, count: Counter = approximate_tokens, target: int = TARGET, overlap: int = OVERLAP) -> list[Piece]:
    """Chunks of at most `target` tokens.

    Code blocks stay whole where they fit, and parts of a split one stand alone. Prose that follows prose begins with up
    to `overlap` tokens of the chunk before. Blank text gives no chunk."""
    limit = max(target - overlap, target // 2)
    units: list[tuple[str, str, bool]] = []
    for kind, body in segments(text):
        if count(body) <= limit:
            units.append((kind, body, False))
        elif kind == "code":
            units += [(kind, x, True) for x in split_code(body, count, limit)]
        else:
            units += [(kind, x, False) for x in split_prose(body, count, limit)]

    out: list[Piece] = []
    held, held_code = "", False

    def flush() -> None:
        nonlocal held, held_code
        body = _strip(held)
        if body:
            kind = "code" if held_code else "prose"
            parts = [body] if count(body) <= target else (split_code if held_code else split_prose)(body, count, target)
            out.extend(Piece(_strip(x), kind, count(_strip(x)), False) for x in parts)
        held, held_code = "", False

    for kind, body, split in units:
        if split:
            flush()
            out.append(Piece(_strip(body), kind, count(_strip(body)), True))
            continue
        if _strip(held) and count(held + body) > target:
            carry = "" if kind == "code" or held_code else tail(held, count, overlap)
            flush()
            held = carry + "\n" if carry else ""
        held += body + "\n"
        held_code |= kind == "code"
    flush()
    return out


def chunk_documents(docs: DataFrame, count: Counter = approximate_tokens, target: int = TARGET, overlap: int = OVERLAP, contextualize: bool = True, pipeline: str = "html1/chunk1/none") -> DataFrame:
    """One row per chunk of the documents (doc_id, title, tags, body, answers, effective_date, source_uri).

    Only packing runs in Python, in Arrow batches; ids, hashes and prefixes are expressions. doc_id and effective_date
    and the like pass through; null titles, bodies and answers count as empty; documents without text have no chunk."""
    fields = ["doc_id", "title", "tags", "effective_date", "source_uri"]
    source = docs.select(*fields, full_text(F.col("title"), F.col("body"), F.col("answers")).alias("full"))
    kept = docs.select(*fields).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", doc_content_hash string, chunk_index int, chunk_count int, display_text string, element_type string, token_count int, split_code boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, total, text, kind, tokens, split = [], [], [], [], [], [], []
            for i, full in enumerate(batch["full"].to_pylist()):
                pieces = chunk_text(full, count, target, overlap)
                for k, p in enumerate(pieces):
                    rows.append(i)
                    index.append(k)
                    total.append(len(pieces))
                    text.append(p.text)
                    kind.append(p.kind)
                    tokens.append(p.tokens)
                    split.append(p.split_code)
            own = batch.select([*fields, "doc_content_hash"]).take(pa.array(rows, pa.int64()))
            more = [pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(text, pa.string()), pa.array(kind, pa.string()), pa.array(tokens, pa.int32()), pa.array(split, pa.bool_())]
            yield pa.RecordBatch.from_arrays(own.columns + more, names=[*own.schema.names, "chunk_index", "chunk_count", "display_text", "element_type", "token_count", "split_code"])

    cut = source.withColumn("doc_content_hash", content_hash(F.col("full"))).mapInArrow(run, schema)
    hashed = cut.withColumn("content_hash", content_hash(F.col("display_text")))
    prefix = context_prefix(F.col("title"), F.col("tags")) if contextualize else F.lit("")
    return hashed.withColumns({"chunk_id": chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content_hash")), "text": F.concat(prefix, F.col("display_text")), "pipeline_version": F.lit(pipeline)})


def changed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of `new` whose content must be embedded again: those whose id `old` doesn't have."""
    return new.join(old.select("chunk_id"), "chunk_id", "left_anti")
