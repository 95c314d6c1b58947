"""Encoding of a corpus by a public byte-level BPE, its pre-tokens found by array scans."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textvec import SPACE, char_prefix, chunked, class_table, code_points, span_hash

#: Where the vocabulary files are, on every worker; a parameter of the operators.
VOCABULARY_DIR = os.environ.get("MARLSTONE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens whose ids a worker remembers; a full cache starts anew.
CACHE = 1 << 17

# Symbols of the scan. Whether white space is the last before a token, and whether a tick begins a contraction of 2 or 3
# code points, is decided by look-ahead, so the automaton needs none. _BREAK stands between texts.
_OTHER, _LETTER, _NUMBER, _BLANK, _WHITE, _LAST_BLANK, _LAST_WHITE, _TICK2, _TICK3, _BREAK = range(10)
_SYMBOLS = 10
# States: what kind of token holds the last code point, or how many code points a contraction still takes.
_S_OTHER, _S_LETTER, _S_NUMBER, _S_WHITE, _S_PREFIX, _S_MORE2, _S_MORE1, _S_DONE = range(8)
_STATES = 8


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token starts, by state * _SYMBOLS + symbol.

    Tokens: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers, or of others, each with one blank before;
    white space without the last one before a token; other white space."""
    step = np.zeros((_STATES, _SYMBOLS), np.uint8)
    start = np.ones((_STATES, _SYMBOLS), bool)
    run = {_OTHER: _S_OTHER, _LETTER: _S_LETTER, _NUMBER: _S_NUMBER}
    for s in range(_STATES):
        for c in range(_SYMBOLS):
            if c == _BREAK:
                step[s, c] = _S_DONE
            elif s in (_S_MORE2, _S_MORE1):
                step[s, c], start[s, c] = (_S_MORE1 if s == _S_MORE2 else _S_DONE), False
            elif c in run:
                step[s, c], start[s, c] = run[c], s not in (run[c], _S_PREFIX)
            elif c in (_TICK2, _TICK3) and s in (_S_OTHER, _S_PREFIX):  # inside a run of others: no contraction
                step[s, c], start[s, c] = _S_OTHER, False
            elif c in (_TICK2, _TICK3):
                step[s, c] = _S_MORE1 if c == _TICK2 else _S_MORE2
            elif c in (_BLANK, _WHITE):
                step[s, c], start[s, c] = _S_WHITE, s != _S_WHITE
            else:
                step[s, c] = _S_PREFIX if c == _LAST_BLANK else _S_DONE
    return step.ravel(), start.ravel()


def _states(symbols: np.ndarray, width: int = 128) -> np.ndarray:
    """The state before every symbol, by an associative scan of transition functions.

    Blocks of `width` symbols are composed into one function each, all blocks side by side; the functions of all blocks up
    to each are composed in steps of doubling distance, which gives every block's entry state; and every block is run from
    its own, again side by side."""
    step, _ = _automaton()
    n = len(symbols)
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    function = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    for row in columns:
        function = step[function * np.uint8(_SYMBOLS) + row]
    reach = 1
    while reach < blocks:
        function = np.concatenate([function[:, :reach], np.take_along_axis(function[:, reach:], function[:, :-reach], axis=0)], axis=1)
        reach *= 2
    entry = np.full(blocks, _S_DONE, np.uint8)
    entry[1:] = function[_S_DONE, :-1]
    before = np.empty((width, blocks), np.uint8)
    now = entry
    for i, row in enumerate(columns):
        before[i] = now
        now = step[now * np.uint8(_SYMBOLS) + row]
    return before.T.reshape(-1)[:n]


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of the texts, in order: code points (a separator after each text), start, end, and each text's first pre-token (one more entry)."""
    cps, starts = code_points([t + "\0" for t in texts])
    breaks = starts[1:] - 1
    kind = class_table()[cps]
    symbols = np.array([_OTHER, _LETTER, _NUMBER, _WHITE], np.uint8)[kind]  # in the order of the classes
    solid = kind != SPACE
    solid[breaks] = False
    blank = cps == 32
    symbols[blank] = _BLANK
    last = np.zeros(len(cps), bool)
    last[:-1] = ~solid[:-1] & solid[1:]
    last[breaks] = False
    symbols[last] = np.where(blank[last], _LAST_BLANK, _LAST_WHITE)
    symbols[breaks] = _BREAK
    tick = np.flatnonzero(cps == 39)
    tick = tick[tick + 1 < len(cps)]
    a = cps[tick + 1]
    b = cps[np.minimum(tick + 2, len(cps) - 1)]
    # a separator is no letter, so no contraction reaches over a text's end
    symbols[tick[np.isin(a, [ord(c) for c in "stmd"])]] = _TICK2
    symbols[tick[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = _TICK3
    _, begins = _automaton()
    begin = np.flatnonzero(begins[_states(symbols) * np.uint8(_SYMBOLS) + symbols])
    end = np.r_[begin[1:], len(cps)]
    real = symbols[begin] != _BREAK
    begin, end = begin[real], end[real]
    return cps, begin, end, np.searchsorted(begin, starts)


class Encoder:
    """Ids of texts by the rank file at `path`; pair merging runs once per distinct pre-token and is remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.cache: dict[str, list[int]] = {}

    def _ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            ids = self.merge(piece)
            if len(piece) < 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin (one more entry than texts)."""
        cps, begin, end, first = pretokens(texts)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        h = span_hash(char_prefix(cps), begin, end)
        _, example, kind = np.unique(h, return_index=True, return_inverse=True)
        size = end - begin
        # equal hashes are only believed after a comparison of the spans themselves
        at = np.repeat(begin[example][kind] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        own = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if (size != size[example][kind]).any() or (cps[at] != cps[own]).any():
            example = kind = np.arange(len(begin))
        joined = "".join(t + "\0" for t in texts)
        ids = [self._ids(joined[a:b]) for a, b in zip(begin[example].tolist(), end[example].tolist(), strict=True)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))
        offset = np.cumsum(length) - length
        n = length[kind]
        total = np.cumsum(n)
        out = flat[np.repeat(offset[kind] - (total - n), n) + np.arange(int(total[-1]))]
        return out, np.r_[0, total][first]

    def offsets(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offset, within its text, at which each id's bytes begin."""
        size = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, t in self.token_bytes.items():
            size[i] = len(t)
        n = size[ids]
        before = np.cumsum(n) - n
        return (before - np.repeat(np.r_[before, int(n.sum())][starts[:-1]], np.diff(starts))).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, with_offsets: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for first, run in chunked(t or "" for t in batch["text"].to_pylist()):
            ids, starts = enc.encode(run)
            at = pa.array(starts.astype(np.int32))
            columns = {"id": batch["id"].slice(first, len(run)), "ids": pa.ListArray.from_arrays(at, pa.array(ids))}
            if with_offsets:
                columns["offsets"] = pa.ListArray.from_arrays(at, pa.array(enc.offsets(ids, starts)))
            yield pa.RecordBatch.from_pydict(columns)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR, with_offsets: bool = False) -> DataFrame:
    """(key, ids[, offsets]) of every row, by the rank file `vocabulary` in `directory`, without special tokens.

    Pre-tokenisation runs on arrays: code points become symbols, an associative scan of the automaton's transition
    functions gives the state everywhere, and with it all boundaries; no regular expression is involved. Distinct
    pre-tokens of a batch are merged once and remembered. Narrow: no shuffle, one pass.

    Null and empty texts both give the empty list; strings of special tokens are ordinary text; any characters, line
    ends and lengths are encoded whole; a null key is kept; repeated rows give repeated rows; other columns are ignored.
    With offsets, each id comes with the byte at which it begins in the UTF-8 text, so any part can be decoded.
    """
    path = f"{directory}/{vocabulary}.tiktoken"
    kind = df.select(key).dtypes[0][1]
    schema = f"id {kind}, ids array<int>" + ", offsets array<int>" * with_offsets
    own = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(lambda b: _encode(b, path, with_offsets), schema).withColumnRenamed("id", key)


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR) -> DataFrame:
    """(key, text): the texts that the ids stand for; null ids give a null text, no ids the empty text."""
    path = f"{directory}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "text": pa.array(texts, pa.string())})

    kind = df.select(key).dtypes[0][1]
    return df.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)
