"""Tables that the engine writes and reads: chunks, labelled pairs, term statistics, prices."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.chunking import approximate_tokens

PRICES = "model string, input_per_mtok double, output_per_mtok double, cache_write_5m_per_mtok double, cache_write_1h_per_mtok double, cache_read_per_mtok double, version string, fetched_at string, source string, currency string"
#: Columns of the chunk index; those a search filters by get Bloom filters, besides the statistics that every column has.
INDEX = "chunk_id string, doc_id bigint, chunk_index int, text string, tags array<string>, element_type string, token_count int, pipeline_version string, content_hash string, embedding array<float>, tenant_id string"
INDEXED = ("chunk_id", "doc_id", "element_type", "pipeline_version", "tags.list.element")
#: A batch of at most so many tenants reads only their folders.
FEW_TENANTS = 1000


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order, repeated ones counted; the sum of 60 bits of each row's MD5, in which nulls differ from empty texts."""
    row = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in df.columns])
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(bits.alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).cast("string").alias("fingerprint"))


def _exists(e: AnalysisException) -> bool:
    if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
        raise e
    return False


def ensure_index(spark: SparkSession, path: str, schema: str = INDEX, tenant: str = "tenant_id") -> bool:
    """Makes an empty chunk table at path, partitioned by tenant; does nothing, and gives False, if there is one."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return False
    except AnalysisException as e:
        _exists(e)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return True


def write_index(chunks: DataFrame, path: str, tenant: str = "tenant_id") -> None:
    """Chunk table partitioned by tenant, so that a tenant's search reads its folder only, with Bloom filters on what searches filter by."""
    w = chunks.write.mode("append").partitionBy(tenant)
    for c in INDEXED:
        if c.split(".")[0] in chunks.columns:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def upsert_index(chunks: DataFrame, path: str, tenant: str = "tenant_id") -> int:
    """Appends the chunks that their tenant doesn't have yet; repeating a batch changes nothing. Returns how many were new.

    Ids depend on document, place and content, not on the tenant, so a chunk is known by tenant and id, and a changed one
    is new. Of the index only the ids are read, and only in the folders of the batch's tenants (all, if these are many)."""
    spark = chunks.sparkSession
    fresh = chunks.dropDuplicates([tenant, "chunk_id"])
    try:
        have = spark.read.parquet(path).select(tenant, "chunk_id")
        some = [r[0] for r in chunks.select(tenant).distinct().limit(FEW_TENANTS + 1).collect()]
        if len(some) <= FEW_TENANTS:
            have = have.filter(F.col(tenant).isin([x for x in some if x is not None]) | (F.col(tenant).isNull() if None in some else F.lit(False)))
        known = have.select(F.col(tenant).alias("_tenant"), F.col("chunk_id").alias("_chunk"))
        fresh = fresh.join(known, fresh[tenant].eqNullSafe(known["_tenant"]) & (fresh["chunk_id"] == known["_chunk"]), "left_anti")
    except AnalysisException as e:
        _exists(e)
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            write_index(fresh, path, tenant)
        return n
    finally:
        fresh.unpersist()


def attach_sparse(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """chunks with their sparse vector as a map of terms to weights; chunks without terms have null. weights: (chunk_id, term, weight)."""
    vectors = weights.groupBy("chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("sparse"))
    return chunks.join(vectors, "chunk_id", "left")


def save_term_stats(frequencies: DataFrame, stats: DataFrame, path: str) -> None:
    frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_term_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frequencies and totals as they were saved; the total length is exact."""
    return spark.read.parquet(f"{path}/frequencies"), spark.read.parquet(f"{path}/stats")


def save_pairs(pairs: DataFrame, path: str, **provenance: str) -> None:
    """Labelled pairs as JSON lines, with what they were made from beside them."""
    pairs.write.mode("overwrite").json(f"{path}/pairs")
    pairs.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "provenance string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")


def load_pairs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    return spark.read.schema(schema).json(f"{path}/pairs"), json.loads(spark.read.text(f"{path}/provenance").first()[0])


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices per million tokens of a TOML file: version, fetched_at, source and currency (USD if absent), and one [models."name"] table each; a price that is absent is 0."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    rates = [x.split()[0] for x in PRICES.split(", ") if x.endswith("_mtok double")]
    about = (str(data.get("version", "")), str(data.get("fetched_at", "")), str(data.get("source", "")), str(data.get("currency", "USD")))
    return spark.createDataFrame([(name, *(float(r.get(k, 0)) for k in rates), *about) for name, r in data["models"].items()], PRICES)


def find_tokenizer(directory: str, contains: str = "", depth: int = 6) -> str | None:
    """The first tokenizer file (*.json with a model in it), at most so deep below a folder, whose path contains a text; None without one."""
    root = Path(directory)
    for p in sorted(root.rglob("*.json")) if root.is_dir() else []:
        if len(p.relative_to(root).parts) <= depth and contains in str(p):
            with open(p, "rb") as f:
                if b'"model"' in f.read(1 << 20):
                    return str(p)
    return None


def token_counter(path: str | None) -> Callable[[str], int]:
    """Counts tokens of a text by a tokenizer file, without special tokens; a text it fails on, and a missing file or library, count a token for every three bytes."""
    if path:
        try:
            from tokenizers import Tokenizer
        except ImportError:
            return approximate_tokens
        held: list = []

        def count(text: str) -> int:
            if not held:  # workers load it themselves
                held.append(Tokenizer.from_file(path))
            try:
                return len(held[0].encode(text, add_special_tokens=False).ids)
            except Exception:
                return approximate_tokens(text)

        return count
    return approximate_tokens


def assemble_frames(pieces: DataFrame, stream: str, seq: str, data: str) -> DataFrame:
    """(stream, i, frame): server-sent event frames of pieces of text that arrive in order; a frame ends with an empty line and may lie across pieces, one left open is no frame. A stream is one response."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, data))), lambda x: x[data]), "")
    frames = pieces.filter(F.col(data).isNotNull()).groupBy(stream).agg(F.split(text, "\n\n").alias("f"))
    # what comes after the last empty line is not complete
    return frames.select(stream, F.posexplode(F.slice("f", F.lit(1), F.size("f") - 1)).alias("i", "frame")).filter("frame <> ''")


_EVENT = "type string, delta struct<text: string, stop_reason: string>, message struct<model: string, usage: struct<input_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>>, usage struct<output_tokens: bigint>, error struct<message: string>"


def parse_sse(frames: DataFrame, frame: str, *keep: str) -> DataFrame:
    """(keep, type, text, model, input_tokens, cache_write_tokens, cache_read_tokens, output_tokens, stop_reason, error) of event frames; lines other than data, and broken JSON, give nulls."""
    x = frames.select(*keep, F.from_json(F.regexp_extract(frame, r"(?m)^data: (.*)$", 1), _EVENT).alias("x"))
    usage = "x.message.usage"
    return x.select(*keep, "x.type", F.col("x.delta.text").alias("text"), F.col("x.message.model").alias("model"), F.col(f"{usage}.input_tokens").alias("input_tokens"), F.col(f"{usage}.cache_creation_input_tokens").alias("cache_write_tokens"), F.col(f"{usage}.cache_read_input_tokens").alias("cache_read_tokens"), F.col("x.usage.output_tokens").alias("output_tokens"), F.col("x.delta.stop_reason").alias("stop_reason"), F.col("x.error.message").alias("error"))


def completions(frames: DataFrame, stream: str) -> DataFrame:
    """(stream, text, model, tokens by class, stop_reason, error) of frames (stream, i, frame): one row a response."""
    x = parse_sse(frames, "frame", stream, "i")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "content_block_delta", F.struct("i", "text")))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens")]
    return x.groupBy(stream).agg(text.alias("text"), F.max("model").alias("model"), *counts, F.max("stop_reason").alias("stop_reason"), F.max(F.when(F.col("type") == "error", F.coalesce("error", F.lit("stream error")))).alias("error"))


#: Encoders by tag, with what is put before queries, never before documents.
ENCODERS = {
    "bge-small-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "all-minilm-l6-v2": "",
    "bge-small-en-v1.5-int8": "Represent this sentence for searching relevant passages: ",
}


def query_prefix(encoder: str) -> str:
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder}")
    return ENCODERS[encoder]


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], prefix: str = "", batch: int = 16, dim: int | None = None, strict: bool = False) -> DataFrame:
    """(key, embedding) by a given encoder, called on texts of like length together; blank texts give null, or with `strict` an error. Vectors of another length than `dim` are an error."""
    kind = df.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            order = sorted((i for i, t in enumerate(texts) if t and t.strip()), key=lambda i: len(texts[i]))
            if strict and len(order) < len(texts):
                raise ValueError("empty text")
            out: list = [None] * len(texts)
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                for i, v in zip(part, encode([prefix + texts[i] for i in part]), strict=True):
                    if dim is not None and len(v) != dim:
                        raise ValueError(f"{len(v)} dimensions, not {dim}")
                    out[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_pydict({"id": b["id"], "embedding": pa.array(out, pa.list_(pa.float32()))})

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", key)
