import numpy as np
from pyspark.sql import functions as F

from marlstone.sources import tables, xml
from marlstone.streaming import ingest

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="31" PostTypeId="1" AcceptedAnswerId="44" Score="6" Title="Cut &amp; paste" Body="&lt;p&gt;How&#xA;so&lt;/p&gt;" Tags="|text|" CreationDate="2020-02-03T04:05:06.007" />
  <row Id="44" PostTypeId="2" ParentId="31" Score="x" Body="like this" />
  <row PostTypeId="2" Score="9" Body="without id" />
  <row Id="90" PostTypeId="1" Score="-11" Title="Other" Body="b" Tags="&lt;a&gt;&lt;b&gt;" />
</posts>
"""
LINKS = """<?xml version="1.0" encoding="utf-8"?>
<links>
  <row Id="5" PostId="90" RelatedPostId="31" LinkTypeId="3" />
  <row Id="6" PostId="31" RelatedPostId="90" LinkTypeId="1" />
  <row Id="7" PostId="31" RelatedPostId="31" LinkTypeId="3" />
  <row Id="8" PostId="12" LinkTypeId="3" />
</links>
"""


def test_xml(spark, tmp_path):
    (tmp_path / "posts.xml").write_text(POSTS)
    (tmp_path / "links.xml").write_text(LINKS)
    posts = {r["id"]: r for r in xml.read_posts(spark, str(tmp_path / "posts.xml")).collect()}
    assert set(posts) == {31, 44, 90}
    assert posts[31]["title"] == "Cut & paste" and posts[31]["body"] == "<p>How\nso</p>" and posts[90]["score"] == -11
    assert posts[44]["title"] is None and posts[44]["parent_id"] == 31 and posts[44]["score"] == 0
    assert xml.read_posts(spark, str(tmp_path / "posts.xml"), limit=2).count() == 2
    assert {(r["post_id"], r["related_post_id"]) for r in xml.read_duplicate_links(spark, str(tmp_path / "links.xml")).collect()} == {(90, 31)}


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/posts.xml").write_text(POSTS)
    index = str(tmp_path / "index")
    for k in range(2):  # another checkpoint: every row is delivered again
        q = ingest.ingest_stream(xml.stream_posts(spark, str(tmp_path / "in")), index, str(tmp_path / f"cp{k}"))
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.parquet(index).collect()
    assert {r["doc_id"] for r in rows} == {31, 90}
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_stage_windows_stream_equals_batch(spark, tmp_path):
    events = spark.range(600).select((F.timestamp_seconds(F.col("id") * 10)).alias("ts"), F.concat(F.lit("s"), F.col("id") % 2).alias("stage"), (F.col("id") % 100).cast("double").alias("ms"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.stage_windows(stream, "ts", "stage", "ms").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in ingest.stage_windows(events, "ts", "stage", "ms").collect()}
    streamed = {tuple(r) for r in spark.table("windows").collect()}
    assert streamed and streamed <= batch


def test_cache_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "How  do I"), (2, "t", "how do i"), (3, "u", "how do i"), (4, None, "x")], "seq bigint, tenant string, query string")
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r"))
    q = ingest.cache_stream(stream).writeStream.format("memory").queryName("cached").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("cached").collect()} == {(1, "miss", None), (2, "exact", 1), (3, "miss", None)}


def test_tables(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert tables.fingerprint(df).first() == tables.fingerprint(df.repartition(7)).first() != tables.fingerprint(df.filter("id > 0")).first()
    pairs = spark.createDataFrame([(1, 2, "t")], "query_id bigint, gold_doc_id bigint, query_title string")
    tables.save_pairs(pairs, str(tmp_path / "g"), source="test", version="1")
    back, provenance = tables.load_pairs(spark, str(tmp_path / "g"), "query_id bigint, gold_doc_id bigint, query_title string")
    assert back.collect() == pairs.collect() and provenance == {"source": "test", "version": "1"}
    (tmp_path / "p.toml").write_text('version = "7"\nfetched_at = "2025-01-01"\nsource = "here"\n[models."m"]\ninput_per_mtok = 1\noutput_per_mtok = 5.0\n')
    price = tables.read_prices(spark, str(tmp_path / "p.toml")).first()
    assert (price["model"], price["cache_read_per_mtok"], price["version"], price["currency"], price["source"]) == ("m", 0, "7", "USD", "here")
    freq, stats = spark.createDataFrame([("a", 1)], "term string, df bigint"), spark.createDataFrame([(3, 7)], "doc_count bigint, total_len bigint")
    tables.save_term_stats(freq, stats, str(tmp_path / "s"))
    assert [x.collect() for x in tables.load_term_stats(spark, str(tmp_path / "s"))] == [freq.collect(), stats.collect()]


def test_sse_and_sparse_and_embedding(spark):
    frames = spark.createDataFrame([('event: x\ndata: {"type":"message_start","message":{"usage":{"input_tokens":9}}}',), ('data: {"type":"content_block_delta","delta":{"text":"hi"}}',), (": ping",)], "frame string")
    got = [(r["type"], r["text"], r["input_tokens"], r["output_tokens"]) for r in tables.parse_sse(frames, "frame").collect()]
    assert got == [("message_start", None, 9, None), ("content_block_delta", "hi", None, None), (None, None, None, None)]
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    weights = spark.createDataFrame([("c1", "b", 2.0), ("c1", "a", 1.0)], "chunk_id string, term string, weight double")
    assert {r["chunk_id"]: r["sparse"] for r in tables.attach_sparse(chunks, weights).collect()} == {"c1": {"a": 1.0, "b": 2.0}, "c2": None}
    texts = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "abcdef")], "id bigint, text string")
    out = tables.embed(texts, "id", "text", lambda ts: np.array([[len(t), 1.0] for t in ts]), prefix="q")
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: [4.0, 1.0], 2: None, 3: None, 4: [7.0, 1.0]}


def test_upsert_keeps_tenants_apart(spark, tmp_path):
    path = str(tmp_path / "index")
    assert tables.ensure_index(spark, path) and not tables.ensure_index(spark, path)
    chunk = spark.createDataFrame([("c", 1, "t")], "chunk_id string, doc_id bigint, text string")
    a, b, none = (chunk.withColumn("tenant_id", F.lit(t).cast("string")) for t in ("a", "b", None))
    assert [tables.upsert_index(x, path) for x in (a, b, a, b, none, none, a.unionByName(b))] == [1, 1, 0, 0, 1, 0, 0]
    rows = spark.read.schema(tables.INDEX).parquet(path).select("tenant_id", "chunk_id").collect()
    assert sorted(rows, key=repr) == sorted([("a", "c"), ("b", "c"), (None, "c")], key=repr)


def test_frames_lie_across_pieces(spark):
    pieces = [(1, 1, 'data: {"type":"content_block_delta","delta":{"te'), (1, 2, 'xt":"one"}}\n'), (1, 3, '\ndata: {"type":"content_block_delta","delta":{"text":" two"}}\n\ndata: {"type":"err'), (2, 1, 'data: {"type":"error","error":{"message":"bad"}}\n\n'), (2, 2, None), (3, 1, "open")]
    frames = tables.assemble_frames(spark.createDataFrame(pieces, "s int, n int, d string"), "s", "n", "d")
    got = {r["s"]: (r["text"], r["error"], r["output_tokens"]) for r in tables.completions(frames, "s").collect()}
    assert got == {1: ("one two", None, 0), 2: ("", "bad", 0)}


def test_tokenizers_and_encoders(spark, tmp_path):
    import pytest

    (tmp_path / "deep").mkdir()
    assert tables.find_tokenizer(str(tmp_path)) is None and tables.find_tokenizer(str(tmp_path / "none")) is None
    (tmp_path / "deep/tokenizer.json").write_text('{"model": {}}')
    (tmp_path / "deep/other.json").write_text("{}")
    assert tables.find_tokenizer(str(tmp_path)).endswith("deep/tokenizer.json") and tables.find_tokenizer(str(tmp_path), "bge") is None
    assert tables.token_counter(None)("abcd") == 2
    path = tables.find_tokenizer("/opt/tokenizers/", "word")
    if path:
        assert tables.token_counter(path)("two words") == 2
    assert tables.query_prefix("all-minilm-l6-v2") == ""
    with pytest.raises(ValueError, match="unknown"):
        tables.query_prefix("x")
    texts = spark.createDataFrame([(1, "a"), (2, " ")], "id bigint, text string")
    for wrong in ({"strict": True}, {"dim": 3}):
        with pytest.raises(Exception, match="empty text|dimensions"):
            tables.embed(texts, "id", "text", lambda ts: np.ones((len(ts), 2)), **wrong).collect()


def test_both_cache_levels_of_a_stream(spark, tmp_path):
    import datetime as dt

    def at(n):
        return dt.datetime(2024, 1, 1, 0, n)

    schema = "seq bigint, tenant string, query string, embedding array<float>, answer string, inserted_at timestamp"
    first = [(1, "t", "a b", [1.0, 0.0], "x", at(1)), (2, "t", "A  b", [0.0, 1.0], "y", at(2)), (3, "t", "c", [1.0, 0.1], "z", at(3))]
    second = [(4, "t", "d", [1.0, 0.0], "w", at(4)), (5, "t", "d now", [1.0, 0.0], "w", at(5)), (6, "u", "a b", [1.0, 0.0], "w", at(6)), (7, "t", "a b", None, None, at(7))]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.cached_answers(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), 2, ~F.col("query").contains("now"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r["query_id"]: (r["outcome"], r["hit_seq"], r["refused"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("miss", None, False), 2: ("exact", 1, False), 3: ("semantic", 1, False), 4: ("semantic", 1, False), 5: ("miss", None, True), 6: ("miss", None, False), 7: ("exact", 2, False)}
