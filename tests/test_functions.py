"""Text, scalar and chunking functions."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import chunking, scalars, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize("value, want", [("Quartz, the DB_2 a! é1", ["quartz", "the", "db_2"]), ("", []), ("Étion", ["tion"])])
def test_tokens(spark, value, want):
    assert one(spark, text.tokens(F.col("t")), t=value) == want


def test_names(spark):
    assert one(spark, text.entity_name(F.col("t")), t="  Ada  \t Lovelace ") == "Ada Lovelace"
    assert one(spark, text.project_name(F.col("t")), t=" My  PROJECT ") == "my project"
    assert one(spark, text.project_name(F.col("t"), exact=True), t="Straße") == "strasse"
    assert one(spark, text.project_terms(F.col("t")), t="a-b_c  d") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("query, name, aliases, want", [("store", "store", [], 0), ("shop", "store", ["shop"], 1), ("sto", "store", [], 2), ("dash store", "store-dashboard", [], 3), ("das store", "store-dashboard", [], None), ("x", "store", ["y"], None)])
def test_rank(spark, query, name, aliases, want):
    cols = F.col("a").cast("array<string>")
    assert one(spark, text.candidate_rank(F.col("q"), F.col("n"), cols), q=query, n=name, a=aliases) == want


def test_uuid5(spark):
    for t in ("https://example.org/a", "é", ""):
        assert one(spark, text.uuid5(F.col("t")), t=t) == str(uuid.uuid5(uuid.NAMESPACE_URL, t))
    own = str(uuid.uuid4())
    assert one(spark, text.session_uuid(F.col("t")), t=own.upper()) == own
    assert one(spark, text.session_uuid(F.col("t")), t="s1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "agno-session:s1"))


def test_event_key(spark):
    assert one(spark, text.event_key(F.col("r"), F.lit("m:0")), r="7") == "agno:7:m:0"
    assert one(spark, text.event_key(F.lit(None).cast("string"), F.col("r")), r="7") is None


def test_replies(spark):
    assert one(spark, text.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.json_object(F.col("t")), t='<think>{"x":0}</think> so {bad} {"a": {"b": [1]}} end') == '{"a": {"b": [1]}}'
    assert one(spark, text.json_object(F.col("t")), t="none") is None
    assert one(spark, text.redact(F.col("t")), t='{"API_KEY": "s", "x": [{"my_token": 1, "y": 2}]}') == '{"API_KEY": "[redacted]", "x": [{"my_token": "[redacted]", "y": 2}]}'


@pytest.mark.parametrize("value, want", [("Error 429", True), ("Bad Gateway", True), ("404 from NIM", True), ("404", False), ("fine", False)])
def test_overload(spark, value, want):
    assert one(spark, text.is_overload(F.col("t")), t=value) is want


def test_keys_and_headings(spark):
    assert one(spark, text.issue_key(F.col("t")), t=" scrum 80 ") == "SCRUM-80"
    assert one(spark, text.find_issue_key(F.col("t")), t="see scrum-80 now") == "SCRUM-80"
    assert one(spark, text.find_issue_key(F.col("t")), t="none") is None
    assert one(spark, text.heading(F.col("t")), t="  ## Retrieval ##") == "Retrieval"
    assert one(spark, text.heading(F.col("t")), t="#x") is None
    assert one(spark, text.serialized(F.col("t")), t=" \n a ") == "a"
    assert one(spark, text.serialized(F.col("t")), t=" ") is None


def test_elapsed_counts_the_bound_as_idle(spark):
    at = dt.datetime(2024, 1, 1, 12, 0)
    gap = lambda m, s=0: one(spark, scalars.elapsed(F.lit(at), F.col("t"), 15), t=at - dt.timedelta(minutes=m, seconds=s))
    assert (gap(15), gap(14, 59), gap(16)) == (True, False, True)
    assert one(spark, scalars.elapsed(F.lit(at), F.lit(None).cast("timestamp"), 15), t=1) is False


def test_vectors(spark):
    assert one(spark, scalars.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)
    assert one(spark, scalars.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert one(spark, scalars.keyword_score(F.col("a"), F.col("b"), F.lit(3.0)), a=["x", "y"], b=["x"]) == pytest.approx(0.6)


def test_embed_chunks():
    chunks = chunking.embed_chunks("word " * 30, 40)
    assert len(chunks) > 1 and all(len(c) <= 40 for c in chunks)
    fence = "```\n" + "code line\n" * 10 + "```"
    chunks = chunking.embed_chunks("intro text here\n\n" + fence + "\n\noutro", 40)
    assert fence in chunks and chunks[0] == "intro text here" and chunks[-1] == "outro"
    assert chunking.embed_chunks("# A\npara one\n\npara two", 14) == ["# A\n\npara one", "para two"]
    assert chunking.embed_chunks(" ", 10, "crumb") == ["crumb"] and chunking.embed_chunks("", 10) == [""]
    assert chunking.embed_chunks("abc", 20, "crumb") == ["crumb\n\nabc"]
    assert chunking.embed_chunks("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    for bad in ((0, ""), (7, "crumb")):
        with pytest.raises(ValueError):
            chunking.embed_chunks("text", *bad)


def test_document_chunks():
    doc = "# Architecture\n\nLayers.\n\n# Retrieval\n\nHybrid."
    assert [c[:3] for c in chunking.document_chunks(doc, 4000)] == [("Architecture", 1, 3), ("Retrieval", 5, 7)]
    assert chunking.document_chunks("", 10) == []
    assert chunking.document_chunks("a\nb\n\nc", 100) == [("Document", 1, 4, "a\nb\n\nc")]
    assert chunking.document_chunks("a\nb\n\nc", 4) == [("Document", 1, 2, "a\nb"), ("Document", 4, 4, "c")]
    assert chunking.document_chunks("aaa\nbbb\n" + "c" * 9 + "\nd", 7) == [("Document", 1, 2, "aaa\nbbb"), ("Document", 3, 3, "c" * 7), ("Document", 3, 3, "cc"), ("Document", 4, 4, "d")]


def test_chunk_columns(spark):
    df = spark.createDataFrame([("a\n\nb",), (None,)], "t string")
    rows = df.select(chunking.markdown_chunks(F.col("t")).alias("m"), chunking.embedding_chunks(F.col("t")).alias("e")).collect()
    assert rows[0].e == ["a\n\nb"] and rows[0].m[0].content == "a\n\nb" and rows[1].e is None and rows[1].m is None


def test_markdown_chunks_hold_few_documents_as_objects(spark):
    """Any number of texts in a batch, null and empty ones between, gives the same chunks from small slices."""
    import pyarrow as pa

    texts = [None if k % 11 == 3 else "" if k % 7 == 2 else "\n\n".join(f"# H{j}\ntext {k} {'x' * (k % 50)}" for j in range(k % 5 + 1)) for k in range(200)]
    got = chunking.markdown_chunks(F.col("t"), 40)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", got.alias("c")).collect()
    want = {k: None if t is None else chunking.document_chunks(t, 40) for k, t in enumerate(texts)}
    assert {r.k: None if r.c is None else [tuple(c) for c in r.c] for r in rows} == want
    assert pa.types.is_list(chunking._chunk_columns([None, "a"], 9).type) and len(chunking._chunk_columns([], 9)) == 0 and chunking.CHUNK_ROWS < 200
