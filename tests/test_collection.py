import os
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.embedding import add_vectors, packed_vectors, unpacked_column
from passagework.operators.vector_search import _planes, probed_buckets, search_buckets
from passagework.plans import ingest as I
from passagework.plans.collection import Collection, list_collections
from passagework.schemas import CHUNK_KEY
from passagework.sources import files as S
from passagework.streaming.ingest import file_stream, progress, start_ingest
from passagework.streaming.prompts import start_prompts
from tests.test_sources import LOADERS, site

DATE = 1_700_000_000_000


@pytest.fixture()
def folder(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("red blue green " * 40)
    (src / "b.pdf").write_bytes(b"%PDFfirst page words\fsecond page words")
    (src / "c.bin").write_bytes(b"\x00\x01")
    (src / "none.pdf").write_bytes(b"%PDF")
    return src


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of_all(collection):
    return [tuple(r) for r in collection.rows().collect()]


def test_life_of_a_collection(spark, tmp_path, folder):
    root = str(tmp_path / "root")
    assert list_collections(spark, root).count() == 0
    c = Collection(spark, root, "notes").create()
    assert c.create().exists() and c.documents().count() == 0 and c.list_documents().count() == 0
    counts = c.ingest_folder(str(folder), LOADERS, "1", DATE)
    chunks = c.chunks().count()
    assert counts == {"chunks": chunks, "pages": 3, "binaries": 2, "documents": 3, "rejected": 1}
    listed = {os.path.basename(r.source): r for r in c.list_documents().collect()}
    assert listed["b.pdf"].page_count == 2 and listed["b.pdf"].vector_count == 2 and listed["b.pdf"]["index"] == "notes.pdf"
    # a document without pages is kept, without binary
    assert listed["none.pdf"].page_count == 0 and listed["none.pdf"].vector_count == 0
    b = listed["b.pdf"]
    got = c.fetch_binary("pdf", b.doc_id).first()
    assert bytes(got.data) == (folder / "b.pdf").read_bytes() and got.media_type == "application/pdf"
    assert c.fetch_binary("pdf", listed["none.pdf"].doc_id).count() == 0
    assert c.fetch_binary("plaintext", listed["a.txt"].doc_id).first().media_type == "text/plain"
    assert c.list_documents(limit=1).count() == 1
    assert not os.listdir(f"{c.path}/_staging")
    assert [(os.path.basename(r.source), r.reason) for r in c.rejected().collect()] == [("c.bin", "no loader takes such a file")]

    # the same source again is another document; the same batch again is not
    c.ingest_folder(str(folder), LOADERS, "2", DATE + 1)
    c.ingest_folder(str(folder), LOADERS, "2", DATE + 1)
    assert c.documents().count() == 6 and c.chunks().count() == 2 * chunks

    keys = spark.createDataFrame([("pdf", b.doc_id), ("pdf", "unknown")], "type string, doc_id string")
    assert rows(c.delete_documents(keys).select("doc_id", "removed")) == [(b.doc_id, 2 + 2 + 1 + 1)]
    assert c.documents().count() == 5 and c.pages().count() == 4 and c.binaries().count() == 3
    assert rows(c.delete_documents(keys)) == []
    assert c.chunks().filter(F.col("doc_id") == b.doc_id).count() == 0

    other = c.copy_to("copied")
    assert rows(other.documents()) == rows(c.documents()) and other.rows().count() == c.rows().count()
    assert {r.collection for r in list_collections(spark, root).collect()} == {"notes", "copied"}
    assert other.drop() and not other.drop()
    assert {r.collection for r in list_collections(spark, root).collect()} == {"notes"}
    with pytest.raises(ValueError):
        Collection(spark, root, "Notes")


def test_uncommitted_batch_is_not_seen(spark, tmp_path, folder):
    c = Collection(spark, str(tmp_path / "root"), "c").create()
    c.ingest_folder(str(folder), LOADERS, "1", DATE)
    parsed = S.loaded(S.load_files(S.scan_files(spark, str(folder)), LOADERS, "c", DATE + 9))
    c._save(I.pages_of(parsed), "pages", "broken", "1")
    assert c.pages().count() == 3


def test_a_failed_rewrite_leaves_the_batch_as_it_was(spark, tmp_path, folder):
    class Failing(type(I.DEFAULT_ENCODER)):
        def __call__(self, texts):
            raise RuntimeError("no vectors")

    root = str(tmp_path / "root")
    c = Collection(spark, root, "c")
    c.ingest_folder(str(folder), LOADERS, "1", DATE)
    before = sorted(map(repr, rows_of_all(c)))
    with pytest.raises(Exception, match="no vectors"):
        Collection(spark, root, "c", Failing()).ingest_folder(str(folder), LOADERS, "1", DATE)
    assert sorted(map(repr, rows_of_all(c))) == before and not os.listdir(f"{c.path}/_staging")
    (folder / "a.txt").write_text("other words")
    c.ingest_folder(str(folder), LOADERS, "1", DATE)
    assert c.batches() == ["1"] and [r.text for r in c.chunks().filter("type = 'plaintext'").collect()] == ["other words"]
    assert {r.attempt for r in c._live().collect()} <= set(os.listdir(f"{c.path}/documents/batch=1")[0].split("=")[1:])


def test_equal_sources_in_a_batch_are_documents_of_their_own(spark, tmp_path, folder):
    c = Collection(spark, str(tmp_path / "root"), "c")
    files = S.scan_files(spark, str(folder)).withColumn("time", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    files = files.withColumn("content", F.when((F.col("time") == 3) & F.col("path").endswith("a.txt"), F.lit("else").cast("binary"))
                             .otherwise(F.col("content"))).drop("time")
    c.ingest_files(files, LOADERS, "1", DATE)
    ids = {r.doc_id for r in c.documents().collect()}
    assert c.documents().count() == 9 == len(ids) and c.pages().count() == 9
    assert c.chunks().filter("text = 'else'").count() == 1
    # the same batch again gives the same ids
    c.ingest_files(files.orderBy(F.rand()), LOADERS, "1", DATE)
    assert {r.doc_id for r in c.documents().collect()} == ids
    alone = Collection(spark, str(tmp_path / "root"), "c2")
    alone.name = "c"
    alone.ingest_folder(str(folder), LOADERS, "1", DATE)
    assert {r.doc_id for r in alone.documents().collect()} <= ids
    c.ingest_web(site(spark).withColumn("time", F.explode(F.array(F.lit(1), F.lit(2)))).drop("time"), "w", ingest_date=DATE)
    web = c.list_documents().filter("type = 'web'")
    assert web.count() == 14 and web.select("doc_id").distinct().count() == 14 and web.select("source").distinct().count() == 7
    with pytest.raises(ValueError):
        c.ingest_files(files, LOADERS, "a/b", DATE)


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def test_a_delete_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "c")
    texts = spark.createDataFrame([(f"/d/{i}.txt", bytearray(f"word{i} and more words".encode())) for i in range(120)],
                                  "path string, content binary")
    c.ingest_files(texts, [S.text_loader()], "1", DATE)
    docs = {r.source: r.doc_id for r in c.documents().collect()}
    gone = docs["/d/7.txt"]
    before = {t: _files(f"{c.path}/{t}") for t in ("documents", "pages", "chunks", "binaries", "vectors")}
    keys = spark.createDataFrame([("plaintext", gone)], "type string, doc_id string")
    assert rows(c.delete_documents(keys).select("doc_id", "removed")) == [(gone, 4)]
    for table, files in before.items():
        after = _files(f"{c.path}/{table}")
        kept = {f for f in files if table == "vectors" or f"part={gone[0]}" not in f}
        touched = {os.path.dirname(f) for f in files.keys() ^ after.keys()}
        assert len(touched) == 1, table
        assert all(after.get(f) == files[f] for f in kept if os.path.dirname(f) not in touched)
        assert c.table(table).filter(F.col("doc_id") == gone).count() == 0 and c.table(table).count() == 119
    for table in (c.chunks(), c.documents(), c.vectors()):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" not in plan and "Exchange hashpartitioning(doc_id" not in plan
    # everything of a partition goes
    rest = c.documents().filter(F.col("doc_id").startswith(gone[0])).select("type", "doc_id")
    n = rest.count()
    assert c.delete_documents(rest).count() == n and c.documents().count() == 119 - n
    assert not any(f"part={gone[0]}" in f for f in _files(f"{c.path}/documents"))
    assert c.delete_documents(keys).count() == 0


def test_pages_of_the_listing_make_the_whole(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "c")
    texts = spark.createDataFrame([(f"/d/{i % 7}.txt", bytearray(f"text {i}".encode())) for i in range(23)], "path string, content binary")
    c.ingest_files(texts, [S.text_loader()], "1", DATE)
    whole = sorted((r.source, r.doc_id, r.page_count, r.vector_count) for r in c.list_documents().collect())
    seen, after = [], None
    while page := sorted((r.source, r.doc_id, r.page_count, r.vector_count) for r in c.list_documents(limit=5, after=after).collect()):
        seen, after = seen + page, page[-1][:2]
    assert seen == whole and len(whole) == 23


def test_hashed_search_of_a_stored_index(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "c")
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.concat(F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    c.ingest_files(texts, [S.text_loader()], "1", DATE)
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("user_input"))

    def hits(found):
        return {(r.query_id, s.page_metadata.doc_id) for r in found.collect() for s in r.sources}

    exact = hits(c.search(asked))
    assert len(exact & hits(c.search(asked, hashed=True))) >= 0.95 * len(exact)
    assert hits(c.search(asked, hashed=True, recall=1)) == exact
    one = asked.filter("query_id = 3")
    vectors = add_vectors(one, "user_input", c.encoder, "query_vector")
    found = search_buckets(vectors, c.table("vectors"), chunk_key=CHUNK_KEY, dim=c.encoder.dim, bits=c.bits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN|INSET)", plan)
    probed = {r["bucket"] for r in c.table("vectors").filter(F.col("bucket").isin(_probed(c, one))).select("bucket").distinct().collect()}
    held = {r["bucket"] for r in c.table("vectors").select("bucket").distinct().collect()}
    assert probed < held and len(probed) < 0.8 * len(held)


def _probed(c, asked):
    vector = c.encoder([asked.first().user_input])
    return np.flatnonzero(probed_buckets(vector, _planes(c.encoder.dim, c.bits), 0.8, 0.95)[0]).tolist()


def test_vectors_are_stored_packed_and_read_as_arrays(spark, tmp_path, folder):
    c = Collection(spark, str(tmp_path / "root"), "c")
    c.ingest_folder(str(folder), LOADERS, "1", DATE)
    stored = spark.read.parquet(f"{c.path}/chunks").select("text", "document_vector")
    assert stored.schema["document_vector"].dataType == T.BinaryType()
    assert all(len(r.document_vector) < 4 * c.encoder.dim for r in stored.collect())
    for chunks in (c.chunks(), c.copy_to("copied").chunks()):
        assert chunks.schema["document_vector"].dataType == T.ArrayType(T.FloatType())
        got = chunks.select("text", "document_vector").collect()
        assert len(got) > 3 and all(r.document_vector == c.encoder([r.text])[0].tolist() for r in got)
        # counting reads no vectors and starts no Python
        plan = chunks.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "document_vector" not in plan
    some = spark.createDataFrame([(1, None), (2, bytearray(packed_vectors(np.eye(2, 384))[1].as_py()))], "n int, v binary")
    read = {r.n: r.v for r in some.select("n", unpacked_column(F.col("v"), 384).alias("v")).collect()}
    assert read[1] is None and read[2] == np.eye(2, 384)[1].tolist()


def test_a_batch_keeps_its_time(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "c")
    assert c.batch_time("files-0") == c.batch_time("files-0") > DATE


def test_absent_roots_keep_their_document(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "c")
    roots = spark.createDataFrame([("http://s.example/",), ("http://absent.example/",)], "url string")
    c.ingest_web(site(spark), "w", roots, ingest_date=DATE)
    assert rows(c.list_documents().select("source", "page_count")) == [("http://absent.example/", 0), ("http://s.example/", 5)]


def test_loaders_may_add_fields(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "talk.srt").write_bytes(b"anna:hello there\nbob:good day")
    (src / "a.txt").write_text("plain")
    fields = T.StructType([T.StructField("speaker", T.StringType())])

    def read_turns(data):
        return [dict(zip(("speaker", "content"), line.split(":"))) for line in data.decode().splitlines()]

    talk = replace(S.paged_loader("talk", ".srt", "text/srt", read_turns, fields),
                   extra={"folder": lambda path: F.regexp_extract(path, "([^/]+)/[^/]+$", 1)})
    c = Collection(spark, str(tmp_path / "root"), "c", document_fields=T.StructType([T.StructField("folder", T.StringType())]),
                   page_fields=fields)
    c.ingest_folder(str(src), [talk, S.text_loader()], "1", DATE)
    assert rows(c.pages().select("type", "page", "speaker").fillna("-").fillna(0)) == [
        ("plaintext", 0, "-"), ("talk", 1, "anna"), ("talk", 2, "bob")]
    assert rows(c.documents().select("type", "folder", "extension").fillna("-")) == [
        ("plaintext", "-", ".txt"), ("talk", "src", "-")]
    assert rows(c.chunks().select("text")) == [("good day",), ("hello there",), ("plain",)]


def test_web_ingest(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "root"), "web")
    roots = spark.createDataFrame([("http://s.example/",), ("",)], "url string")
    counts = c.ingest_web(site(spark), "w", roots, ingest_date=DATE)
    assert counts["documents"] == 1 and counts["pages"] == 5 and counts["binaries"] == 0
    assert c.list_documents().first().page_count == 5
    c.ingest_web(site(spark), "all", ingest_date=DATE + 1)
    assert c.documents().count() == 1 + 7
    done = I.progress_of(c.pages().filter(F.col("doc_id") == c.documents().filter(f"ingest_date = {DATE}").first().doc_id))
    assert rows(done.select("done", "total")) == [(i, 5) for i in range(1, 6)]


def test_stream_equals_batch_and_replays_nothing(spark, tmp_path, folder):
    c = Collection(spark, str(tmp_path / "root"), "stream").create()
    seen = []

    def run():
        q = start_ingest(file_stream(spark, str(folder)), c, LOADERS, str(tmp_path / "ckpt"), on_batch=lambda b, n: seen.append((b, n)))
        assert q.awaitTermination(300)
        return progress(q)

    assert run()["rows"] == 4
    (folder / "d.txt").write_text("a new file")
    assert run()["rows"] == 1
    assert run()["rows"] == 0
    assert [n["documents"] for _, n in seen] == [3, 1] and [n["rejected"] for _, n in seen] == [1, 0]
    batch = Collection(spark, str(tmp_path / "root"), "batch")
    batch.ingest_folder(str(folder), LOADERS, "1", DATE)
    cols = ["type", "page_no", "chunk_no", "text", "document_vector"]
    assert rows(c.chunks().select(cols)) == rows(batch.chunks().select(cols))
    assert rows(c.documents().select("source", "type", "filename")) == rows(batch.documents().select("source", "type", "filename"))


def test_stream_of_prompts(spark, tmp_path, folder):
    c = Collection(spark, str(tmp_path / "root"), "c")
    c.ingest_folder(str(folder), LOADERS, "1", DATE)
    schema = "query_id string, user_input string, task string, persona string, enhancers array<string>, source_file string"
    drop = str(tmp_path / "in")
    ask = [("q1", "red blue green", "fact", None, [], None), ("q2", "nothing alike", "fact", None, [], None)]
    spark.createDataFrame(ask, schema).coalesce(1).write.parquet(drop)
    templates = spark.createDataFrame([("task", "fact", "TASK")], "kind string, name string, prompt string")
    q = start_prompts(spark.readStream.schema(schema).parquet(drop), c, templates, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(300)
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["q1"].source_count == 4 and got["q1"].prompt.startswith("TASK\n\nContext: ")
    assert got["q2"].source_count == 0 and got["q2"].prompt is None
