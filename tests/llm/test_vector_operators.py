"""Graphs, search and near-duplicate vectors against brute force, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import embed_dedup as E
from passagework.llm import hnsw
from passagework.llm.embed_dedup import near_duplicates
from passagework.llm.neighbors import nearest
from passagework.llm.shared import Scratch

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def _arrays(vectors):
    p = vectors.toPandas()
    return p.vec_id.to_numpy(), np.stack(p.embedding).astype(np.float64), p.label.to_numpy()


def test_graph_is_flat_and_finds_neighbours(vectors):
    ids, x, _ = _arrays(vectors)
    graph = hnsw.build(x.astype(np.float32), ids)
    again = hnsw.Graph.from_bytes(graph.to_bytes())
    found, _ = hnsw.search(again, x[:200].astype(np.float32), 64)
    exact = np.argsort(((x[:200, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found.tolist(), exact.tolist())]) > 0.95
    for n in (0, 1, 2, 5):
        small = hnsw.build(x[:n].astype(np.float32), ids[:n])
        assert (hnsw.search(small, x[:3].astype(np.float32), 4)[0] >= 0).sum(1).tolist() == [min(n, 4)] * 3


ODD = [(-1, None, 1), (-2, [0.0] * 64, 1), (-3, [float("nan")] * 64, 1), (-4, [None] + [1.0] * 63, 1), (-5, [], 1),
       (-6, [1.0] * 64, None), (-7, [1.0] * 3, 1), (None, [1.0] * 64, 1)]


def test_search_recall_and_odd_vectors(spark, vectors):
    odd = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")
    table = vectors.unionByName(odd).unionByName(vectors.filter("vec_id = 100")).withColumn("_dim", F.lit("x"))
    got = nearest(table, table.filter("vec_id % 100 = 0"), shard_rows=500, queries_per_block=8).toPandas()
    ids, x, _ = _arrays(vectors.unionByName(odd.filter("vec_id = -6")))
    hits, n = 0, 0
    for q in ids[(ids % 100 == 0)]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        hits, n = hits + len(set(ids[best]) & set(mine.vec_id)), n + 10
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine.score, [d[ids == v][0] for v in mine.vec_id])
    assert hits / n >= 0.9 and not got.vec_id.isin([-1, -2, -3, -4, -5, -7]).any()
    assert nearest(table.limit(0), table.limit(0)).count() == 0


def test_search_among_many_copies(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(3000, 16)).astype(np.float32)
    ids = random.permutation(30_000)[:3000]
    copies = random.permutation(3000)[:1000]
    x[copies] = x[copies[0]]
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<float>")
    asked = np.append(ids[copies[:30]], ids[:60])
    got = nearest(table, table.filter(F.col("vec_id").isin(asked.tolist())), shard_rows=1500).toPandas()
    mine = {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")}
    wide, hits = x.astype(np.float64), 0
    for q in set(asked.tolist()):
        d = np.sqrt(((wide - wide[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        hits += len(set(best) & set(mine[q]))
        if q in ids[copies]:
            assert mine[q] == best
    assert hits / (10 * len(set(asked.tolist()))) >= 0.95


def _exact(ids, x, label):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return link.sum(1), low
        low = new


def test_near_duplicate_vectors(spark, vectors):
    copies = vectors.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 100_000)
    odd = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")
    table = vectors.unionByName(copies)
    ids, x, label = _arrays(table)
    n, low = _exact(ids, x, label)
    everything = table.unionByName(odd).unionByName(copies.limit(3)).withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in near_duplicates(everything, shard_rows=120).collect()}
    assert {i: (got[i].n_links, got[i].component_id) for i in ids.tolist()} == dict(zip(ids.tolist(), zip(n.tolist(), low.tolist())))
    assert all(got[i].n_links == 0 and got[i].kept for i in (-1, -2, -3, -4, -5, -6, -7)) and len(got) == len(ids) + 7
    assert near_duplicates(everything.limit(0)).count() == 0


def test_tight_groups_of_distinct_vectors(spark):
    random = np.random.default_rng(5)
    centers = random.normal(size=(8, 16))
    spread = np.repeat([1e-4, 1e-2, 1e-4, 1e-2, 1e-3, 1e-3, 0.06, 0.06], 300)[:, None]
    x = (np.repeat(centers, 300, axis=0) + spread * random.normal(size=(2400, 16))).astype(np.float32)
    pair = np.repeat(centers[:2], 100, axis=0) + 1e-3 * random.normal(size=(200, 16))
    x = np.vstack([x, random.normal(size=(400, 16)), pair]).astype(np.float32)
    ids, label = random.permutation(3000), np.repeat([0, 1], [2800, 200])
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), label.tolist())),
                                  "vec_id long, embedding array<float>, label int")
    n, low = _exact(ids, x.astype(np.float64), label)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table, shard_rows=5000).collect()}
    assert got == dict(zip(ids.tolist(), zip(n.tolist(), low.tolist())))


def test_pipeline_stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        new = scratch.write(stage(spark, docs, "/root/testdata/sf0.01"))
        if name != "packing":
            assert new.columns == names
            kept[name] = {r.doc_id: r.text for r in new.collect()}
        docs = new
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = kept["quality"].keys()
    assert sum(i in held for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(i in held for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    assert kept["near_duplicates"].keys() < held and kept["near_duplicates"].keys() == kept["secrets"].keys()
    assert not any("AKIA" in (t or "") for t in kept["secrets"].values())
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(kept["secrets"])


def test_pipeline_on_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (None, "word " * 30, "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            n = stage(spark, rows, "/root/testdata/sf0.01").count()
            assert n == rows.count()
        assert corpus_pipeline.good_documents(spark, rows, "/root/testdata/sf0.01").count() <= rows.count()


@pytest.mark.parametrize("size", [1e25, 1e-25, 1e200, 1e-200])
def test_components_of_any_size(spark, size):
    random = np.random.default_rng(9)
    x = random.normal(size=(60, 8)) * size
    x[30:] = x[:30] * 1.5 + 1e-3 * size * random.normal(size=(30, 8))
    kind = "float" if 1e-38 < size < 1e38 else "double"
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")
    x = np.array(table.toPandas().embedding.tolist(), np.float64)
    got = nearest(table, table.filter("vec_id < 5"), k=10).toPandas()
    unit = x / size
    for q in range(5):
        d = np.linalg.norm(unit - unit[q], axis=1)
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == np.lexsort((np.arange(60), d))[:10].tolist()
        assert np.allclose(mine.score / size, np.sort(d)[:10])
    links, low = _exact(np.arange(60), unit, np.ones(60))
    assert links.sum() > 0
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table).collect()} == {
        i: (links[i], low[i]) for i in range(60)}


def test_beams_and_audits_compare_far_fewer_pairs_than_all():
    random = np.random.default_rng(10)
    n, size, dim = 20_000, 4096, 24
    centers = random.normal(size=(n // 4, dim))
    x = np.repeat(centers, 4, axis=0) + 0.1 * random.normal(size=(n, dim))
    x = x[random.permutation(n)]
    unit = E.directions(x)
    shards = []
    for lo in range(0, n, size):
        part, ids = unit[lo:lo + size], np.arange(lo, min(n, lo + size))
        shards.append(E.Shard(ids, np.ones(len(ids), np.int64), part, E.shard_graph(part, ids)))
    found = np.zeros(n, np.int64)
    for i, a in enumerate(shards):
        for j, b in enumerate(shards[i:], i):
            ids, count, _ = E.link_shards(a, None if i == j else b, 0.93)
            np.add.at(found, ids, count)
    want = np.concatenate([(unit[lo:lo + 1000] @ unit.T >= 0.93).sum(1) - 1 for lo in range(0, n, 1000)])
    assert want.sum() > n and (found == want).mean() > 0.999 and (found <= want).all()
    assert sum(s.compared for s in shards) < n * n / 4


def test_a_graph_is_one_part():
    random = np.random.default_rng(11)
    unit = E.directions(np.repeat(random.normal(size=(8, 16)), 100, axis=0) + 1e-4 * random.normal(size=(800, 16)))
    graph = E.shard_graph(unit, np.arange(800))
    assert len(np.unique(E.parts(graph.levels[0]))) == 1
