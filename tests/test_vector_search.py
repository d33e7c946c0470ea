import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.chunking import chunk_pass
from passagework.functions.embedding import HashingEncoder, add_vectors, packed_vectors, unpacked_vectors
from passagework.operators.vector_search import (
    RECALL, _bucket, _Cell, _folded, _groups, _planes, probed_buckets, top_k_similar, top_k_similar_lsh,
)
from passagework.plans.queries import QUERIES

DIM = 16


def make(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, DIM)).astype(np.float32)
    if copies:
        v[:copies] = v[0]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")


def brute(q, c, k, t):
    q, c = q.astype(np.float64), c.astype(np.float64)
    out = {}
    for i, x in enumerate(q):
        s = np.round((1 + c @ x / np.sqrt((c * c).sum(1) * (x * x).sum())) / 2, 9)
        order = sorted((j for j in range(len(c)) if s[j] >= t), key=lambda j: (-s[j], j))[:k]
        out[i] = [(j, s[j]) for j in order]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def search(fn, q, c, **kw):
    queries = q.withColumnsRenamed({"id": "query_id", "v": "query_vector"})
    return fn(queries, c, chunk_key=["id"], chunk_vector="v", dim=DIM, **kw)


def same(got, want):
    want = {i: w for i, w in want.items() if w}
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-8)


@pytest.mark.parametrize("per_line", [8192, 7])
def test_exact_equals_brute_force_in_one_or_many_lines(spark, per_line):
    qv, q = make(spark, 60, 1)
    cv, c = make(spark, 3000, 2)
    got = search(top_k_similar, q, c, k=5, min_score=0.7, queries_per_line=per_line)
    same(collect(got), brute(qv, cv, 5, 0.7))


def test_more_queries_than_a_broadcast_holds_are_shuffled(spark):
    """Ten times the automatic broadcast threshold: queries and chunks meet by one shuffle of both, keys only."""
    bound = 100_000
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(bound))
    try:
        n = 10 * bound // (4 * DIM)
        qv, q = make(spark, n, 11)
        cv, c = make(spark, 400, 12)
        c = c.withColumn("text", F.concat(F.lit("text "), "id"))
        found = search(top_k_similar, q, c, k=2, min_score=0.8, carry=["text"], queries_per_line=2000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the hits are written before their texts are looked up, so that plan holds the lookup alone
        assert "MapInArrow" not in plan
        hits = search(top_k_similar, q, c, k=2, min_score=0.8, queries_per_line=2000)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan and "text" not in plan
        got = found.collect()
        assert all(r.text == f"text {r.id}" for r in got)
        same(collect(hits), brute(qv, cv, 2, 0.8))
        assert len(got) == hits.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_hot_copies_tie_by_key(spark):
    qv, q = make(spark, 10, 3)
    cv, c = make(spark, 3000, 4, copies=2500)
    same(collect(search(top_k_similar, q, c, k=7, min_score=0.3)), brute(qv, cv, 7, 0.3))


def test_zero_vectors_and_low_scores_are_no_hits(spark):
    q = spark.createDataFrame([(1, [0.0] * DIM), (2, [1.0] + [0.0] * (DIM - 1))], "id long, v array<float>")
    c = spark.createDataFrame([(1, [0.0] * DIM), (2, [-1.0] + [0.0] * (DIM - 1))], "id long, v array<float>")
    assert search(top_k_similar, q, c, min_score=0.1).count() == 0


def test_null_vectors_match_nothing_and_wrong_dimensions_fail(spark):
    one = [1.0] + [0.0] * (DIM - 1)
    df = spark.createDataFrame([(1, one), (2, None)], "id long, v array<float>")
    assert collect(search(top_k_similar, df, df)) == {1: [(1, 1.0)]}
    assert collect(search(top_k_similar_lsh, df, df)) == {1: [(1, 1.0)]}
    bad = spark.createDataFrame([(1, one), (2, [1.0])], "id long, v array<float>")
    with pytest.raises(Exception, match="must have 16 dimensions"):
        search(top_k_similar, df, bad).collect()


def test_empty_sides(spark):
    _, q = make(spark, 5, 1)
    assert search(top_k_similar, q.limit(0), q).count() == 0
    assert search(top_k_similar, q, q.limit(0)).count() == 0


def test_hashed_search_of_all_buckets_is_exact(spark):
    qv, q = make(spark, 50, 5)
    cv, c = make(spark, 4000, 6, copies=1500)
    full = collect(search(top_k_similar_lsh, q, c, k=5, min_score=0.75, bits=6, recall=1, queries_per_line=20))
    same(full, brute(qv, cv, 5, 0.75))


def test_fewer_buckets_for_less_recall():
    vectors = np.random.default_rng(7).standard_normal((200, 64))
    planes = _planes(64, 8)
    counts = [probed_buckets(vectors, planes, score, recall).sum(1).mean() for score, recall in
              ((0.8, 0.5), (0.8, 0.95), (0.95, 0.95), (0.8, 1))]
    assert counts[0] < counts[1] < counts[3] == 256 and counts[2] < counts[1] < 200
    home = _bucket(vectors, planes)
    assert probed_buckets(vectors, planes, 0.8, 0.01)[np.arange(200), home].all()
    assert probed_buckets(np.zeros((1, 64)), planes, 0.8, 0.95).sum() >= 0.95 * 256


def test_a_neighbour_at_the_least_score_is_found_as_often_as_stated():
    random = np.random.default_rng(8)
    planes, n = _planes(64, 8), 4000
    q = random.standard_normal((n, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    other = random.standard_normal((n, 64))
    other -= (other * q).sum(1)[:, None] * q
    other /= np.linalg.norm(other, axis=1)[:, None]
    for score in (0.65, 0.8, 0.9):
        cosine = 2 * score - 1
        near = cosine * q + np.sqrt(1 - cosine**2) * other
        found = probed_buckets(q, planes, score, RECALL)[np.arange(n), _bucket(near, planes)].mean()
        assert found > RECALL - 0.02


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_hashed_search(spark, sf):
    exact, hashed = (
        {(r.query_id, r.vec_id) for r in QUERIES[name](spark, f"/root/testdata/{sf}").collect()} for name in ("knn_dense", "knn_lsh"))
    assert len(exact & hashed) >= 0.95 * len(exact)


def test_hashing_encoder(spark):
    encoder = HashingEncoder()
    one, two, word, none = encoder(["Red red, RED blue", "blue red red red", "éé", "-- !"])
    assert (one == two).all() and one.sum() == 4 and word.sum() == 1 and none.sum() == 0
    df = spark.createDataFrame([("Red red",), (None,)], "t string")
    rows = add_vectors(df, "t", encoder, "v").collect()
    assert sorted(sum(r.v) for r in rows) == [0, 2] and len(rows[0].v) == 384


@pytest.mark.parametrize("dim", [5, 384])
def test_packed_vectors_are_the_vectors(dim):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((40, dim)).astype(np.float32)
    rows[::2] *= rng.random((20, dim)) < 0.05
    rows[4], rows[6, 0] = 0, -0.0
    packed = packed_vectors(rows)
    assert unpacked_vectors(packed, dim).tobytes() == rows.tobytes()
    assert unpacked_vectors(packed.slice(3, 9), dim).tobytes() == rows[3:12].tobytes()
    assert unpacked_vectors(packed.slice(0, 0), dim).shape == (0, dim)
    assert all(len(p) <= 4 * dim for p in packed.to_pylist())
    with pytest.raises(ValueError):
        unpacked_vectors(packed, dim - 1)


def test_few_queries_shuffle_no_chunk(spark):
    qv, q = make(spark, 60, 1)
    cv, c = make(spark, 3000, 2)
    hits = search(top_k_similar, q, c, k=5, min_score=0.7)
    # the only exchange is that of the hits, above the search
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow"):]
    same(collect(hits), brute(qv, cv, 5, 0.7))
    hashed = search(top_k_similar_lsh, q, c, k=5, min_score=0.7, bits=6, recall=1)
    same(collect(hashed), brute(qv, cv, 5, 0.7))


def test_chunks_are_scored_in_the_task_that_makes_them(spark):
    encoder = HashingEncoder()
    words = "red blue green white black grey".split()
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 4 + i % 90)) for i in range(200)] + ["", None, "!?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(0, "red blue"), (1, "green grey black"), (2, "none of them"), (3, "...")], "query_id long, text string")
    asked = add_vectors(asked, "text", encoder, "query_vector", packed=True)
    made = chunk_pass(docs, "text", out_col="part", keep=["id"], encoder=encoder, pack=packed_vectors)

    def found(chunks):
        return top_k_similar(asked, chunks, chunk_key=["id", "chunk_no"], carry=["part"], dim=encoder.dim)

    def all_of(df):
        return sorted(tuple(r) for r in df.select("query_id", "rank", "score", "id", "chunk_no", "part").collect())

    want = all_of(found(made.rows()))
    assert len(want) > 8 and all_of(found(made)) == want
    hits = top_k_similar(asked, made, chunk_key=["id", "chunk_no"], dim=encoder.dim)
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert all_of(found(made)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sparse(n, seed, dim=384, words=20, signs=False, kinds=3):
    """Counts of words as texts of some languages have them; a few rows are zero, and some are copies."""
    rng = np.random.default_rng(seed)
    common = np.random.default_rng(0).permutation(dim).reshape(kinds, -1)
    v, kind = np.zeros((n, dim), np.float32), rng.integers(kinds, size=n)
    for i in range(n):
        at = np.minimum(rng.zipf(1.3, words), 4 * common.shape[1]) - 1
        places = np.where(at < common.shape[1], common[kind[i], at % common.shape[1]], at % dim)
        np.add.at(v[i], places, rng.choice([1, -1], words) if signs else 1)
    v[::97] = 0
    v[1:n:50] = v[1]
    return v


def stored(spark, v):
    rows = [(i, bytes(x)) for i, x in enumerate(packed_vectors(v).to_pylist())]
    return spark.createDataFrame(rows, "id long, v binary")


def cell_of(q, c, k, min_score, at_once=2500):
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("id", T.LongType())])
    cell = _Cell(schema, ["id"], q.shape[1], k, min_score, hashed=False)
    cell.held = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), packed_vectors(q)], names=["_query", "_vector"])]
    for lo in range(0, len(c), at_once):
        part = c[lo:lo + at_once]
        cell.stream(pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), packed_vectors(part)], names=["id", "_vector"]))
    found = {}
    for batch in cell.finish():
        for row in sorted(batch.to_pylist(), key=lambda r: (r["query_id"], -r["score"], r["id"])):
            found.setdefault(row["query_id"], []).append((row["id"], row["score"]))
    return cell, found


def nearest(q, c, k, min_score):
    """``brute`` for many queries: products of whole numbers are exact."""
    q, c, out = q.astype(np.float64), c.astype(np.float64), {}
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.round((1 + q @ c.T / np.sqrt(np.outer((q * q).sum(1), (c * c).sum(1)))) / 2, 9)
    for i, s in enumerate(scores):
        at = np.flatnonzero(s >= min_score)
        out[i] = [(int(j), s[j]) for j in at[np.lexsort((at, -s[at]))][:k]]
    return out


@pytest.mark.parametrize("signs, min_score", [(False, 0.8), (True, 0.8), (False, 0.45)])
def test_vectors_with_few_components_are_compared_by_shorter_ones(signs, min_score):
    """Most pairs are left out by products of fewer components, of counts by fewer than half, and no hit is lost."""
    q, c = sparse(4500, 1, signs=signs), sparse(3200, 2, signs=signs)
    cell, found = cell_of(q, c, 5, min_score)
    if min_score == 0.8:
        products = [384 if g is None else g.shape[1] for g in cell.groups.values()]
        assert len(products) > 1 and np.mean(products) < (384 if signs else 384 / 2)
    same(found, nearest(q, c, 5, min_score))


def test_dense_vectors_are_compared_in_full():
    rng = np.random.default_rng(3)
    q, c = rng.standard_normal((4500, 64)).astype(np.float32), rng.standard_normal((2500, 64)).astype(np.float32)
    cell, found = cell_of(q, c, 5, 0.65)
    assert {*cell.groups.values()} == {None}
    same(found, brute(q, c, 5, 0.65))


def test_products_of_shorter_vectors_are_never_below():
    rng = np.random.default_rng(4)
    q, c = ((x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32) for x in rng.standard_normal((2, 300, 96)))
    for parts in (8, 24, 48):
        groups = _groups(np.abs(q).mean(0), np.abs(c).mean(0), parts)
        assert (groups.sum(1) == 1).all() and (groups.sum(0) > 0).all()
        assert (_folded(q, groups) @ _folded(c, groups).T >= q @ c.T - 1e-5).all()


@pytest.mark.parametrize("bound", ["1k", "64m"])
def test_sparse_search_in_cells_and_in_place_equals_brute_force(spark, bound):
    """More queries than one direction takes, with copies on both sides, zero vectors and a hashed search of all buckets."""
    q, c = sparse(4200, 5, words=12), sparse(1500, 6, words=12)
    want = nearest(q, c, 3, 0.8)
    queries, chunks = stored(spark, q).withColumnsRenamed({"id": "query_id", "v": "query_vector"}), stored(spark, c)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        options = dict(chunk_key=["id"], chunk_vector="v", dim=384, k=3, min_score=0.8)
        found = top_k_similar(queries, chunks, **options)
        # packed vectors travel as they are, not in a struct with the other forms
        assert "wide" not in found._jdf.queryExecution().optimizedPlan().toString()
        same(collect(found), want)
        same(collect(top_k_similar_lsh(queries, chunks, bits=2, recall=1, **options)), want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
