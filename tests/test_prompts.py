import os
import uuid

import itertools

from pyspark.sql import functions as F

from passagework.config import NO_SOURCES_MESSAGE
from passagework.operators import retrieval as R
from passagework.operators.generate import generate
from passagework.operators.prompts import attach_templates, prepare_prompt
from passagework.operators.vector_search import top_k_similar_lsh
from passagework.plans import search as S

TEMPLATES = [
    ("task", "fact", "hi", "TASK"), ("task", "locate", "hi", None), ("persona", "terse", None, "TERSE"),
    ("enhancer", "one", None, "E1"), ("enhancer", "two", None, "E2"),
]
REQUEST = "query_id int, user_input string, task string, persona string, enhancers array<string>, source_file string"


def templates(spark):
    return spark.createDataFrame(TEMPLATES, "kind string, name string, greeting string, prompt string")


GOLDEN = {
    (0, 0, 0): "TASK\n\nContext: C\n\nUser input: U",
    (0, 0, 1): "TASK\n\nContext: C\n\nUser input: U\n\nSource file: F",
    (0, 1, 0): "TASK\n\nE1\n\nContext: C\n\nUser input: U",
    (0, 1, 1): "TASK\n\nE1\n\nContext: C\n\nUser input: U\n\nSource file: F",
    (0, 2, 0): "TASK\n\nE2\n\nE1\n\nContext: C\n\nUser input: U",
    (0, 2, 1): "TASK\n\nE2\n\nE1\n\nContext: C\n\nUser input: U\n\nSource file: F",
    (1, 0, 0): "TERSE\n\nTASK\n\nContext: C\n\nUser input: U",
    (1, 0, 1): "TERSE\n\nTASK\n\nContext: C\n\nUser input: U\n\nSource file: F",
    (1, 1, 0): "TERSE\n\nTASK\n\nE1\n\nContext: C\n\nUser input: U",
    (1, 1, 1): "TERSE\n\nTASK\n\nE1\n\nContext: C\n\nUser input: U\n\nSource file: F",
    (1, 2, 0): "TERSE\n\nTASK\n\nE2\n\nE1\n\nContext: C\n\nUser input: U",
    (1, 2, 1): "TERSE\n\nTASK\n\nE2\n\nE1\n\nContext: C\n\nUser input: U\n\nSource file: F",
}


def test_golden_prompts(spark):
    cases = list(itertools.product((0, 1), (0, 1, 2), (0, 1)))
    rows = [(i, "U", "fact", "terse" if p else "None", ["two", "one"][2 - e:], "F" if f else "")
            for i, (p, e, f) in enumerate(cases)]
    asked = attach_templates(spark.createDataFrame(rows, REQUEST), templates(spark))
    prompt = prepare_prompt(F.lit("C"), F.col("task_prompt"), F.col("user_input"), F.col("persona_prompt"),
                            F.col("enhancer_prompts"), F.col("source_file"))
    got = {cases[r.query_id]: r.prompt for r in asked.select("query_id", prompt.alias("prompt")).collect()}
    assert got == GOLDEN


def test_missing_templates_are_named(spark):
    rows = [(1, "U", "nope", "terse", ["one"], None), (2, "U", "locate", "rude", ["x", "one"], None), (3, "U", "locate", None, None, None)]
    got = {r.query_id: sorted(r.missing_templates) for r in attach_templates(spark.createDataFrame(rows, REQUEST), templates(spark)).collect()}
    assert got == {1: ["nope"], 2: ["rude", "x"], 3: []}


def corpus(spark):
    docs = spark.createDataFrame([("web", "d1", "http://top", 5, None, None, None), ("plaintext", "d2", "/a.txt", 5, "a.txt", None, ".txt")],
                                 "type string, doc_id string, source string, ingest_date long, filename string, media_type string, extension string")
    pages = spark.createDataFrame(
        [("d1/0", "d1", "web", 0, None, "T", "en", "http://top/x"), ("d2/0", "d2", "plaintext", 0, None, None, None, None)],
        "page_id string, doc_id string, type string, page_no long, page long, title string, language string, source string")
    texts = [("d1/0", "d1", "web", 0, 0, "red blue green"), ("d1/0", "d1", "web", 0, 1, "red blue green"),
             ("d2/0", "d2", "plaintext", 0, 0, "red blue"), ("d2/0", "d2", "plaintext", 0, 1, "other words")]
    raw = spark.createDataFrame(texts, "page_id string, doc_id string, type string, page_no long, chunk_no long, text string")
    from passagework.functions.embedding import add_vectors
    return docs, pages, add_vectors(raw, "text", S.DEFAULT_ENCODER)


def test_search_and_answer(spark):
    docs, pages, chunks = corpus(spark)
    rows = [(1, "green red blue", "fact", None, [], None), (2, "zzz", "fact", None, [], None), (3, "blue red", "locate", None, [], None)]
    queries = spark.createDataFrame(rows, REQUEST)
    found = S.retrieve(queries, chunks, pages, docs)
    got = {r.query_id: r for r in S.rag_prompts(queries, found, templates(spark), "c").collect()}
    web = 'Web page: <http://top/x>{target="_blank"} scraped 5 from parent URL <http://top>{target="_blank"}\n\n'
    text = '.txt file [a.txt](</files/c/plaintext/d2>){target="_blank"}\n\n'
    assert got[1].answer == S.SOURCES_HEADING + web + web + text  # one page cited per hit, duplicates kept
    assert got[1].context == "red blue green\nred blue green\nred blue"
    assert got[1].prompt == "TASK\n\nContext: " + got[1].context + "\n\nUser input: green red blue"
    assert got[2].answer == NO_SOURCES_MESSAGE and got[2].prompt is None and got[2].source_count == 0
    assert got[3].prompt is None and got[3].answer.startswith(S.SOURCES_HEADING + text)
    empty = S.rag_prompts(queries, found, templates(spark), "c", on_empty="prompt").filter("query_id = 2").first()
    assert empty.prompt == "TASK\n\nContext: \n\nUser input: zzz"

    def make_client():
        return lambda prompt: (200, "made: " + prompt[-3:]) if "green" in prompt[:40] else (503, "busy")

    done = {r.query_id: r for r in S.answers(S.rag_prompts(queries, found, templates(spark), "c", on_empty="prompt"), make_client).collect()}
    assert done[1].response == "made: lue" and done[1].answer.endswith("\n\nmade: lue") and done[1].status == 200
    assert done[2].response == "ollama status: 503" and done[3].response is None


def test_limit_threshold_and_orphans(spark):
    docs, pages, chunks = corpus(spark)
    q = spark.createDataFrame([(1, "red blue green")], "query_id int, user_input string")
    hits = S.semantic_search(q, chunks, k=1)
    assert [(r.doc_id, r.chunk_no, r.score) for r in hits.collect()] == [("d1", 0, 1.0)]
    assert S.semantic_search(q, chunks, min_score=0.0).count() == 4
    assert R.distinct_hit_pages(S.semantic_search(q, chunks)).count() == 2
    assert [tuple(r) for r in R.orphan_chunks(chunks, pages.filter("type = 'web'")).collect()] == [("plaintext", "d2/0", 2)]
    unbounded = R.hits_with_pages(S.semantic_search(q, chunks), pages)
    assert unbounded.count() == 3


def test_search_kinds_agree(spark):
    _, _, chunks = corpus(spark)
    rows = [(i, t) for i, t in enumerate(["red", "blue green", "red blue green", "other", "", "words red"])]
    q = spark.createDataFrame(rows, "query_id int, user_input string")

    def run(**options):
        return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_no, r.score) for r in S.semantic_search(q, chunks, min_score=0.6, **options).collect())

    exact = run()
    assert exact and exact == run(search=top_k_similar_lsh, bits=4, recall=1)
    assert exact == run(queries_per_line=1)


def test_generate_calls_each_prompt_once_in_order(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("p"), "id")).alias("prompt"))
    got = generate(df, lambda: lambda p: (200, p.upper()), rows_per_call=7).collect()
    assert all(r.response == (None if r.id % 10 == 0 else f"P{r.id}") for r in got) and len(got) == 500


def test_answers_are_kept_and_no_prompt_is_sent_twice(spark, tmp_path):
    from passagework.operators.generate import CLIENT_ERROR, generate_once

    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    os.mkdir(log)

    def client_that(fails):
        def make():
            def call(prompt):
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(prompt)
                if fails(prompt):
                    raise ConnectionError("gone")
                return (413, "long") if prompt == "p3" else (200, prompt.upper())

            return call

        return make

    def calls():
        return sorted(open(f"{log}/{name}").read() for name in os.listdir(log))

    rows = spark.createDataFrame([(i, f"p{i % 8}") for i in range(24)] + [(99, None)], "query_id long, prompt string")
    first = {r.query_id: (r.status, r.response) for r in generate_once(
        rows, client_that(lambda p: p in ("p5", "p6")), store, calls_per_commit=2).collect()}
    assert calls() == [f"p{i}" for i in range(8)] and len(first) == 25
    assert first[0] == (200, "P0") and first[99] == (None, None) and first[3] == (413, "ollama status: 413")
    assert first[5] == (CLIENT_ERROR, "ollama status: 599: ConnectionError: gone")
    # the next job sends only what failed
    again = {r.query_id: r.status for r in generate_once(rows, client_that(lambda p: False), store).collect()}
    assert calls() == sorted([f"p{i}" for i in range(8)] + ["p3", "p5", "p6"])
    assert again[5] == again[13] == 200 and again[3] == 413


def test_a_job_that_fails_midway_pays_only_for_its_last_group(spark, tmp_path, monkeypatch):
    from passagework.operators import generate as G

    store, sent = str(tmp_path / "store"), []
    real = G.generate

    def failing(prompts, *args, **kw):
        sent.append([r._prompt for r in prompts.collect()])
        if len(sent) == 3:
            raise RuntimeError("executor lost")
        return real(prompts, *args, **kw)

    monkeypatch.setattr(G, "generate", failing)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "query_id long, prompt string")
    try:
        G.generate_once(rows, lambda: lambda p: (200, p), store, calls_per_commit=10)
    except RuntimeError:
        pass
    done = {p for group in sent[:2] for p in group}
    assert len(sent) == 3 and done
    G.generate_once(rows, lambda: lambda p: (200, p), store, calls_per_commit=10).count()
    assert not done & {p for group in sent[3:] for p in group}
