"""Search and prompt pipelines for many user inputs in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.config import MIN_SCORE, NO_SOURCES_MESSAGE, REFERENCE_LIMIT, written
from passagework.functions.chunking import ChunkPass
from passagework.functions.citations import page_link
from passagework.functions.embedding import add_vectors
from passagework.operators.generate import generate, generate_once
from passagework.operators.prompts import attach_templates, prepare_prompt
from passagework.operators.retrieval import hits_with_documents, hits_with_pages, retrieval_sources
from passagework.operators.vector_search import top_k_similar
from passagework.plans.ingest import DEFAULT_ENCODER
from passagework.schemas import CHUNK_KEY

# fixed value
SOURCES_HEADING = "Responding based on the following sources:\n\n"


def semantic_search(
    queries: DataFrame,
    chunks: DataFrame | ChunkPass,
    encoder=DEFAULT_ENCODER,
    k: int = REFERENCE_LIMIT,
    min_score: float = MIN_SCORE,
    search: Callable[..., DataFrame] = top_k_similar,
    texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Ranked hits of every query: query_id, rank, score, chunk key, page_id, text.

    ``queries`` has query_id and user_input; ``search`` may be the exact or the hashed search, or that
    of a stored index. ``texts`` are the chunks without their vectors, where these are computed, or a
    function of the hits' keys that gives them. The query vectors are written once, so that a slow encoder runs once; so are the hits, whose texts are
    looked up.
    """
    vectors = add_vectors(queries.select("query_id", "user_input"), "user_input", encoder, "query_vector", packed=True)
    vectors = written(vectors.select("query_id", "query_vector"))
    return search(
        vectors, chunks, chunk_key=CHUNK_KEY, carry=["page_id", "text"], texts=texts, dim=encoder.dim,
        k=k, min_score=min_score, **options,
    )


def retrieve(
    queries: DataFrame, chunks: DataFrame | ChunkPass, pages: DataFrame, documents: DataFrame, encoder=DEFAULT_ENCODER,
    k: int = REFERENCE_LIMIT, min_score: float = MIN_SCORE, **options,
) -> DataFrame:
    """Context and sources per query; only queries with hits.

    The hits (at most queries * k rows, found at great cost) are written once with their texts; both
    lookups read them from there.
    """
    hits = written(semantic_search(queries, chunks, encoder, k, min_score, **options))
    return retrieval_sources(hits_with_documents(hits_with_pages(hits, pages), documents, hits))


def search_task(queries: DataFrame, retrieved: DataFrame, collection: str) -> DataFrame:
    """One row per query: citations in rank order, or the message that nothing was found."""
    found = queries.select("query_id", "user_input").join(retrieved, "query_id", "left")
    links = F.transform("sources", lambda s: page_link(
        F.lit(collection), lambda f: s["doc_metadata"][f], lambda f: s["page_metadata"][f]))
    n = F.coalesce(F.size("sources"), F.lit(0))
    return found.select(
        "query_id", "user_input", n.alias("source_count"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.when(n > 0, F.concat(
            F.lit(SOURCES_HEADING), F.array_join(F.transform(links, lambda x: F.concat(x, F.lit("\n\n"))), "")
        )).otherwise(NO_SOURCES_MESSAGE).alias("answer"),
    )


def rag_prompts(
    queries: DataFrame, retrieved: DataFrame, templates: DataFrame, collection: str, on_empty: str = "message"
) -> DataFrame:
    """Search result plus the prompt of every query.

    ``queries`` has query_id, user_input, task, persona, enhancers and source_file. The prompt is
    NULL for tasks without one, and for queries without sources unless ``on_empty='prompt'``.
    """
    found = search_task(queries, retrieved, collection)
    asked = attach_templates(queries.drop("user_input"), templates)
    prompt = prepare_prompt(
        F.col("context"), F.col("task_prompt"), F.col("user_input"),
        F.col("persona_prompt"), F.col("enhancer_prompts"), F.col("source_file"),
    )
    wanted = F.col("source_count") > 0 if on_empty == "message" else F.lit(True)
    return found.join(asked, "query_id").select(
        *found.columns, "missing_templates", F.when(wanted, prompt).alias("prompt")
    )


def answers(prompts: DataFrame, make_client, concurrency: int = 4, store: str | None = None) -> DataFrame:
    """Citations followed by the generated response, where there is a prompt. With the folder ``store``
    responses are kept there, and no prompt is sent twice."""
    if store is None:
        done = generate(prompts, make_client, concurrency=concurrency)
    else:
        done = generate_once(prompts, make_client, store, concurrency=concurrency)
    return done.withColumn("answer", F.concat("answer", F.coalesce("response", F.lit(""))))
