"""Prompt templates and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import written


def prepare_prompt(
    context: Column,
    task_prompt: Column,
    user_input: Column,
    persona_prompt: Column | None = None,
    enhancer_prompts: Column | None = None,
    source_file: Column | None = None,
) -> Column:
    """Persona, task, enhancers, context, user input and source file as one text; absent or empty
    optional parts leave no trace."""

    def given(value: Column | None, text) -> Column:
        return F.lit("") if value is None else F.when(F.length(value) > 0, text(value)).otherwise("")

    enhancers = F.lit("")
    if enhancer_prompts is not None:
        each = F.transform(enhancer_prompts, lambda e: F.concat(F.lit("\n\n"), e))
        enhancers = F.coalesce(F.array_join(each, ""), F.lit(""))
    return F.concat(
        given(persona_prompt, lambda p: F.concat(p, F.lit("\n\n"))),
        task_prompt,
        enhancers,
        F.lit("\n\nContext: "), context,
        F.lit("\n\nUser input: "), user_input,
        given(source_file, lambda s: F.concat(F.lit("\n\nSource file: "), s)),
    )


def attach_templates(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """Look up task, persona and enhancers by name.

    ``queries`` has query_id, task, persona and enhancers (array, order kept); ``templates`` has
    kind, name, prompt. Adds task_prompt, persona_prompt, enhancer_prompts and
    ``missing_templates``, the names that were not found.
    """
    templates = written(templates.select("kind", "name", "prompt"))

    def kind(of: str, name: str) -> DataFrame:
        return templates.filter(F.col("kind") == of).select(
            F.col("name").alias(name), F.col("prompt").alias(f"{of}_prompt"), F.lit(True).alias(f"__{of}")
        )

    chosen = queries.select("query_id", F.posexplode("enhancers").alias("at", "enhancer"))
    enhancers = chosen.join(kind("enhancer", "enhancer"), "enhancer", "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("__enhancer"), F.struct("at", "enhancer_prompt")))).alias("e"),
        F.collect_set(F.when(F.col("__enhancer").isNull(), F.col("enhancer"))).alias("unknown"),
    )
    none = F.array().cast("array<string>")
    persona_given = F.col("persona").isNotNull() & (F.col("persona") != "None") & (F.col("persona") != "")
    return (
        queries.join(kind("task", "task"), "task", "left")
        .join(kind("persona", "persona"), "persona", "left")
        .join(enhancers, "query_id", "left")
        .withColumn("enhancer_prompts", F.coalesce(F.transform("e", lambda x: x["enhancer_prompt"]), none))
        .withColumn(
            "missing_templates",
            F.array_compact(F.concat(
                F.array(
                    F.when(F.col("__task").isNull(), F.col("task")),
                    F.when(persona_given & F.col("__persona").isNull(), F.col("persona")),
                ),
                F.coalesce(F.array_sort("unknown"), none),
            )),
        )
        .drop("e", "unknown", "__task", "__persona")
    )
