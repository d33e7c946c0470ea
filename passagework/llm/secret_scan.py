"""Secret scans by patterns and by two character Markov models, in DataFrame functions only.

Three fixed patterns give the base spans. Further candidates, unbroken runs of token characters, cut at
the base spans that they meet, are scored by the log-likelihood ratio of two first-order character models, one of random
strings and one of ordinary words and identifiers, trained from labelled samples. The ratios are one table of 128 x 128
numbers, a constant of the plan.
Positions come from the lengths of the matches and of the texts between them, summed in blocks, so a text with many
matches stays linear. Everything is map-only; one row per input row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import bounded_sample

# fixed values: kinds in their order, patterns, the group that is measured and its least length
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# runs are maximal, so their least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{3,}"
SAMPLE_DOCUMENTS = 2_000
LEAST_RATIO = 12.0
LEAST_MEAN_RATIO = 0.8
MASK = "[REDACTED]"
_BLOCK = 256
_CODES = 128


_SPAN = "struct<start:bigint,kind:int,stop:bigint,value:string>"


def _starts(steps: str) -> Column:
    """Running start of each match from ``steps``, pairs of the text before a match and of its length.

    Blocks of a fixed size are summed on their own and then shifted, so the work is linear in the matches. ``steps`` has
    to be a stored column: an expression would be computed anew inside the functions.
    """
    empty = F.array().cast("array<bigint>")
    n_blocks = F.ceil(F.size(steps) / F.lit(_BLOCK)).cast("int")
    blocks = F.when(n_blocks > 0, F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))

    def one(acc, s):
        return F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"),
                        F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts"))

    def block(acc, b):
        inner = F.aggregate(b, F.struct(acc["at"].alias("at"), empty.alias("starts")), one)
        return F.transform(F.array(inner), lambda i: F.struct(
            i["at"].alias("at"), F.concat(acc["all"], F.array(i["starts"])).alias("all")))[0]

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.flatten(F.aggregate(F.coalesce(blocks, F.array().cast("array<array<struct<gap:bigint,size:bigint>>>")),
                                 start, block, lambda acc: acc["all"]))


def _with_spans(rows: DataFrame, out: str, pattern: str, kind: int, group: int | None = None,
                least: int = 0) -> DataFrame:
    """Add ``out``: spans of all matches of ``pattern`` in ``_text``, those whose ``group`` has ``least`` characters."""
    rows = rows.withColumn("_m", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    hit = F.size("_m") > 0
    gaps = F.transform(F.split("_text", pattern, -1), lambda g: F.length(g).cast("bigint"))
    sizes = F.transform("_m", lambda m: F.length(m).cast("bigint"))
    steps = F.filter(F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size"))),
                     lambda s: s["size"].isNotNull())
    rows = rows.withColumn("_steps", F.when(hit, steps)).withColumn("_at", F.when(hit, _starts("_steps")))
    spans = F.zip_with("_m", "_at", lambda m, at: F.struct(
        at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop"), m.alias("value")).cast(_SPAN))
    if group is not None:
        values = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
        spans = F.filter(F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= least, s)),
                         lambda s: s.isNotNull())
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.withColumn(out, F.when(hit, spans).otherwise(none)).drop("_m", "_steps", "_at")


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``_base``: spans of the three patterns in ``_text`` (not null), by start and kind."""
    rows = _with_spans(docs, "_b0", ASSIGN, 0, 2, ASSIGN_LEAST)
    rows = _with_spans(_with_spans(rows, "_b1", ACCESS, 1), "_b2", HEX, 2)
    return rows.withColumn("_base", F.array_sort(F.concat("_b0", "_b1", "_b2"))).drop("_b0", "_b1", "_b2")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``(value, random)`` from at most about ``sample_documents`` documents: pattern hits are random strings, the
    other words are ordinary."""
    some = bounded_sample(docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")),
                          "_id", sample_documents)
    spans = base_spans(some).select("_text", "_base")
    secrets = spans.select(F.explode("_base").alias("s")).select(
        F.regexp_extract("s.value", r"([A-Za-z0-9+/_.=-]+)$", 1).alias("value"), F.lit(True).alias("random"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    free = spans.filter(F.size("_base") == 0).select(F.explode(words).alias("value"), F.lit(False).alias("random"))
    return secrets.unionAll(free)


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair of neighbouring characters, from ``samples(value, random)``.

    Only counts of character pairs reach the driver, 2 x 128 x 128 at most. Without samples every ratio is 0.
    """
    codes = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1),
                       lambda a, b: a * _CODES + b)
    counted = (
        samples.filter(F.length("value") > 1).select("random", codes.alias("codes"))
        .select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
        .filter(F.col("pair").between(0, _CODES * _CODES - 1)).collect()
    )
    logs = {}
    for kind in (True, False):
        counts = {r["pair"]: r["n"] for r in counted if r["random"] is kind}
        letters = 64
        totals = [0] * _CODES
        for pair, n in counts.items():
            totals[pair // _CODES] += n
        logs[kind] = [math.log((counts.get(p, 0) + 1) / (totals[p // _CODES] + letters)) for p in range(_CODES**2)]
    return [a - b for a, b in zip(logs[True], logs[False])]


def _ratio(value: Column, table: Column) -> Column:
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    left, right = F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1)
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.get(table, a * _CODES + b)),
                       F.lit(0.0), lambda a, b: a + b)


def _parts(c: Column) -> Column:
    """What is left of candidate ``c`` outside the spans of ``_base``, which are by start."""
    none = F.array().cast(f"array<{_SPAN}>")

    def part(start, stop):
        value = c["value"].substr((start - c["start"] + 1).cast("int"), (stop - start).cast("int"))
        return F.when(start < stop, F.array(F.struct(
            start.alias("start"), F.lit(3).alias("kind"), stop.alias("stop"), value.alias("value")).cast(_SPAN))
        ).otherwise(none)

    def step(acc, b):
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"),
                        F.concat(acc["parts"], part(acc["at"], b["start"])).alias("parts"))

    meets = F.filter("_base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    return F.aggregate(meets, F.struct(c["start"].alias("at"), none.alias("parts")), step,
                       lambda acc: F.concat(acc["parts"], part(acc["at"], c["stop"])))


def secret_spans(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the whole input row), ``_text``, ``_base`` and ``_all``: base spans and those that the models add.

    Candidates are cut at the base spans that they meet. A part is added if its ratio reaches ``LEAST_RATIO`` and
    ``LEAST_MEAN_RATIO`` per character pair. Kind 3 marks added spans.
    """
    table = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = _with_spans(base_spans(rows), "_found", CANDIDATE, 3)
    cut = F.flatten(F.transform("_found", _parts))
    rows = rows.withColumn("_cut", F.when(F.size("_base") == 0, F.col("_found")).otherwise(cut))
    added = F.filter("_cut", lambda c: _ratio(c["value"], table) >= F.greatest(
        F.lit(LEAST_RATIO), LEAST_MEAN_RATIO * (F.length(c["value"]) - 1)))
    return rows.select("_row", "_text", "_base", F.array_sort(F.concat("_base", added)).alias("_all"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "markov"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, hash of the base spans, all spans and the number the models added.

    A null text counts as empty and has no spans; repeated rows and ids are scanned row by row; an empty table gives no
    rows; other columns are ignored whatever their names.
    """
    rows = secret_spans(docs.select(id_col, text_col), ratios, id_col, text_col)

    def n(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        F.col("_row")[id_col].alias(id_col), *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written("_base"), 256).alias("base_sha256"), _written("_all").alias("spans"),
        F.size(F.filter("_all", lambda s: s["kind"] == 3)).cast("long").alias("n_markov"))


def mask_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns with every span replaced by ``MASK``; overlapping spans become one. Other texts stay as they are."""
    rows = secret_spans(docs, ratios, id_col, text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        begin = F.greatest(s["start"], acc["at"])
        gap = F.substring("_text", (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], gap, F.lit(MASK)).alias("out"), s["stop"].alias("at"))).otherwise(F.struct(
                acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at")))

    built = rows.withColumn("_built", F.aggregate("_all", start, step))
    masked = F.when(F.size("_all") == 0, F.col("_row")[text_col]).otherwise(F.concat(
        F.col("_built.out"), F.substring("_text", (F.col("_built.at") + 1).cast("int"), F.length("_text"))))
    return built.select(F.col("_row").withField(text_col, masked).alias("_row")).select("_row.*")
