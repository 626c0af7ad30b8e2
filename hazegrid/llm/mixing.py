"""Mixing sources to target weights by iterative proportional fitting (operator 6), in DataFrame functions only.

Documents are counted into cells of (source, language, topic) with their token weight. The cell weights are raked in turn to
the target shares of each of the three marginals. Tokens are an estimate from bytes and topics are shapes of text unless
other expressions are given. A document's probability is proportional to its cell's calibrated weight
over its natural weight, scaled so that the largest is 1: expected tokens then have the target marginals. A document is
kept if a hash of its id falls below its probability, so a rerun keeps the same ones.

A null source, language or topic is a category of its own, "(none)". A null text has no tokens; a cell or category without
tokens keeps weight 0 and its documents are never sampled. Repeated rows count each time; rows of one id are all kept or none,
and a row without an id is never sampled. There are no ties to break. Texts of any length are weighed whole. An empty table
gives an empty result. Other columns are left out by `mix` and kept by `sample`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, uniform

MARGINS = ("source", "lang", "topic")
#: Cells up to this number are raked in one partition, so that the windows need no shuffle; beyond, they are dealt by key. Results are the same.
ONE_PARTITION_CELLS = 100_000
#: Cells whose table is broadcast when documents are sampled, about 100 MB in memory; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def token_weight(text: Column) -> Column:
    """An estimate of a text's tokens: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4.0)).cast("long")


def topic(text: Column) -> Column:
    """The kind of text: numeric (a digit in 50 characters or more), lists (lines of under 80 characters), long, or prose."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, "0123456789", ""))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(text.isNull(), "(none)").when(digits * 50 > n, "numeric").when(lines * 80 > n, "lists").when(n > 6000, "long").otherwise("prose")


def tempered(cells: DataFrame, margin: str, power: float = 0.8) -> DataFrame:
    """Targets that flatten a marginal: (margin, share) with natural shares to a power, made to sum to 1."""
    natural = cells.groupBy(margin).agg(F.sum("w").alias("s")).where("s > 0").withColumn("p", F.pow(F.col("s"), F.lit(power)))
    return natural.crossJoin(natural.agg(F.sum("p").alias("total"))).select(margin, (F.col("p") / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], iterations: int = 12) -> DataFrame:
    """cells (source, lang, topic, w) with the column `raked`: after each pass one marginal's sums are its target shares."""
    out = cells.withColumn("raked", F.col("w").cast("double"))
    for m in MARGINS:
        out = out.join(targets[m].select(m, F.col("share").alias(f"share_{m}")), m, "left").fillna(0.0, [f"share_{m}"])
    out = cut(out)
    if out.count() <= ONE_PARTITION_CELLS:
        out = out.coalesce(1)
    for step in range(iterations):
        for m in MARGINS:
            total = F.sum("raked").over(Window.partitionBy(m))
            out = out.withColumn("raked", F.when(total > 0, F.col("raked") * F.col(f"share_{m}") / total).otherwise(0.0))
        if step % 4 == 3:
            out = cut(out)
    return out.select(*MARGINS, "w", "raked")


def reached(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """How far raking has come: (margin, category, target, share) for every category of raked cells."""
    rows = None
    total = raked.agg(F.sum("raked").alias("total"))
    for m in MARGINS:
        part = raked.groupBy(m).agg(F.sum("raked").alias("s")).crossJoin(total).join(targets[m].select(m, "share"), m, "left")
        part = part.select(F.lit(m).alias("margin"), F.col(m).alias("category"), F.coalesce("share", F.lit(0.0)).alias("target"), F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(0.0).alias("share"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _probabilities(docs: DataFrame, categories: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None, power: float, iterations: int) -> DataFrame:
    """(source, lang, topic, multiplier, probability) of each cell of docs."""
    cells = cut(docs.select(*[c.alias(m) for m, c in categories.items()], tokens.alias("w")).groupBy(*MARGINS).agg(F.sum("w").alias("w")))
    raked = cut(rake(cells, {m: (targets or {}).get(m) or tempered(cells, m, power) for m in MARGINS}, iterations))
    natural = raked.agg(F.sum("w").alias("all_w"), F.sum("raked").alias("all_raked"))
    ratio = cut(raked.crossJoin(natural).select(*MARGINS, F.when((F.col("w") > 0) & (F.col("all_raked") > 0), F.col("raked") / F.col("all_raked") / (F.col("w") / F.col("all_w"))).otherwise(0.0).alias("multiplier")))
    most = ratio.agg(F.max("multiplier").alias("most"))
    return cut(ratio.crossJoin(most).select(*MARGINS, "multiplier", F.when(F.col("most") > 0, F.col("multiplier") / F.col("most")).otherwise(0.0).alias("probability")))


def _categories(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_of) -> dict[str, Column]:
    return {"source": F.coalesce(docs[source_col].cast("string"), F.lit("(none)")), "lang": F.coalesce(docs[lang_col].cast("string"), F.lit("(none)")), "topic": topic_of(docs[text_col])}


def mix(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, power: float = 0.8, iterations: int = 12, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic, tokens_of=token_weight) -> DataFrame:
    """One row a document: id, source, lang, topic, tokens, multiplier (calibrated over natural share), probability, kept."""
    marked = cut(docs.select(docs[id_col].cast("long").alias("id"), *[c.alias(m) for m, c in _categories(docs, text_col, source_col, lang_col, topic_of).items()], tokens_of(docs[text_col]).alias("tokens")))
    scaled = _probabilities(marked, {m: F.col(m) for m in MARGINS}, F.col("tokens"), targets, power, iterations)
    out = marked.join(scaled, list(MARGINS)).withColumn("kept", uniform(F.col("id"), seed) < F.col("probability"))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "tokens", F.round("multiplier", 6).alias("multiplier"), F.round("probability", 6).alias("probability"), "kept")


def sample(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, power: float = 0.8, iterations: int = 12, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic, tokens_of=token_weight) -> DataFrame:
    """The documents, all columns, that `mix` keeps. Whether a document is kept follows from its row and its cell, so few cells are broadcast and no text is shuffled."""
    categories = _categories(docs, text_col, source_col, lang_col, topic_of)
    cell = free_name(docs)
    scaled = _probabilities(docs, categories, tokens_of(docs[text_col]), targets, power, iterations).select(F.struct(*MARGINS, "probability").alias(cell))
    if scaled.count() <= BROADCAST_CELLS:
        scaled = F.broadcast(scaled)
    same = [c == F.col(cell)[m] for m, c in categories.items()]
    return docs.join(scaled, same).where(uniform(docs[id_col].cast("long"), seed) < F.col(cell)["probability"]).select(*[docs[c] for c in docs.columns])


def oracle(power: float = 0.8, iterations: int = 12, seed: int = 11) -> str:
    """The same over the table documents, for DuckDB."""
    steps, last = [], "start"
    for i in range(iterations):
        for m in MARGINS:
            name = f"s{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(raked) OVER (PARTITION BY {m}) > 0 THEN raked * share_{m} / sum(raked) OVER (PARTITION BY {m}) ELSE 0 END AS raked) FROM {last})")
            last = name
    goals = ", ".join(f"g_{m} AS (SELECT {m}, pow(s, {power}) / sum(pow(s, {power})) OVER () AS share_{m} FROM (SELECT {m}, CAST(sum(w) AS DOUBLE) AS s FROM cells GROUP BY 1) WHERE s > 0)" for m in MARGINS)
    joins = " ".join(f"LEFT JOIN g_{m} USING ({m})" for m in MARGINS)
    shares = ", ".join(f"coalesce(share_{m}, 0) AS share_{m}" for m in MARGINS)
    return f"""
WITH marked AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN text IS NULL THEN '(none)' WHEN (length(text) - length(translate(text, '0123456789', ''))) * 50 > length(text) THEN 'numeric'
         WHEN (length(text) - length(replace(text, chr(10), '')) + 1) * 80 > length(text) THEN 'lists' WHEN length(text) > 6000 THEN 'long' ELSE 'prose' END AS topic,
    CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS w FROM marked GROUP BY ALL),
{goals},
start AS MATERIALIZED (SELECT source, lang, topic, w, CAST(w AS DOUBLE) AS raked, {shares} FROM cells {joins}),
{", ".join(steps)},
ratio AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN w > 0 AND sum(raked) OVER () > 0 THEN raked / sum(raked) OVER () / (w / sum(w) OVER ()) ELSE 0 END AS multiplier FROM {last}),
scaled AS (SELECT *, CASE WHEN max(multiplier) OVER () > 0 THEN multiplier / max(multiplier) OVER () ELSE 0 END AS probability FROM ratio)
SELECT doc_id, source, lang, topic, tokens, round(multiplier, 6) AS multiplier, round(probability, 6) AS probability,
  CAST('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < probability AS kept
FROM marked JOIN scaled USING (source, lang, topic)"""
