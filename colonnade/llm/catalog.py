"""Queries of the operators for language-model training data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import sketch
from colonnade.llm.leaks import find_leaks
from colonnade.llm.packing import CAPACITY, pack, token_counts
from colonnade.llm.topn import top_n_per_group
from colonnade.llm.truncation import find_truncated, share_by_source
from colonnade.operators.positions import ranked
from colonnade.runtime import join_dimension, materialize
from colonnade.sources.tables import table


LEVELS = (5, 25, 50, 75, 95, 99)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stock_quotes").select("symbol", "binVolume", "rid")
    return top_n_per_group(bars, "symbol", "binVolume", "rid", 5).select("symbol", "rid")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Days are sketched first and added up, as summaries of separate days or files would be."""
    bars = table(spark, folder, "stock_quotes").filter("symbol is not null")
    days = sketch.sketch(bars, ["symbol", "trade_day"], ["binClose", "binVolume"])
    found = sketch.percentiles(sketch.merge(days, ["symbol"]), ["symbol"], LEVELS)
    return found.select("symbol", "column", "n", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in LEVELS])


def p3_error(spark: SparkSession, folder: str) -> DataFrame:
    """Per symbol and column whether every percentile of the sketch lies within the stated error of the exact value at its rank."""
    bars = table(spark, folder, "stock_quotes").filter("symbol is not null")
    found = sketch.percentiles(sketch.sketch(bars, ["symbol"], ["binClose", "binVolume"]), ["symbol"], LEVELS)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in ("binClose", "binVolume")])
    values = bars.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.column", "p.value").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    exact = join_dimension(ranked(values, ["symbol", "column"], [("value", False)], "at"), found, ["symbol", "column"], "inner")
    errors = [F.when(F.col("at") == F.floor(F.lit(p / 100) * (F.col("n") - 1)) + 1, F.abs(F.col(f"p{p}") - F.col("value")) - F.lit(sketch.ERROR * (1 + 1e-9)) * F.abs("value")) for p in LEVELS]
    worst = exact.groupBy("symbol", "column").agg(F.max("n").alias("n"), *[F.max(e).alias(f"e{p}") for e, p in zip(errors, LEVELS)])
    return worst.select("symbol", "column", "n", (F.greatest(*[f"e{p}" for p in LEVELS]) <= 0).alias("within"))


def tokenizer() -> str:
    """Path of the vocabulary: COLONNADE_TOKENIZER, else the many-language one of the installed tokenizer files."""
    if path := os.environ.get("COLONNADE_TOKENIZER"):
        return path
    try:
        import public_tokenizers
    except ImportError:
        raise RuntimeError("set COLONNADE_TOKENIZER to a file of token ranks") from None
    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    # counted once: sorting by size samples its input before it reads it
    sizes = materialize(token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizer()), "tokens")
    return pack(sizes, "doc_id", "tokens", CAPACITY)


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What any packing must keep: no container over the capacity, every text whole and once, hardly more containers than the tokens fill."""
    sizes = materialize(token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizer()), "tokens")
    packed = materialize(pack(sizes, "doc_id", "tokens", CAPACITY), "packed")
    fill = packed.filter("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("fill"))
    over = fill.agg(F.count_if(F.col("fill") > CAPACITY).alias("over_capacity"), F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("placed"))
    pieces = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    texts = sizes.join(pieces, "doc_id", "left").agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce(F.col("placed") != F.col("tokens"), F.lit(True))).alias("not_whole"),
        F.count_if((F.col("tokens") <= CAPACITY) & (F.col("pieces") > 1)).alias("split_needlessly"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    floor = F.ceil(F.col("tokens") / CAPACITY)
    return over.crossJoin(texts).select("documents", "over_capacity", "not_whole", "split_needlessly", (F.col("placed") == F.col("tokens")).alias("all_placed"), (F.col("containers") <= F.lit(1.01) * floor + 1).alias("tight"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_truncated(table(spark, folder, "documents"), "doc_id", "source", "text").filter("cut").select("doc_id")


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return share_by_source(find_truncated(table(spark, folder, "documents"), "doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p3_percentiles, p3_error, p6_containers, p6_invariants, p7_found, p8_found, p8_share)}

_G = sketch.gamma(sketch.ERROR)

ORACLES = {
    "p3_percentiles": f"""
  WITH v AS (SELECT symbol, 'binClose' AS "column", CAST("binClose" AS DOUBLE) AS v FROM stock_quotes UNION ALL SELECT symbol, 'binVolume', CAST("binVolume" AS DOUBLE) FROM stock_quotes),
  b AS (SELECT symbol, "column", sign(v) AS s, CASE WHEN v = 0 THEN 0 ELSE ceil(ln(abs(v)) / ln({_G!r}::DOUBLE)) END AS b FROM v WHERE symbol IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
  r AS (SELECT *, row_number() OVER (PARTITION BY symbol, "column" ORDER BY s, s * b) - 1 AS k, count(*) OVER (PARTITION BY symbol, "column") AS n FROM b),
  x AS (SELECT *, s * exp(b * ln({_G!r}::DOUBLE)) * (2 / ({_G!r}::DOUBLE + 1)) AS e FROM r)
  SELECT symbol, "column", n, {", ".join(f"round(max(e) FILTER (WHERE k = floor({p / 100}::DOUBLE * (n - 1))), 4) AS p{p}" for p in LEVELS)} FROM x GROUP BY symbol, "column", n
""",
    "p2_found": """
  SELECT symbol, rid FROM (
    SELECT symbol, rid, row_number() OVER (PARTITION BY symbol ORDER BY "binVolume" DESC, rid) AS k
    FROM stock_quotes WHERE symbol IS NOT NULL AND "binVolume" IS NOT NULL)
  WHERE k <= 5
""",
    "p3_error": """
  WITH v AS (SELECT symbol, 'binClose' AS "column", CAST("binClose" AS DOUBLE) AS v FROM stock_quotes UNION ALL SELECT symbol, 'binVolume', CAST("binVolume" AS DOUBLE) FROM stock_quotes)
  SELECT symbol, "column", count(*) AS n, true AS within FROM v WHERE symbol IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY symbol, "column"
""",
    "p6_invariants": """
  SELECT count(*) AS documents, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS split_needlessly, true AS all_placed, true AS tight FROM documents
""",
}
