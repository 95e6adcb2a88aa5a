"""Token totals, price lists and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import small_or_materialized

PRICE_LIST_TYPE = (
    "struct<data: array<struct<id: string, pricing: struct<prompt: string, completion: string>>>>"
)


def clean_pricing(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Saved price-list JSON -> (model_id, prompt_price, completion_price).

    Entries without id, without both prices or with a non-numeric price are dropped;
    of a repeated id the last entry of the list wins.
    """
    items = raw.select(
        F.posexplode(F.from_json(F.col(col), PRICE_LIST_TYPE)["data"]).alias("pos", "item")
    ).select(
        "pos",
        F.nullif(F.col("item.id"), F.lit("")).alias("model_id"),
        F.col("item.pricing.prompt").try_cast("double").alias("prompt_price"),
        F.col("item.pricing.completion").try_cast("double").alias("completion_price"),
    )
    prices = F.struct("prompt_price", "completion_price")
    return (
        items.na.drop()
        .groupBy("model_id")
        .agg(F.max_by(prices, F.col("pos")).alias("price"))
        .select("model_id", "price.prompt_price", "price.completion_price")
    )


def cost_column(
    prompt_tokens: Column,
    completion_tokens: Column,
    prompt_price: Column,
    completion_price: Column,
    reported: Column,
) -> Column:
    """Reported cost if numeric, else tokens times price, else 0."""
    estimated = (
        F.coalesce(prompt_tokens, F.lit(0)) * prompt_price
        + F.coalesce(completion_tokens, F.lit(0)) * completion_price
    )
    return F.coalesce(reported.cast("string").try_cast("double"), estimated, F.lit(0.0))


def with_cost(df: DataFrame, pricing: DataFrame, reported_col: str | None = None) -> DataFrame:
    """Add ``cost_usd``. A price list of checked small size is broadcast, so usage rows
    stay in place however many of them one model has."""
    reported = F.col(reported_col) if reported_col else F.lit(None)
    prices = pricing.select("model_id", "prompt_price", "completion_price")
    return (
        df.join(small_or_materialized(prices, "prices"), "model_id", "left")
        .withColumn(
            "cost_usd",
            cost_column(
                F.col("prompt_tokens"),
                F.col("completion_tokens"),
                F.col("prompt_price"),
                F.col("completion_price"),
                reported,
            ),
        )
        .drop("prompt_price", "completion_price")
    )


def token_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token sums per group, a missing count is 0."""
    return df.groupBy(*by).agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens_total"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens_total"),
    )
