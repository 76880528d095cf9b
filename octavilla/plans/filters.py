"""Optional row filters.

Parameters are settled in plain Python before the plan is built: a filter that is not
asked for leaves no trace in the plan, so what remains can be pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import promos
from ..functions.columns import is_blank
from ..sources.star import Star
from .views import is_record


def normalize_with_category(value) -> str | None:
    v = (value or "").strip().lower()
    return v if v in ("si", "no") else None


def normalize_flyer(value) -> str | None:
    return (value or "").strip() or None


def with_category(df: DataFrame, value, column: str = "categoria") -> DataFrame:
    """``si`` keeps rows with a category, ``no`` the others, anything else all."""
    wanted = normalize_with_category(value)
    if wanted is None:
        return df
    blank = is_blank(F.col(column))
    return df.filter(~blank if wanted == "si" else blank)


def of_flyer(df: DataFrame, value, column: str = "folleto_id_fuente") -> DataFrame:
    flyer = normalize_flyer(value)
    return df if flyer is None else df.filter(F.col(column) == flyer)


def one_of(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))) if values else df


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df if value in (None, "") else df.filter(F.col(column) == value)


def contains_text(df: DataFrame, column: str, text) -> DataFrame:
    return df.filter(F.contains(F.lower(F.col(column)), F.lit(text.lower()))) if text else df


def equals_ignoring_case(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.lower(F.col(column)) == text.lower())


def between_dates(df: DataFrame, start_column: str, end_column: str, start=None, end=None) -> DataFrame:
    if start:
        df = df.filter(F.col(start_column) >= F.lit(str(start)).cast("date"))
    if end:
        df = df.filter(F.col(end_column) <= F.lit(str(end)).cast("date"))
    return df


def at_least_or_null(df: DataFrame, column: str, minimum) -> DataFrame:
    if minimum is None:
        return df
    return df.filter(F.col(column).isNull() | (F.col(column) >= minimum))


def plausible(price: Column) -> Column:
    return price.between(1, 100000)


def confident(df: DataFrame, minimum=None, column: str = "confianza") -> DataFrame:
    """Text blocks read with enough confidence; no minimum (or zero) means 0.15."""
    return df.filter(F.col(column) >= (minimum or 0.15))


def load_errors(df: DataFrame, categories=None, stores=None, source=None, state=None, flyer=None) -> DataFrame:
    df = of_flyer(df, flyer)
    df = one_of(df, "categoria", categories)
    df = one_of(df, "tienda_slug", stores)
    df = equal_to(df, "fuente", source)
    if state == "abiertos":
        df = df.filter(~F.col("resuelto"))
    elif state == "resueltos":
        df = df.filter("resuelto")
    return df


def _promotion_events(star: Star, level, campaigns) -> DataFrame | None:
    """Events that count as a promotion; None when the level has no data at all."""
    if level is not None and level not in promos.LEVELS_WITH_DATA:
        return None
    events = promos.classify_events(star.eventos_promo).filter("clase = 'campania'")
    return one_of(events, "campania", campaigns)


def records_of_groups(star: Star) -> DataFrame:
    """Records keyed as a price-range group is looked up: NULL and empty category are one."""
    return star.extracciones.filter(is_record()).select(
        F.col("texto_norm").alias("producto"),
        F.coalesce("categoria_nlp", F.lit("")).alias("_cat"),
        "folleto_id",
    )


def _match_groups(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = keys.select("producto", "_cat").distinct()
    return df.withColumn("_cat", F.coalesce("categoria", F.lit(""))).join(keys, ["producto", "_cat"], how).drop("_cat")


def groups_in_flyer(df: DataFrame, star: Star, value) -> DataFrame:
    """Price-range groups with a record in the flyer."""
    flyer = normalize_flyer(value)
    if flyer is None:
        return df
    wanted = of_flyer(star.folletos, flyer).select(F.col("id").alias("folleto_id"))
    return _match_groups(df, records_of_groups(star).join(wanted, "folleto_id", "left_semi"), "left_semi")


def by_promotion(df: DataFrame, star: Star, promotion=None, level=None, campaigns=None, mode: str = "vista") -> DataFrame:
    """Rows with or without a promotion.

    A campaign alone means "with that campaign"; a level alone filters nothing; a level
    without data matches no event.  ``mode`` says how rows reach a flyer: by source key
    (``vista``), by flyer id (``extraccion``) or through any record of the price-range
    group (``comparativa``).
    """
    promotion = promos.normalize_promotion(promotion)
    level = promos.normalize_level(level)
    campaigns = promos.normalize_campaigns(campaigns)
    if mode not in ("vista", "extraccion", "comparativa"):
        raise ValueError(f"unknown mode: {mode}")
    if promotion is None and campaigns:
        promotion = "con"
    if promotion is None:
        return df
    events = _promotion_events(star, level, campaigns)
    if events is None:
        return df.limit(0) if promotion == "con" else df
    how = "left_semi" if promotion == "con" else "left_anti"
    flyers = events.select("folleto_id").distinct()
    if mode == "extraccion":
        return df.join(flyers, "folleto_id", how)
    if mode == "vista":
        keys = star.folletos.join(flyers, F.col("id") == F.col("folleto_id"), "left_semi")
        return df.join(keys.select("fuente", "folleto_id_fuente"), ["fuente", "folleto_id_fuente"], how)
    return _match_groups(df, records_of_groups(star).join(flyers, "folleto_id", "left_semi"), how)
