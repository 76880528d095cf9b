"""Views over the star: records, price ranges, flyer quality, validity and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up
from ..sources.star import Star

# Day limits of the date checks.
OLD_START_DAYS = 365
FUTURE_START_DAYS = 30
LONG_VALIDITY_DAYS = 120


def is_record() -> Column:
    """The unit every count is about: a price row with a value and a shown name."""
    return (F.col("tipo") == "PRECIO") & F.col("valor").isNotNull() & F.col("texto_norm").isNotNull()


def records(star: Star) -> DataFrame:
    return star.extracciones.filter(is_record())


def discount_pct(current: Column, previous: Column) -> Column:
    """Discount with one decimal, only where the previous price is higher."""
    return F.when(previous > current, half_up((previous - current) / previous * 100, 1))


def _stores(star: Star) -> DataFrame:
    return star.tiendas.select(
        F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda"), F.col("slug").alias("tienda_slug"))


def _flyers(star: Star, *columns: str) -> DataFrame:
    return star.folletos.select(F.col("id").alias("folleto_id"), *columns)


def current_prices(star: Star) -> DataFrame:
    """Records with store, flyer and discount."""
    flyers = _flyers(star, "fecha_inicio", "fecha_fin", "fuente", "folleto_id_fuente", "titulo", "url_origen")
    return (
        records(star)
        .join(_stores(star), "tienda_id")
        .join(flyers, "folleto_id")
        .select(
            "tienda", "tienda_slug",
            F.col("texto_norm").alias("producto"),
            F.col("categoria_nlp").alias("categoria"),
            F.col("valor").alias("precio_actual"),
            F.col("valor_anterior").alias("precio_anterior"),
            discount_pct(F.col("valor"), F.col("valor_anterior")).alias("descuento_pct"),
            F.col("fecha_inicio").alias("vigencia_desde"),
            F.col("fecha_fin").alias("vigencia_hasta"),
            "fuente", "folleto_id_fuente", "confianza_ocr", "created_at", "id",
            # provenance, pruned unless a panel asks for it
            "folleto_id", "pagina_id",
            F.col("titulo").alias("folleto_titulo"), "url_origen",
        )
    )


def price_history(star: Star) -> DataFrame:
    """Records of flyers with a start date."""
    flyers = _flyers(star, "fecha_inicio", "fuente", "folleto_id_fuente", "titulo", "url_origen")
    return (
        records(star)
        .join(_stores(star), "tienda_id")
        .join(flyers.filter("fecha_inicio IS NOT NULL"), "folleto_id")
        .select(
            "tienda", "tienda_slug",
            F.col("texto_norm").alias("producto"),
            F.col("categoria_nlp").alias("categoria"),
            F.col("fecha_inicio").alias("fecha"),
            F.col("valor").alias("precio"),
            F.col("valor_anterior").alias("precio_anterior"),
            "folleto_id_fuente", "fuente", "id",
            "folleto_id", "pagina_id",
            F.col("titulo").alias("folleto_titulo"), "url_origen",
        )
    )


def price_ranges(star: Star) -> DataFrame:
    """Price range of each (product, category) sold in two or more stores.

    Aggregated to (product, category, store) first: a product that holds a large part
    of all rows is then spread over its stores before it meets in one group, and the
    distinct counts need no expansion of the records.
    """
    per_store = (
        records(star)
        .groupBy(F.col("texto_norm").alias("producto"), F.col("categoria_nlp").alias("categoria"), "tienda_id")
        .agg(
            F.min("valor").alias("lo"),
            F.max("valor").alias("hi"),
            F.sum(F.col("valor").cast("decimal(18,6)")).alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    average = F.sum("total").cast("double") / F.sum("n")
    return (
        per_store.join(_stores(star).drop("tienda_slug"), "tienda_id")
        .groupBy("producto", "categoria")
        .agg(
            F.min("lo").alias("precio_min"),
            F.max("hi").alias("precio_max"),
            half_up(average, 2).alias("precio_promedio"),
            (F.max("hi") - F.min("lo")).alias("diferencia"),
            F.sum("n").alias("num_registros"),
            F.count(F.lit(1)).alias("num_tiendas"),
            F.array_join(F.sort_array(F.collect_set("tienda")), ", ").alias("tiendas"),
        )
        .filter("num_tiendas > 1")
    )


def flyer_quality(star: Star) -> DataFrame:
    """Page metrics per flyer; the pages are summed before they meet the flyers."""
    pages = star.paginas.groupBy("folleto_id").agg(
        F.count("id").alias("paginas_procesadas"),
        F.sum("total_productos").alias("total_productos"),
        F.sum("total_precios").alias("total_precios"),
        F.sum("total_promos").alias("total_promos"),
        half_up(F.sum(F.col("confianza_ocr_prom").cast("decimal(18,6)")).cast("double")
                / F.count("confianza_ocr_prom"), 3).alias("confianza_ocr_prom"),
        half_up(F.sum(F.col("tasa_util").cast("decimal(18,6)")).cast("double")
                / F.count("tasa_util"), 3).alias("tasa_util_prom"),
    )
    flyers = _flyers(star, "tienda_id", "folleto_id_fuente", "fuente", "fecha_inicio", "total_paginas",
                     "perfil_ocr", "motor_ocr", "estado", "scrapeado_at")
    return (
        flyers.join(_stores(star).drop("tienda_slug"), "tienda_id")
        .join(pages, "folleto_id", "left")
        .withColumn("paginas_procesadas", F.coalesce("paginas_procesadas", F.lit(0)))
        .drop("tienda_id")
    )


def date_anomaly(start: Column, end: Column, scraped: Column) -> Column:
    """First date problem of a flyer, NULL without one; a missing scrape date skips its checks."""
    seen = scraped.cast("date")
    return (
        F.when(start.isNull() | end.isNull(), "sin_fecha")
        .when(end < start, "fin_antes_inicio")
        .when(start < F.date_sub(seen, OLD_START_DAYS), "inicio_antiguo")
        .when(start > F.date_add(seen, FUTURE_START_DAYS), "inicio_futuro_vs_scrapeo")
        .when(F.date_diff(end, start) > LONG_VALIDITY_DAYS, "vigencia_larga")
    )


def flyer_validity(star: Star, as_of) -> DataFrame:
    """Every flyer with its date problem and the flags current, doubtful and upcoming on ``as_of``."""
    day = F.lit(str(as_of)).cast("date")
    in_dates = (F.col("fecha_inicio") <= day) & (F.col("fecha_fin") >= day)
    clean = F.col("anomalia_fecha").isNull()
    return (
        star.folletos.join(_stores(star), "tienda_id")
        .select("id", "tienda_id", "tienda_slug", "tienda", "fuente", "folleto_id_fuente", "titulo",
                "fecha_inicio", "fecha_fin", "scrapeado_at", "total_paginas", "url_origen",
                date_anomaly(F.col("fecha_inicio"), F.col("fecha_fin"), F.col("scrapeado_at"))
                .alias("anomalia_fecha"))
        .withColumns({
            "vigente": clean & in_dates,
            "vigente_dudoso": ~clean & in_dates,
            "proximo": clean & (F.col("fecha_inicio") > day),
        })
    )


def validity_state(current: Column, doubtful: Column, upcoming: Column) -> Column:
    """One state per flyer; missing flags count as false."""
    return (
        F.when(F.coalesce(current, F.lit(False)), "vigente")
        .when(F.coalesce(doubtful, F.lit(False)), "vigente_dudoso")
        .when(F.coalesce(upcoming, F.lit(False)), "proximo")
        .otherwise("fuera")
    )


def price_rows_per_flyer(star: Star) -> DataFrame:
    return star.precios().groupBy("folleto_id").agg(F.count("id").alias("precios"))


def active_events(star: Star, as_of) -> DataFrame:
    """Campaigns without an end or ending on or after ``as_of``.

    ``num_precios_asociados`` counts each price once per event of its flyer, as the
    data owners define it.
    """
    day = F.lit(str(as_of)).cast("date")
    live = star.eventos_promo.filter(F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= day))
    return (
        live.join(_stores(star), "tienda_id")
        .join(price_rows_per_flyer(star), "folleto_id", "left")
        .groupBy("nombre_evento", "tienda", "fecha_inicio", "fecha_fin", "texto_raw")
        .agg(F.sum(F.coalesce("precios", F.lit(0))).alias("num_precios_asociados"), F.min("id").alias("id"))
    )


def register_views(star: Star, as_of) -> list[str]:
    """Registers the star tables and views for SQL users; returns the names."""
    from .comparison import comparison_by_key
    frames = {
        **{t: getattr(star, t) for t in ("tiendas", "folletos", "paginas", "extracciones", "eventos_promo",
                                         "errores_carga", "productos_canonicos")},
        "v_precios_actuales": current_prices(star),
        "v_comparativa_precios": price_ranges(star),
        "v_calidad_folletos": flyer_quality(star),
        "v_historico_precios": price_history(star),
        "v_folletos_vigencia": flyer_validity(star, as_of),
        "v_eventos_activos": active_events(star, as_of),
        "v_comparativa_precios_v2": comparison_by_key(star),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
