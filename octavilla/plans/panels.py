"""The questions the data is asked: one function per panel, each a lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, promos
from ..functions.columns import half_up, is_blank, percentage, safe_url
from ..operators.medians import exact_median
from ..sources.star import Star
from . import filters, views

# How a shown name counts as taken from the catalogue.
CATALOGUE_METHODS = ("exacto", "fuzzy", "fuzzy_bajo")
# Date problems that make the start date useless; a long validity does not.
UNRELIABLE_START = ("sin_fecha", "fin_antes_inicio", "inicio_antiguo", "inicio_futuro_vs_scrapeo")
# Error categories of the load log, in order of presentation.
ERROR_CATEGORIES = (
    "tamano_excesivo", "valor_fuera_de_rango", "formato_invalido", "violacion_integridad",
    "json_corrupto", "archivo_faltante", "otro",
)
# Days before and after today shown by the weekly series.
WEEKS_BACK_DAYS = 182
WEEKS_AHEAD_DAYS = 30
# Display names of the validity states.
VALIDITY_NAMES = {
    "vigente": "Vigente hoy",
    "vigente_dudoso": "Vigente (fecha dudosa)",
    "proximo": "Próximo",
    "fuera": "Fuera de vigencia",
}


def one_row(*single_rows: DataFrame) -> DataFrame:
    """Puts one-row aggregates of different tables side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# -- provenance ------------------------------------------------------------------------

def attach_page_number(rows: DataFrame, star: Star) -> DataFrame:
    """Adds ``numero_pagina``, NULL for a page that is not there, and cleans the source address."""
    pages = star.paginas.select(F.col("id").alias("pagina_id"), "numero_pagina")
    return rows.join(pages, "pagina_id", "left").withColumn("url_origen", safe_url(F.col("url_origen")))


def provenance(ids: DataFrame, star: Star) -> DataFrame:
    """Page and flyer of each extraction id; unknown ids keep NULL fields."""
    facts = star.extracciones.select("id", "pagina_id", "folleto_id").join(
        ids.select("id").distinct(), "id", "left_semi")
    flyers = star.folletos.select(
        F.col("id").alias("folleto_id"), "folleto_id_fuente",
        F.col("titulo").alias("folleto_titulo"), safe_url(F.col("url_origen")).alias("url_origen"))
    pages = star.paginas.select(F.col("id").alias("pagina_id"), "numero_pagina")
    found = facts.join(flyers, "folleto_id", "left").join(pages, "pagina_id", "left")
    return ids.join(found, "id", "left")


def extraction_origin(star: Star, extraction_ids=None) -> DataFrame:
    """Extractions with the product row they point to."""
    fields = ["id", "tipo", "texto_raw", "texto_norm", "valor", "valor_anterior", "confianza_ocr",
              "bbox_x", "bbox_y", "bbox_ancho", "bbox_alto", "pagina_id", "producto_extraccion_id",
              "metodo_norm"]
    rows = filters.one_of(star.extracciones, "id", extraction_ids).select(*fields, "folleto_id")
    products = star.extracciones.filter("tipo = 'PRODUCTO'").select(
        "folleto_id", F.col("id").alias("producto_extraccion_id"),
        F.col("texto_raw").alias("producto_texto"),
        F.col("texto_norm").alias("producto_nombre"),
        F.col("metodo_norm").alias("producto_metodo"),
        F.col("bbox_x").alias("producto_x"), F.col("bbox_y").alias("producto_y"))
    # a price and its product stand in one flyer: the key a table by flyer is spread by
    key = ["folleto_id", "producto_extraccion_id"]
    points = F.col("folleto_id").isNotNull() & F.col("producto_extraccion_id").isNotNull()
    found = rows.filter(points).join(products, key, "left")
    # rows that point to none, most of them products themselves, are not dealt to meet the products
    return found.unionByName(rows.filter(~points), allowMissingColumns=True).drop("folleto_id")


# -- prices ----------------------------------------------------------------------------

def current_prices(star: Star, stores=None, categories=None, start=None, end=None, text=None,
                   only_discounted=False, with_category=None, flyer=None, promotion=None,
                   level=None, campaigns=None, limit: int = 500) -> DataFrame:
    df = views.current_prices(star)
    df = filters.of_flyer(filters.with_category(df, with_category), flyer)
    df = filters.by_promotion(df, star, promotion, level, campaigns, "vista")
    df = filters.one_of(df, "tienda", stores)
    df = filters.one_of(df, "categoria", categories)
    df = filters.between_dates(df, "vigencia_desde", "vigencia_hasta", start, end)
    df = filters.contains_text(df, "producto", text)
    if only_discounted:
        df = df.filter(F.col("descuento_pct").isNotNull())
    top = df.orderBy(F.col("descuento_pct").desc_nulls_last(), "id").limit(limit)
    kept = top.select("id", "tienda", "producto", "categoria", "precio_actual", "precio_anterior",
                      "descuento_pct", "vigencia_desde", "vigencia_hasta", "confianza_ocr", "pagina_id",
                      "folleto_id", "folleto_id_fuente", "folleto_titulo", "url_origen")
    return promos.attach_campaigns(attach_page_number(kept, star), star.eventos_promo)


def price_comparison(star: Star, categories=None, text=None, min_stores: int = 1, with_category=None,
                     flyer=None, promotion=None, level=None, campaigns=None, limit: int = 300) -> DataFrame:
    df = views.price_ranges(star).filter(F.col("num_tiendas") >= min_stores)
    df = filters.with_category(df, with_category)
    df = filters.groups_in_flyer(df, star, flyer)
    df = filters.by_promotion(df, star, promotion, level, campaigns, "comparativa")
    df = filters.one_of(df, "categoria", categories)
    df = filters.contains_text(df, "producto", text)
    return df.orderBy(F.col("diferencia").desc(), "producto", F.col("categoria").asc_nulls_first()).limit(limit)


def comparison_detail(star: Star, product: str, with_category=None, category=None) -> DataFrame:
    """Prices of one group; ``category=''`` is the group without category, None is any."""
    df = star.precios().filter(F.col("valor").isNotNull() & (F.col("texto_norm") == product))
    df = filters.with_category(df, with_category, "categoria_nlp")
    if category == "":
        df = df.filter(F.coalesce("categoria_nlp", F.lit("")) == "")
    elif category is not None:
        df = df.filter(F.col("categoria_nlp") == category)
    stores = star.tiendas.select(F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda"))
    flyers = star.folletos.select(
        F.col("id").alias("folleto_id"), F.col("fecha_inicio").alias("vigencia_desde"),
        F.col("fecha_fin").alias("vigencia_hasta"), "folleto_id_fuente",
        F.col("titulo").alias("folleto_titulo"), "url_origen")
    rows = df.select("id", "tienda_id", F.col("valor").alias("precio"), "pagina_id", "folleto_id")
    rows = rows.join(stores, "tienda_id").join(flyers, "folleto_id").drop("tienda_id")
    rows = attach_page_number(rows, star)
    return promos.attach_campaigns(rows, star.eventos_promo).orderBy("precio", "id")


def price_history(star: Star, product: str, stores=None, start=None, end=None, with_category=None,
                  flyer=None, promotion=None, level=None, campaigns=None) -> DataFrame:
    df = filters.equals_ignoring_case(views.price_history(star), "producto", product)
    df = filters.of_flyer(filters.with_category(df, with_category), flyer)
    df = filters.by_promotion(df, star, promotion, level, campaigns, "vista")
    df = filters.one_of(df, "tienda", stores)
    df = filters.between_dates(df, "fecha", "fecha", start, end)
    kept = df.select("id", "tienda", "producto", "categoria", "fecha", "precio", "precio_anterior",
                     "pagina_id", "folleto_id", "folleto_id_fuente", "folleto_titulo", "url_origen")
    rows = promos.attach_campaigns(attach_page_number(kept, star), star.eventos_promo)
    return rows.orderBy("fecha", "id")


def suggest_products(star: Star, text: str, limit: int = 20) -> DataFrame:
    """Most recorded products of the history whose name holds the text."""
    df = filters.contains_text(views.price_history(star), "producto", text)
    if not text:
        df = df.limit(0)
    counts = df.groupBy("producto").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "producto").limit(limit)


# -- summary ---------------------------------------------------------------------------

def distinct_categories(star: Star, flyer=None) -> DataFrame:
    df = views.current_prices(star) if filters.normalize_flyer(flyer) else views.records(star).withColumn(
        "categoria", F.col("categoria_nlp"))
    df = filters.of_flyer(filters.with_category(df, "si"), flyer)
    return df.select(F.trim("categoria").alias("categoria")).distinct()


def category_kpi(categories: Column, categorized: Column, base: Column, with_category=None) -> dict[str, Column]:
    """Category count and share; not applicable when only uncategorized rows are asked for."""
    if filters.normalize_with_category(with_category) == "no":
        categories = categorized = F.lit(None).cast("bigint")
    return {
        "categorias": categories,
        "registros_con_categoria": categorized,
        "registros_base": base,
        "pct_con_categoria": percentage(categorized, base),
    }


def summary_kpis(star: Star, as_of, with_category=None, flyer=None) -> DataFrame:
    wanted = filters.normalize_with_category(with_category)
    blank = is_blank(F.col("categoria"))
    in_filter = F.lit(True) if wanted is None else (~blank if wanted == "si" else blank)
    flyer = filters.normalize_flyer(flyer)
    in_flyer = F.lit(True) if flyer is None else (F.col("folleto_id_fuente") == flyer)
    validity = views.flyer_validity(star, as_of).agg(
        F.count(F.lit(1)).alias("total_folletos"),
        count_where(F.col("vigente")).alias("folletos_vigentes"),
        count_where(F.col("vigente_dudoso")).alias("folletos_vigentes_dudosos"),
    )
    counted = views.current_prices(star).agg(
        count_where(in_filter & in_flyer).alias("registros_dashboard"),
        F.count(F.lit(1)).alias("registros_dashboard_todos"),
        F.count_distinct(F.when(~blank & in_flyer, F.trim("categoria"))).alias("c"),
        count_where(~blank & in_flyer).alias("con"),
        count_where(in_flyer).alias("base"),
    )
    prices = counted.select(
        "registros_dashboard", "registros_dashboard_todos",
        *[c.alias(n) for n, c in category_kpi(F.col("c"), F.col("con"), F.col("base"), wanted).items()])
    stores = star.tiendas.agg(count_where(F.col("activa")).alias("tiendas_activas"))
    return one_row(stores, validity, prices)


def top_categories(star: Star, limit: int = 10, with_category=None, flyer=None) -> DataFrame:
    df = views.current_prices(star)
    if filters.normalize_with_category(with_category) == "no":
        df = df.limit(0)
    df = filters.of_flyer(filters.with_category(df, "si"), flyer)
    counts = df.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "categoria").limit(limit)


def flyers_per_store(star: Star) -> DataFrame:
    counts = star.folletos.groupBy(F.col("tienda_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = star.tiendas.join(counts, "id").groupBy(F.col("nombre").alias("tienda")).agg(F.sum("n").alias("n"))
    return named.orderBy(F.col("n").desc(), "tienda")


def flyer_state(star: Star, flyer) -> DataFrame:
    """Whether the flyer exists, has records, and how many load errors it has."""
    flyer = filters.normalize_flyer(flyer)
    if flyer is None:
        raise ValueError("a flyer id is needed")
    flyers = filters.of_flyer(star.folletos, flyer)
    stores = star.tiendas.select(F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda"))
    found = flyers.join(stores, "tienda_id").agg(
        F.count(F.lit(1)).alias("folletos"),
        F.array_join(F.sort_array(F.collect_set("tienda")), ", ").alias("tiendas"),
        F.array_join(F.sort_array(F.collect_set("fuente")), ", ").alias("fuentes"))
    rows = views.records(star).join(
        flyers.select(F.col("id").alias("folleto_id")), "folleto_id", "left_semi"
    ).agg(F.count(F.lit(1)).alias("registros"))
    errors = filters.of_flyer(star.errores_carga, flyer).agg(F.count(F.lit(1)).alias("errores_carga"))
    state = (F.when(F.col("folletos") == 0, "no_existe")
             .when(F.col("registros") == 0, "sin_precios").otherwise("con_precios"))
    return one_row(found, rows, errors).select(F.lit(flyer).alias("folleto"), state.alias("estado"), "*")


# -- quality, reliability and coverage ---------------------------------------------------

def flyer_quality(star: Star, stores=None, source=None, state=None, min_useful=None, flyer=None,
                  limit: int = 500) -> DataFrame:
    df = filters.of_flyer(views.flyer_quality(star), flyer)
    df = filters.one_of(df, "tienda", stores)
    df = filters.equal_to(df, "fuente", source)
    df = filters.equal_to(df, "estado", state)
    df = filters.at_least_or_null(df, "tasa_util_prom", min_useful)
    return df.orderBy(F.col("tasa_util_prom").asc_nulls_last(), "folleto_id").limit(limit).select(
        "folleto_id", "tienda", "folleto_id_fuente", "fuente", "fecha_inicio", "total_paginas",
        "paginas_procesadas", "confianza_ocr_prom", "tasa_util_prom", "estado")


def records_with_product(star: Star) -> DataFrame:
    """Records joined to their product row; a price without one is dropped.

    The link never leaves the flyer, so the flyer id is part of the join key: a table
    bucketed by flyer is joined in place.
    """
    products = star.extracciones.filter("tipo = 'PRODUCTO'").select(
        "folleto_id", F.col("id").alias("producto_extraccion_id"),
        F.col("metodo_norm").alias("_product_method"))
    return (
        views.records(star)
        .join(products, ["folleto_id", "producto_extraccion_id"])
        .withColumn("metodo", F.coalesce("metodo_norm", "_product_method"))
        .drop("_product_method")
    )


def store_reliability(star: Star, stores=None, start=None, end=None, with_category=None, flyer=None) -> DataFrame:
    """Data figures of every store, also of stores without records."""
    base = filters.with_category(records_with_product(star), with_category, "categoria_nlp")
    flyer = filters.normalize_flyer(flyer)
    if start or end or flyer:
        wanted = filters.of_flyer(star.folletos, flyer)
        wanted = filters.between_dates(wanted, "fecha_inicio", "fecha_inicio", start, end)
        base = base.join(wanted.select(F.col("id").alias("folleto_id")), "folleto_id", "left_semi")
    # One shuffle on the finest key feeds every count: repeats, flyers and totals per store.
    lines = base.groupBy("tienda_id", "folleto_id", "pagina_id", "texto_norm", "valor").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("metodo").isin(*CATALOGUE_METHODS)).alias("cat"),
        count_where(F.col("metodo") == "heuristico").alias("heu"),
        count_where(is_blank(F.col("categoria_nlp"))).alias("sin"),
        count_where(~filters.plausible(F.col("valor"))).alias("ati"),
        F.sum(F.col("confianza_ocr").cast("decimal(18,6)")).alias("conf"),
        F.count("confianza_ocr").alias("nconf"),
    )
    per_flyer = lines.groupBy("tienda_id", "folleto_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "cat", "heu", "sin", "ati", "conf", "nconf")],
        F.sum(F.col("n") - 1).alias("dup"))
    per_store = per_flyer.groupBy("tienda_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "cat", "heu", "sin", "ati", "conf", "nconf", "dup")],
        F.count(F.lit(1)).alias("fol"))
    medians = exact_median(base.filter("confianza_ocr IS NOT NULL"), ["tienda_id"], "confianza_ocr", "med")
    facts = per_store.join(medians, "tienda_id", "left").withColumnRenamed("tienda_id", "id")

    shops = filters.one_of(star.tiendas, "nombre", stores)
    if flyer:
        owners = filters.of_flyer(star.folletos, flyer).select(F.col("tienda_id").alias("id"))
        shops = shops.join(owners, "id", "left_semi")
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    return shops.join(facts, "id", "left").select(
        F.col("slug").alias("tienda_slug"), F.col("nombre").alias("tienda"),
        F.coalesce(n, zero).alias("registros"),
        F.coalesce("cat", zero).alias("reg_catalogo"),
        F.coalesce("sin", zero).alias("reg_sin_categoria"),
        F.coalesce("fol", zero).alias("folletos_con_precio"),
        percentage(F.col("cat"), n).alias("pct_catalogo"),
        percentage(F.col("heu"), n).alias("pct_heuristico"),
        percentage(F.col("sin"), n).alias("pct_sin_categoria"),
        half_up(F.col("conf").cast("double") / F.nullif("nconf", F.lit(0)), 3).alias("conf_ocr_media"),
        half_up(F.col("med"), 3).alias("conf_ocr_mediana"),
        percentage(F.col("dup"), n).alias("pct_duplicados"),
        F.coalesce("ati", zero).alias("atipicos"),
    ).orderBy(F.col("registros").desc(), "tienda")


def reliability_totals(rows: DataFrame) -> DataFrame:
    """Totals of the reliability panel.  Here the heuristic share is everything outside the
    catalogue; the per-store column counts the method ``heuristico`` only."""
    total, cat = F.sum("registros"), F.sum("reg_catalogo")
    return rows.agg(
        total.alias("registros"),
        percentage(cat, total).alias("pct_catalogo"),
        percentage(total - cat, total).alias("pct_heuristico"),
        percentage(F.sum("reg_sin_categoria"), total).alias("pct_sin_categoria"),
    )


def store_coverage(star: Star, as_of, stores=None, with_category=None) -> DataFrame:
    """Freshness and coverage of every store.  Pages, prices and errors are each counted
    per flyer or store before they meet, so none multiplies another."""
    day = F.lit(str(as_of)).cast("date")
    pages = star.paginas.groupBy("folleto_id").agg(
        F.count(F.lit(1)).alias("paginas"),
        count_where(F.col("total_precios") > 0).alias("con_precio"))
    prices = filters.with_category(views.records(star), with_category, "categoria_nlp").groupBy(
        "folleto_id").agg(F.count(F.lit(1)).alias("precios"))
    errors = star.errores_carga.groupBy(F.col("tienda_slug").alias("slug")).agg(
        count_where(~F.col("resuelto")).alias("abiertos"), F.count(F.lit(1)).alias("total"))
    reliable = F.col("anomalia_fecha").isNull() | ~F.col("anomalia_fecha").isin(*UNRELIABLE_START)
    live = F.col("vigente")
    amount = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    flyers = (
        views.flyer_validity(star, as_of).withColumnRenamed("id", "folleto_id")
        .join(pages, "folleto_id", "left").join(prices, "folleto_id", "left")
        .groupBy(F.col("tienda_id").alias("id")).agg(
            F.count(F.lit(1)).alias("folletos_total"),
            count_where(live).alias("folletos_vigentes"),
            count_where(F.col("vigente_dudoso")).alias("vigentes_fecha_dudosa"),
            count_where(F.col("proximo")).alias("proximos"),
            count_where(F.col("anomalia_fecha").isNotNull()).alias("folletos_fecha_anomala"),
            F.max(F.when((F.col("fecha_inicio") <= day) & reliable, F.col("fecha_inicio")))
            .alias("fecha_ultimo_folleto"),
            F.max("scrapeado_at").cast("date").alias("ultimo_scrapeo"),
            F.sum(amount("paginas")).alias("paginas_total"),
            F.sum(F.when(live, amount("paginas"))).alias("paginas_vigentes"),
            F.sum(F.when(live, amount("con_precio"))).alias("paginas_vig_con_precio"),
            F.sum(F.when(live, amount("precios"))).alias("precios_vigentes"),
            F.sum(amount("precios")).alias("precios_total"),
        )
    )
    rows = filters.one_of(star.tiendas, "nombre", stores).join(flyers, "id", "left").join(errors, "slug", "left")
    return rows.select(
        F.col("slug").alias("tienda_slug"), F.col("nombre").alias("tienda"),
        *[amount(c).alias(c) for c in ("folletos_total", "folletos_vigentes", "vigentes_fecha_dudosa", "proximos")],
        "fecha_ultimo_folleto",
        F.date_diff(day, F.col("fecha_ultimo_folleto")).alias("dias_desde_ultimo"),
        "ultimo_scrapeo",
        *[amount(c).alias(c) for c in ("paginas_vigentes", "paginas_vig_con_precio", "precios_vigentes",
                                       "paginas_total", "precios_total", "folletos_fecha_anomala")],
        amount("abiertos").alias("errores_abiertos"),
        amount("total").alias("errores_total"),
    ).orderBy(F.col("folletos_vigentes").desc(), F.col("dias_desde_ultimo").asc_nulls_last(), "tienda")


def coverage_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("tiendas"),
        count_where(F.col("folletos_vigentes") > 0).alias("tiendas_con_vigente"),
        *[F.sum(c).alias(c) for c in ("folletos_vigentes", "vigentes_fecha_dudosa", "proximos",
                                      "precios_vigentes", "paginas_vigentes")],
        F.max("ultimo_scrapeo").alias("ultimo_scrapeo"))


def first_pages(star: Star) -> DataFrame:
    """Page with the lowest number of each flyer."""
    return star.paginas.groupBy("folleto_id").agg(F.min_by("id", "numero_pagina").alias("primera_pagina_id"))


def doubtful_flyers(star: Star, as_of, stores=None) -> DataFrame:
    df = filters.one_of(views.flyer_validity(star, as_of).filter("anomalia_fecha IS NOT NULL"), "tienda", stores)
    pages = first_pages(star).withColumnRenamed("folleto_id", "id")
    return df.join(pages, "id", "left").select(
        "id", "tienda", "folleto_id_fuente", "fuente", "titulo", "fecha_inicio", "fecha_fin",
        F.col("scrapeado_at").cast("date").alias("scrapeado"), "anomalia_fecha", "vigente_dudoso",
        safe_url(F.col("url_origen")).alias("url_origen"), "primera_pagina_id",
    ).orderBy("anomalia_fecha", "tienda", F.col("fecha_inicio").asc_nulls_last(), "id")


def flyers_per_week(star: Star, as_of, stores=None, start=None, end=None) -> DataFrame:
    """Flyers by Monday of their start date and store."""
    day = F.lit(str(as_of)).cast("date")
    since = F.lit(str(start)).cast("date") if start else F.date_sub(day, WEEKS_BACK_DAYS)
    until = F.lit(str(end)).cast("date") if end else F.date_add(day, WEEKS_AHEAD_DAYS)
    reliable = F.col("anomalia_fecha").isNull() | ~F.col("anomalia_fecha").isin(*UNRELIABLE_START)
    df = views.flyer_validity(star, as_of).filter(
        reliable & (F.col("fecha_inicio") >= since) & (F.col("fecha_inicio") <= until))
    week = F.date_trunc("week", F.col("fecha_inicio")).cast("date")
    return filters.one_of(df, "tienda", stores).groupBy(week.alias("semana"), "tienda").agg(
        F.count(F.lit(1)).alias("folletos")).orderBy("semana", "tienda")


def weekly_series(weeks: DataFrame, keep: int = 7) -> DataFrame:
    """Folds the weekly counts to the stores with most flyers and ``Otras``."""
    totals = weeks.groupBy("tienda").agg(F.sum("folletos").alias("t"))
    best = totals.orderBy(F.col("t").desc(), "tienda").limit(keep).select("tienda", F.col("tienda").alias("serie"))
    return weeks.join(F.broadcast(best), "tienda", "left").groupBy(
        "semana", F.coalesce("serie", F.lit("Otras")).alias("serie")
    ).agg(F.sum("folletos").alias("folletos")).orderBy("semana", "serie")


# -- explorer ----------------------------------------------------------------------------

def list_stores(star: Star) -> DataFrame:
    return star.tiendas.filter("activa").select("id", "nombre", "slug").orderBy("nombre")


def list_categories(star: Star) -> DataFrame:
    df = filters.with_category(views.records(star), "si", "categoria_nlp")
    return df.select(F.col("categoria_nlp").alias("categoria")).distinct().orderBy("categoria")


def list_stores_detail(star: Star) -> DataFrame:
    counts = star.folletos.groupBy(F.col("tienda_id").alias("id")).agg(F.count(F.lit(1)).alias("num_folletos"))
    return star.tiendas.join(counts, "id", "left").select(
        "id", "nombre", "slug", "fuente_slug", "activa", "created_at",
        F.coalesce("num_folletos", F.lit(0).cast("bigint")).alias("num_folletos")).orderBy("nombre")


def list_flyers(star: Star, store_id=None, flyer=None, limit: int = 200) -> DataFrame:
    df = filters.equal_to(filters.of_flyer(star.folletos, flyer), "tienda_id", store_id)
    top = df.orderBy(F.col("created_at").desc(), "id").limit(limit)
    stores = star.tiendas.select(F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda"))
    few = top.select(F.col("id").alias("folleto_id"))
    pages = star.paginas.join(few, "folleto_id", "left_semi").groupBy(F.col("folleto_id").alias("id")).agg(
        F.min_by(F.struct(F.col("id")), "numero_pagina")["id"].alias("primera_pagina_id"))
    rows = top.join(stores, "tienda_id").join(pages, "id", "left").select(
        "id", "tienda", "fuente", "folleto_id_fuente", "titulo", "fecha_inicio", "fecha_fin", "total_paginas",
        "estado", "scrapeado_at", "created_at", safe_url(F.col("url_origen")).alias("url_origen"),
        "primera_pagina_id")
    return promos.attach_campaigns(rows, star.eventos_promo, "id")


def list_types(star: Star) -> DataFrame:
    return star.extracciones.select("tipo").distinct().orderBy("tipo")


def list_extractions(star: Star, store_id=None, flyer_id=None, kind=None, with_category=None, flyer=None,
                     limit: int = 200) -> DataFrame:
    df = filters.with_category(star.extracciones, with_category, "categoria_nlp")
    df = filters.equal_to(df, "tienda_id", store_id)
    df = filters.equal_to(df, "folleto_id", flyer_id)
    df = filters.equal_to(df, "tipo", kind)
    if filters.normalize_flyer(flyer):
        wanted = filters.of_flyer(star.folletos, flyer).select(F.col("id").alias("folleto_id"))
        df = df.join(wanted, "folleto_id", "left_semi")
    top = df.orderBy(F.col("created_at").desc(), "id").limit(limit)
    stores = star.tiendas.select(F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda"))
    names = star.productos_canonicos.select(F.col("id").alias("producto_canonico_id"), "nombre_canonico")
    rows = top.join(stores, "tienda_id").join(names, "producto_canonico_id", "left").select(
        "id", "tienda", "folleto_id", "tipo", "texto_raw", "texto_norm", "categoria_nlp", "valor",
        "valor_anterior", "confianza_ocr", "nombre_canonico", "created_at", "pagina_id")
    return promos.attach_campaigns(rows, star.eventos_promo)


# -- promotions --------------------------------------------------------------------------

def promotions(star: Star, as_of, stores=None, flyer=None, campaigns=None, state=None, event_class=None,
               categories=None) -> DataFrame:
    """Events at (flyer, class, campaign) grain with the prices of their flyer."""
    wanted_class = event_class if event_class in (*promos.EVENT_CLASSES, "todas") else "campania"
    campaigns = promos.normalize_campaigns(campaigns)
    events = promos.classify_events(star.eventos_promo)
    if wanted_class != "todas":
        events = events.filter(F.col("clase") == wanted_class)
    events = filters.one_of(events, "campania", campaigns)
    shown = F.trim(F.coalesce(F.nullif("texto_raw", F.lit("")), "nombre_evento"))
    groups = events.groupBy(
        "folleto_id", "clase", F.coalesce("campania", "nombre_evento").alias("clave")
    ).agg(F.sort_array(F.collect_set(shown)).alias("textos_detectados"), F.count(F.lit(1)).alias("eventos"))

    flyers = filters.of_flyer(views.flyer_validity(star, as_of), flyer)
    flyers = filters.one_of(flyers, "tienda", stores).withColumn(
        "vigencia", views.validity_state(F.col("vigente"), F.col("vigente_dudoso"), F.col("proximo")))
    if state in VALIDITY_NAMES:
        flyers = flyers.filter(F.col("vigencia") == state)
    flyers = flyers.withColumnRenamed("id", "folleto_id")
    counted = filters.one_of(views.records(star), "categoria_nlp", categories)
    prices = counted.join(groups.select("folleto_id").distinct(), "folleto_id", "left_semi").groupBy(
        "folleto_id").agg(F.count(F.lit(1)).alias("precios_en_folleto"))
    is_campaign = F.col("clase") == "campania"
    state_names = F.create_map(*[F.lit(x) for kv in VALIDITY_NAMES.items() for x in kv])
    rows = (
        groups.join(flyers, "folleto_id")
        .join(prices, "folleto_id", "inner" if categories else "left")
        .join(first_pages(star), "folleto_id", "left")
    )
    return rows.select(
        "folleto_id", "tienda", "fuente", "folleto_id_fuente", F.col("titulo").alias("folleto_titulo"),
        F.col("fecha_inicio").alias("vigencia_desde"), F.col("fecha_fin").alias("vigencia_hasta"),
        "anomalia_fecha", "vigencia", state_names[F.col("vigencia")].alias("vigencia_nombre"),
        "clase", promos.class_name(F.col("clase")).alias("clase_nombre"),
        F.when(is_campaign, F.col("clave")).alias("campania"),
        F.when(is_campaign, promos.campaign_name(F.col("clave"))).otherwise(F.col("clave")).alias("nombre"),
        "textos_detectados", "eventos",
        F.coalesce("precios_en_folleto", F.lit(0).cast("bigint")).alias("precios_en_folleto"),
        "primera_pagina_id",
    ).orderBy(F.col("vigencia") != "vigente", "tienda", "folleto_id_fuente", "nombre")


def promotion_kpis(rows: DataFrame) -> DataFrame:
    """Counts of the promotions panel; the prices of a flyer are added once."""
    per_flyer = rows.groupBy("folleto_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("precios_en_folleto").alias("p"),
        F.max((F.col("vigencia") == "vigente").cast("int")).alias("v"))
    totals = per_flyer.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.count(F.lit(1)).alias("folletos"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("precios_en_folletos"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("vigentes"))
    names = rows.agg(F.count_distinct("campania").alias("campanias"), F.count_distinct("tienda").alias("tiendas"))
    return one_row(totals, names)


# -- load errors -------------------------------------------------------------------------

def error_kpis(star: Star) -> DataFrame:
    open_ = ~F.col("resuelto")
    return star.errores_carga.agg(
        count_where(open_).alias("abiertos"),
        F.count_distinct(F.when(open_, F.struct("fuente", "folleto_id_fuente"))).alias("folletos_afectados"),
        count_where(F.col("resuelto")).alias("resueltos"),
        F.max("corrida_at").alias("ultima_corrida"))


def errors_by_category(star: Star, **wanted) -> DataFrame:
    """Counts of every category, also of those without errors."""
    errors = filters.load_errors(star.errores_carga, **wanted)
    counts = errors.agg(*[count_where(F.col("categoria") == c).alias(c) for c in ERROR_CATEGORIES])
    pairs = ", ".join(f"'{c}', `{c}`" for c in ERROR_CATEGORIES)
    return counts.selectExpr(f"stack({len(ERROR_CATEGORIES)}, {pairs}) AS (categoria, n)")


def error_rows(star: Star, limit: int = 1000, **wanted) -> DataFrame:
    order = [F.col("corrida_at").desc(), "fuente", "folleto_id_fuente", F.col("pagina").asc_nulls_last(), "id"]
    return filters.load_errors(star.errores_carga, **wanted).orderBy(*order).limit(limit)


def hidden_errors(star: Star, state, flyer, **wanted) -> DataFrame | None:
    """Errors left out only by the state filter; asked for with a state and a flyer."""
    opposite = {"abiertos": "resueltos", "resueltos": "abiertos"}.get(state)
    if opposite is None or filters.normalize_flyer(flyer) is None:
        return None
    rows = filters.load_errors(star.errores_carga, state=opposite, flyer=flyer, **wanted)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(opposite).alias("estado_oculto"), F.lit(state).alias("estado_filtro"))


def error_stores(star: Star) -> DataFrame:
    return star.errores_carga.filter("tienda_slug IS NOT NULL").select("tienda_slug").distinct().orderBy("tienda_slug")


# -- page viewer -------------------------------------------------------------------------

def neighbour_pages(star: Star) -> DataFrame:
    """Previous and next page of each page; a flyer has a bounded number of pages."""
    w = Window.partitionBy("folleto_id").orderBy("numero_pagina")
    return star.paginas.select("id", "folleto_id", "numero_pagina",
                               F.lag("id").over(w).alias("anterior"), F.lead("id").over(w).alias("siguiente"))


def page_blocks(star: Star, page_id=None) -> DataFrame:
    """Extractions of a page in reading order."""
    df = filters.equal_to(star.extracciones, "pagina_id", page_id)
    return df.select("id", "pagina_id", "tipo", "texto_raw", "valor", "bbox_x", "bbox_y", "bbox_ancho",
                     "bbox_alto").orderBy("pagina_id", "bbox_y", "bbox_x", "id")


def page_prices(star: Star, page_id=None) -> DataFrame:
    """Price and product pairs, with a mark on prices repeated within their page.

    Repeats are counted where the rows of one page, name and price meet, so the rows are read and
    dealt once; a page that holds a large part of all rows is spread by its names and prices.
    """
    shown = ["pagina_id", "texto_norm", "valor"]
    base = filters.equal_to(records_with_product(star), "pagina_id", page_id).filter("pagina_id IS NOT NULL")
    repeated = F.count(F.lit(1)).over(Window.partitionBy(*shown))
    return base.withColumn("veces", repeated).select(
        "id", *shown, "valor_anterior", "categoria_nlp", "confianza_ocr", "producto_extraccion_id",
        F.coalesce(F.col("metodo").isin(*CATALOGUE_METHODS), F.lit(False)).alias("es_catalogo"),
        F.when(F.col("valor_anterior") > 0, views.discount_pct(F.col("valor"), F.col("valor_anterior")))
        .alias("descuento_pct"),
        (F.col("veces") > 1).alias("repetido"),
        "bbox_x", "bbox_y", "bbox_ancho", "bbox_alto")


def prices_without_product(star: Star, page_id=None) -> DataFrame:
    """Price rows of each page that the price list leaves out."""
    listed = views.is_record() & F.col("producto_extraccion_id").isNotNull()
    rows = filters.equal_to(star.precios(), "pagina_id", page_id)
    return rows.groupBy("pagina_id").agg(count_where(~listed).alias("precios_sin_producto"))


def page_boxes(star: Star, image_width: int, image_height: int) -> DataFrame:
    """Extraction boxes as percentages of the page image."""
    box = geometry.box_percent("bbox_x", "bbox_y", "bbox_ancho", "bbox_alto", image_width, image_height)
    return star.extracciones.select("id", "pagina_id", *[c.alias(n) for n, c in box.items()])


# -- reconciliation ----------------------------------------------------------------------

def control_counts(star: Star) -> DataFrame:
    """The control counts taken before and after a reload, in one row."""
    prices = star.precios().agg(
        F.count(F.lit(1)).alias("precio_filas"),
        count_where(views.is_record()).alias("dashboard_registros"),
        count_where(F.col("metodo_norm").isNotNull()).alias("precio_con_metodo_norm"),
        count_where(views.is_record() & is_blank(F.col("categoria_nlp"))).alias("sin_categoria"),
        count_where(F.col("valor") >= 1000).alias("precios_mil_o_mas"))
    catalogue = records_with_product(star).agg(
        F.count(F.lit(1)).alias("registros"),
        count_where(F.col("metodo").isin(*CATALOGUE_METHODS)).alias("catalogo"))
    catalogue = catalogue.withColumn("pct_catalogo", percentage(F.col("catalogo"), F.col("registros")))
    ranges = views.price_ranges(star).agg(
        F.count(F.lit(1)).alias("comparativa_grupos"),
        F.coalesce(F.sum("num_registros"), F.lit(0)).alias("comparativa_registros"))
    sizes = [star.folletos.agg(F.count(F.lit(1)).alias("folletos")),
             star.eventos_promo.agg(F.count(F.lit(1)).alias("eventos")),
             star.extracciones.agg(F.count(F.lit(1)).alias("extracciones"))]
    return one_row(prices, catalogue, ranges, *sizes)


def high_prices_per_store(star: Star, minimum: float = 1000) -> DataFrame:
    counts = star.precios().filter(F.col("valor") >= minimum).groupBy(F.col("tienda_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    return star.tiendas.join(counts, "id").select("slug", "n").orderBy("slug")


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences between two one-row snapshots in long form."""
    names = [c for c in before.columns if c in after.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in names)
        return df.selectExpr(f"stack({len(names)}, {pairs}) AS (control, {name})")

    return long(before, "antes").join(long(after, "despues"), "control").withColumn(
        "cambio", F.col("despues") - F.col("antes"))


def unused_names(star: Star) -> DataFrame:
    """Canonical names that no extraction uses."""
    used = star.extracciones.select(F.col("producto_canonico_id").alias("id")).filter("id IS NOT NULL").distinct()
    return star.productos_canonicos.join(used, "id", "left_anti")


def mark_blocks(blocks: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Text blocks that coincide with a named box of a record.

    ``boxes`` has the page keys, ``registro``, ``caja`` (price or product) and a box;
    the result lists the positions of the blocks per record and box.
    """
    from ..operators.spatial import boxes_meeting
    b = blocks.select(*page, "bloque", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "ancho", "alto")])
    x, y, w, h = (F.col(c) for c in ("x", "y", "ancho", "alto"))
    ox, oy, ow, oh = (F.col(f"o_{c}") for c in ("x", "y", "ancho", "alto"))
    near = boxes_meeting(boxes.select(*page, "registro", "caja", "x", "y", "ancho", "alto"), b, page,
                         (x, y, x + w, y + h), (ox, oy, ox + ow, oy + oh))
    same = geometry.boxes_coincide(("o_x", "o_y", "o_ancho", "o_alto"), ("x", "y", "ancho", "alto"))
    return near.filter(same).groupBy(*page, "registro", "caja").agg(
        F.sort_array(F.collect_list("bloque")).alias("bloques"))


def reading_order(blocks: DataFrame, page: list[str], band: int = 20) -> DataFrame:
    """Blocks by bands of height, then from left to right."""
    return blocks.orderBy(*page, F.floor(F.col("y") / band), "x", "bloque")
