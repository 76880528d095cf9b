"""Incremental load of the star: what is pending, upserts, rejections and the error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_name
from ..operators.cut import cut_lineage
from .naming import accepted_products, event_dimension
from .panels import ERROR_CATEGORIES, count_where

# Stores that belong to a chain.
CHAINS = {"soriana_hiper": "soriana", "soriana_mercado": "soriana", "walmart": "walmart", "walmart_express": "walmart"}
# Longest texts of the star columns.
MAX_LENGTHS = {"texto_norm": 300, "categoria_nlp": 50, "nombre_canonico": 150, "slug": 50, "nombre": 100,
               "folleto_id_fuente": 50, "archivo_imagen": 100}
# Allowed values of the enumerated columns.
KINDS = ("PRODUCTO", "PRECIO", "PRECIO_ANTERIOR", "AHORRO", "PROMO", "EVENTO_PROMO", "ATRIBUTO", "DESCARTE")
# Error category by state code.
STATE_CATEGORIES = {"22001": "tamano_excesivo", "22003": "valor_fuera_de_rango", "22P02": "formato_invalido",
                    "22007": "formato_invalido", "22008": "formato_invalido"}
# Kinds that are classified but not stored.
NOT_STORED = ("PRECIO_ANTERIOR", "AHORRO", "DESCARTE")


def pending(landed: DataFrame, done: DataFrame, keys=("fuente", "folleto_id")) -> DataFrame:
    """Landed rows whose key is not done yet."""
    return landed.join(done.select(*keys).distinct(), list(keys), "left_anti")


def error_category(state: Column, failure: Column) -> Column:
    """Category of an error from its state code or, without one, the kind of failure."""
    known = F.coalesce(*[F.when(state == s, c) for s, c in STATE_CATEGORIES.items()],
                       F.when(state.startswith("23"), "violacion_integridad"), F.lit("otro"))
    plain = F.when(failure == "json", "json_corrupto").when(failure == "archivo", "archivo_faltante").otherwise("otro")
    return F.when(F.coalesce(state, F.lit("")) != "", known).otherwise(plain)


# -- upserts -------------------------------------------------------------------------------

def corrected_stores(slugs: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Store slug and name; (fuente, slug_raw) corrections win over the name made from the slug."""
    rows = slugs.withColumn("_name", display_name(F.col("slug_raw")))
    if corrections is None:
        return rows.select("*", F.col("slug_raw").alias("slug"), F.col("_name").alias("nombre")).drop("_name")
    fix = corrections.select("fuente", "slug_raw", F.col("slug").alias("_slug"), F.col("nombre").alias("_fixed"))
    return rows.join(fix, ["fuente", "slug_raw"], "left").select(
        *slugs.columns, F.coalesce("_slug", "slug_raw").alias("slug"), F.coalesce("_fixed", "_name").alias("nombre"))


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep=(), update=(), fill=()) -> DataFrame:
    """Upsert: one row per key.

    Of several incoming rows of a key the first in ``order`` counts.  Columns in ``keep``
    stay as they are once set, those in ``update`` take the new value, those in ``fill``
    take it unless it is NULL; any other column of an existing row stays.
    """
    rest = [c for c in existing.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_n"))
    old = existing.select(*keys, F.struct(*rest).alias("_o"))
    both = old.join(first, keys, "full_outer")

    def value(c: str) -> Column:
        o, n = F.col("_o")[c], F.col("_n")[c]
        if c in update:
            changed = n
        elif c in fill:
            changed = F.coalesce(n, o)
        elif c in keep:
            changed = F.coalesce(o, n)
        else:
            changed = o
        return F.when(F.col("_o").isNull(), n).when(F.col("_n").isNull(), o).otherwise(changed)

    return both.select(*keys, *[value(c).alias(c) for c in rest]).select(*existing.columns)


def upsert_stores(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stores by slug; an existing store only gets a chain if it has none."""
    chain = F.coalesce(*[F.when(F.col("slug") == s, c) for s, c in CHAINS.items()])
    ready = incoming.withColumn("cadena", chain)
    return merge(existing, ready, ["slug"], ["nombre"], keep=("cadena",))


def upsert_flyers(existing: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Flyers by (source, id): ignored when known, or replaced keeping what comes empty."""
    keys = ["fuente", "folleto_id_fuente"]
    order = ["scrapeado_at", "titulo", "url_origen"]
    if not replace:
        return merge(existing, incoming, keys, order)
    return merge(existing, incoming, keys, order, update=("tienda_id", "total_paginas", "estado"), fill=(
        "titulo", "fecha_inicio", "fecha_fin", "url_origen", "perfil_ocr", "motor_ocr", "scrapeado_at"))


def upsert_pages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages by (flyer, number): the row stays, its metrics are those of the last load."""
    keys = ["folleto_id", "numero_pagina"]
    metrics = tuple(c for c in existing.columns if c.startswith(("total_", "confianza_", "tasa_")))
    return merge(existing, incoming, keys, ["archivo_imagen"], update=metrics)


def replace_children(existing: DataFrame, incoming: DataFrame, flyers: DataFrame, key: str = "folleto_id") -> DataFrame:
    """Rows of reloaded flyers are all replaced; the others stay.

    Few flyers are broadcast.  Where a large part of them is reloaded, give ``flyers`` with the hint
    ``shuffle_hash``: a task then holds its distinct flyers only, while rows of both sides pass by unsorted.
    """
    return existing.join(flyers.select(key).distinct(), key, "left_anti").unionByName(incoming)


def write_buckets(rows: DataFrame, path: str, key: str = "folleto_id", buckets: int = 256) -> None:
    """Rewrites only the buckets of the given flyers.

    ``rows`` must hold every row of the touched buckets.  Whole partitions are swapped, so
    a failed load leaves the previous ones in place.  ``buckets`` is fixed when the table is
    made; a large bucket is written by many tasks.
    """
    marked = rows.withColumn("cubeta", F.pmod(F.xxhash64(key), F.lit(buckets)))
    marked.hint("rebalance", "cubeta").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("cubeta").parquet(path)


# -- rejections and the error log ------------------------------------------------------------

def rejections(rows: DataFrame, max_value: float = 1e12) -> Column:
    """Category of the first rule a row breaks, NULL for a good row."""
    cols = set(rows.columns)
    steps = [F.when(F.length(c) > n, "tamano_excesivo") for c, n in MAX_LENGTHS.items() if c in cols]
    if "valor" in cols:
        steps.append(F.when(F.isnan("valor") | (F.abs("valor") > max_value), "valor_fuera_de_rango"))
    if "tipo" in cols:
        steps.append(F.when(~F.col("tipo").isin(*KINDS), "formato_invalido"))
    for c in ("folleto_id", "pagina_id", "tipo"):
        if c in cols:
            steps.append(F.when(F.col(c).isNull(), "violacion_integridad"))
    return F.coalesce(*steps)


def split_rejected(rows: DataFrame, page: str = "pagina_id") -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and one error per page that cannot.

    A page with a bad row is left out as a whole; the other pages of its flyer go on.
    """
    judged = rows.withColumn("_error", rejections(rows))
    bad = judged.filter("_error IS NOT NULL").groupBy(page).agg(
        F.min("_error").alias("categoria"), F.count(F.lit(1)).alias("filas"))
    good = judged.join(bad.select(page), page, "left_anti").drop("_error")
    return good, bad


def append_errors(log: DataFrame, errors: DataFrame) -> DataFrame:
    return log.unionByName(errors, allowMissingColumns=True)


def resolve_errors(log: DataFrame, loads: DataFrame) -> DataFrame:
    """Open errors of a flyer are resolved by a later load of it that succeeded."""
    keys = ["fuente", "folleto_id_fuente"]
    last = loads.groupBy(*keys).agg(F.max("corrida_at").alias("_ok"))
    done = ~F.col("resuelto") & F.coalesce(F.col("corrida_at") < F.col("_ok"), F.lit(False))
    return log.join(last, keys, "left").withColumns({
        "resuelto_at": F.when(done, F.col("_ok")).otherwise(F.col("resuelto_at")),
        "resuelto": F.col("resuelto") | done}).drop("_ok").select(*log.columns)


def batch_totals(flyers: DataFrame, errors: DataFrame) -> DataFrame:
    """Totals of a load: flyers done, skipped and failed, and errors by category."""
    n = lambda s: count_where(F.col("resultado") == s)
    done = flyers.agg(n("procesado").alias("procesados"), n("omitido").alias("omitidos"), n("error").alias("errores"))
    kinds = errors.agg(*[count_where(F.col("categoria") == c).alias(f"errores_{c}") for c in ERROR_CATEGORIES])
    from .panels import one_row
    return one_row(done, kinds)


# -- from classified pages to facts ------------------------------------------------------------

def page_facts(classified: DataFrame, page: list[str], normalize, regions: DataFrame | None = None) -> DataFrame:
    """Extraction rows of classified pages.

    Ids are the natural key, so a price knows its product row before anything is written.
    ``normalize`` turns distinct texts in column ``texto`` into names.
    """
    from .association import associate, choose_above
    blocks = cut_lineage(classified)
    shown = blocks.filter("tipo = 'PRODUCTO'").withColumn("texto", F.col("texto_norm"))
    names = cut_lineage(normalize(shown.select("texto").distinct()))
    products = cut_lineage(accepted_products(shown, names, page))
    prices = associate(blocks.withColumn("texto", F.col("texto_norm")), products, page, normalize, regions)
    attributes = blocks.filter("tipo = 'ATRIBUTO' AND x IS NOT NULL")
    owners = choose_above(attributes, products.filter("NOT ilegible"), page)
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    ident = lambda kind, block: F.concat_ws("/", *page, F.lit(kind), block)
    box = ("x", "y", "ancho", "alto")
    boxes = [F.col(c).alias(f"bbox_{c}") for c in box]

    def rows(df, kind, **values):
        base = {"texto_raw": F.col("texto_norm"), "texto_norm": none, "categoria_nlp": none, "valor": no_number,
                "valor_anterior": no_number, "producto_extraccion_id": none, "nombre_canonico": none,
                "confianza_norm": no_number, "metodo_norm": none, **values}
        return df.select(*page, ident(kind, F.col("bloque")).alias("id"), F.lit(kind).alias("tipo"),
                         F.col("confianza").alias("confianza_ocr"), *boxes, *[c.alias(n) for n, c in base.items()])

    product_rows = rows(
        products.filter("NOT ilegible"), "PRODUCTO", texto_raw=F.col("texto"), texto_norm=F.col("nombre_canonico"),
        categoria_nlp=F.nullif("categoria", F.lit("")), nombre_canonico=F.col("nombre_canonico"),
        confianza_norm=F.col("confianza_norm"), metodo_norm=F.col("metodo_norm"))
    link = F.when(F.col("producto").isNotNull(), ident("PRODUCTO", F.col("producto")))
    price_rows = rows(
        prices, "PRECIO", texto_raw=F.col("texto"), texto_norm=F.col("texto_norm"), categoria_nlp=F.col("categoria_nlp"),
        valor=F.col("valor"), valor_anterior=F.col("valor_anterior"), producto_extraccion_id=link,
        nombre_canonico=F.col("nombre_canonico"), metodo_norm=F.col("metodo_norm"))
    attribute_rows = rows(
        attributes.join(owners, [*page, "bloque"], "left"), "ATRIBUTO", texto_norm=F.col("texto_norm"),
        categoria_nlp=F.nullif("categoria", F.lit("")), producto_extraccion_id=link)
    promo_rows = rows(blocks.filter("tipo = 'PROMO'"), "PROMO", texto_norm=F.col("texto_norm"))
    event_rows = rows(blocks.filter("tipo = 'EVENTO_PROMO' AND evento IS NOT NULL"), "EVENTO_PROMO",
                      texto_norm=F.col("evento"))
    return product_rows.unionByName(price_rows).unionByName(attribute_rows).unionByName(promo_rows).unionByName(event_rows)


def flyer_events(classified: DataFrame, flyers: DataFrame) -> DataFrame:
    """Event rows of flyers from their event blocks (``folleto_id``, ``evento``, ``texto``, ``bloque``)."""
    blocks = classified.filter("tipo = 'EVENTO_PROMO' AND evento IS NOT NULL").withColumnRenamed("evento", "nombre_evento")
    return event_dimension(blocks, flyers, "bloque")
