"""Panels over the star, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from octavilla.functions import promos
from octavilla.plans import filters, panels, views

from .common import (AS_OF, BLANK, CATALOGUE, DAY, RECORD, UNRELIABLE, pct, rnd, star_of, star_query)

QUERIES: dict = {}
ORACLES: dict = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _joined(df, column="campanias"):
    return df.withColumn(column, F.array_join(column, ","))


def _no_category(column: str) -> str:
    return BLANK.format(c=column)


# -- prices ------------------------------------------------------------------------------

_PRICE_COLUMNS = """v.id, v.tienda, v.producto, v.categoria, v.precio_actual, v.precio_anterior, v.descuento_pct,
    v.vigencia_desde, v.vigencia_hasta, v.confianza_ocr, v.pagina_id, v.folleto_id, v.folleto_id_fuente,
    v.folleto_titulo, u.url AS url_origen, p.numero_pagina, coalesce(c.campanias, '') AS campanias"""
_PRICE_JOINS = """LEFT JOIN urls u ON u.folleto_id = v.folleto_id LEFT JOIN paginas p ON p.id = v.pagina_id
    LEFT JOIN camps c ON c.folleto_id = v.folleto_id"""


def _prices_sql(where: str = "", limit: int = 500, **extra) -> str:
    return star_query(
        f"SELECT {_PRICE_COLUMNS} FROM (SELECT * FROM vpa r {where} ORDER BY descuento_pct DESC NULLS LAST, id"
        f" LIMIT {limit}) v {_PRICE_JOINS}", "vpa", "camps", "urls", **extra)


@check("current_prices", _prices_sql())
def _(spark, sf):
    return _joined(panels.current_prices(star_of(spark, sf)))


@check("current_prices_filtered", _prices_sql(
    f"""WHERE lower(producto) LIKE '%widget%' AND categoria IN ('economy', 'small', 'promo')
        AND vigencia_desde >= DATE '1996-01-01' AND vigencia_hasta <= DATE '2000-12-31'
        AND descuento_pct IS NOT NULL AND NOT ({_no_category('categoria')})
        AND EXISTS (SELECT 1 FROM evc x JOIN folletos f ON f.id = x.folleto_id WHERE x.clase = 'campania'
            AND f.fuente = r.fuente AND f.folleto_id_fuente = r.folleto_id_fuente)"""))
def _(spark, sf):
    return _joined(panels.current_prices(
        star_of(spark, sf), categories=["economy", "small", "promo"], start="1996-01-01", end="2000-12-31",
        text="Widget", only_discounted=True, with_category=" SI ", promotion="con"))


@check("current_prices_without_promotion", _prices_sql(
    """WHERE NOT EXISTS (SELECT 1 FROM evc x JOIN folletos f ON f.id = x.folleto_id
            WHERE x.campania IN ('navidad', 'hot_sale')
            AND f.fuente = r.fuente AND f.folleto_id_fuente = r.folleto_id_fuente)"""))
def _(spark, sf):
    return _joined(panels.current_prices(star_of(spark, sf), promotion="sin", campaigns=["navidad", "hot_sale"]))


@check("current_prices_view", star_query(
    """SELECT tienda, fuente, count(*) AS n, count(descuento_pct) AS con_descuento,
        CAST(sum(CAST(descuento_pct AS DECIMAL(18,1))) AS DOUBLE) AS suma_descuento, max(precio_actual) AS maximo
        FROM vpa GROUP BY 1, 2""", "vpa"))
def _(spark, sf):
    return views.current_prices(star_of(spark, sf)).groupBy("tienda", "fuente").agg(
        F.count(F.lit(1)).alias("n"), F.count("descuento_pct").alias("con_descuento"),
        F.sum(F.col("descuento_pct").cast("decimal(18,1)")).cast("double").alias("suma_descuento"),
        F.max("precio_actual").alias("maximo"))


@check("records_in_promotion_flyers", star_query(
    f"""SELECT e.tienda_id, count(*) AS n FROM extracciones e WHERE {RECORD}
        AND EXISTS (SELECT 1 FROM evc x WHERE x.folleto_id = e.folleto_id AND x.campania = 'buen_fin')
        GROUP BY 1""", "evc"))
def _(spark, sf):
    star = star_of(spark, sf)
    df = filters.by_promotion(views.records(star), star, campaigns=["buen_fin"], mode="extraccion")
    return df.groupBy("tienda_id").agg(F.count(F.lit(1)).alias("n"))


@check("price_ranges", star_query("SELECT * FROM vcp", "vcp"))
def _(spark, sf):
    return views.price_ranges(star_of(spark, sf))


_RANGE_ORDER = "ORDER BY diferencia DESC, producto, categoria NULLS FIRST"


@check("price_comparison", star_query(f"SELECT * FROM vcp {_RANGE_ORDER} LIMIT 300", "vcp"))
def _(spark, sf):
    return panels.price_comparison(star_of(spark, sf))


@check("price_comparison_in_flyer", star_query(
    f"""SELECT * FROM vcp v WHERE EXISTS (SELECT 1 FROM extracciones e JOIN folletos f ON f.id = e.folleto_id
        WHERE {RECORD} AND f.folleto_id_fuente = '400001' AND e.texto_norm = v.producto
        AND coalesce(e.categoria_nlp, '') = coalesce(v.categoria, '')) {_RANGE_ORDER} LIMIT 300""", "vcp"))
def _(spark, sf):
    return panels.price_comparison(star_of(spark, sf), flyer=" 400001 ")


@check("price_comparison_by_promotion", star_query(
    f"""SELECT * FROM vcp v WHERE num_tiendas >= 3 AND EXISTS (SELECT 1 FROM extracciones e
        JOIN evc x ON x.folleto_id = e.folleto_id AND x.campania = 'liquidacion'
        WHERE {RECORD} AND e.texto_norm = v.producto
        AND coalesce(e.categoria_nlp, '') = coalesce(v.categoria, '')) {_RANGE_ORDER} LIMIT 300""", "vcp", "evc"))
def _(spark, sf):
    return panels.price_comparison(star_of(spark, sf), min_stores=3, campaigns=["liquidacion"])


_DETAIL = """SELECT e.id, t.nombre AS tienda, e.valor AS precio, f.fecha_inicio AS vigencia_desde,
    f.fecha_fin AS vigencia_hasta, e.pagina_id, p.numero_pagina, e.folleto_id, f.folleto_id_fuente,
    f.titulo AS folleto_titulo, u.url AS url_origen, coalesce(c.campanias, '') AS campanias
    FROM extracciones e JOIN tiendas t ON t.id = e.tienda_id JOIN folletos f ON f.id = e.folleto_id
    LEFT JOIN urls u ON u.folleto_id = f.id LEFT JOIN paginas p ON p.id = e.pagina_id
    LEFT JOIN camps c ON c.folleto_id = e.folleto_id
    WHERE e.tipo = 'PRECIO' AND e.valor IS NOT NULL AND e.texto_norm = 'Medio kilo de red widget'"""


@check("comparison_detail", star_query(_DETAIL, "camps", "urls"))
def _(spark, sf):
    return _joined(panels.comparison_detail(star_of(spark, sf), "Medio kilo de red widget"))


@check("comparison_detail_without_category", star_query(
    _DETAIL + " AND coalesce(e.categoria_nlp, '') = ''", "camps", "urls"))
def _(spark, sf):
    return _joined(panels.comparison_detail(star_of(spark, sf), "Medio kilo de red widget", category=""))


@check("price_history", star_query(
    f"""SELECT v.id, v.tienda, v.producto, v.categoria, v.fecha, v.precio, v.precio_anterior, v.pagina_id,
        v.folleto_id, v.folleto_id_fuente, v.folleto_titulo, u.url AS url_origen, p.numero_pagina,
        coalesce(c.campanias, '') AS campanias
        FROM vhist v {_PRICE_JOINS} WHERE lower(v.producto) = 'medio kilo de red widget'
        AND v.fecha >= DATE '1996-01-01'""", "vhist", "camps", "urls"))
def _(spark, sf):
    return _joined(panels.price_history(star_of(spark, sf), "MEDIO Kilo de Red Widget", start="1996-01-01"))


@check("price_history_view", star_query(
    """SELECT producto, count(*) AS n, min(fecha) AS primera, max(fecha) AS ultima,
        CAST(sum(CAST(precio AS DECIMAL(18,6))) AS DOUBLE) AS suma FROM vhist GROUP BY 1""", "vhist"))
def _(spark, sf):
    return views.price_history(star_of(spark, sf)).groupBy("producto").agg(
        F.count(F.lit(1)).alias("n"), F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"),
        F.sum(F.col("precio").cast("decimal(18,6)")).cast("double").alias("suma"))


@check("product_suggestions", star_query(
    """SELECT producto, count(*) AS n FROM vhist WHERE lower(producto) LIKE '%bolt%' GROUP BY 1
        ORDER BY n DESC, producto LIMIT 20""", "vhist"))
def _(spark, sf):
    return panels.suggest_products(star_of(spark, sf), "BOLT")


@check("record_provenance", star_query(
    f"""SELECT e.id, e.pagina_id, e.folleto_id, p.numero_pagina, f.folleto_id_fuente, f.titulo AS folleto_titulo,
        u.url AS url_origen FROM extracciones e JOIN folletos f ON f.id = e.folleto_id
        JOIN paginas p ON p.id = e.pagina_id JOIN urls u ON u.folleto_id = f.id WHERE e.tipo = 'PROMO'""", "urls"))
def _(spark, sf):
    star = star_of(spark, sf)
    return panels.provenance(star.extracciones.filter("tipo = 'PROMO'").select("id"), star)


@check("extraction_origin", star_query(
    """SELECT e.id, e.tipo, e.texto_raw, e.texto_norm, e.valor, e.valor_anterior, e.confianza_ocr, e.bbox_x, e.bbox_y,
        e.bbox_ancho, e.bbox_alto, e.pagina_id, e.producto_extraccion_id, e.metodo_norm,
        p.texto_raw AS producto_texto, p.texto_norm AS producto_nombre, p.metodo_norm AS producto_metodo,
        p.bbox_x AS producto_x, p.bbox_y AS producto_y
        FROM extracciones e LEFT JOIN extracciones p ON p.id = e.producto_extraccion_id"""))
def _(spark, sf):
    return panels.extraction_origin(star_of(spark, sf))


# -- summary -----------------------------------------------------------------------------

def _summary_sql(registros: str, categories: bool) -> str:
    none = "CAST(NULL AS BIGINT)"
    con = f"count(*) FILTER (WHERE NOT ({_no_category('categoria')}))"
    cat = f"count(DISTINCT trim(categoria)) FILTER (WHERE NOT ({_no_category('categoria')}))"
    return star_query(f"""SELECT (SELECT count(*) FROM tiendas WHERE activa) AS tiendas_activas,
        (SELECT count(*) FROM folletos) AS total_folletos,
        (SELECT count(*) FILTER (WHERE vigente) FROM vfv) AS folletos_vigentes,
        (SELECT count(*) FILTER (WHERE vigente_dudoso) FROM vfv) AS folletos_vigentes_dudosos,
        {registros} AS registros_dashboard, count(*) AS registros_dashboard_todos,
        {cat if categories else none} AS categorias, {con if categories else none} AS registros_con_categoria,
        count(*) AS registros_base,
        {pct(con, 'count(*)') if categories else 'CAST(NULL AS DOUBLE)'} AS pct_con_categoria FROM vpa""", "vpa", "vfv")


@check("summary_kpis", _summary_sql("count(*)", True))
def _(spark, sf):
    return panels.summary_kpis(star_of(spark, sf), AS_OF)


@check("summary_kpis_uncategorized", _summary_sql(f"count(*) FILTER (WHERE {_no_category('categoria')})", False))
def _(spark, sf):
    return panels.summary_kpis(star_of(spark, sf), AS_OF, with_category="no")


@check("top_categories", star_query(
    f"""SELECT categoria, count(*) AS n FROM vpa WHERE NOT ({_no_category('categoria')}) GROUP BY 1
        ORDER BY n DESC, categoria LIMIT 10""", "vpa"))
def _(spark, sf):
    return panels.top_categories(star_of(spark, sf))


@check("distinct_categories", star_query(
    f"SELECT DISTINCT trim(categoria) AS categoria FROM vpa WHERE NOT ({_no_category('categoria')})", "vpa"))
def _(spark, sf):
    return panels.distinct_categories(star_of(spark, sf))


@check("flyers_per_store", star_query(
    "SELECT t.nombre AS tienda, count(*) AS n FROM folletos f JOIN tiendas t ON t.id = f.tienda_id GROUP BY 1"))
def _(spark, sf):
    return panels.flyers_per_store(star_of(spark, sf))


@check("flyer_state", star_query(
    f"""SELECT '400007' AS folleto, CASE WHEN folletos = 0 THEN 'no_existe' WHEN registros = 0 THEN 'sin_precios'
        ELSE 'con_precios' END AS estado, * FROM (SELECT
        (SELECT count(*) FROM folletos WHERE folleto_id_fuente = '400007') AS folletos,
        (SELECT string_agg(DISTINCT t.nombre, ', ' ORDER BY t.nombre) FROM folletos f JOIN tiendas t
            ON t.id = f.tienda_id WHERE folleto_id_fuente = '400007') AS tiendas,
        (SELECT string_agg(DISTINCT fuente, ', ' ORDER BY fuente) FROM folletos
            WHERE folleto_id_fuente = '400007') AS fuentes,
        (SELECT count(*) FROM vpa WHERE folleto_id_fuente = '400007') AS registros,
        (SELECT count(*) FROM errores_carga WHERE folleto_id_fuente = '400007') AS errores_carga) x""", "vpa"))
def _(spark, sf):
    return panels.flyer_state(star_of(spark, sf), "400007")


# -- quality, reliability, coverage --------------------------------------------------------

@check("flyer_quality_view", star_query("SELECT * FROM vcal", "vcal"))
def _(spark, sf):
    return views.flyer_quality(star_of(spark, sf))


@check("flyer_quality", star_query(
    """SELECT folleto_id, tienda, folleto_id_fuente, fuente, fecha_inicio, total_paginas, paginas_procesadas,
        confianza_ocr_prom, tasa_util_prom, estado FROM vcal WHERE fuente = 'tiendeo' AND estado = 'done'
        AND (tasa_util_prom IS NULL OR tasa_util_prom >= 0.4) ORDER BY tasa_util_prom ASC NULLS LAST, folleto_id
        LIMIT 500""", "vcal"))
def _(spark, sf):
    return panels.flyer_quality(star_of(spark, sf), source="tiendeo", state="done", min_useful=0.4)


# one line per store and record, stores without records keep one; a repeated line is surplus from its second time on
_RELIABILITY = f"""SELECT slug AS tienda_slug, nombre AS tienda, count(id) AS registros, count(1) FILTER (WHERE cat) AS reg_catalogo,
    count(1) FILTER (WHERE sin) AS reg_sin_categoria, count(DISTINCT folleto_id) AS folletos_con_precio,
    {pct('count(1) FILTER (WHERE cat)', 'count(id)')} AS pct_catalogo, {pct('count(1) FILTER (WHERE heu)', 'count(id)')} AS pct_heuristico,
    {pct('count(1) FILTER (WHERE sin)', 'count(id)')} AS pct_sin_categoria,
    {rnd('CAST(sum(CAST(confianza_ocr AS DECIMAL(18,6))) AS DOUBLE) / count(confianza_ocr)', 3)} AS conf_ocr_media,
    {rnd('median(confianza_ocr)', 3)} AS conf_ocr_mediana, {pct('count(1) FILTER (WHERE vez > 1)', 'count(id)')} AS pct_duplicados,
    count(1) FILTER (WHERE valor NOT BETWEEN 1 AND 100000) AS atipicos FROM linea GROUP BY tid, slug, nombre"""


def _reliability_ctes(where: str) -> dict[str, str]:
    return {
        "linea": f"""SELECT s.id AS tid, s.slug, s.nombre, x.* FROM tiendas s LEFT JOIN (
            SELECT b.id, b.tienda_id, b.folleto_id, b.valor, b.confianza_ocr, b.metodo IN {CATALOGUE} AS cat,
                b.metodo = 'heuristico' AS heu, {_no_category('b.categoria_nlp')} AS sin, row_number() OVER (
                    PARTITION BY b.tienda_id, b.folleto_id, b.pagina_id, b.texto_norm, b.valor ORDER BY b.id) AS vez
            FROM base b JOIN folletos f ON f.id = b.folleto_id {where}) x ON x.tienda_id = s.id""",
    }


@check("store_reliability", star_query(_RELIABILITY, "base", **_reliability_ctes("")))
def _(spark, sf):
    return panels.store_reliability(star_of(spark, sf))


@check("store_reliability_filtered", star_query(_RELIABILITY, "base", **_reliability_ctes(
    f"""WHERE f.fecha_inicio >= DATE '1997-01-01' AND f.fecha_inicio <= DATE '1999-12-31'
        AND NOT ({_no_category('b.categoria_nlp')})""")))
def _(spark, sf):
    return panels.store_reliability(star_of(spark, sf), start="1997-01-01", end="1999-12-31", with_category="si")


@check("reliability_totals", star_query(
    f"""SELECT count(*) AS registros, {pct(f"count(*) FILTER (WHERE metodo IN {CATALOGUE})", 'count(*)')} AS pct_catalogo,
        {pct(f"(count(*) - count(*) FILTER (WHERE metodo IN {CATALOGUE}))", 'count(*)')} AS pct_heuristico,
        {pct(f"count(*) FILTER (WHERE {_no_category('categoria_nlp')})", 'count(*)')} AS pct_sin_categoria
        FROM base""", "base"))
def _(spark, sf):
    return panels.reliability_totals(panels.store_reliability(star_of(spark, sf)))


# every table adds lines (store, measure, amount, day); the answer is their sum or maximum by measure
_CURRENT = "CASE WHEN vigente THEN '{}' END"
_COVERAGE_CTES = {
    "apunte": f"""SELECT tienda_slug AS slug, unnest(['folletos_total', {_CURRENT.format('folletos_vigentes')},
            CASE WHEN vigente_dudoso THEN 'vigentes_fecha_dudosa' END, CASE WHEN proximo THEN 'proximos' END,
            CASE WHEN anomalia_fecha IS NOT NULL THEN 'folletos_fecha_anomala' END,
            CASE WHEN fecha_inicio <= {DAY} AND coalesce(anomalia_fecha, '') NOT IN {UNRELIABLE} THEN 'inicio' END]) AS medida,
            fecha_inicio AS dia, scrapeado_at AS visto FROM vfv
        UNION ALL BY NAME SELECT v.tienda_slug AS slug, unnest(['paginas_total', {_CURRENT.format('paginas_vigentes')},
            CASE WHEN vigente AND total_precios > 0 THEN 'paginas_vig_con_precio' END]) AS medida
            FROM paginas p JOIN vfv v ON v.id = p.folleto_id
        UNION ALL BY NAME SELECT v.tienda_slug AS slug, unnest(['precios_total', {_CURRENT.format('precios_vigentes')}]) AS medida
            FROM extracciones e JOIN vfv v ON v.id = e.folleto_id WHERE {RECORD}
        UNION ALL BY NAME SELECT tienda_slug AS slug,
            unnest(['errores_total', CASE WHEN NOT resuelto THEN 'errores_abiertos' END]) AS medida FROM errores_carga""",
    "cov": "SELECT s.slug AS tienda_slug, s.nombre AS tienda, " + ", ".join(
        f"count(1) FILTER (WHERE medida = '{m}') AS {m}" for m in (
            "folletos_total", "folletos_vigentes", "vigentes_fecha_dudosa", "proximos", "paginas_vigentes",
            "paginas_vig_con_precio", "precios_vigentes", "paginas_total", "precios_total", "folletos_fecha_anomala",
            "errores_abiertos", "errores_total")) + f""", max(CASE WHEN medida = 'inicio' THEN dia END) AS fecha_ultimo_folleto,
        CAST(date_diff('day', max(CASE WHEN medida = 'inicio' THEN dia END), {DAY}) AS INTEGER) AS dias_desde_ultimo,
        CAST(max(visto) AS DATE) AS ultimo_scrapeo FROM tiendas s LEFT JOIN apunte a ON a.slug = s.slug GROUP BY s.id, s.slug, s.nombre""",
}


@check("store_coverage", star_query("SELECT * FROM cov", "vfv", **_COVERAGE_CTES))
def _(spark, sf):
    return panels.store_coverage(star_of(spark, sf), AS_OF)


@check("coverage_kpis", star_query(
    """SELECT count(*) AS tiendas, count(*) FILTER (WHERE folletos_vigentes > 0) AS tiendas_con_vigente,
        CAST(sum(folletos_vigentes) AS BIGINT) AS folletos_vigentes,
        CAST(sum(vigentes_fecha_dudosa) AS BIGINT) AS vigentes_fecha_dudosa,
        CAST(sum(proximos) AS BIGINT) AS proximos, CAST(sum(precios_vigentes) AS BIGINT) AS precios_vigentes,
        CAST(sum(paginas_vigentes) AS BIGINT) AS paginas_vigentes, max(ultimo_scrapeo) AS ultimo_scrapeo
        FROM cov""", "vfv", **_COVERAGE_CTES))
def _(spark, sf):
    return panels.coverage_kpis(panels.store_coverage(star_of(spark, sf), AS_OF))


@check("doubtful_flyers", star_query(
    """SELECT v.id, v.tienda, v.folleto_id_fuente, v.fuente, v.titulo, v.fecha_inicio, v.fecha_fin,
        CAST(v.scrapeado_at AS DATE) AS scrapeado, v.anomalia_fecha, v.vigente_dudoso, u.url AS url_origen,
        p.primera_pagina_id FROM vfv v JOIN urls u ON u.folleto_id = v.id
        LEFT JOIN primeras p ON p.folleto_id = v.id WHERE v.anomalia_fecha IS NOT NULL""",
    "vfv", "urls", "primeras"))
def _(spark, sf):
    return panels.doubtful_flyers(star_of(spark, sf), AS_OF)


_WEEKS = f"""SELECT CAST(date_trunc('week', fecha_inicio) AS DATE) AS semana, tienda, count(*) AS folletos FROM vfv
    WHERE (anomalia_fecha IS NULL OR anomalia_fecha NOT IN {UNRELIABLE})
    AND fecha_inicio >= {DAY} - 182 AND fecha_inicio <= {DAY} + 30 GROUP BY 1, 2"""


@check("flyers_per_week", star_query(_WEEKS, "vfv"))
def _(spark, sf):
    return panels.flyers_per_week(star_of(spark, sf), AS_OF)


@check("weekly_series", star_query(
    """SELECT semana, coalesce(b.tienda, 'Otras') AS serie, CAST(sum(folletos) AS BIGINT) AS folletos FROM wk
        LEFT JOIN best b ON b.tienda = wk.tienda GROUP BY 1, 2""", "vfv", wk=_WEEKS,
    best="SELECT tienda FROM wk GROUP BY 1 ORDER BY sum(folletos) DESC, tienda LIMIT 7"))
def _(spark, sf):
    return panels.weekly_series(panels.flyers_per_week(star_of(spark, sf), AS_OF))


@check("flyer_validity", star_query("SELECT * FROM vfv", "vfv"))
def _(spark, sf):
    return views.flyer_validity(star_of(spark, sf), AS_OF)


@check("active_events", star_query(
    f"""SELECT ep.nombre_evento, t.nombre AS tienda, ep.fecha_inicio, ep.fecha_fin, ep.texto_raw,
        count(e.id) AS num_precios_asociados, min(ep.id) AS id FROM eventos_promo ep
        JOIN tiendas t ON t.id = ep.tienda_id
        LEFT JOIN extracciones e ON e.folleto_id = ep.folleto_id AND e.tipo = 'PRECIO'
        WHERE ep.fecha_fin IS NULL OR ep.fecha_fin >= {DAY} GROUP BY 1, 2, 3, 4, 5"""))
def _(spark, sf):
    return views.active_events(star_of(spark, sf), AS_OF)


# -- explorer --------------------------------------------------------------------------------

@check("list_stores", star_query("SELECT id, nombre, slug FROM tiendas WHERE activa"))
def _(spark, sf):
    return panels.list_stores(star_of(spark, sf))


@check("list_categories", star_query(
    f"SELECT DISTINCT categoria FROM vpa WHERE NOT ({_no_category('categoria')})", "vpa"))
def _(spark, sf):
    return panels.list_categories(star_of(spark, sf))


@check("list_stores_detail", star_query(
    """SELECT t.id, t.nombre, t.slug, t.fuente_slug, t.activa, t.created_at, count(f.id) AS num_folletos
        FROM tiendas t LEFT JOIN folletos f ON f.tienda_id = t.id GROUP BY ALL"""))
def _(spark, sf):
    return panels.list_stores_detail(star_of(spark, sf))


@check("list_flyers", star_query(
    """SELECT f.id, t.nombre AS tienda, f.fuente, f.folleto_id_fuente, f.titulo, f.fecha_inicio, f.fecha_fin,
        f.total_paginas, f.estado, f.scrapeado_at, f.created_at, u.url AS url_origen, p.primera_pagina_id,
        coalesce(c.campanias, '') AS campanias
        FROM (SELECT * FROM folletos ORDER BY created_at DESC, id LIMIT 200) f JOIN tiendas t ON t.id = f.tienda_id
        JOIN urls u ON u.folleto_id = f.id LEFT JOIN primeras p ON p.folleto_id = f.id
        LEFT JOIN camps c ON c.folleto_id = f.id""", "urls", "primeras", "camps"))
def _(spark, sf):
    return _joined(panels.list_flyers(star_of(spark, sf)))


@check("list_types", star_query("SELECT DISTINCT tipo FROM extracciones"))
def _(spark, sf):
    return panels.list_types(star_of(spark, sf))


@check("list_extractions", star_query(
    """SELECT e.id, t.nombre AS tienda, e.folleto_id, e.tipo, e.texto_raw, e.texto_norm, e.categoria_nlp, e.valor,
        e.valor_anterior, e.confianza_ocr, n.nombre_canonico, e.created_at, e.pagina_id,
        coalesce(c.campanias, '') AS campanias
        FROM (SELECT * FROM extracciones WHERE tipo = 'PRODUCTO' ORDER BY created_at DESC, id LIMIT 200) e
        JOIN tiendas t ON t.id = e.tienda_id LEFT JOIN productos_canonicos n ON n.id = e.producto_canonico_id
        LEFT JOIN camps c ON c.folleto_id = e.folleto_id""", "camps"))
def _(spark, sf):
    return _joined(panels.list_extractions(star_of(spark, sf), kind="PRODUCTO"))


# -- promotions --------------------------------------------------------------------------------

_NAMES = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in promos.CAMPAIGNS.items())
_CLASS_NAMES = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in promos.EVENT_CLASSES.items())
_STATE_NAMES = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in panels.VALIDITY_NAMES.items())


def _promotions_ctes(event_filter: str) -> dict[str, str]:
    return {
        "g": f"""SELECT folleto_id, clase, coalesce(campania, nombre_evento) AS clave, count(*) AS eventos,
            string_agg(DISTINCT trim(coalesce(nullif(texto_raw, ''), nombre_evento)), ' / '
                ORDER BY trim(coalesce(nullif(texto_raw, ''), nombre_evento))) AS textos_detectados
            FROM evc WHERE {event_filter} GROUP BY 1, 2, 3""",
        "n": f"SELECT e.folleto_id, count(*) AS n FROM extracciones e WHERE {RECORD} GROUP BY 1",
        "filas": f"""SELECT g.folleto_id, v.tienda, v.fuente, v.folleto_id_fuente, v.titulo AS folleto_titulo,
            v.fecha_inicio AS vigencia_desde, v.fecha_fin AS vigencia_hasta, v.anomalia_fecha, v.vigencia,
            CASE v.vigencia {_STATE_NAMES} END AS vigencia_nombre, g.clase, CASE g.clase {_CLASS_NAMES} END
            AS clase_nombre, CASE WHEN g.clase = 'campania' THEN g.clave END AS campania,
            CASE WHEN g.clase = 'campania' THEN CASE g.clave {_NAMES} END ELSE g.clave END AS nombre,
            g.textos_detectados, g.eventos, coalesce(n.n, 0) AS precios_en_folleto, p.primera_pagina_id
            FROM g JOIN (SELECT *, CASE WHEN coalesce(vigente, false) THEN 'vigente'
                WHEN coalesce(vigente_dudoso, false) THEN 'vigente_dudoso'
                WHEN coalesce(proximo, false) THEN 'proximo' ELSE 'fuera' END AS vigencia FROM vfv) v
                ON v.id = g.folleto_id
            LEFT JOIN n ON n.folleto_id = g.folleto_id LEFT JOIN primeras p ON p.folleto_id = g.folleto_id""",
    }


@check("promotions", star_query("SELECT * FROM filas", "evc", "vfv", "primeras",
                                **_promotions_ctes("clase = 'campania'")))
def _(spark, sf):
    rows = panels.promotions(star_of(spark, sf), AS_OF)
    return rows.withColumn("textos_detectados", F.array_join("textos_detectados", " / "))


@check("promotions_all_classes", star_query("SELECT * FROM filas", "evc", "vfv", "primeras",
                                            **_promotions_ctes("true")))
def _(spark, sf):
    rows = panels.promotions(star_of(spark, sf), AS_OF, event_class="todas")
    return rows.withColumn("textos_detectados", F.array_join("textos_detectados", " / "))


@check("promotion_kpis", star_query(
    """SELECT count(*) AS filas, count(DISTINCT folleto_id) AS folletos,
        (SELECT CAST(sum(p) AS BIGINT) FROM (SELECT DISTINCT folleto_id, precios_en_folleto AS p FROM filas) d)
        AS precios_en_folletos, count(DISTINCT folleto_id) FILTER (WHERE vigencia = 'vigente') AS vigentes,
        count(DISTINCT campania) AS campanias, count(DISTINCT tienda) AS tiendas FROM filas""",
    "evc", "vfv", "primeras", **_promotions_ctes("clase = 'campania'")))
def _(spark, sf):
    return panels.promotion_kpis(panels.promotions(star_of(spark, sf), AS_OF))


@check("event_classes", star_query("SELECT id, nombre_evento, clase, campania FROM evc", "evc"))
def _(spark, sf):
    events = promos.classify_events(star_of(spark, sf).eventos_promo)
    return events.select("id", "nombre_evento", "clase", "campania")


@check("campaigns_by_flyer", star_query("SELECT folleto_id, campanias FROM camps", "camps"))
def _(spark, sf):
    return _joined(promos.campaigns_by_flyer(star_of(spark, sf).eventos_promo))


# -- load errors ---------------------------------------------------------------------------------

@check("error_kpis", star_query(
    """SELECT count(*) FILTER (WHERE NOT resuelto) AS abiertos,
        count(DISTINCT (fuente, folleto_id_fuente)) FILTER (WHERE NOT resuelto) AS folletos_afectados,
        count(*) FILTER (WHERE resuelto) AS resueltos, max(corrida_at) AS ultima_corrida FROM errores_carga"""))
def _(spark, sf):
    return panels.error_kpis(star_of(spark, sf))


@check("errors_by_category", star_query(
    "SELECT c AS categoria, (SELECT count(*) FROM errores_carga e WHERE e.categoria = c AND NOT e.resuelto) AS n "
    "FROM (VALUES " + ", ".join(f"('{c}')" for c in panels.ERROR_CATEGORIES) + ") v(c)"))
def _(spark, sf):
    return panels.errors_by_category(star_of(spark, sf), state="abiertos")


@check("error_rows", star_query(
    """SELECT * FROM errores_carga WHERE fuente = 'tiendeo' AND NOT resuelto AND categoria IN
        ('tamano_excesivo', 'formato_invalido') ORDER BY corrida_at DESC, fuente, folleto_id_fuente,
        pagina NULLS LAST, id LIMIT 1000"""))
def _(spark, sf):
    return panels.error_rows(star_of(spark, sf), source="tiendeo", state="abiertos",
                             categories=["tamano_excesivo", "formato_invalido"])


@check("hidden_errors", star_query(
    """SELECT count(*) AS n, 'resueltos' AS estado_oculto, 'abiertos' AS estado_filtro FROM errores_carga
        WHERE folleto_id_fuente = '400007' AND resuelto"""))
def _(spark, sf):
    return panels.hidden_errors(star_of(spark, sf), "abiertos", "400007")


@check("error_stores", star_query(
    "SELECT DISTINCT tienda_slug FROM errores_carga WHERE tienda_slug IS NOT NULL"))
def _(spark, sf):
    return panels.error_stores(star_of(spark, sf))


# -- page viewer -----------------------------------------------------------------------------------

@check("neighbour_pages", star_query(
    """SELECT id, folleto_id, numero_pagina, lag(id) OVER w AS anterior, lead(id) OVER w AS siguiente FROM paginas
        WINDOW w AS (PARTITION BY folleto_id ORDER BY numero_pagina)"""))
def _(spark, sf):
    return panels.neighbour_pages(star_of(spark, sf))


@check("page_blocks", star_query(
    "SELECT id, pagina_id, tipo, texto_raw, valor, bbox_x, bbox_y, bbox_ancho, bbox_alto FROM extracciones"))
def _(spark, sf):
    return panels.page_blocks(star_of(spark, sf))


@check("page_prices", star_query(
    f"""SELECT id, pagina_id, texto_norm, valor, valor_anterior, categoria_nlp, confianza_ocr, producto_extraccion_id,
        coalesce(metodo IN {CATALOGUE}, false) AS es_catalogo,
        CASE WHEN valor_anterior > 0 AND valor_anterior > valor
             THEN {rnd('(valor_anterior - valor) / valor_anterior * 100', 1)} END AS descuento_pct,
        count(*) OVER (PARTITION BY pagina_id, texto_norm, valor) > 1 AS repetido,
        bbox_x, bbox_y, bbox_ancho, bbox_alto FROM base""", "base"))
def _(spark, sf):
    return panels.page_prices(star_of(spark, sf))


@check("prices_without_product", star_query(
    f"""SELECT pagina_id, count(*) FILTER (WHERE NOT ({RECORD} AND e.producto_extraccion_id IS NOT NULL))
        AS precios_sin_producto FROM extracciones e WHERE e.tipo = 'PRECIO' GROUP BY 1"""))
def _(spark, sf):
    return panels.prices_without_product(star_of(spark, sf))


_X0, _Y0 = "greatest(0e0, CAST(bbox_x AS DOUBLE))", "greatest(0e0, CAST(bbox_y AS DOUBLE))"
_X1, _Y1 = "least(1200e0, CAST(bbox_x + bbox_ancho AS DOUBLE))", "least(1800e0, CAST(bbox_y + bbox_alto AS DOUBLE))"


@check("page_boxes", star_query(
    f"""SELECT id, pagina_id, CASE WHEN ok THEN {rnd('100e0 * x0 / 1200e0', 3)} END AS "left",
        CASE WHEN ok THEN {rnd('100e0 * y0 / 1800e0', 3)} END AS top,
        CASE WHEN ok THEN {rnd('100e0 * (x1 - x0) / 1200e0', 3)} END AS width,
        CASE WHEN ok THEN {rnd('100e0 * (y1 - y0) / 1800e0', 3)} END AS height
        FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM (SELECT id, pagina_id, {_X0} AS x0, {_Y0} AS y0,
        {_X1} AS x1, {_Y1} AS y1 FROM extracciones) a) b"""))
def _(spark, sf):
    return panels.page_boxes(star_of(spark, sf), 1200, 1800)


# -- reconciliation ------------------------------------------------------------------------------------

@check("control_counts", star_query(
    f"""SELECT count(*) FILTER (WHERE tipo = 'PRECIO') AS precio_filas, count(*) FILTER (WHERE {RECORD})
        AS dashboard_registros, count(*) FILTER (WHERE tipo = 'PRECIO' AND metodo_norm IS NOT NULL)
        AS precio_con_metodo_norm, count(*) FILTER (WHERE {RECORD} AND {_no_category('categoria_nlp')}) AS sin_categoria,
        count(*) FILTER (WHERE tipo = 'PRECIO' AND valor >= 1000) AS precios_mil_o_mas,
        (SELECT count(*) FROM base) AS registros, (SELECT count(*) FROM base WHERE metodo IN {CATALOGUE}) AS catalogo,
        {pct(f"(SELECT count(*) FROM base WHERE metodo IN {CATALOGUE})", "(SELECT count(*) FROM base)")} AS pct_catalogo,
        (SELECT count(*) FROM vcp) AS comparativa_grupos,
        (SELECT CAST(sum(num_registros) AS BIGINT) FROM vcp) AS comparativa_registros,
        (SELECT count(*) FROM folletos) AS folletos, (SELECT count(*) FROM eventos_promo) AS eventos,
        count(*) AS extracciones FROM extracciones e""", "base", "vcp"))
def _(spark, sf):
    return panels.control_counts(star_of(spark, sf))


@check("high_prices_per_store", star_query(
    """SELECT t.slug, count(*) AS n FROM extracciones e JOIN tiendas t ON t.id = e.tienda_id
        WHERE e.tipo = 'PRECIO' AND e.valor >= 1000 GROUP BY 1"""))
def _(spark, sf):
    return panels.high_prices_per_store(star_of(spark, sf))


@check("snapshot_difference", star_query(
    f"""SELECT control, antes, despues, despues - antes AS cambio FROM (
        SELECT 'precios' AS control, CAST(count(*) AS DOUBLE) AS antes,
            CAST(count(*) FILTER (WHERE valor IS NOT NULL) AS DOUBLE) AS despues FROM extracciones WHERE tipo = 'PRECIO'
        UNION ALL SELECT 'maximo', max(valor), max(valor) FROM extracciones WHERE tipo = 'PRECIO') x"""))
def _(spark, sf):
    prices = star_of(spark, sf).precios()
    shape = [F.count(F.lit(1)).alias("precios"), F.max("valor").alias("maximo")]
    return panels.compare_snapshots(prices.agg(*shape), prices.filter("valor IS NOT NULL").agg(*shape))


@check("unused_names", star_query(
    """SELECT * FROM productos_canonicos p WHERE NOT EXISTS (SELECT 1 FROM extracciones e
        WHERE e.producto_canonico_id = p.id)"""))
def _(spark, sf):
    return panels.unused_names(star_of(spark, sf))


@check("category_filter_complement", star_query(
    f"""SELECT count(*) AS todos, count(*) FILTER (WHERE NOT ({_no_category('e.categoria_nlp')})) AS con,
        count(*) FILTER (WHERE {_no_category('e.categoria_nlp')}) AS sin FROM extracciones e WHERE {RECORD}"""))
def _(spark, sf):
    rows = views.records(star_of(spark, sf))
    return panels.one_row(
        rows.agg(F.count(F.lit(1)).alias("todos")),
        filters.with_category(rows, "si", "categoria_nlp").agg(F.count(F.lit(1)).alias("con")),
        filters.with_category(rows, "no", "categoria_nlp").agg(F.count(F.lit(1)).alias("sin")))
