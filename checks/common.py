"""Helpers of the checked queries: shared parameters and SQL fragments."""

from __future__ import annotations

from octavilla.functions import promos
from octavilla.sources.star import Star, from_tpch
from octavilla.sources.tpch_star import star_ctes

AS_OF = "1998-06-15"
DAY = f"DATE '{AS_OF}'"
RECORD = "e.tipo = 'PRECIO' AND e.valor IS NOT NULL AND e.texto_norm IS NOT NULL"
BLANK = "trim(coalesce({c}, '')) = ''"
CATALOGUE = "('exacto', 'fuzzy', 'fuzzy_bajo')"
UNRELIABLE = "('sin_fecha', 'fin_antes_inicio', 'inicio_antiguo', 'inicio_futuro_vs_scrapeo')"


def star_of(spark, sf_dir: str) -> Star:
    return from_tpch(spark, sf_dir)


def rnd(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"100e0 * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0e0)", digits)


_CAMPAIGN_CASE = " ".join(
    f"WHEN regexp_matches(n, '{p}') THEN '{s}'" for s, p in promos.CAMPAIGN_PATTERNS.items())
_KNOWN = ", ".join(f"'{s}'" for s in promos.CAMPAIGNS)
_RANK = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(promos.CAMPAIGNS))

_SHOP = "(SELECT id AS tienda_id, nombre AS tienda, slug AS tienda_slug FROM tiendas)"


def _average(column: str, digits: int) -> str:
    return rnd(f"CAST(sum(CAST({column} AS DECIMAL(18,6))) AS DOUBLE) / count({column})", digits)


# the first label of this list that holds
_DATE_LABELS = """coalesce(
    CASE WHEN fecha_inicio IS NULL OR fecha_fin IS NULL THEN 'sin_fecha' END,
    CASE WHEN fecha_inicio > fecha_fin THEN 'fin_antes_inicio' END,
    CASE WHEN date_diff('day', fecha_inicio, CAST(scrapeado_at AS DATE)) > 365 THEN 'inicio_antiguo' END,
    CASE WHEN date_diff('day', CAST(scrapeado_at AS DATE), fecha_inicio) > 30 THEN 'inicio_futuro_vs_scrapeo' END,
    CASE WHEN date_diff('day', fecha_inicio, fecha_fin) > 120 THEN 'vigencia_larga' END)"""

VIEWS = {
    "vpa": f"""SELECT r.* EXCLUDE (tienda_id), s.tienda, s.tienda_slug, d.* EXCLUDE (fid)
        FROM (SELECT id, tienda_id, folleto_id, pagina_id, confianza_ocr, created_at, texto_norm AS producto,
                categoria_nlp AS categoria, valor AS precio_actual, valor_anterior AS precio_anterior,
                CASE WHEN valor < valor_anterior THEN {rnd('(valor_anterior - valor) / valor_anterior * 100', 1)} END AS descuento_pct
              FROM extracciones e WHERE {RECORD}) r
        JOIN {_SHOP} s USING (tienda_id)
        JOIN (SELECT id AS fid, folleto_id_fuente, fuente, titulo AS folleto_titulo, url_origen,
                fecha_inicio AS vigencia_desde, fecha_fin AS vigencia_hasta FROM folletos) d ON d.fid = r.folleto_id""",
    "vhist": "SELECT *, vigencia_desde AS fecha, precio_actual AS precio FROM vpa WHERE vigencia_desde IS NOT NULL",
    "vcp": f"""SELECT producto, categoria, list_min(precios) AS precio_min, list_max(precios) AS precio_max,
        {rnd("CAST(list_sum(list_transform(precios, lambda v: CAST(v AS DECIMAL(18,6)))) AS DOUBLE) / len(precios)", 2)} AS precio_promedio,
        list_max(precios) - list_min(precios) AS diferencia, len(precios) AS num_registros,
        len(list_distinct(ids)) AS num_tiendas, array_to_string(list_sort(list_distinct(nombres)), ', ') AS tiendas
        FROM (SELECT e.texto_norm AS producto, e.categoria_nlp AS categoria, list(e.valor) AS precios,
                list(s.tienda_id) AS ids, list(s.tienda) AS nombres
              FROM extracciones e JOIN {_SHOP} s USING (tienda_id) WHERE {RECORD} GROUP BY ALL) g
        WHERE len(list_distinct(ids)) >= 2""",
    "vcal": f"""SELECT d.id AS folleto_id, s.tienda, d.folleto_id_fuente, d.fuente, d.fecha_inicio, d.total_paginas,
        coalesce(m.vistas, 0) AS paginas_procesadas, m.total_productos, m.total_precios, m.total_promos,
        m.confianza_ocr_prom, m.tasa_util_prom, d.perfil_ocr, d.motor_ocr, d.estado, d.scrapeado_at
        FROM folletos d JOIN {_SHOP} s ON s.tienda_id = d.tienda_id
        LEFT JOIN (SELECT folleto_id, count(*) AS vistas,
            CAST(sum(total_productos) AS BIGINT) AS total_productos, CAST(sum(total_precios) AS BIGINT) AS total_precios,
            CAST(sum(total_promos) AS BIGINT) AS total_promos, {_average('confianza_ocr_prom', 3)} AS confianza_ocr_prom,
            {_average('tasa_util', 3)} AS tasa_util_prom
          FROM (SELECT DISTINCT * FROM paginas) GROUP BY folleto_id) m ON m.folleto_id = d.id""",
    "vfv": f"""SELECT * EXCLUDE (hoy), hoy AND anomalia_fecha IS NULL AS vigente, hoy AND anomalia_fecha IS NOT NULL AS vigente_dudoso,
        fecha_inicio > {DAY} AND anomalia_fecha IS NULL AS proximo
        FROM (SELECT d.* EXCLUDE (tienda_id), s.*, {DAY} BETWEEN fecha_inicio AND fecha_fin AS hoy, {_DATE_LABELS} AS anomalia_fecha
              FROM (SELECT id, tienda_id, fuente, folleto_id_fuente, titulo, fecha_inicio, fecha_fin, scrapeado_at,
                      total_paginas, url_origen FROM folletos) d JOIN {_SHOP} s ON s.tienda_id = d.tienda_id) x""",
    "evc": f"""SELECT *, CASE WHEN n IN ({_KNOWN}) THEN 'campania'
            WHEN regexp_matches(n, '{promos.PRODUCT_NAME}') THEN 'producto'
            WHEN regexp_matches(n, '{promos.LEGAL_TEXT}') THEN 'legal'
            WHEN CASE {_CAMPAIGN_CASE} END IS NOT NULL THEN 'campania'
            WHEN regexp_matches(n, '{promos.SLOGAN}') THEN 'lema' ELSE 'otro' END AS clase,
        CASE WHEN n IN ({_KNOWN}) THEN n
            WHEN regexp_matches(n, '{promos.PRODUCT_NAME}') OR regexp_matches(n, '{promos.LEGAL_TEXT}') THEN NULL
            {_CAMPAIGN_CASE} END AS campania
        FROM (SELECT *, lower(trim(coalesce(nombre_evento, ''))) AS n FROM eventos_promo) x""",
    "camps": f"""SELECT folleto_id, string_agg(campania, ',' ORDER BY CASE campania {_RANK} END) AS campanias
        FROM (SELECT DISTINCT folleto_id, campania FROM evc WHERE campania IS NOT NULL) c GROUP BY folleto_id""",
    "urls": r"""SELECT id AS folleto_id, CASE WHEN regexp_full_match(trim(url_origen), '(?i)https?://\S+')
        THEN trim(url_origen) END AS url FROM folletos""",
    "base": f"""SELECT e.*, coalesce(e.metodo_norm, p.metodo_norm) AS metodo FROM extracciones e
        JOIN extracciones p ON p.id = e.producto_extraccion_id WHERE {RECORD}""",
    "primeras": """SELECT folleto_id, min_by(id, numero_pagina) AS primera_pagina_id FROM paginas GROUP BY 1""",
}

_USES = {"vhist": ["vpa"], "camps": ["evc"]}


def star_query(sql: str, *views: str, **extra: str) -> str:
    """SQL over the star CTEs plus the named views and extra CTEs."""
    names: list[str] = []
    for v in views:
        for need in [*_USES.get(v, []), v]:
            if need not in names:
                names.append(need)
    parts = [star_ctes()] + [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names] + [f"{n} AS MATERIALIZED ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql
