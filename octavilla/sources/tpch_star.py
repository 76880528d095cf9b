"""Maps TPC-H shaped tables onto the flyer star.

The star of a real deployment is read with :func:`octavilla.sources.star.from_parquet`.
This adapter exists so that every query can be run, checked and timed on the
generated tables.  Each column is one portable SQL expression, so the same mapping can
be evaluated by another engine that checks the results (``star_ctes``).

No adapter needs a global count, a row number or any other single-task step: all keys
are arithmetic on the source keys.  Extraction ids are strings made from the natural
key, since a 64-bit number cannot hold it at large scale factors.
"""

from __future__ import annotations

# Event names seen in flyers, one of each kind.
EVENT_NAMES = (
    "julio_regalado", "julioregaladods", "hot_sale", "buenfin", "regreso_a_clases",
    "back_to_school_100_hojas", "navidad", "figura_navidad_c_ml", "da_de_muertos",
    "halloween", "liquidacin", "excepto_cdigos_de_liquidacin", "72aniversario", "ofertones",
    "fiestaspatrias", "precio_especial", "la_supercampeona", "sucursales_participantes",
    "super_oferta", "gran_venta_nocturna",
)

# Error categories of the load log.
ERROR_CATEGORIES = (
    "tamano_excesivo", "valor_fuera_de_rango", "formato_invalido", "violacion_integridad",
    "json_corrupto", "archivo_faltante", "otro",
)


def _pick(index: str, values) -> str:
    """The value at a zero-based index of a fixed list."""
    return f"split_part('{','.join(values)}', ',', CAST({index} + 1 AS INT))"


_PRICE_ID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
             " CAST(floor(l_extendedprice * 1e2 + 0.5e0) AS BIGINT))")
_UNIT = "CAST(floor(l_extendedprice * 1e2 / l_quantity) AS DOUBLE) / 1e2"
_VALUE = (f"CASE WHEN l_partkey % 97 = 5 THEN NULL WHEN l_partkey % 89 = 3 THEN {_UNIT} / 1e4"
          f" WHEN l_partkey % 83 = 2 THEN {_UNIT} * 1e3 ELSE {_UNIT} END")
_NAME = ("CASE p_partkey % 6"
         " WHEN 0 THEN p_name || ' de ' || CAST(p_size AS STRING) || ' Kg'"
         " WHEN 1 THEN 'Medio kilo de ' || p_name"
         " WHEN 2 THEN upper(p_name) || ', ' || CAST(p_size * 10 AS STRING) || ' grs.'"
         " WHEN 3 THEN p_name"
         " WHEN 4 THEN p_name || ' 1,5 Litros c/u'"
         " ELSE 'Jamón ' || p_name || ' 500 g' END")
_CATEGORY = ("CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' '"
             " WHEN 3 THEN ' ' || lower(p_type) ELSE lower(p_type) END")
_PAGE = "l_orderkey * 8 + l_linenumber"
_START = "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"
_END = ("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE)"
        " + CAST(o_orderkey % 150 - 5 AS INT) END")
_SHIFT = "CASE o_orderkey % 13 WHEN 0 THEN 400 WHEN 1 THEN -45 ELSE CAST(o_orderkey % 7 AS INT) END"
_EVENT_INDEX = "CAST(floor(o_orderkey / 5) AS BIGINT) % 20"

# table -> (source relation, columns, group columns)
MAPPING: dict[str, tuple[str, list[tuple[str, str]], str | None]] = {
    "tiendas": ("supplier JOIN nation ON s_nationkey = n_nationkey", [
        ("id", "s_suppkey"),
        ("nombre", "s_name"),
        ("slug", "lower(replace(s_name, '#', '_'))"),
        ("fuente_slug", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lower(s_name) END"),
        ("activa", "s_acctbal > 0"),
        ("created_at", "CAST('1995-01-01 00:00:00' AS TIMESTAMP_NTZ)"),
        ("cadena", "CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) END"),
    ], None),
    "folletos": ("orders", [
        ("id", "o_orderkey"),
        ("tienda_id", "CAST(floor(o_custkey / 15) AS BIGINT)"),
        ("folleto_id_fuente", "CAST(400000 + CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)"),
        ("fuente", "CASE WHEN o_orderkey % 2 = 0 THEN 'tiendeo' ELSE 'ofertomat' END"),
        ("titulo", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Folleto ' || o_orderpriority END"),
        ("fecha_inicio", _START),
        ("fecha_fin", _END),
        ("url_origen", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'javascript:alert(1)'"
                       " WHEN 2 THEN ' HTTPS://example.com/f/' || CAST(o_orderkey AS STRING) || ' '"
                       " WHEN 3 THEN 'http://example.com/a b'"
                       " ELSE 'http://example.com/f/' || CAST(o_orderkey AS STRING) END"),
        ("total_paginas", "CAST(1 + o_orderkey % 8 AS INT)"),
        ("perfil_ocr", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'color_normal' END"),
        ("motor_ocr", "'easyocr'"),
        ("scrapeado_at", f"CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE"
                         f" CAST(CAST(o_orderdate AS DATE) + {_SHIFT} AS TIMESTAMP_NTZ) END"),
        ("estado", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END"),
        ("created_at", "o_orderdate"),
    ], None),
    "paginas": ("lineitem", [
        ("id", f"{_PAGE}"),
        ("folleto_id", "l_orderkey"),
        ("numero_pagina", "l_linenumber"),
        ("archivo_imagen", "'pagina_00' || CAST(l_linenumber AS STRING) || '.webp'"),
        ("total_bloques_ocr", "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE CAST(count(*) * 4 AS BIGINT) END"),
        ("confianza_ocr_prom", "CASE WHEN l_orderkey % 19 = 0 THEN NULL"
                               " ELSE CAST((l_orderkey * 7 + l_linenumber * 13) % 50 + 50 AS DOUBLE) / 1e2 END"),
        ("total_productos", "CAST(count(*) AS BIGINT)"),
        ("total_precios", "CAST(sum(CASE WHEN l_partkey % 97 = 5 THEN 0 ELSE 1 END) AS BIGINT)"),
        ("total_promos", "CAST(sum(CASE WHEN l_discount >= 0.09e0 THEN 1 ELSE 0 END) AS BIGINT)"),
        ("total_atributos", "CAST(sum(CASE WHEN l_partkey % 40 = 9 THEN 1 ELSE 0 END) AS BIGINT)"),
        ("tasa_util", "CASE WHEN l_orderkey % 19 = 0 THEN NULL"
                      " ELSE CAST((l_orderkey * 3 + l_linenumber) % 100 AS DOUBLE) / 1e2 END"),
    ], "l_orderkey, l_linenumber"),
    "extracciones_precio": ("lineitem JOIN part ON l_partkey = p_partkey", [
        ("id", _PRICE_ID),
        ("pagina_id", _PAGE),
        ("folleto_id", "l_orderkey"),
        ("tienda_id", "l_suppkey"),
        ("tipo", "'PRECIO'"),
        ("texto_raw", "'$' || CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS STRING)"),
        ("texto_norm", f"CASE WHEN l_partkey % 61 = 8 THEN NULL ELSE {_NAME} END"),
        ("categoria_nlp", _CATEGORY),
        ("valor", _VALUE),
        ("valor_anterior", f"CASE WHEN l_discount > 0.01e0 THEN"
                           f" CAST(floor({_UNIT} * 1e2 / (1e0 - l_discount)) AS DOUBLE) / 1e2 END"),
        ("texto_promo", "CAST(NULL AS STRING)"),
        ("confianza_ocr", "CAST((l_orderkey * 31 + l_partkey * 17) % 100 AS DOUBLE) / 1e2"),
        ("bbox_x", "CAST((l_partkey * 37) % 1400 AS INT)"),
        ("bbox_y", "CAST((l_suppkey * 53 + l_orderkey * 7) % 1900 AS INT)"),
        ("bbox_ancho", "CAST(20 + l_partkey % 60 AS INT)"),
        ("bbox_alto", "CAST(20 + l_suppkey % 40 AS INT)"),
        ("producto_extraccion_id", f"CASE WHEN l_partkey % 41 = 7 THEN NULL ELSE {_PRICE_ID} || '-p' END"),
        ("producto_canonico_id", "l_partkey"),
        ("confianza_norm", "CAST(NULL AS DOUBLE)"),
        ("metodo_norm", "CASE l_partkey % 7 WHEN 0 THEN 'exacto' WHEN 1 THEN 'fuzzy'"
                        " WHEN 2 THEN 'fuzzy_bajo' WHEN 3 THEN NULL ELSE 'heuristico' END"),
        ("created_at", "l_shipdate"),
    ], None),
    "extracciones_producto": ("lineitem JOIN part ON l_partkey = p_partkey", [
        ("id", f"{_PRICE_ID} || '-p'"),
        ("pagina_id", _PAGE),
        ("folleto_id", "l_orderkey"),
        ("tienda_id", "l_suppkey"),
        ("tipo", "'PRODUCTO'"),
        ("texto_raw", "upper(p_name)"),
        ("texto_norm", _NAME),
        ("categoria_nlp", _CATEGORY),
        ("valor", "CAST(NULL AS DOUBLE)"),
        ("valor_anterior", "CAST(NULL AS DOUBLE)"),
        ("texto_promo", "CAST(NULL AS STRING)"),
        ("confianza_ocr", "CAST((l_orderkey * 13 + l_partkey * 7) % 100 AS DOUBLE) / 1e2"),
        ("bbox_x", "CAST((l_partkey * 37) % 1400 AS INT)"),
        ("bbox_y", "CAST((l_suppkey * 53 + l_orderkey * 7) % 1900 + 60 AS INT)"),
        ("bbox_ancho", "CAST(80 + l_partkey % 200 AS INT)"),
        ("bbox_alto", "CAST(20 + l_suppkey % 20 AS INT)"),
        ("producto_extraccion_id", "CAST(NULL AS STRING)"),
        ("producto_canonico_id", "l_partkey"),
        ("confianza_norm", "CAST(60 + l_partkey % 40 AS DOUBLE) / 1e2"),
        ("metodo_norm", "CASE l_partkey % 5 WHEN 0 THEN 'exacto' WHEN 1 THEN 'fuzzy' ELSE 'heuristico' END"),
        ("created_at", "l_shipdate"),
    ], None),
    "extracciones_otras": ("lineitem JOIN part ON l_partkey = p_partkey", [
        ("id", f"{_PRICE_ID} || '-o'"),
        ("pagina_id", _PAGE),
        ("folleto_id", "l_orderkey"),
        ("tienda_id", "l_suppkey"),
        ("tipo", "CASE WHEN l_discount >= 0.09e0 THEN 'PROMO' ELSE 'ATRIBUTO' END"),
        ("texto_raw", "CASE WHEN l_discount >= 0.09e0 THEN '3x2' ELSE lower(p_type) END"),
        ("texto_norm", "CASE WHEN l_discount >= 0.09e0 THEN '3x2' ELSE lower(p_type) END"),
        ("categoria_nlp", "CAST(NULL AS STRING)"),
        ("valor", "CAST(NULL AS DOUBLE)"),
        ("valor_anterior", "CAST(NULL AS DOUBLE)"),
        ("texto_promo", "CAST(NULL AS STRING)"),
        ("confianza_ocr", "CAST((l_orderkey * 3 + l_partkey) % 100 AS DOUBLE) / 1e2"),
        ("bbox_x", "CAST((l_partkey * 11) % 1400 AS INT)"),
        ("bbox_y", "CAST((l_suppkey * 29) % 1900 AS INT)"),
        ("bbox_ancho", "60"),
        ("bbox_alto", "25"),
        ("producto_extraccion_id", "CAST(NULL AS STRING)"),
        ("producto_canonico_id", "CAST(NULL AS BIGINT)"),
        ("confianza_norm", "CAST(NULL AS DOUBLE)"),
        ("metodo_norm", "CAST(NULL AS STRING)"),
        ("created_at", "l_shipdate"),
    ], None),
    "eventos_base": ("orders", [
        ("folleto_id", "o_orderkey"),
        ("tienda_id", "CAST(floor(o_custkey / 15) AS BIGINT)"),
        ("k", _EVENT_INDEX),
        ("fecha_inicio", _START),
        ("fecha_fin", _END),
    ], None),
    "errores_carga": ("events", [
        ("id", "event_id"),
        ("corrida_at", "ts"),
        ("fuente", "CASE WHEN event_id % 2 = 0 THEN 'tiendeo' ELSE 'ofertomat' END"),
        ("tienda_slug", "CASE WHEN event_id % 9 = 0 THEN NULL"
                        " ELSE 'supplier_' || lpad(CAST(user_id % 50 AS STRING), 9, '0') END"),
        ("folleto_id_fuente", "CAST(400000 + user_id AS STRING)"),
        ("pagina", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'pagina_00' || CAST(event_id % 8 AS STRING) || '.webp' END"),
        ("categoria", _pick("event_id % 6", ERROR_CATEGORIES[:6])),
        ("sqlstate", "CASE event_id % 6 WHEN 0 THEN '22001' WHEN 1 THEN '22003' WHEN 2 THEN '22P02'"
                     " WHEN 3 THEN '23505' END"),
        ("mensaje", "props"),
        ("detalle", "CAST(NULL AS STRING)"),
        ("ruta_archivo", "'processed/' || CAST(user_id AS STRING) || '/nlp_resultado.json'"),
        ("resuelto", "event_id % 3 = 0"),
        ("resuelto_at", "CASE WHEN event_id % 3 = 0 THEN ts END"),
    ], None),
    "productos_canonicos": ("part", [
        ("id", "p_partkey"),
        ("nombre_canonico", "p_name || ' ' || CAST(p_partkey AS STRING)"),
        ("categoria", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE lower(p_type) END"),
        ("marca", "lower(p_brand)"),
    ], None),
}

_WHERE = {
    "errores_carga": "event_type = 'error'",
    "eventos_base": "o_orderkey % 5 = 0",
    "extracciones_producto": "l_partkey % 41 <> 7",
    "extracciones_otras": "l_discount >= 0.09e0 OR l_partkey % 40 = 9",
}

EXTRACTION_PARTS = ("extracciones_precio", "extracciones_producto", "extracciones_otras")

# Each event flyer has one event; every second one also carries the next name of the list.
EVENT_COLUMNS = [
    ("id", "folleto_id * 2"), ("folleto_id", "folleto_id"), ("tienda_id", "tienda_id"),
    ("nombre_evento", _pick("k", EVENT_NAMES)),
    ("texto_raw", f"CASE WHEN folleto_id % 3 = 0 THEN NULL ELSE upper({_pick('k', EVENT_NAMES)}) || ' ' END"),
    ("fecha_inicio", "fecha_inicio"), ("fecha_fin", "fecha_fin"),
]
SECOND_EVENT_COLUMNS = [
    ("id", "folleto_id * 2 + 1"), ("folleto_id", "folleto_id"), ("tienda_id", "tienda_id"),
    ("nombre_evento", _pick("(k + 1) % 20", EVENT_NAMES)),
    ("texto_raw", "'campaña'"),
    ("fecha_inicio", "fecha_inicio"), ("fecha_fin", "fecha_fin"),
]
SECOND_EVENT_FILTER = "folleto_id % 10 = 0"


def select_list(columns) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns)


def table_sql(table: str) -> str:
    source, columns, group = MAPPING[table]
    where = f" WHERE {_WHERE[table]}" if table in _WHERE else ""
    by = f" GROUP BY {group}" if group else ""
    return f"SELECT {select_list(columns)} FROM {source}{where}{by}"


def star_sql(table: str) -> str:
    """Portable SELECT for one star table over the source tables."""
    if table == "extracciones":
        return " UNION ALL ".join(table_sql(p) for p in EXTRACTION_PARTS)
    if table == "eventos_promo":
        base = table_sql("eventos_base")
        return (f"SELECT {select_list(EVENT_COLUMNS)} FROM ({base}) b UNION ALL "
                f"SELECT {select_list(SECOND_EVENT_COLUMNS)} FROM ({base}) b WHERE {SECOND_EVENT_FILTER}")
    return table_sql(table)


STAR_TABLES = ("tiendas", "folletos", "paginas", "extracciones", "eventos_promo",
               "errores_carga", "productos_canonicos")


def star_ctes() -> str:
    """The whole star as a list of CTEs for a checking engine."""
    return ",\n".join(
        f"{t} AS ({star_sql(t).replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for t in STAR_TABLES
    )
