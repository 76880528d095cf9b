"""Text blocks of flyer pages derived from TPC-H shaped tables.

Eight orders make one page; every line item is a cell of a four-column grid with a name,
a price in one of the forms prices are read in, and sometimes cents, a previous price, a
saving, a promotion or another text.  Expressions are portable, as in ``tpch_star``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_KEY = "CAST(floor(l_orderkey / 8) AS BIGINT)"
_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
ITEM_COLUMNS = [
    ("pagina", PAGE_KEY),
    ("tienda", f"'tienda_' || CAST({PAGE_KEY} % 20 AS STRING)"),
    ("pos", f"CAST(row_number() OVER (PARTITION BY {PAGE_KEY} {_ORDER}) AS INT)"),
    ("entero", "CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) % 890 + 10 AS INT)"),
    ("cent", "lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')"),
    ("p", "l_partkey"), ("s", "l_suppkey"),
    ("nombre", "p_name"), ("talla", "p_size"), ("tipo_parte", "lower(p_type)"),
    ("desc_", "CAST(floor(l_discount * 100 + 0.5e0) AS INT)"),
    ("imp", "CAST(floor(l_tax * 100 + 0.5e0) AS INT)"),
]
ITEM_SOURCE = "lineitem JOIN part ON l_partkey = p_partkey"

_E = "CAST(entero AS STRING)"
_X = "100 + (pos % 4) * 420"
_Y = "CAST(200 + floor(pos / 4) * 300 AS INT)"
# slot -> text, x, y, width, height; a NULL text means there is no such block
SLOTS = [
    ("CASE p % 4 WHEN 0 THEN upper(nombre) WHEN 1 THEN nombre || ' ' || CAST(talla AS STRING) || ' g'"
     " WHEN 2 THEN 'Oferta ' || nombre ELSE nombre END",
     f"{_X} + s % 30", f"{_Y} + p % 40", "60 + p % 120", "24"),
    (f"CASE p % 9 WHEN 0 THEN '$' || {_E} || '.' || cent WHEN 1 THEN '$' || {_E} || cent WHEN 2 THEN 's' || {_E} || cent"
     f" WHEN 3 THEN '5' || {_E} || 'clu' WHEN 4 THEN {_E} || cent WHEN 5 THEN '$1,' || lpad({_E}, 3, '0')"
     f" WHEN 6 THEN 'A solo $' || {_E} WHEN 7 THEN CAST(entero % 90 + 10 AS STRING) ELSE '8' || CAST(entero % 90 + 10 AS STRING) END",
     f"{_X} + s % 60", f"{_Y} + 80", "120", "60 + p % 20"),
    ("CASE WHEN p % 9 = 7 THEN cent END", f"{_X} + s % 60 + 125", f"{_Y} + 82", "40", "30"),
    ("CASE WHEN desc_ > 3 THEN 'Antes $' || CAST(entero + 10 + entero * desc_ / 20 - (entero * desc_ / 20) % 1 AS STRING) END",
     f"{_X} + s % 50", f"{_Y} + 150 + p % 10", "110", "26"),
    ("CASE WHEN desc_ > 8 THEN 'Ahorra $' || CAST(10 + desc_ AS STRING) END", f"{_X} + 130", f"{_Y} + 150", "110", "26"),
    ("CASE WHEN imp = 8 THEN '3x2' WHEN imp = 7 THEN '50% de descuento' END", f"{_X} + 200", f"{_Y} + 90", "90", "40"),
    ("CASE WHEN p % 50 = 0 THEN 'Puntos' WHEN p % 97 = 0 THEN 'JULIO REGALADO' WHEN p % 41 = 0 THEN tipo_parte || ' 2 pzas'"
     " WHEN p % 43 = 0 THEN 'walmart' END", f"{_X} + 190", f"{_Y} + 20", "100", "22"),
]
# The previous price avoids division that engines do differently.
SLOTS[3] = ("CASE WHEN desc_ > 3 THEN 'Antes $' || CAST(entero + 10 + CAST(floor(entero * desc_ / 20e0) AS INT) AS STRING) END",
            *SLOTS[3][1:])
CONFIDENCE = "CAST((p * 7 + s * 3 + {k} * 11) % 100 AS DOUBLE) / 1e2"
PAGE_WIDTH = 1500


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their parts, as the columns that cells are made of, and their page.

    They are dealt by page with these alone; what is made of them is made after.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    joined = lines.join(parts, F.expr("l_partkey = p_partkey"))
    used = set(re.findall(r"\w+", " ".join([_ORDER, *[e for n, e in ITEM_COLUMNS if n != "pos"]])))
    return joined.select(*[c for c in joined.columns if c in used], F.expr(PAGE_KEY).alias("pagina"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {**dict(ITEM_COLUMNS), "pagina": "pagina", "pos": f"CAST(row_number() OVER (PARTITION BY pagina {_ORDER}) AS INT)"}
    return _cells(spark, sf_dir).repartition("pagina").selectExpr(*[f"{e} AS {n}" for n, e in made.items()])


def blocks(spark: SparkSession, sf_dir: str, deal: list[str] | None = None, told: dict[str, str] | None = None) -> DataFrame:
    """(pagina, tienda, bloque, texto, confianza, x, y, ancho, alto, ancho_pagina)

    ``told`` has columns that a page tells, which are added.  ``deal`` names those, or ``tienda``, that
    rows are dealt by instead of by page: whoever groups the blocks by them need not deal them again.
    """
    order = _ORDER.removeprefix("ORDER BY ")
    deal, told, of_item = deal or [], told or {}, dict(ITEM_COLUMNS)
    paged = _cells(spark, sf_dir)
    dealt = paged.select("*", *[F.expr(told.get(n, of_item.get(n))).alias(n) for n in deal]).repartition(*(deal or ["pagina"]))
    made = {**{n: e for n, e in of_item.items() if n not in ("pagina", "pos")}, **told}
    cells = dealt.selectExpr("pagina", *[n if n in deal else f"{e} AS {n}" for n, e in made.items()], *order.split(", "))
    more = [n for n in told if n != "tienda"]
    # Texts before the numbering, boxes after it: the JVM does not compile a method of over 8000
    # bytes, which both together would be, and interprets it at several times the cost.
    texts = cells.selectExpr("pagina", "tienda", *more, "p", "s", *order.split(", "), f"array({', '.join(t for t, *_ in SLOTS)}) AS textos")
    place = ", ".join([*deal, "pagina"])
    rows = texts.selectExpr("pagina", "tienda", *more, "p", "s", f"CAST(row_number() OVER (PARTITION BY {place} {_ORDER}) AS INT) AS pos", "textos")
    rows = rows.selectExpr("pagina", "tienda", *more, "pos", "p", "s", "posexplode(textos) AS (k, texto)").filter("texto IS NOT NULL")

    def of_slot(i: int) -> str:
        return f"CAST(CASE k {' '.join(f'WHEN {k} THEN {slot[i]}' for k, slot in enumerate(SLOTS))} END AS INT)"

    box = [f"{of_slot(i)} AS {n}" for i, n in enumerate(("x", "y", "ancho", "alto"), 1)]
    return rows.selectExpr("pagina", "tienda", "CAST(pos * 8 + k AS INT) AS bloque", "texto", f"{CONFIDENCE.format(k='k')} AS confianza",
                           *box, f"{PAGE_WIDTH} AS ancho_pagina", *more)


def blocks_sql() -> dict[str, str]:
    """The same blocks as CTEs for a checking engine."""
    cols = ", ".join(f"{e} AS {n}" for n, e in ITEM_COLUMNS)
    parts = [
        f"SELECT pagina, tienda, CAST(pos * 8 + {k} AS INT) AS bloque, {text} AS texto, {CONFIDENCE.format(k=k)} AS confianza,"
        f" CAST({x} AS INT) AS x, CAST({y} AS INT) AS y, CAST({w} AS INT) AS ancho, CAST({h} AS INT) AS alto FROM items"
        for k, (text, x, y, w, h) in enumerate(SLOTS)]
    return {"items": f"SELECT {cols} FROM {ITEM_SOURCE}",
            "bloques": f"SELECT *, {PAGE_WIDTH} AS ancho_pagina FROM ({' UNION ALL '.join(parts)}) b WHERE texto IS NOT NULL"}
