"""Text blocks, association, names, evaluation and load, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from octavilla.functions import block_patterns, block_text, columns, geometry, names
from octavilla.functions.names import KeywordCatalogue
from octavilla.operators.cut import cut_lineage
from octavilla.operators.medians import exact_median
from octavilla.plans import association, evaluation, ingest, naming, panels, views
from octavilla.plans.classification import classify
from octavilla.sources import listings, tpch_blocks, writers

from .common import AS_OF, CATALOGUE, RECORD, pct, rnd, star_of, star_query

QUERIES: dict = {}
ORACLES: dict = {}
PAGE = ["pagina"]
NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
WORDS = KeywordCatalogue([(w, f"cat_{w}") for w in NOUNS])


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _with(ctes: dict[str, str], sql: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items()) + "\n" + sql


BLOCKS = tpch_blocks.blocks_sql()
# Slots of a cell: 0 is the name, 1 the price, 3 the previous price.
_SLOT = {"nombres": 0, "precios": 1, "antes": 3}
_VALUE = "TRY_CAST(nullif(regexp_extract(texto, '[0-9]+'), '') AS DOUBLE)"
CELLS = {**BLOCKS, **{n: f"SELECT *, {_VALUE} AS valor FROM bloques WHERE bloque % 8 = {k}" for n, k in _SLOT.items()}}


def _blocks(spark, sf, *slots):
    """The blocks as a written table, since the operators read them several times; of some slots, where these are all that is read."""
    rows = tpch_blocks.blocks(spark, sf)
    return cut_lineage(rows.filter((F.col("bloque") % 8).isin(*[_SLOT[s] for s in slots])) if slots else rows)


def _slot(spark, sf, name, blocks=None):
    blocks = _blocks(spark, sf) if blocks is None else blocks
    df = blocks.filter(F.col("bloque") % 8 == _SLOT[name])
    value = F.regexp_extract("texto", "[0-9]+", 0).try_cast("double")
    return df.withColumn("valor", value).withColumn("candidatos", F.array("valor"))


def _catalogue(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("orden"))
    none = F.lit(None).cast("string")
    return first.select("orden", F.initcap("p_name").alias("nombre"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("categoria"),
                        none.alias("marca"), F.array(F.concat("p_name", F.lit(" pieza"))).alias("aliases"))


def _normalizer(spark, sf):
    catalogue = _catalogue(spark, sf)
    return lambda texts: naming.normalize_names(texts, "texto", catalogue, WORDS, ("hot", "cold"))


# -- classification -------------------------------------------------------------------------

# What each slot and form of a generated cell is, told from the numbers it was made of.
_CELLS = """SELECT b.*, b.bloque % 8 AS slot, i.p % 9 AS forma, i.p, i.entero, i.cent, i.desc_, i.imp,
    b.x + b.ancho / 2e0 AS cx, b.y + b.alto / 2e0 AS cy, CAST(i.entero || '.' || i.cent AS DOUBLE) AS ec, i.entero % 90 + 10 AS nn
    FROM bloques b JOIN items i ON i.pagina = b.pagina AND i.pos = b.bloque // 8"""
_NEARBY = """SELECT t.pagina, t.bloque, o.bloque AS o_bloque, o.slot, o.forma, o.p, o.entero, o.desc_, o.texto
    FROM cel t JOIN cel o ON o.pagina = t.pagina AND o.bloque <> t.bloque
    WHERE t.slot = 1 AND t.forma IN (1, 3, 4, 8) AND sqrt((t.cx - o.cx) * (t.cx - o.cx) + (t.cy - o.cy) * (t.cy - o.cy)) <= 220"""
# the readings of "Antes $A": A, A with cents, and A with its first digit taken for a sign before 1
_EARLIER = """SELECT pagina, bloque, unnest(list_filter([v, CASE WHEN v >= 100 THEN v / 100e0 END, w, CASE WHEN w >= 100 THEN w / 100e0 END],
    lambda a: a IS NOT NULL AND a <> 0)) AS a FROM (SELECT pagina, bloque, CAST(substr(texto, 8) AS DOUBLE) AS v,
    CASE WHEN substr(texto, 8, 1) IN ('3', '4', '7', '9') THEN CAST('1' || substr(texto, 9) AS DOUBLE) END AS w FROM cerca WHERE slot = 3) q"""
_CONTEXT = """SELECT pagina, bloque, bool_or(slot IN (3, 4) OR slot = 1 AND forma = 6) AS fuerte,
    bool_or(slot = 0 AND p % 4 = 1 OR slot = 6 AND texto LIKE '% pzas') AS unidad, bool_or(slot = 6 AND texto = 'Puntos') AS puntos
    FROM cerca GROUP BY 1, 2"""
_WHOLE = "CASE WHEN c.forma = 8 THEN c.nn WHEN c.forma = 4 AND c.texto[1] IN ('5', '6', '8') THEN TRY_CAST(substr(c.texto, 2) AS INT) END"
_SUBTRACTED = f"""SELECT DISTINCT c.pagina, c.bloque FROM cel c JOIN antes_ a USING (pagina, bloque)
    JOIN cerca o ON o.pagina = c.pagina AND o.bloque = c.bloque AND o.slot = 4
    WHERE {_WHOLE} > 0 AND CAST(round(a.a * 100) AS BIGINT) - {_WHOLE} * 100 = (10 + o.desc_) * 100"""
_PRICES = f"""SELECT c.*, CASE c.forma WHEN 0 THEN c.ec WHEN 2 THEN c.ec WHEN 5 THEN 1000 + c.entero WHEN 6 THEN c.entero
    WHEN 1 THEN CASE WHEN v.entero AND NOT v.dividido THEN CAST(c.entero || c.cent AS DOUBLE) ELSE c.ec END
    WHEN 3 THEN CASE WHEN c.entero % 100 <> 0 OR (x.fuerte OR x.unidad) AND NOT x.puntos THEN c.entero END
    WHEN 4 THEN CASE WHEN c.entero >= 800 THEN CAST(c.entero % 100 || '.' || c.cent AS DOUBLE)
        WHEN regexp_full_match(c.texto, '20[12][0-9]') THEN NULL WHEN r.bloque IS NOT NULL THEN {_WHOLE} ELSE c.ec END
    WHEN 8 THEN CASE WHEN r.bloque IS NOT NULL OR c.alto >= 2 * m.m AND e.n >= 2 THEN c.nn
        WHEN x.fuerte AND NOT x.puntos THEN CAST('8.' || c.nn AS DOUBLE) END END AS valor
    FROM cel c LEFT JOIN contexto x USING (pagina, bloque) LEFT JOIN resta r USING (pagina, bloque)
    LEFT JOIN (SELECT c.pagina, c.bloque, bool_or(a.a / 3 <= CAST(c.entero || c.cent AS DOUBLE) AND CAST(c.entero || c.cent AS DOUBLE) < a.a) AS entero,
        bool_or(a.a / 3 <= c.ec AND c.ec < a.a) AS dividido FROM cel c JOIN antes_ a USING (pagina, bloque) GROUP BY 1, 2) v USING (pagina, bloque)
    LEFT JOIN (SELECT pagina, median(alto) AS m FROM bloques WHERE regexp_matches(texto, '[A-Za-z]{{3}}') GROUP BY 1) m USING (pagina)
    LEFT JOIN (SELECT pagina, count(*) AS n FROM cel WHERE slot = 1 AND forma = 8 GROUP BY 1) e USING (pagina)
    WHERE c.slot = 1 AND c.forma <> 7"""
_NOUN_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(texto), '\\b{w}\\b') THEN 'cat_{w}'" for w in sorted(NOUNS, key=len, reverse=True)) + " END"
CLASSIFIED = {**BLOCKS, "cel": _CELLS, "cerca": _NEARBY, "antes_": _EARLIER, "contexto": _CONTEXT, "resta": _SUBTRACTED, "conprecio": _PRICES,
              "clases": f"""SELECT pagina, bloque, CASE WHEN valor IS NULL THEN 'DESCARTE' ELSE 'PRECIO' END AS tipo, texto AS texto_norm, valor,
        CAST(NULL AS VARCHAR) AS categoria FROM conprecio WHERE confianza >= 0.15
    UNION ALL SELECT pagina, bloque, 'PRECIO', nn || '.' || cent, CAST(nn || '.' || cent AS DOUBLE), NULL FROM cel WHERE slot = 1 AND forma = 7
    UNION ALL SELECT pagina, bloque, CASE slot WHEN 0 THEN 'PRODUCTO' WHEN 3 THEN 'PRECIO_ANTERIOR' WHEN 4 THEN 'AHORRO'
        WHEN 5 THEN CASE WHEN texto = '3x2' OR pagina IN (SELECT pagina FROM conprecio WHERE valor IS NOT NULL AND confianza >= 0.15
            UNION ALL SELECT pagina FROM cel WHERE slot = 1 AND forma = 7 AND confianza >= 0.15) THEN 'PROMO' ELSE 'PRODUCTO' END
        ELSE CASE WHEN texto = 'JULIO REGALADO' THEN 'EVENTO_PROMO' WHEN texto LIKE '% pzas' THEN 'PRODUCTO' ELSE 'DESCARTE' END END, texto,
        CASE slot WHEN 3 THEN CAST(substr(texto, 8) AS DOUBLE) WHEN 4 THEN 10 + desc_ END, CASE WHEN slot = 0 THEN {_NOUN_CASE} END
    FROM cel WHERE slot NOT IN (1, 2) AND confianza >= 0.15"""}


@check("block_classification", _with(CLASSIFIED, "SELECT * FROM clases"))
def _(spark, sf):
    return classify(tpch_blocks.blocks(spark, sf), PAGE, WORDS).select(
        "pagina", "bloque", "tipo", "texto_norm", "valor", "categoria")


# Golden texts, one form per cell, filled with the cell's numbers: what a block is by its text alone.
# (text, discarded, purchase condition, strong promotion, weak promotion, campaign)
_NONE = (False, False, False, False, None)
_DROP = (True, False, False, False, None)
TEXT_FORMS = [
    ("nombre || ' ' || CAST(talla AS STRING) || ' g'", *_NONE),
    ("upper(nombre)", *_NONE),
    ("CAST(talla % 90 + 10 AS STRING)", *_NONE),
    ("'Leche ' || nombre", *_NONE),
    # size and shape
    ("substr(nombre, 1, 2)", *_DROP),
    ("'*** --- ' || substr('!!!!!!', 1, talla % 5 + 1)", *_DROP),
    ("'www.tienda' || CAST(talla AS STRING) || '.com'", *_DROP),
    ("'azul ###~~ ' || CAST(talla AS STRING)", *_DROP),
    ("'bcd fgh'", *_DROP),
    # validity, footer, calendar, limits
    ("'Vigencia al ' || CAST(talla AS STRING) || ' de julio'", *_DROP),
    ("'Hasta agotar ' || CAST(entero AS STRING) || ' piezas'", *_DROP),
    ("'Martes ' || CAST(talla % 20 + 10 AS STRING) || ' de julio'", *_DROP),
    ("'Maximo ' || CAST(talla AS STRING) || ' piezas por cliente'", *_DROP),
    ("'Del ' || CAST(talla % 20 + 1 AS STRING) || ' al 30 de jul'", *_DROP),
    # stores, sizes, states
    ("'Soriana'", *_DROP),
    ("'Tallas: ' || CAST(entero AS STRING)", *_DROP),
    ("CAST(entero AS STRING) || ' gb'", *_DROP),
    ("'Jalisco'", *_DROP),
    ("'CDMX'", *_DROP),
    # banks and financing
    ("'Banorte'", *_DROP),
    ("'Meses sin intereses'", *_DROP),
    ("'$' || CAST(entero AS STRING) || ' MN'", *_DROP),
    ("'Banorte o Santander ' || CAST(talla AS STRING)", *_DROP),
    # slogans, channels, loose words, covers
    ("'Aprovecha estos ' || nombre", *_DROP),
    ("'En línea'", *_DROP),
    ("'Golden Hills'", *_DROP),
    ("'OFERTAS'", *_DROP),
    ("'Síguenos en'", *_DROP),
    # whole-block captions
    ("'Sólo'", *_DROP),
    ("'Llévate más'", *_DROP),
    ("CAST(talla AS STRING) || ' puntos'", *_DROP),
    ("'Multi ahorro'", *_DROP),
    ("'Precio regular'", *_DROP),
    ("'Todos los días'", *_DROP),
    # purchase conditions
    ("'En compras de ' || CAST(entero AS STRING) || ' pesos o tu azul'", False, True, False, False, None),
    ("'compras mayores a $' || CAST(entero AS STRING)", False, True, False, False, None),
    # promotions
    ("CAST(talla AS STRING) || ' x $' || CAST(entero AS STRING)", False, False, True, False, None),
    ("'Compra uno y llévate otro azul'", False, False, True, False, None),
    ("'$' || CAST(talla AS STRING) || ' por cada $' || CAST(entero AS STRING)", False, False, True, False, None),
    ("CAST(talla AS STRING) || '% de descuento azul'", False, False, False, True, None),
    ("'azul gratis ' || nombre", False, False, False, True, None),
    # campaigns
    ("'Hot Sale'", False, False, False, False, "hot_sale"),
    ("'El Buen Fin'", False, False, False, False, "buen_fin"),
    ("'Regreso a clases ' || split_part(nombre, ' ', 2)", False, False, False, False, "regreso_a_clases"),
    ("'JULIO REGALADO'", False, False, False, False, "julio_regalado"),
    ("'Navidad'", False, False, False, False, "navidad"),
    ("'Navidad ' || nombre", *_NONE),
    ("'Aniversario de ' || nombre || ' azul'", *_NONE),
]
_TEXT_FORM = f"pos % {len(TEXT_FORMS)}"
_TEXT_CASE = "CASE " + _TEXT_FORM + " " + " ".join(f"WHEN {k} THEN {f[0]}" for k, f in enumerate(TEXT_FORMS)) + " END"


def _text_flag(n: int) -> str:
    holds = [str(k) for k, f in enumerate(TEXT_FORMS) if f[n]]
    return f"{_TEXT_FORM} IN ({', '.join(holds)})"


@check("text_kinds", _with(BLOCKS, f"""SELECT pagina, pos, {_TEXT_CASE} AS texto, {_text_flag(1)} AS descarte, {_text_flag(2)} AS condicion,
    {_text_flag(3)} AS promo_fuerte, {_text_flag(4)} AS promo_debil, CASE {_TEXT_FORM} """ + " ".join(
    f"WHEN {k} THEN '{f[5]}'" for k, f in enumerate(TEXT_FORMS) if f[5]) + " END AS evento FROM items"))
def _(spark, sf):
    rows = tpch_blocks.items(spark, sf).selectExpr("pagina", "pos", f"{_TEXT_CASE} AS texto")
    t = block_text.clean(F.col("texto"))
    return rows.select("pagina", "pos", "texto", block_text.is_discard(t).alias("descarte"),
                       t.rlike(block_patterns.PURCHASE_CONDITION).alias("condicion"), block_text.strong_promotion(t).alias("promo_fuerte"),
                       block_text.weak_promotion(t).alias("promo_debil"), block_text.campaign(t).alias("evento"))


# Amounts in the forms they are written in, and what they are read as.
# (text, kind, value read from entero E, cent C and size T)
AMOUNT_FORMS = [
    ("'Antes $' || CAST(entero AS STRING)", "antes", "entero"),
    ("'Antes: $1,' || lpad(CAST(entero AS STRING), 3, '0')", "antes", "1000 + entero"),
    ("'Precio anterior $' || CAST(entero AS STRING) || '.' || cent", "antes", "CAST(entero || '.' || cent AS DOUBLE)"),
    ("'DE $1' || lpad(CAST(entero AS STRING), 3, '0') || ' A'", "antes", "(1000 + entero) / 100e0"),
    ("'Ahorra $' || CAST(entero AS STRING)", "ahorro", "entero"),
    ("'Ahorro $1,' || lpad(CAST(entero AS STRING), 3, '0') || '.' || cent", "ahorro", "CAST((1000 + entero) || '.' || cent AS DOUBLE)"),
    ("'$ ' || CAST(entero AS STRING) || '.' || cent", "signo", "CAST(entero || '.' || cent AS DOUBLE)"),
    ("'$2,' || lpad(CAST(entero AS STRING), 3, '0')", "signo", "2000 + entero"),
    ("'S' || CAST(entero AS STRING) || cent", "signo", "CAST(entero || '.' || cent AS DOUBLE)"),
    ("'$3O' || CAST(talla % 10 AS STRING)", "signo", "300 + talla % 10"),
    ("'en compras mayores a $' || CAST(entero AS STRING)", "signo", "NULL"),
    ("CAST(CASE talla % 4 WHEN 0 THEN 6 WHEN 1 THEN 9 WHEN 2 THEN 12 ELSE 18 END AS STRING) || ' MSI de $' || CAST(entero AS STRING)", "meses",
     "CASE talla % 4 WHEN 0 THEN 6 WHEN 1 THEN 9 WHEN 2 THEN 12 ELSE 18 END"),
    ("'7 MSI de $' || CAST(entero AS STRING)", "meses", "NULL"),
    ("'Apartalo con $' || CAST(entero AS STRING)", "meses", "10"),
    ("'I2 MSI'", "meses", "12"),
]
_AMOUNT_FORM = f"pos % {len(AMOUNT_FORMS)}"
_AMOUNT_CASE = f"CASE {_AMOUNT_FORM} " + " ".join(f"WHEN {k} THEN {f[0]}" for k, f in enumerate(AMOUNT_FORMS)) + " END"
_AMOUNT_KIND = f"CASE {_AMOUNT_FORM} " + " ".join(f"WHEN {k} THEN '{f[1]}'" for k, f in enumerate(AMOUNT_FORMS)) + " END"


@check("text_amounts", _with(BLOCKS, f"""SELECT pagina, pos, {_AMOUNT_CASE} AS texto, CAST(CASE {_AMOUNT_FORM} """ + " ".join(
    f"WHEN {k} THEN {f[2]}" for k, f in enumerate(AMOUNT_FORMS)) + " END AS DOUBLE) AS valor FROM items"))
def _(spark, sf):
    rows = tpch_blocks.items(spark, sf).selectExpr("pagina", "pos", f"{_AMOUNT_CASE} AS texto", f"{_AMOUNT_KIND} AS clase")
    t, kind = block_text.clean(F.col("texto")), F.col("clase")
    value = (F.when(kind == "antes", F.try_element_at(block_text.previous_prices(t), F.lit(1))).when(kind == "ahorro", block_text.saving(t))
             .when(kind == "meses", block_text.months_of(t).cast("double")).otherwise(block_text.signed_price(t)["valor"]))
    return rows.select("pagina", "pos", "texto", value.alias("valor"))


@check("page_text_height", _with(BLOCKS, """SELECT pagina, median(alto) AS alto_texto FROM bloques
    WHERE regexp_matches(texto, '[A-Za-z]{3}') GROUP BY 1"""))
def _(spark, sf):
    lettered = tpch_blocks.blocks(spark, sf).filter(F.col("texto").rlike("[A-Za-z]{3}"))
    return exact_median(lettered, PAGE, "alto", "alto_texto")


@check("confident_blocks", _with(BLOCKS, "SELECT pagina, count(*) AS n FROM bloques WHERE confianza >= 0.15 GROUP BY 1"))
def _(spark, sf):
    from octavilla.plans import filters
    return filters.confident(tpch_blocks.blocks(spark, sf)).groupBy("pagina").agg(F.count(F.lit(1)).alias("n"))


@check("reading_order", _with(BLOCKS, """SELECT pagina, bloque, texto,
    row_number() OVER (PARTITION BY pagina ORDER BY floor(y / 20), x, bloque) AS lugar FROM bloques"""))
def _(spark, sf):
    from pyspark.sql import Window
    rows = panels.reading_order(tpch_blocks.blocks(spark, sf), PAGE)
    w = Window.partitionBy("pagina").orderBy(F.floor(F.col("y") / 20), "x", "bloque")
    return rows.select("pagina", "bloque", "texto", F.row_number().over(w).cast("bigint").alias("lugar"))


@check("block_words", _with(BLOCKS, """SELECT pagina, bloque, base,
    array_to_string(list_filter(string_split(base, ' '), lambda w: length(w) >= 3 AND w NOT IN
    ('de','la','el','los','las','y','o','con','en','del','a','sin','para','por','un','una','al','su','tu','mi','que','es','se','le','lo')),
    ' ') AS palabras FROM (SELECT pagina, bloque,
    trim(regexp_replace(regexp_replace(lower(trim(texto)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM bloques) b"""))
def _(spark, sf):
    rows = tpch_blocks.blocks(spark, sf).select("pagina", "bloque", names.base_text(F.col("texto")).alias("base"))
    return rows.select("pagina", "bloque", "base", F.array_join(names.significant_in(F.col("base")), " ").alias("palabras"))


@check("document_words", f"""SELECT doc_id, length(base) AS largo, len(string_split(base, ' ')) AS palabras,
    md5(base) AS huella FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(trim(text)),
    '{columns.ACCENTED}', '{columns.PLAIN}'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM documents) d""")
def _(spark, sf):
    base = names.base_text(F.col("text"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", base.alias("base"))
    return docs.select("doc_id", F.length("base").alias("largo"), F.size(F.split("base", " ")).alias("palabras"),
                       F.md5("base").alias("huella"))


# -- association ------------------------------------------------------------------------------

_PAIR = """SELECT p.pagina, p.bloque, a.bloque AS o_bloque, a.valor AS valor_anterior, p.texto, p.valor,
    greatest(CASE WHEN a.y + a.alto / 2.0 < p.y + p.alto / 2.0 THEN p.y - (a.y + a.alto) ELSE a.y - (p.y + p.alto) END, 0)
        / CAST(greatest(p.alto, a.alto) AS DOUBLE)
    + abs((a.x + a.ancho / 2e0) - (p.x + p.ancho / 2e0)) / greatest(p.ancho, a.ancho)
    + CASE WHEN p.alto < a.alto THEN 0.5e0 ELSE 0e0 END AS costo,
    CASE WHEN a.y + a.alto / 2.0 < p.y + p.alto / 2.0 THEN p.y - (a.y + a.alto) ELSE a.y - (p.y + p.alto) END AS gap,
    least(p.x + p.ancho, a.x + a.ancho) - greatest(p.x, a.x) AS tx, least(p.ancho, a.ancho) AS w,
    least(p.alto, a.alto) AS hmin, greatest(p.alto, a.alto) AS hmax,
    TRY_CAST(nullif(replace(regexp_extract(p.texto, '^[58](\\d[\\d,]*)$', 1), ',', ''), '') AS DOUBLE) AS otro
    FROM precios p JOIN antes a USING (pagina)"""


@check("previous_price_pairs", _with({**CELLS, "pares": _PAIR},
    f"""SELECT pagina, bloque, o_bloque, {rnd('costo', 6)} AS costo, valor_anterior FROM pares
    WHERE tx >= 0.3 * w AND gap >= -0.6 * hmin AND gap <= 1.2 * hmax AND valor > 0
    AND (valor_anterior - valor) / valor_anterior BETWEEN 0.03 AND 0.5
    AND NOT coalesce(otro <> valor AND (valor_anterior - otro) / valor_anterior BETWEEN 0.03 AND 0.5, false)"""))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    pairs = association.previous_price_pairs(_slot(spark, sf, "precios", blocks), _slot(spark, sf, "antes", blocks), PAGE)
    return pairs.withColumn("costo", columns.half_up(F.col("costo"), 6))


# the previous price of a cell lies nearest to its own price, so no two pairs share a side
@check("previous_prices", _with({**CELLS, "pares": _PAIR, "buenos": """SELECT *, count(*) OVER (PARTITION BY pagina, bloque) AS n,
    count(*) OVER (PARTITION BY pagina, o_bloque) AS m FROM pares WHERE tx >= 0.3 * w AND gap >= -0.6 * hmin AND gap <= 1.2 * hmax AND valor > 0
    AND (valor_anterior - valor) / valor_anterior BETWEEN 0.03 AND 0.5
    AND NOT coalesce(otro <> valor AND (valor_anterior - otro) / valor_anterior BETWEEN 0.03 AND 0.5, false)"""},
    "SELECT pagina, bloque, valor_anterior FROM buenos WHERE n = 1 AND m = 1"))
def _(spark, sf):
    blocks = _blocks(spark, sf, "precios", "antes")
    return association.match_previous_prices(_slot(spark, sf, "precios", blocks), _slot(spark, sf, "antes", blocks), PAGE)


_ALIGNED = """SELECT p.pagina, p.bloque, bool_or(n.y >= p.y - p.alto - 100 AND n.y < p.y) AS a,
    bool_or(n.y >= p.y + p.alto / 2.0 AND n.y <= p.y + p.alto + 100) AS b FROM precios p JOIN nombres n USING (pagina)
    WHERE abs(n.x - p.x) <= 20 AND n.y BETWEEN p.y - p.alto - 100 AND p.y + p.alto + 100 GROUP BY 1, 2"""


@check("aligned_neighbours", _with({**CELLS, "al": _ALIGNED},
    """SELECT pagina, count(*) FILTER (WHERE a AND NOT b) AS solo_arriba, count(*) FILTER (WHERE b AND NOT a) AS solo_debajo,
    count(*) FILTER (WHERE a AND b) AS ambos FROM al GROUP BY 1"""))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    return association.aligned_neighbours(_slot(spark, sf, "precios", blocks), _slot(spark, sf, "nombres", blocks), PAGE)


@check("page_layouts", _with({**CELLS, "al": _ALIGNED, "c": """SELECT pagina, count(*) FILTER (WHERE a AND NOT b) AS u,
    count(*) FILTER (WHERE b AND NOT a) AS d, count(*) FILTER (WHERE a AND b) AS m FROM al GROUP BY 1"""},
    "SELECT pagina, d > u + m AS nombre_debajo, m >= 3 AND m > u + d AS reticula FROM c"))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    return association.page_layouts(_slot(spark, sf, "precios", blocks), _slot(spark, sf, "nombres", blocks), PAGE)


_NEAR = """SELECT p.pagina, p.bloque, n.bloque AS o, abs(p.y - n.y) AS d, n.y >= p.y AS debajo,
    least(p.x + p.ancho, n.x + n.ancho) - greatest(p.x, n.x) > 0 AS propia,
    least(p.y + p.alto, n.y + n.alto) - greatest(p.y, n.y) > 0 AS fila
    FROM precios p JOIN nombres n USING (pagina) WHERE abs(n.x - p.x) <= 400 AND (n.y < p.y OR n.y - p.y <= p.alto + 100)"""


@check("nearest_product", _with({**CELLS, "near": _NEAR, "best": """SELECT pagina, bloque,
    min(ROW(d, debajo, o, propia OR fila)) AS mejor, min(ROW(d, debajo, o)) FILTER (WHERE propia) AS columna FROM near GROUP BY 1, 2"""},
    """SELECT p.pagina, p.bloque, CASE WHEN NOT b.mejor[4] AND b.columna IS NOT NULL THEN b.columna[3] ELSE b.mejor[3] END AS producto
    FROM precios p LEFT JOIN best b USING (pagina, bloque)"""))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    prices, products = _slot(spark, sf, "precios", blocks), _slot(spark, sf, "nombres", blocks)
    plain = association.page_layouts(prices, products, PAGE).withColumns(
        {"nombre_debajo": F.lit(False), "reticula": F.lit(False)})
    return association.choose_by_distance(prices, products, PAGE, layouts=plain)


@check("product_by_distance", _with({**CELLS, "near": _NEAR, "al": _ALIGNED, "c": """SELECT pagina, count(*) FILTER (WHERE a AND NOT b) AS u,
    count(*) FILTER (WHERE b AND NOT a) AS d, count(*) FILTER (WHERE a AND b) AS m FROM al GROUP BY 1""",
    "best": """SELECT pagina, bloque, min(ROW(d, debajo, o, propia OR fila)) AS mejor, min(ROW(d, debajo, o)) FILTER (WHERE propia) AS columna,
    min(ROW(d, debajo, o)) FILTER (WHERE propia AND NOT debajo) AS arriba FROM near GROUP BY 1, 2"""},
    # names of this data stand above their prices, so no page takes the name aligned below
    """SELECT p.pagina, p.bloque, CASE WHEN NOT b.mejor[4] AND b.columna IS NOT NULL THEN
        CASE WHEN coalesce(c.m >= 3 AND c.m > c.u + c.d, false) THEN coalesce(b.arriba, b.columna) ELSE b.columna END[3] ELSE b.mejor[3] END AS producto
    FROM precios p LEFT JOIN best b USING (pagina, bloque) LEFT JOIN c USING (pagina) WHERE NOT coalesce(c.d > c.u + c.m, false)"""))
def _(spark, sf):
    blocks = _blocks(spark, sf, "precios", "nombres")
    return association.choose_by_distance(_slot(spark, sf, "precios", blocks), _slot(spark, sf, "nombres", blocks), PAGE)


@check("product_above", _with(CELLS, """SELECT p.pagina, p.bloque, (SELECT min(ROW(p.y - n.y, n.bloque)) FROM nombres n
    WHERE n.pagina = p.pagina AND abs(n.x - p.x) <= 400 AND n.y < p.y)[2] AS producto FROM antes p"""))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    return association.choose_above(_slot(spark, sf, "antes", blocks), _slot(spark, sf, "nombres", blocks), PAGE)


@check("line_edges", _with(BLOCKS, """SELECT b.pagina, b.bloque, o.bloque AS o_bloque, b.y - (o.y + o.alto) AS hueco
    FROM bloques b JOIN bloques o USING (pagina) WHERE o.bloque <> b.bloque AND o.y < b.y
    AND least(b.x + b.ancho, o.x + o.ancho) - greatest(b.x, o.x) > 0
    AND b.y - (o.y + o.alto) BETWEEN -b.alto / 2.0 AND 2 * b.alto"""))
def _(spark, sf):
    return association.line_edges(tpch_blocks.blocks(spark, sf), PAGE).select("pagina", "bloque", "o_bloque", "hueco")


_REGION = """SELECT pagina, pos AS region, CAST(80 + (pos % 4) * 420 AS INT) AS x, CAST(190 + floor(pos / 4) * 300 AS INT) AS y,
    CAST(300 + p % 3 * 60 AS INT) AS ancho, CAST(260 AS INT) AS alto FROM items"""


def _regions(spark, sf):
    return tpch_blocks.items(spark, sf).selectExpr(
        "pagina", "pos AS region", "CAST(80 + (pos % 4) * 420 AS INT) AS x", "CAST(190 + floor(pos / 4) * 300 AS INT) AS y",
        "CAST(300 + p % 3 * 60 AS INT) AS ancho", "CAST(260 AS INT) AS alto")


_IN = "{c}.x + {c}.ancho / 2.0 BETWEEN r.x AND r.x + r.ancho AND {c}.y + {c}.alto / 2.0 BETWEEN r.y AND r.y + r.alto"


@check("product_by_region", _with({**CELLS, "reg": _REGION, "own": f"""SELECT p.pagina, p.bloque, min(r.region) AS region, any_value(p.y) AS py
    FROM precios p JOIN reg r ON r.pagina = p.pagina AND {_IN.format(c='p')} GROUP BY 1, 2""",
    "cand": f"SELECT r.pagina, r.region, r.ancho, n.bloque AS b, n.y, n.x + n.ancho / 2.0 AS cx FROM reg r JOIN nombres n ON n.pagina = r.pagina AND {_IN.format(c='n')}",
    "sp": """SELECT pagina, region, count(*) AS n, min(b) AS primero, (max(cx) - min(cx)) / max(ancho) AS disp FROM cand GROUP BY 1, 2"""},
    """SELECT o.pagina, o.bloque, CASE WHEN s.n = 1 THEN s.primero ELSE coalesce((SELECT min(ROW(o.py - c.y, c.b)) FROM cand c
    WHERE c.pagina = o.pagina AND c.region = o.region AND c.y < o.py)[2], s.primero) END AS producto
    FROM own o JOIN sp s USING (pagina, region) WHERE s.n = 1 OR s.disp <= 0.5"""))
def _(spark, sf):
    blocks = _blocks(spark, sf, "precios", "nombres")
    products = _slot(spark, sf, "nombres", blocks).withColumn("ilegible", F.lit(False))
    return association.choose_by_region(_slot(spark, sf, "precios", blocks), products, _regions(spark, sf), PAGE).select(
        "pagina", "bloque", "producto")


@check("regions_with_price", _with({**CELLS, "reg": _REGION}, """SELECT * FROM reg r WHERE EXISTS (SELECT 1 FROM precios p
    WHERE p.pagina = r.pagina AND regexp_matches(p.texto, '^(\\$|A solo \\$)\\d') AND
    greatest(0, least(p.x + p.ancho, r.x + r.ancho) - greatest(p.x, r.x))
    * greatest(0, least(p.y + p.alto, r.y + r.alto) - greatest(p.y, r.y)) >= 0.5 * p.ancho * p.alto)"""))
def _(spark, sf):
    prices = _slot(spark, sf, "precios").filter(F.col("texto").rlike(r"^(\$|A solo \$)\d"))
    return association.regions_with_price(_regions(spark, sf), prices, PAGE)


_AREA = "least(a.ancho * a.alto, b.ancho * b.alto)"


@check("outer_regions", _with({**CELLS, "todas": f"""SELECT * FROM ({_REGION}) UNION ALL
    SELECT pagina, region + 100000, x + 10, y + 10, ancho - 200, alto - 60 FROM ({_REGION})"""},
    f"""SELECT a.* FROM todas a WHERE NOT EXISTS (SELECT 1 FROM todas b WHERE b.pagina = a.pagina
        AND ROW(-b.ancho * b.alto, b.region) < ROW(-a.ancho * a.alto, a.region)
        AND greatest(0, least(a.x + a.ancho, b.x + b.ancho) - greatest(a.x, b.x))
            * greatest(0, least(a.y + a.alto, b.y + b.alto) - greatest(a.y, b.y)) >= 0.85 * {_AREA})"""))
def _(spark, sf):
    inner = _regions(spark, sf).selectExpr("pagina", "region + 100000 AS region", "x + 10 AS x", "y + 10 AS y",
                                           "ancho - 200 AS ancho", "alto - 60 AS alto")
    return association.drop_nested(_regions(spark, sf).unionByName(inner), PAGE)


@check("name_positions", _with(CELLS, """SELECT p.pagina, p.bloque, n.bloque AS nombre, CASE
    WHEN least(p.y + p.alto, n.y + n.alto) - greatest(p.y, n.y) > 0.3 * greatest(1, least(p.alto, n.alto))
      THEN CASE WHEN n.x + n.ancho / 2.0 < p.x + p.ancho / 2.0 THEN 'fila_izq' ELSE 'fila_der' END
    WHEN n.y + n.alto / 2.0 < p.y THEN 'arriba' WHEN n.y + n.alto / 2.0 > p.y + p.alto THEN 'debajo'
    WHEN n.x + n.ancho / 2.0 < p.x + p.ancho / 2.0 THEN 'fila_izq' ELSE 'fila_der' END AS posicion,
    abs(n.x - p.x) <= 400 AND (p.y > n.y OR n.y - p.y <= p.alto + 100) AS alcanzable
    FROM precios p JOIN nombres n ON n.pagina = p.pagina AND n.bloque = p.bloque - 1"""))
def _(spark, sf):
    n = _slot(spark, sf, "nombres").select("pagina", (F.col("bloque") + 1).alias("bloque"), F.col("bloque").alias("nombre"),
                                           *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "ancho", "alto")])
    return _slot(spark, sf, "precios").join(n, ["pagina", "bloque"]).select(
        "pagina", "bloque", "nombre", association.name_position().alias("posicion"),
        association.name_reachable().alias("alcanzable"))


@check("flyer_facts")
def _(spark, sf):
    classified = classify(tpch_blocks.blocks(spark, sf), PAGE, WORDS)
    return ingest.page_facts(classified, PAGE, _normalizer(spark, sf)).select(
        "pagina", "id", "tipo", "texto_raw", "texto_norm", "valor", "valor_anterior", "producto_extraccion_id", "metodo_norm")


_BOXES = "('bbox_x', 'bbox_y', 'bbox_ancho', 'bbox_alto')"


@check("coinciding_boxes", star_query("""SELECT e.id, p.id AS producto, (e.bbox_x = p.bbox_x AND e.bbox_y = p.bbox_y
    AND e.bbox_ancho = p.bbox_ancho AND e.bbox_alto = p.bbox_alto) OR
    greatest(0, least(e.bbox_x + e.bbox_ancho, p.bbox_x + p.bbox_ancho) - greatest(e.bbox_x, p.bbox_x))
    * greatest(0, least(e.bbox_y + e.bbox_alto, p.bbox_y + p.bbox_alto) - greatest(e.bbox_y, p.bbox_y))
    >= 0.5 * least(e.bbox_ancho * e.bbox_alto, p.bbox_ancho * p.bbox_alto) AS coincide
    FROM extracciones e JOIN extracciones p ON p.id = e.producto_extraccion_id"""))
def _(spark, sf):
    star = star_of(spark, sf)
    box = ("bbox_x", "bbox_y", "bbox_ancho", "bbox_alto")
    products = star.extracciones.filter("tipo = 'PRODUCTO'").select(
        F.col("id").alias("producto"), *[F.col(c).alias(f"p_{c}") for c in box])
    return star.precios().join(products, F.col("producto_extraccion_id") == F.col("producto")).select(
        "id", "producto", geometry.boxes_coincide(box, tuple(f"p_{c}" for c in box)).alias("coincide"))


@check("marked_blocks", _with(CELLS, """SELECT p.pagina, p.bloque AS registro, 'precio' AS caja,
    string_agg(CAST(b.bloque AS VARCHAR), ',' ORDER BY b.bloque) AS bloques FROM precios p JOIN bloques b USING (pagina)
    WHERE (b.x = p.x AND b.y = p.y AND b.ancho = p.ancho AND b.alto = p.alto) OR
    greatest(0, least(b.x + b.ancho, p.x + p.ancho) - greatest(b.x, p.x)) * greatest(0, least(b.y + b.alto, p.y + p.alto)
    - greatest(b.y, p.y)) >= 0.5 * least(b.ancho * b.alto, p.ancho * p.alto) GROUP BY 1, 2"""))
def _(spark, sf):
    blocks = _blocks(spark, sf)
    boxes = _slot(spark, sf, "precios", blocks).withColumns({"registro": F.col("bloque"), "caja": F.lit("precio")})
    rows = panels.mark_blocks(blocks, boxes, PAGE)
    return rows.withColumn("bloques", F.array_join(F.transform("bloques", lambda b: b.cast("string")), ","))


# -- names ----------------------------------------------------------------------------------------

# the catalogue's forms are the part names: a name is found, one with a size too, one after another word is not
_NORMALIZED = """SELECT texto, kind AS metodo_norm, false AS descartado,
    CASE WHEN kind = 'heuristico' THEN array_to_string(list_transform(string_split(lower(texto), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
        ELSE titulo END AS nombre_canonico,
    CASE WHEN kind = 'heuristico' THEN 0e0 ELSE 1e0 END AS confianza_norm,
    CASE WHEN kind = 'heuristico' THEN (SELECT min(ROW(-length(n), n)) FROM nouns WHERE regexp_matches(lower(texto), '\\b' || n || '\\b'))[2]
        ELSE split_part(nombre, ' ', 2) END AS categoria,
    CASE WHEN regexp_matches(lower(texto), '\\bcold\\b') THEN 'Cold' WHEN regexp_matches(lower(texto), '\\bhot\\b') THEN 'Hot' END AS marca
    FROM (SELECT DISTINCT texto, nombre, array_to_string(list_transform(string_split(nombre, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titulo,
            CASE WHEN starts_with(texto, 'Oferta ') THEN 'heuristico' WHEN regexp_matches(texto, ' \\d+ g$') THEN 'fuzzy' ELSE 'exacto' END AS kind
          FROM (SELECT texto, regexp_replace(regexp_replace(lower(texto), '^oferta ', ''), ' \\d+ g$', '') AS nombre FROM nombres))"""


@check("normalized_names", _with({**CELLS, "nouns": "SELECT unnest([" + ", ".join(f"'{n}'" for n in NOUNS) + "]) AS n"},
    "SELECT * REPLACE (CASE WHEN metodo_norm = 'heuristico' THEN 'cat_' || categoria ELSE categoria END AS categoria) FROM ("
    + _NORMALIZED + ")"))
def _(spark, sf):
    texts = _slot(spark, sf, "nombres").select("texto").distinct()
    return _normalizer(spark, sf)(texts).drop("alias_nuevo")


@check("word_categories", _with(CELLS, "SELECT DISTINCT texto, CASE " + " ".join(
    f"WHEN regexp_matches(lower(texto), '\\b{w}\\b') THEN 'cat_{w}'" for w in sorted(NOUNS, key=len, reverse=True))
    + " END AS categoria FROM nombres"))
def _(spark, sf):
    return _slot(spark, sf, "nombres").select("texto").distinct().select(
        "texto", WORDS.category(F.col("texto")).alias("categoria"))


@check("word_categories_by_table", _with(CELLS, "SELECT DISTINCT texto, CASE " + " ".join(
    f"WHEN contains(lower(texto), '{w}') THEN 'cat_{w}'" for w in sorted(NOUNS, key=len, reverse=True))
    + " WHEN contains(lower(texto), 'hot') THEN 'marca' END AS categoria, contains(lower(texto), 'anvil') AS es_atributo FROM nombres"))
def _(spark, sf):
    # the words are those of the parts: a table that grows with them
    part = spark.read.parquet(f"{sf}/part.parquet")
    each = part.select(F.explode(F.split("p_name", " ")).alias("palabra")).distinct()
    words = each.filter(F.col("palabra").isin(*NOUNS)).select(
        "palabra", F.concat(F.lit("cat_"), "palabra").alias("categoria"), F.lit(1).alias("orden"))
    brands = each.filter("palabra = 'hot'").select("palabra", F.lit("marca").alias("categoria"), F.lit(1).alias("orden"))
    return naming.categories(_slot(spark, sf, "nombres"), "texto", words, brands, "cat_anvil")


@check("title_case", _with(CELLS, """SELECT DISTINCT texto, array_to_string(list_transform(string_split(lower(texto), ' '),
    lambda w, i: CASE WHEN i > 1 AND w IN ('de','del','la','las','el','los','y','en','con','sin') THEN w
    ELSE upper(w[1]) || w[2:] END), ' ') AS titulo FROM nombres"""))
def _(spark, sf):
    return _slot(spark, sf, "nombres").select("texto").distinct().select("texto", names.title_case(F.col("texto")).alias("titulo"))


_FOLDED = f"translate(lower({{c}}), '{columns.ACCENTED}', '{columns.PLAIN}')"


@check("name_edit_similarity", star_query(f"""SELECT DISTINCT a, b, {rnd("1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)", 6)}
    AS similitud FROM (SELECT {_FOLDED.format(c='e.texto_norm')} AS a, {_FOLDED.format(c='n.nombre_canonico')} AS b
    FROM extracciones e JOIN productos_canonicos n ON n.id = e.producto_canonico_id WHERE {RECORD}) x"""))
def _(spark, sf):
    star = star_of(spark, sf)
    used = views.records(star).select("texto_norm", F.col("producto_canonico_id").alias("id")).distinct()
    rows = used.join(star.productos_canonicos, "id").select(
        columns.fold(F.col("texto_norm")).alias("a"), columns.fold(F.col("nombre_canonico")).alias("b")).distinct()
    return rows.withColumn("similitud", columns.half_up(names.edit_similarity(F.col("a"), F.col("b")), 6))


@check("normalization_summary", star_query(f"""SELECT tienda_id, count(*) AS total_productos,
    count(*) FILTER (WHERE metodo_norm IN ('exacto', 'fuzzy')) AS matcheados, count(*) FILTER (WHERE texto_norm IS NULL) AS descartados,
    count(*) - count(*) FILTER (WHERE metodo_norm IN ('exacto', 'fuzzy')) - count(*) FILTER (WHERE texto_norm IS NULL) AS sin_match,
    {rnd("CAST(count(*) FILTER (WHERE metodo_norm IN ('exacto', 'fuzzy')) AS DOUBLE) / count(*)", 3)} AS tasa_match
    FROM extracciones WHERE tipo = 'PRODUCTO' GROUP BY 1"""))
def _(spark, sf):
    rows = star_of(spark, sf).extracciones.filter("tipo = 'PRODUCTO'").withColumn("descartado", F.col("texto_norm").isNull())
    return naming.normalization_summary(rows, ["tienda_id"])


@check("canonical_names", star_query("""SELECT coalesce(o.nombre_canonico, n.nombre) AS nombre_canonico,
    coalesce(o.categoria, n.cat) AS categoria, coalesce(o.marca, n.marca) AS marca,
    coalesce(array_to_string(n.alias, ','), '') AS aliases FROM productos_canonicos o FULL JOIN
    (SELECT nombre, arg_min(c, id) FILTER (WHERE c <> '') AS cat, CAST(NULL AS VARCHAR) AS marca,
        (SELECT list(a ORDER BY m) FROM (SELECT r2.alias AS a, min(r2.id) AS m FROM res r2 WHERE r2.nombre = r.nombre
            AND r2.alias IS NOT NULL GROUP BY 1) x) AS alias FROM res r GROUP BY nombre) n ON n.nombre = o.nombre_canonico""",
    res="""SELECT e.id, CASE WHEN e.metodo_norm = 'heuristico' THEN e.texto_norm ELSE n.nombre_canonico END AS nombre,
    e.categoria_nlp AS c, CASE WHEN e.metodo_norm = 'fuzzy' THEN lower(e.texto_norm) END AS alias
    FROM extracciones e JOIN productos_canonicos n ON n.id = e.producto_canonico_id WHERE e.tipo = 'PRODUCTO'"""))
def _(spark, sf):
    star = star_of(spark, sf)
    old = star.productos_canonicos.withColumn("aliases", F.array().cast("array<string>"))
    rows = star.extracciones.filter("tipo = 'PRODUCTO'").withColumnRenamed("id", "fila").join(
        star.productos_canonicos.select(F.col("id").alias("producto_canonico_id"), F.col("nombre_canonico").alias("n")), "producto_canonico_id")
    results = rows.select(
        "fila", F.when(F.col("metodo_norm") == "heuristico", F.col("texto_norm")).otherwise(F.col("n")).alias("nombre_canonico"),
        F.col("categoria_nlp").alias("categoria"), F.lit(None).cast("string").alias("marca"),
        F.when(F.col("metodo_norm") == "fuzzy", F.lower("texto_norm")).alias("alias_nuevo"))
    return naming.merge_canonical(old, results, ["fila"]).withColumn("aliases", F.array_join("aliases", ","))


@check("event_dimension", star_query("""SELECT f.id AS folleto_id, f.tienda_id, x.campania AS nombre_evento,
    substr(coalesce(x.texto, ''), 1, 200) AS texto_raw, f.fecha_inicio, f.fecha_fin FROM
    (SELECT folleto_id, campania, arg_min(coalesce(texto_raw, nombre_evento), id) AS texto FROM evc WHERE campania IS NOT NULL GROUP BY 1, 2) x
    JOIN folletos f ON f.id = x.folleto_id""", "evc"))
def _(spark, sf):
    from octavilla.functions import promos
    star = star_of(spark, sf)
    blocks = promos.classify_events(star.eventos_promo).select(
        "folleto_id", F.col("id").alias("bloque"), F.col("campania").alias("evento"), F.lit("EVENTO_PROMO").alias("tipo"),
        F.coalesce("texto_raw", "nombre_evento").alias("texto"))
    return ingest.flyer_events(blocks, star.folletos)


# -- evaluation -------------------------------------------------------------------------------------
# A labelled document is an article, its quality says whether the record is right, and its
# source plays the store.

_LABELLED = """SELECT d.source AS tienda, count(*) AS articulos_con_precio, CAST(sum(1 - l.toxic) AS BIGINT) AS registros_dashboard,
    CAST(sum(CASE WHEN l.toxic = 0 THEN l.quality ELSE 0 END) AS BIGINT) AS completos_ok FROM labels l JOIN documents d USING (doc_id) GROUP BY 1"""


def _label_counts(spark, sf, strict=False):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("tienda"), "lang")
    good = F.when(F.col("toxic") == 0, F.col("quality")).otherwise(0)
    if strict:
        good = F.when(F.col("lang") == "en", good).otherwise(0)
    rows = labels.join(docs, "doc_id").groupBy("tienda").agg(
        F.count(F.lit(1)).alias("articulos_con_precio"), F.sum(1 - F.col("toxic")).cast("bigint").alias("registros_dashboard"),
        F.sum(good).cast("bigint").alias("completos_ok"))
    zero = F.lit(0).cast("bigint")
    return rows.select("*", *[zero.alias(c) for c in evaluation.COUNTS if c not in rows.columns])


def _wilson_sql(sign: str) -> str:
    p, n = "(CAST(completos_ok AS DOUBLE) / n)", "n"
    center = f"({p} + 3.8416e0 / (2 * {n})) / (1 + 3.8416e0 / {n})"
    margin = f"1.96e0 * sqrt({p} * (1 - {p}) / {n} + 3.8416e0 / (4 * {n} * {n})) / (1 + 3.8416e0 / {n})"
    edge = f"greatest(0e0, {center} - {margin})" if sign == "-" else f"least(1e0, {center} + {margin})"
    return f"CASE WHEN n IS NOT NULL THEN {rnd(edge, 4)} END"


_METRICS = f"""SELECT *, {rnd('CAST(completos_ok AS DOUBLE) / n', 4)} AS precision,
    {rnd('CAST(completos_ok AS DOUBLE) / articulos_con_precio', 4)} AS recall,
    {_wilson_sql('-')} AS precision_ic95_inf, {_wilson_sql('+')} AS precision_ic95_sup FROM (SELECT tienda,
    CAST(sum(articulos_con_precio) AS BIGINT) AS articulos_con_precio, CAST(sum(registros_dashboard) AS BIGINT) AS registros_dashboard,
    CAST(sum(completos_ok) AS BIGINT) AS completos_ok, CAST(nullif(sum(registros_dashboard), 0) AS DOUBLE) AS n FROM lab
    GROUP BY GROUPING SETS ((tienda), ())) s"""
_F1 = f"CASE WHEN precision + recall = 0 THEN 0e0 ELSE {rnd('2 * precision * recall / nullif(precision + recall, 0)', 4)} END"


@check("evaluation_metrics", _with({"lab": _LABELLED, "m": _METRICS}, f"""SELECT tienda, registros_dashboard, articulos_con_precio,
    completos_ok, precision, recall, {_F1} AS f1, precision_ic95_inf, precision_ic95_sup FROM m"""))
def _(spark, sf):
    return evaluation.metrics(_label_counts(spark, sf)).select(
        "tienda", "registros_dashboard", "articulos_con_precio", "completos_ok", "precision", "recall", "f1",
        "precision_ic95_inf", "precision_ic95_sup")


_STRICT = _LABELLED.replace("WHEN l.toxic = 0 THEN", "WHEN l.toxic = 0 AND d.lang = 'en' THEN")


def _run_side(metric, whole):
    z = ("(CAST(n.completos_ok AS DOUBLE) / n.{w} - CAST(b.completos_ok AS DOUBLE) / b.{w}) / nullif(sqrt(pp * (1 - pp)"
         " * (1e0 / b.{w} + 1e0 / n.{w})), 0)").format(w=whole)
    pp = f"CAST(b.completos_ok + n.completos_ok AS DOUBLE) / (b.{whole} + n.{whole})"
    delta = rnd(f"(n.{metric} - b.{metric}) * 100", 2)
    return f"""SELECT coalesce(b.tienda, 'global') AS ambito, '{metric}' AS metrica, b.{metric} AS base, n.{metric} AS nueva,
        {delta} AS delta_pts, least(b.{whole}, n.{whole}) AS n, {rnd(z.replace('pp', f'({pp})'), 2)} AS z,
        coalesce({delta} < -2, false) AS regresion,
        coalesce({delta} < -2, false) AND least(b.{whole}, n.{whole}) >= 20 AND coalesce(abs({z.replace('pp', f'({pp})')}) >= 1.96, false)
        AS significativa, coalesce({delta} < -2, false) AND least(b.{whole}, n.{whole}) >= 20 AS bloquea
        FROM mb b JOIN mn n ON n.tienda IS NOT DISTINCT FROM b.tienda"""


@check("run_comparison", _with({"lab": _LABELLED, "mb": _METRICS, "lab2": _STRICT, "mn": _METRICS.replace("FROM lab", "FROM lab2")},
                               _run_side("precision", "registros_dashboard") + " UNION ALL " + _run_side("recall", "articulos_con_precio")))
def _(spark, sf):
    return evaluation.compare_runs(evaluation.metrics(_label_counts(spark, sf)),
                                   evaluation.metrics(_label_counts(spark, sf, strict=True)))


_RELIABILITY_LABEL = """CASE WHEN precision IS NULL OR coalesce(n, 0) = 0 THEN 'Sin medir' WHEN n < 30 THEN 'Muestra insuficiente'
    WHEN precision < 0.10 THEN 'Baja' WHEN precision >= 0.25 AND coalesce(precision_ic95_inf, -1) >= 0.15 THEN 'Aceptable' ELSE 'Media' END"""


@check("reliability_with_run", star_query(f"""SELECT t.slug AS tienda_slug, coalesce(r.n, 0) AS registros, m.precision,
    coalesce(m.etiqueta, 'Sin medir') AS etiqueta, coalesce({pct('r.cat', 'r.n')} < 20, false) AS base_heuristica
    FROM tiendas t LEFT JOIN (SELECT tienda_id, count(*) AS n, count(*) FILTER (WHERE metodo IN {CATALOGUE}) AS cat FROM base GROUP BY 1) r
        ON r.tienda_id = t.id
    LEFT JOIN (SELECT 'supplier_' || lpad(substr(tienda, 4), 9, '0') AS slug, precision, {_RELIABILITY_LABEL} AS etiqueta
        FROM m WHERE tienda IS NOT NULL) m ON m.slug = t.slug""", "base", lab=_LABELLED, m=_METRICS))
def _(spark, sf):
    rows = panels.store_reliability(star_of(spark, sf))
    scores = evaluation.metrics(_label_counts(spark, sf)).filter("tienda IS NOT NULL")
    measured = scores.select(
        F.concat(F.lit("supplier_"), F.lpad(F.substring("tienda", 4, 20), 9, "0")).alias("tienda_slug"), "precision",
        evaluation.reliability_label(F.col("precision"), F.col("precision_ic95_inf"), F.col("registros_dashboard")).alias("etiqueta"))
    return evaluation.join_reliability(rows, measured).select("tienda_slug", "registros", "precision", "etiqueta", "base_heuristica")


_TOLD = """SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(translate(lower(trim(text)),
    '{a}', '{p}'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN
    ('de','la','el','los','las','y','o','con','en','del','a','sin','para','por','un','una','al','su','tu','mi','que','es','se','le','lo'))
    AS w FROM conversations WHERE role = 'user'""".format(a=columns.ACCENTED, p=columns.PLAIN)
_CORPUS = """SELECT conv_id, string_agg(trim(regexp_replace(regexp_replace(translate(lower(trim(text)), '{a}', '{p}'),
    '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ' ORDER BY turn) AS c FROM conversations WHERE role = 'assistant' GROUP BY 1""".format(
        a=columns.ACCENTED, p=columns.PLAIN)


@check("text_recall", _with({"told": _TOLD, "corpus": _CORPUS}, f"""SELECT t.conv_id, t.turn, {rnd('s', 6)} AS cobertura, s >= 0.5 AS encontrado
    FROM (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0e0 ELSE CAST(len(list_filter(w, lambda x: contains(coalesce(c, ''), x))) AS DOUBLE)
    / len(w) END AS s FROM told LEFT JOIN corpus USING (conv_id)) t"""))
def _(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    found = evaluation.recall_in_corpus(talks.filter("role = 'user'"), "text", talks.filter("role = 'assistant'"), ["conv_id"],
                                        ["turn"], "text")
    return found.withColumn("cobertura", columns.half_up(F.col("cobertura"), 6))


def _judged(spark, sf):
    """Records read from the cells and the articles that the line items say are there."""
    cells, blocks = cut_lineage(tpch_blocks.items(spark, sf)), _blocks(spark, sf)
    names_ = _slot(spark, sf, "nombres", blocks).select("pagina", F.col("bloque").alias("nb"), F.col("texto").alias("producto"))
    records = _slot(spark, sf, "precios", blocks).withColumn("nb", F.col("bloque") - 1).join(names_, ["pagina", "nb"]).select(
        "pagina", "tienda", F.col("bloque").alias("registro"), F.col("valor").alias("precio"), F.col("texto").alias("precio_texto"),
        "producto", F.col("producto").alias("producto_texto"), F.lit(None).cast("string").alias("categoria"),
        F.lit(None).cast("double").alias("precio_anterior"), "x", "y")
    articles = cells.select(
        "pagina", "tienda", F.col("pos").alias("id"), F.concat("nombre", F.lit(" "), "tipo_parte").alias("producto"),
        F.lit(None).cast("string").alias("categoria"), F.col("entero").cast("double").alias("precio"),
        F.lit(None).cast("double").alias("precio_anterior"))
    return cut_lineage(records), articles


@check("matched_records")
def _(spark, sf):
    records, articles = _judged(spark, sf)
    return evaluation.match_records(records, articles, PAGE).select(
        "pagina", "registro", "id", "precio_ok", columns.half_up(F.col("similitud"), 6).alias("similitud"), "error")


@check("evaluated_run")
def _(spark, sf):
    records, articles = _judged(spark, sf)
    blocks = tpch_blocks.blocks(spark, sf)
    kind = F.coalesce(F.when(F.col("bloque") % 8 == 0, "PRODUCTO"), F.when(F.col("bloque") % 8 == 1, "PRECIO"), F.lit("DESCARTE"))
    classified = blocks.withColumns({"tipo": kind, "valor": F.regexp_extract("texto", "[0-9]+", 0).try_cast("double")})
    promotions = blocks.filter("bloque % 8 = 5").select("pagina", "texto")
    out = evaluation.evaluate(articles.select("pagina", "tienda").distinct(), records, articles, promotions, blocks, classified,
                              blocks.filter("bloque % 8 = 0"), PAGE)
    return out["metricas"]


@check("layout_catalogue")
def _(spark, sf):
    _, articles = _judged(spark, sf)
    return evaluation.layout_catalogue(articles, _slot(spark, sf, "precios"), _slot(spark, sf, "nombres"), PAGE)


_SPLIT = """SELECT tienda, folleto, CASE WHEN ok AND rn <= CASE WHEN n >= 6 THEN 2 ELSE 1 END THEN 'holdout' ELSE 'dev' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY tienda ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, abs(articulos - med),
        sha256('semilla:' || folleto)) AS rn FROM (SELECT *, maxa = 0 OR antes > 0 AS ok FROM (SELECT *, count(*) OVER w AS n,
        median(articulos) OVER w AS med, max(antes) OVER w AS maxa FROM (SELECT tienda_id AS tienda, CAST(folleto_id AS VARCHAR) AS folleto,
        count(id) AS articulos, count(valor_anterior) AS antes FROM extracciones WHERE tipo = 'PRECIO' GROUP BY 1, 2) f
        WINDOW w AS (PARTITION BY tienda)) g) h) i"""


@check("flyer_split", star_query(_SPLIT))
def _(spark, sf):
    articles = star_of(spark, sf).precios().select(
        F.col("tienda_id").alias("tienda"), F.col("folleto_id").cast("string").alias("folleto"), "id",
        F.col("valor_anterior").alias("precio_anterior"))
    return evaluation.split_flyers(articles, "semilla")


@check("quota_sample", star_query("""SELECT id, grupo, tienda, orden FROM (SELECT *, row_number() OVER (PARTITION BY grupo ORDER BY vuelta, tienda)
    AS orden FROM (SELECT id, categoria AS grupo, tienda_slug AS tienda, row_number() OVER (PARTITION BY categoria, tienda_slug
    ORDER BY sha256('v1:' || CAST(id AS VARCHAR)), id) AS vuelta FROM errores_carga WHERE tienda_slug IS NOT NULL) a) b
    WHERE orden <= CASE grupo WHEN 'tamano_excesivo' THEN 14 WHEN 'formato_invalido' THEN 16 ELSE 0 END"""))
def _(spark, sf):
    cases = star_of(spark, sf).errores_carga.filter("tienda_slug IS NOT NULL").select(
        F.col("id").cast("string").alias("caso"), "id", F.col("categoria").alias("grupo"), F.col("tienda_slug").alias("tienda"))
    rows = evaluation.quota_sample(cases, {"tamano_excesivo": 14, "formato_invalido": 16}, "caso", "v1")
    return rows.select("id", "grupo", "tienda", F.col("orden").cast("bigint").alias("orden"))


@check("seal_drift", """SELECT coalesce(a.doc_id, b.doc_id) AS archivo, CASE WHEN a.doc_id IS NULL THEN 'nuevo' WHEN b.doc_id IS NULL
    THEN 'falta' ELSE 'modificado' END AS estado FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h
    FROM documents WHERE lang <> 'fr') a FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(replace(CASE WHEN lang = 'de' THEN text || '!'
    ELSE text END, chr(13) || chr(10), chr(10))) AS h FROM documents WHERE lang <> 'es') b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("path", F.col("doc_id").cast("string"))
    before = docs.filter("lang <> 'fr'").withColumn("content", F.col("text"))
    after = docs.filter("lang <> 'es'").withColumn("content", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return evaluation.seal_drift(evaluation.seals(before), evaluation.seals(after))


@check("changed_pages", star_query("""SELECT pagina_id, CASE WHEN count(*) FILTER (WHERE v = 'b') = 0 THEN 'solo_a'
    WHEN count(*) FILTER (WHERE v = 'a') = 0 THEN 'solo_b' ELSE 'distinta' END AS estado FROM (SELECT 'a' AS v, pagina_id, id, valor FROM a
    UNION ALL SELECT 'b', pagina_id, id, valor FROM b) u GROUP BY 1
    HAVING bool_or(v = 'a') <> bool_or(v = 'b') OR pagina_id IN (SELECT pagina_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x
        UNION SELECT pagina_id FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y)""",
    a="SELECT pagina_id, id, valor FROM extracciones WHERE tipo = 'PRECIO' AND texto_norm IS NOT NULL",
    b="SELECT pagina_id, id, CASE WHEN metodo_norm = 'exacto' THEN valor * 2 ELSE valor END AS valor FROM extracciones WHERE tipo = 'PRECIO' AND valor IS NOT NULL"))
def _(spark, sf):
    prices = star_of(spark, sf).precios()
    before = prices.filter("texto_norm IS NOT NULL").select("pagina_id", "id", "valor")
    after = prices.filter("valor IS NOT NULL").select(
        "pagina_id", "id", F.when(F.col("metodo_norm") == "exacto", F.col("valor") * 2).otherwise(F.col("valor")).alias("valor"))
    key = ["pagina_id"]
    return evaluation.fingerprint_differences(
        evaluation.page_fingerprints(before, key), evaluation.page_fingerprints(after, key), key)


@check("rule_impact", star_query("""SELECT id, antes, despues, cambio, texto, regexp_replace(texto, '[0-9]', 'd', 'g') AS forma FROM (SELECT id,
    a.valor AS antes, b.valor AS despues, CASE WHEN a.valor IS NULL THEN 'creado' WHEN b.valor IS NULL THEN 'perdido'
    WHEN NOT abs(a.valor - b.valor) < 0.01 THEN 'cambiado' END AS cambio, coalesce(b.t, a.t) AS texto FROM a FULL JOIN b USING (id)) x
    WHERE cambio IS NOT NULL""",
    a="SELECT id, valor, texto_raw AS t FROM extracciones WHERE tipo = 'PRECIO' AND metodo_norm IS NOT NULL AND valor IS NOT NULL",
    b="SELECT id, CASE WHEN valor >= 1000 THEN valor / 100 ELSE valor END AS valor, texto_raw AS t FROM extracciones WHERE tipo = 'PRECIO' AND categoria_nlp IS NOT NULL AND valor IS NOT NULL"))
def _(spark, sf):
    prices = star_of(spark, sf).precios().filter("valor IS NOT NULL").withColumn("texto", F.col("texto_raw"))
    before = prices.filter("metodo_norm IS NOT NULL").select("id", "tipo", "valor", "texto")
    after = prices.filter("categoria_nlp IS NOT NULL").select(
        "id", "tipo", F.when(F.col("valor") >= 1000, F.col("valor") / 100).otherwise(F.col("valor")).alias("valor"), "texto")
    return evaluation.rule_impact(before, after, ["id"])


@check("case_changes", star_query("""SELECT coalesce(a.clave, b.clave) AS clave, coalesce(b.tienda, a.tienda) AS tienda,
    coalesce(a.estado, 'fuera') AS antes, coalesce(b.estado, 'fuera') AS despues FROM a FULL JOIN b USING (clave)
    WHERE coalesce(a.estado, 'fuera') <> coalesce(b.estado, 'fuera')""",
    a="SELECT CAST(id AS VARCHAR) AS clave, fuente AS tienda, categoria AS estado FROM errores_carga WHERE NOT resuelto",
    b="SELECT CAST(id AS VARCHAR) AS clave, fuente AS tienda, CASE WHEN sqlstate IS NULL THEN 'ok' ELSE categoria END AS estado FROM errores_carga WHERE pagina IS NOT NULL"))
def _(spark, sf):
    log = star_of(spark, sf).errores_carga.withColumn("clave", F.col("id").cast("string")).withColumnRenamed("fuente", "tienda")
    before = log.filter("NOT resuelto").select("clave", "tienda", F.col("categoria").alias("estado"))
    after = log.filter("pagina IS NOT NULL").select(
        "clave", "tienda", F.when(F.col("sqlstate").isNull(), "ok").otherwise(F.col("categoria")).alias("estado"))
    return evaluation.case_changes(before, after, "fuera")


# -- sources and load ----------------------------------------------------------------------------------

@check("listing_links", """SELECT page_id, count(*) AS enlaces, count(DISTINCT href) AS distintos, max(href) AS mayor FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages) l GROUP BY 1""")
def _(spark, sf):
    links = listings.page_links(spark.read.parquet(f"{sf}/pages.parquet"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("enlaces"), F.count_distinct("href").alias("distintos"),
                                        F.max("href").alias("mayor"))


@check("listing_cards")
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return listings.leaflet_cards(pages, "http://example.com", id_pattern=r"/([A-Za-z]{5,})$")


@check("validity_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha_inicio,
    CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) + 7 END AS fecha_fin FROM orders""")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("fin", F.date_add(F.col("o_orderdate").cast("date"), 7))
    k, day = F.col("o_orderkey") % 4, lambda f, c="o_orderdate": F.date_format(c, f)
    iso = F.concat(F.lit("Folleto "), day("yyyy-MM-dd"), F.lit("T00:00:00.000Z - "), day("yyyy-MM-dd", "fin"), F.lit("T00"))
    long_ = F.concat(F.lit("vale durante los días "), day("dd/MM/yyyy"), F.lit(" - "), day("dd/MM/yyyy", "fin"))
    url = F.concat(F.lit("/x/oferta-desde-lunes-"), day("dd-MM-yyyy"), F.lit("-12345"))
    none = F.lit("")
    dates = listings.validity_dates(F.when(k == 0, iso).otherwise(none), F.when(k.isin(1, 2), long_).otherwise(none),
                                    F.when(k == 3, url).otherwise(none))
    return orders.select("o_orderkey", *[c.alias(n) for n, c in dates.items()])


@check("page_metrics", _with({**BLOCKS, "k": "SELECT pagina, bloque, CASE bloque % 8 WHEN 0 THEN 'PRODUCTO' WHEN 1 THEN 'PRECIO' WHEN 3 THEN"
    " 'PRECIO_ANTERIOR' WHEN 4 THEN 'AHORRO' WHEN 5 THEN 'PROMO' ELSE 'DESCARTE' END AS tipo FROM bloques"},
    f"""SELECT pagina, count(*) FILTER (WHERE tipo = 'PRODUCTO') AS total_productos, count(*) FILTER (WHERE tipo = 'PRECIO') AS total_precios,
    count(*) FILTER (WHERE tipo = 'PROMO') AS total_promos, CAST(0 AS BIGINT) AS total_atributos, count(*) AS total_bloques_ocr,
    {rnd("CAST(count(*) FILTER (WHERE tipo <> 'DESCARTE') AS DOUBLE) / count(*)", 3)} AS tasa_util FROM k GROUP BY 1"""))
def _(spark, sf):
    blocks = _kinds(spark, sf)
    readings = blocks.groupBy("pagina").agg(F.count(F.lit(1)).alias("total_bloques_ocr"))
    return writers.page_metrics(blocks, readings, PAGE)


def _kinds(spark, sf, **dealt):
    kinds = ("PRODUCTO", "PRECIO", "DESCARTE", "PRECIO_ANTERIOR", "AHORRO", "PROMO", "DESCARTE", "DESCARTE")
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.col("bloque") % 8)
    return tpch_blocks.blocks(spark, sf, **dealt).withColumn("tipo", kind)


@check("flyer_totals", _with(BLOCKS, f"""SELECT tienda, count(*) FILTER (WHERE bloque % 8 = 0) AS total_productos,
    count(*) FILTER (WHERE bloque % 8 = 1) AS total_precios, count(*) FILTER (WHERE bloque % 8 = 3) AS total_precios_anterior,
    count(*) FILTER (WHERE bloque % 8 = 4) AS total_ahorros, count(*) FILTER (WHERE bloque % 8 = 5) AS total_promos,
    CAST(0 AS BIGINT) AS total_eventos_promo, CAST(0 AS BIGINT) AS total_atributos, count(*) FILTER (WHERE bloque % 8 IN (2, 6)) AS total_descartes,
    {rnd("CAST(count(*) FILTER (WHERE bloque % 8 NOT IN (2, 6)) AS DOUBLE) / count(*)", 3)} AS tasa_util FROM bloques GROUP BY 1"""))
def _(spark, sf):
    return writers.flyer_totals(_kinds(spark, sf), ["tienda"])


_INCOMING = """SELECT id, tienda_id + 1 AS tienda_id, folleto_id_fuente, fuente, CASE WHEN estado = 'done' THEN NULL ELSE 'Nuevo ' || titulo END AS titulo,
    fecha_inicio, fecha_fin, url_origen, total_paginas + 1 AS total_paginas, perfil_ocr, motor_ocr, scrapeado_at, 'done' AS estado, created_at FROM folletos"""


@check("flyer_upsert", star_query(f"""SELECT coalesce(o.id, n.id) AS id, coalesce(n.tienda_id, o.tienda_id) AS tienda_id, coalesce(o.folleto_id_fuente,
    n.folleto_id_fuente) AS folleto_id_fuente, coalesce(o.fuente, n.fuente) AS fuente, coalesce(n.titulo, o.titulo) AS titulo,
    coalesce(n.total_paginas, o.total_paginas) AS total_paginas, coalesce(n.estado, o.estado) AS estado
    FROM (SELECT * FROM folletos WHERE fuente = 'tiendeo') o FULL JOIN ({_INCOMING}) n ON n.fuente = o.fuente
    AND n.folleto_id_fuente = o.folleto_id_fuente"""))
def _(spark, sf):
    flyers = star_of(spark, sf).folletos
    incoming = flyers.withColumns({
        "tienda_id": F.col("tienda_id") + 1, "titulo": F.when(F.col("estado") != "done", F.concat(F.lit("Nuevo "), "titulo")),
        "total_paginas": F.col("total_paginas") + 1, "estado": F.lit("done")})
    return ingest.upsert_flyers(flyers.filter("fuente = 'tiendeo'"), incoming, replace=True).select(
        "id", "tienda_id", "folleto_id_fuente", "fuente", "titulo", "total_paginas", "estado")


@check("pending_flyers", star_query("""SELECT fuente, folleto_id_fuente FROM folletos f WHERE NOT EXISTS (SELECT 1 FROM errores_carga e
    WHERE e.fuente = f.fuente AND e.folleto_id_fuente = f.folleto_id_fuente)"""))
def _(spark, sf):
    star = star_of(spark, sf)
    keys = ("fuente", "folleto_id_fuente")
    return ingest.pending(star.folletos.select(*keys), star.errores_carga, keys)


@check("replaced_children", star_query("""SELECT e.folleto_id, count(*) AS n FROM extracciones e WHERE e.tipo = 'PRECIO' AND e.folleto_id NOT IN
    (SELECT id FROM folletos WHERE estado = 'done') GROUP BY 1 UNION ALL SELECT e.folleto_id, count(*) FROM extracciones e JOIN folletos f
    ON f.id = e.folleto_id AND f.estado = 'done' WHERE e.tipo = 'PRODUCTO' GROUP BY 1"""))
def _(spark, sf):
    star = star_of(spark, sf)
    # half of all flyers, so neither side is sorted to drop their rows
    done = star.folletos.filter("estado = 'done'").select(F.col("id").alias("folleto_id")).hint("shuffle_hash")
    new = star.extracciones.filter("tipo = 'PRODUCTO'").join(done, "folleto_id", "left_semi")
    return ingest.replace_children(star.precios(), new, done).groupBy("folleto_id").agg(F.count(F.lit(1)).alias("n"))


@check("rejected_pages", star_query("""SELECT pagina_id, CASE WHEN bool_or(c = 'tamano_excesivo') THEN 'tamano_excesivo' ELSE 'valor_fuera_de_rango' END
    AS categoria, count(*) AS filas FROM (SELECT pagina_id, CASE WHEN length(texto_norm) > 300 THEN 'tamano_excesivo' WHEN abs(valor) > 20000
    THEN 'valor_fuera_de_rango' END AS c FROM (SELECT pagina_id, CASE WHEN metodo_norm = 'fuzzy_bajo' THEN repeat(texto_norm, 20) ELSE texto_norm END
    AS texto_norm, valor FROM extracciones WHERE tipo = 'PRECIO') a) b WHERE c IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    rows = star_of(spark, sf).precios().withColumn("texto_norm", F.when(
        F.col("metodo_norm") == "fuzzy_bajo", F.repeat("texto_norm", F.lit(20))).otherwise(F.col("texto_norm")))
    judged = rows.withColumn("_e", ingest.rejections(rows, max_value=20000))
    return judged.filter("_e IS NOT NULL").groupBy("pagina_id").agg(
        F.min("_e").alias("categoria"), F.count(F.lit(1)).alias("filas"))


@check("resolved_errors", star_query("""SELECT e.id, e.resuelto OR coalesce(e.corrida_at < m.ok, false) AS resuelto,
    CASE WHEN NOT e.resuelto AND coalesce(e.corrida_at < m.ok, false) THEN m.ok ELSE e.resuelto_at END AS resuelto_at FROM errores_carga e
    LEFT JOIN (SELECT fuente, folleto_id_fuente, max(corrida_at) AS ok FROM errores_carga WHERE sqlstate IS NULL GROUP BY 1, 2) m
    USING (fuente, folleto_id_fuente)"""))
def _(spark, sf):
    log = star_of(spark, sf).errores_carga
    return ingest.resolve_errors(log, log.filter("sqlstate IS NULL")).select("id", "resuelto", "resuelto_at")


@check("batch_totals", star_query("""SELECT count(*) FILTER (WHERE estado = 'done') AS procesados, count(*) FILTER (WHERE estado = 'pending') AS omitidos,
    count(*) FILTER (WHERE estado = 'error') AS errores, """ + ", ".join(
        f"(SELECT count(*) FROM errores_carga WHERE categoria = '{c}') AS errores_{c}" for c in panels.ERROR_CATEGORIES) + " FROM folletos"))
def _(spark, sf):
    star = star_of(spark, sf)
    state = F.when(F.col("estado") == "done", "procesado").when(F.col("estado") == "pending", "omitido").otherwise("error")
    return ingest.batch_totals(star.folletos.withColumn("resultado", state), star.errores_carga)


@check("error_categories", star_query("""SELECT id, CASE WHEN sqlstate = '22001' THEN 'tamano_excesivo' WHEN sqlstate = '22003' THEN 'valor_fuera_de_rango'
    WHEN sqlstate IN ('22P02', '22007', '22008') THEN 'formato_invalido' WHEN sqlstate LIKE '23%' THEN 'violacion_integridad' WHEN sqlstate IS NOT NULL
    THEN 'otro' WHEN categoria = 'json_corrupto' THEN 'json_corrupto' ELSE 'archivo_faltante' END AS categoria_leida FROM errores_carga"""))
def _(spark, sf):
    failure = F.when(F.col("categoria") == "json_corrupto", "json").otherwise("archivo")
    return star_of(spark, sf).errores_carga.select("id", ingest.error_category(F.col("sqlstate"), failure).alias("categoria_leida"))


@check("store_names", star_query("""SELECT slug, array_to_string(list_transform(string_split(replace(slug, '_', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS nombre, replace(slug, '_', '') AS compacto FROM tiendas"""))
def _(spark, sf):
    rows = star_of(spark, sf).tiendas.select(F.lit("tiendeo").alias("fuente"), F.col("slug").alias("slug_raw"))
    return ingest.corrected_stores(rows).select("slug", "nombre", columns.compact_slug(F.col("slug")).alias("compacto"))


@check("page_numbers", star_query("""SELECT id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(archivo_imagen, '([0-9]+)', 1), '') AS INT), 0) AS INT) AS numero
    FROM paginas"""))
def _(spark, sf):
    return star_of(spark, sf).paginas.select("id", columns.page_number(F.col("archivo_imagen")).alias("numero"))


# -- cases of two runs ------------------------------------------------------------------------------------

_CASES = {
    "a": "SELECT CAST(id AS VARCHAR) AS clave, fuente AS tienda, categoria AS estado FROM errores_carga WHERE NOT resuelto",
    "b": "SELECT CAST(id AS VARCHAR) AS clave, fuente AS tienda, CASE WHEN sqlstate IS NULL THEN 'ok' ELSE categoria END AS estado FROM errores_carga WHERE pagina IS NOT NULL",
    "ch": """SELECT coalesce(a.clave, b.clave) AS clave, coalesce(b.tienda, a.tienda) AS tienda, coalesce(a.estado, 'no_existe') AS antes,
        coalesce(b.estado, 'no_existe') AS despues FROM a FULL JOIN b USING (clave)
        WHERE coalesce(a.estado, 'no_existe') <> coalesce(b.estado, 'no_existe')""",
}


def _case_runs(spark, sf):
    log = star_of(spark, sf).errores_carga.withColumn("clave", F.col("id").cast("string")).withColumnRenamed("fuente", "tienda")
    before = log.filter("NOT resuelto").select("clave", "tienda", F.col("categoria").alias("estado"))
    after = log.filter("pagina IS NOT NULL").select(
        "clave", "tienda", F.when(F.col("sqlstate").isNull(), "ok").otherwise(F.col("categoria")).alias("estado"))
    return before, after


@check("case_transitions", star_query("SELECT antes || ' -> ' || despues AS transicion, count(*) AS n FROM ch GROUP BY 1", **_CASES))
def _(spark, sf):
    return evaluation.transitions(evaluation.case_changes(*_case_runs(spark, sf), "no_existe"))


@check("case_gains_and_losses", star_query("""SELECT tienda, count(*) FILTER (WHERE despues = 'ok') AS articulos_ganados,
    count(*) FILTER (WHERE antes = 'ok') AS articulos_perdidos, count(*) FILTER (WHERE antes <> 'ok' AND despues <> 'ok') AS articulos_cambio_error,
    count(*) FILTER (WHERE despues = 'ok') AS registros_ganados, count(*) FILTER (WHERE antes = 'ok') AS registros_perdidos,
    count(*) FILTER (WHERE antes = 'no_existe' AND despues <> 'ok') AS registros_nuevos_mal FROM ch GROUP BY 1""", **_CASES))
def _(spark, sf):
    changes = evaluation.case_changes(*_case_runs(spark, sf), "no_existe")
    return evaluation.change_summary(changes, changes)


@check("error_examples", star_query("""SELECT clave, tienda, estado, rn FROM (SELECT *, row_number() OVER (PARTITION BY estado, tienda ORDER BY clave) AS rn
    FROM b WHERE estado <> 'ok') x WHERE rn <= 10""", **_CASES))
def _(spark, sf):
    _, after = _case_runs(spark, sf)
    return evaluation.error_examples(after).withColumn("rn", F.col("rn").cast("bigint"))


@check("judge_agreement", """SELECT count(*) FILTER (WHERE d.lang <> 'fr' AND l.toxic = 0) AS evaluados,
    count(*) FILTER (WHERE d.lang <> 'fr' AND l.toxic = 0 AND (l.quality = 1) = (d.n_chars >= 300)) AS acuerdos,
    count(*) FILTER (WHERE d.lang <> 'fr' AND l.toxic = 1) AS dudosos, count(*) FILTER (WHERE d.lang = 'fr') AS excluidos,
    CAST(round(CAST(CAST(count(*) FILTER (WHERE d.lang <> 'fr' AND l.toxic = 0 AND (l.quality = 1) = (d.n_chars >= 300)) AS DOUBLE)
        / count(*) FILTER (WHERE d.lang <> 'fr' AND l.toxic = 0) AS DECIMAL(38,10)), 4) AS DOUBLE) AS concordancia
    FROM labels l JOIN documents d USING (doc_id)""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = docs.select(F.col("doc_id").alias("caso"), F.col("lang").alias("pagina"), (F.col("n_chars") >= 300).alias("juez_producto_ok"),
                         F.lit(True).alias("juez_precio_ok"))
    answers = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("caso"), F.when(F.col("toxic") == 1, "dudoso").when(F.col("quality") == 1, "si").otherwise("no").alias("r_producto"),
        F.lit("si").alias("r_precio"))
    return evaluation.agreement(sample, answers, docs.filter("lang = 'fr'").select(F.col("lang").alias("pagina")))


@check("field_scores")
def _(spark, sf):
    cells = cut_lineage(tpch_blocks.items(spark, sf))
    classified = cut_lineage(_kinds(spark, sf).withColumn("valor", F.regexp_extract("texto", "[0-9]+", 0).try_cast("double")))
    articles = cells.select("pagina", F.col("pos").alias("id"), "nombre", F.col("nombre").alias("producto"),
                            F.col("entero").cast("double").alias("precio"))
    promotions = cells.filter("imp >= 7").select("pagina", F.col("pos").alias("promo"), F.lit("descuento especial").alias("texto"))
    return evaluation.field_scores(articles, promotions, classified, classified, PAGE)
