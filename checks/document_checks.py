"""Documents, written shapes, runs and loads: given tables nested into files, written, and read back.

The files are made by Spark from the tables, so they grow with them; their folders are named
``key=value`` and hold one document per flyer or run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from octavilla.operators.cut import shared_folder
from octavilla.plans import evaluation, ingest
from octavilla.sources import documents, listings, star, tpch_blocks, writers
from octavilla.streaming import landing

from .block_checks import _RELIABILITY_LABEL, _kinds, _wilson_sql, _with
from .common import rnd, star_of, star_query

QUERIES: dict = {}
ORACLES: dict = {}
FLYER = ["fuente", "tienda", "folleto_id"]
FILES = "fuente={source}/*/*/*.json.gz"


def check(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn
    return add


# Twenty pages of a store make a flyer.
_FLYER = [("fuente", "CASE WHEN pagina % 2 = 0 THEN 'tiendeo' ELSE 'ofertomat' END"),
          ("folleto_id", "CAST(CAST(floor(pagina / 400) AS BIGINT) AS STRING)"),
          ("archivo", "'pagina_' || CAST(pagina AS STRING) || '.webp'")]
BLOCKS = {**tpch_blocks.blocks_sql(), "fb": "SELECT b.*, " + ", ".join(f"{e} AS {n}" for n, e in _FLYER) + " FROM bloques b"}


# blocks are made where those of their flyer are, so documents and pages are nested without dealing them again
_DEALT = {"deal": FLYER, "told": dict(_FLYER)}


def _write_documents(docs, path: str) -> None:
    """One gzipped file per flyer, in folders of its source, store and id; ``docs`` are grouped by these."""
    docs.write.partitionBy(*FLYER).json(path, compression="gzip")


# -- read blocks -----------------------------------------------------------------------------

def _block_documents(spark, sf):
    blocks = tpch_blocks.blocks(spark, sf, **_DEALT)
    block = F.struct("bloque", "texto", "confianza", F.struct("x", "y", "ancho", "alto").alias("bbox"))
    pages = blocks.groupBy(*FLYER, "pagina", "archivo", "ancho_pagina").agg(
        F.max("confianza").alias("confianza_prom"), F.sort_array(F.collect_list(block)).alias("bloques"))
    page = F.struct("pagina", F.col("archivo"), "ancho_pagina", "confianza_prom", "bloques")
    docs = pages.groupBy(*FLYER).agg(F.sort_array(F.collect_list(page)).alias("p")).select(
        *FLYER, F.size("p").alias("total_paginas"), F.transform("p", lambda p: F.struct(
            p["archivo"].alias("pagina"), p["ancho_pagina"].alias("ancho_pagina"), p["confianza_prom"].alias("confianza_prom"),
            p["bloques"].alias("bloques"))).alias("paginas"))
    path = shared_folder(spark, "read")
    _write_documents(docs, path)
    return documents.block_documents(spark, path, files=FILES)


@check("read_blocks", _with(BLOCKS, """SELECT fuente, tienda, folleto_id, archivo AS pagina, CAST(row_number() OVER (PARTITION BY pagina
    ORDER BY bloque) - 1 AS INT) AS bloque, ancho_pagina, texto, confianza, x, y, ancho, alto FROM fb"""))
def _(spark, sf):
    return documents.text_blocks(_block_documents(spark, sf))


@check("read_pages", _with(BLOCKS, """SELECT fuente, folleto_id, archivo AS archivo_imagen, CAST(pagina AS INT) AS numero_pagina,
    CAST(count(*) AS INT) AS total_bloques_ocr, max(confianza) AS confianza_ocr_prom FROM fb GROUP BY 1, 2, 3, pagina"""))
def _(spark, sf):
    docs = _block_documents(spark, sf)
    metrics = documents.reading_metrics(docs).withColumnRenamed("pagina", "archivo_imagen")
    return documents.page_rows(docs).join(metrics, ["fuente", "folleto_id", "archivo_imagen"])


# -- classified flyers -----------------------------------------------------------------------

_VALUE = "TRY_CAST(nullif(regexp_extract(texto, '[0-9]+', 0), '') AS DOUBLE)"
# order of the kinds in a document, and whether a kind has a value and a category
_KIND = """CASE bloque % 8 WHEN 0 THEN 'PRODUCTO' WHEN 1 THEN 'PRECIO' WHEN 3 THEN 'PRECIO_ANTERIOR' WHEN 4 THEN 'AHORRO'
    WHEN 5 THEN 'PROMO' END"""
CLASSIFIED = {**BLOCKS, "fk": f"SELECT *, {_KIND} AS tipo, {_VALUE} AS numero FROM fb WHERE bloque % 8 IN (0, 1, 3, 4, 5)"}


def _classified(spark, sf):
    blocks = _kinds(spark, sf, **_DEALT)
    value = F.regexp_extract("texto", "[0-9]+", 0).try_cast("double")
    return blocks.drop("pagina").withColumnRenamed("archivo", "pagina").withColumns({
        "texto_norm": F.col("texto"), "valor": value, "candidatos": F.array_compact(F.array(value, value + 1)),
        "categoria": F.when(F.col("tipo") == "PRODUCTO", F.lower("texto"))})


@check("read_classified", _with(CLASSIFIED, """SELECT fuente, tienda, folleto_id, archivo AS pagina,
    CAST(row_number() OVER (PARTITION BY pagina ORDER BY bloque % 8, bloque) - 1 AS INT) AS bloque, tipo,
    CAST(row_number() OVER (PARTITION BY pagina, tipo ORDER BY bloque) - 1 AS INT) AS orden, texto, confianza,
    CASE WHEN tipo IN ('PRECIO', 'PRECIO_ANTERIOR', 'AHORRO') THEN numero END AS valor,
    CASE WHEN tipo = 'PRECIO_ANTERIOR' THEN numero + 1 END AS otro, CASE WHEN tipo = 'PRODUCTO' THEN lower(texto) END AS categoria,
    x, y, ancho, alto FROM fk"""))
def _(spark, sf):
    pages = writers.nested_pages(_classified(spark, sf), FLYER)
    page = F.struct("pagina", *documents.PAGE_LISTS)
    docs = pages.groupBy(*FLYER).agg(F.count(F.lit(1)).cast("int").alias("total_paginas"), F.collect_list(page).alias("paginas"))
    path = shared_folder(spark, "classified")
    _write_documents(docs, path)
    back = documents.classified_blocks(documents.classified_documents(spark, path, files=FILES))
    return back.withColumn("otro", F.get("candidatos", F.lit(1))).drop("candidatos")


@check("written_pages", _with(CLASSIFIED, """SELECT fuente, tienda, folleto_id, archivo AS pagina, CAST(count(*) FILTER (WHERE tipo = 'PRODUCTO') AS INT)
    AS productos, CAST(count(*) FILTER (WHERE tipo = 'PRECIO') AS INT) AS precios, CAST(count(*) FILTER (WHERE tipo = 'PRECIO_ANTERIOR') AS INT)
    AS precios_anteriores, CAST(count(*) FILTER (WHERE tipo = 'AHORRO') AS INT) AS ahorros, CAST(count(*) FILTER (WHERE tipo = 'PROMO') AS INT)
    AS promos, arg_min(texto, bloque) FILTER (WHERE tipo = 'PRECIO') AS primer_precio, max(numero) FILTER (WHERE tipo = 'PRECIO') AS mayor
    FROM fk GROUP BY 1, 2, 3, 4"""))
def _(spark, sf):
    path = shared_folder(spark, "pages")
    kinds = _classified(spark, sf).filter("tipo <> 'DESCARTE'")
    writers.write_classified(kinds, path)
    back = spark.read.schema(
        "fuente string, tienda string, folleto_id string, pagina string, "
        + ", ".join(f"{n} array<struct<texto:string,valor:double>>" for n in documents.PAGE_LISTS)).json(path)
    lists = ("productos", "precios", "precios_anteriores", "ahorros", "promos")
    return back.select(*FLYER, "pagina", F.get("precios", F.lit(0))["texto"].alias("primer_precio"),
                       F.array_max(F.transform("precios", lambda p: p["valor"])).alias("mayor"),
                       *[F.size(n).alias(n) for n in lists])


# -- the register and labelled flyers ----------------------------------------------------------

@check("scraped_register", star_query("""SELECT fuente, CAST(id AS VARCHAR) AS folleto_id, titulo || ' {"n}' AS titulo, fecha_inicio, fecha_fin,
    scrapeado_at, url_origen FROM folletos"""))
def _(spark, sf):
    # registers of a thousand flyers at most, each one indented JSON object in its own file
    f = star_of(spark, sf).folletos
    fields = {"titulo": F.concat("titulo", F.lit(' {"n}')), "fecha_inicio": F.col("fecha_inicio").cast("string"),
              "fecha_fin": F.col("fecha_fin").cast("string"), "procesado_at": F.date_format("scrapeado_at", "yyyy-MM-dd'T'HH:mm:ss"),
              "url_folleto": F.col("url_origen")}
    value = {n: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')),
                           F.lit("null")) for n, c in fields.items()}
    lines = [F.concat(F.lit(f'    "{n}": '), v) for n, v in value.items()]
    entry = F.concat(F.lit('  "'), "fuente", F.lit(":"), F.col("id").cast("string"), F.lit('": {\n'), F.concat_ws(",\n", *lines), F.lit("\n  }"))
    registers = f.groupBy(F.floor(F.col("id") / 1000).alias("n")).agg(F.concat(
        F.lit("{\n"), F.concat_ws(",\n", F.collect_list(entry)), F.lit("\n}")).alias("value")).select("value")
    path = shared_folder(spark, "register")
    registers.write.option("maxRecordsPerFile", 1).text(path)
    return documents.flyer_register(spark, path)


_LABELLED = "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def _labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    return docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


def _truth(spark, sf):
    rows = _labelled(spark, sf)
    article = F.struct(F.col("doc_id").cast("int").alias("id"), F.when(F.col("toxic") == 0, F.concat(F.lit("Art "), "doc_id")).alias("producto"),
                       F.col("lang").alias("categoria"), (F.col("n_chars") / 4).alias("precio"))
    pages = rows.groupBy("source", "lang").agg(
        F.collect_list(article).alias("articulos"), F.count(F.lit(1)).alias("n"), F.max("quality").alias("q"))
    page = F.struct(F.col("lang").alias("pagina"), "articulos", F.array(
        F.struct(F.lit("3x2").alias("texto"), F.concat(F.lit("n "), "n").alias("notas")),
        F.struct(F.lit("").alias("texto"), F.col("q").cast("string").alias("notas"))).alias("promociones_pagina"))
    docs = pages.groupBy("source").agg(F.collect_list(page).alias("paginas")).select(
        F.col("source").alias("tienda"), F.concat(F.lit("f-"), "source").alias("folleto_id"), "paginas")
    path = shared_folder(spark, "truth")
    docs.repartition("tienda").write.partitionBy("tienda").json(path)
    return documents.ground_truth(spark, path, files="*/*.json")


@check("labelled_articles", f"""SELECT source AS tienda, 'f-' || source AS folleto, lang AS pagina, CAST(doc_id AS INT) AS id,
    CASE WHEN toxic = 0 THEN 'Art ' || doc_id ELSE '' END AS producto, lang AS categoria, n_chars / 4e0 AS precio,
    CAST(NULL AS DOUBLE) AS precio_anterior, CAST(NULL AS VARCHAR) AS promocion FROM ({_LABELLED}) x""")
def _(spark, sf):
    return _truth(spark, sf)[0]


@check("labelled_promotions", f"""SELECT source AS tienda, 'f-' || source AS folleto, lang AS pagina, k AS promo,
    CASE k WHEN 0 THEN '3x2 n ' || n ELSE CAST(q AS VARCHAR) END AS texto
    FROM (SELECT source, lang, count(*) AS n, max(quality) AS q FROM ({_LABELLED}) x GROUP BY 1, 2) y, (VALUES (0), (1)) v(k)""")
def _(spark, sf):
    return _truth(spark, sf)[1]


# -- runs of the judge ---------------------------------------------------------------------------

# A language plays a run: date, whether its code had changes, its split.  The latest fit one is "en".
RUNS = {"en": ("2026-03-02", False, "dev"), "de": ("2026-03-01", False, "dev"), "es": ("2026-04-01", True, "dev"),
        "fr": ("2026-05-01", False, "holdout")}


def _runs(spark, sf):
    right = ((F.col("toxic") == 0) & (F.col("quality") == 1)).cast("int")
    stores = _labelled(spark, sf).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("toxic")).alias("shown"), F.sum(right).alias("hits"), F.sum("toxic").alias("bad"))
    counts = F.create_map(F.lit("paginas"), "n", F.lit("articulos_con_precio"), "n", F.lit("registros_dashboard"), "shown")
    metrics = F.struct(counts.alias("conteos"), evaluation.rate(F.col("hits"), F.col("shown")).alias("precision"),
                       evaluation.wilson(F.col("hits"), F.col("shown")).alias("precision_ic95"),
                       evaluation.rate(F.col("hits"), F.col("n")).alias("recall"),
                       F.create_map(F.lit("precio_mal_leido"), "bad", F.lit("sobrante"), F.col("shown") - F.col("hits")).alias("errores_registro"))
    whole = F.struct(F.create_map(F.lit("paginas"), F.sum("n")).alias("conteos"),
                     evaluation.rate(F.sum("hits"), F.sum("shown")).alias("precision"), evaluation.rate(F.sum("hits"), F.sum("n")).alias("recall"))
    runs = stores.withColumn("m", metrics).groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("tiendas"), whole.alias("global"))
    told = {k: F.coalesce(*[F.when(F.col("lang") == run, v[i]) for run, v in RUNS.items()]) for i, k in enumerate(("fecha", "dirty", "split"))}
    docs = runs.select(
        F.struct(told["fecha"].alias("fecha"), told["split"].alias("split"), F.struct(
            F.concat(F.lit("c-"), "lang").alias("commit"), told["dirty"].alias("cambios_sin_commit")).alias("codigo")).alias("meta"),
        F.struct(F.lit(True).alias("valida")).alias("integridad"), F.struct("global", "tiendas").alias("metricas"))
    path = shared_folder(spark, "runs")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return documents.evaluation_runs(spark, path)


_RUN = f"""SELECT source AS tienda, count(*) AS articulos_con_precio, CAST(nullif(sum(1 - toxic), 0) AS DOUBLE) AS n,
    CAST(sum(1 - toxic) AS BIGINT) AS registros, CAST(sum(toxic) AS BIGINT) AS mal,
    CAST(sum(CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS completos_ok FROM ({_LABELLED}) x WHERE lang = 'en' GROUP BY 1"""
_RUN_METRICS = f"""SELECT *, {rnd('CAST(completos_ok AS DOUBLE) / n', 4)} AS precision, {_wilson_sql('-')} AS precision_ic95_inf,
    {_wilson_sql('+')} AS precision_ic95_sup, {rnd('CAST(completos_ok AS DOUBLE) / articulos_con_precio', 4)} AS recall FROM run"""


@check("current_run_stores", _with({"run": _RUN, "m": _RUN_METRICS}, f"""SELECT tienda AS tienda_slug, precision, precision_ic95_inf, precision_ic95_sup,
    recall, registros AS registros_evaluados, articulos_con_precio AS articulos_gt, articulos_con_precio AS paginas_evaluadas,
    CASE WHEN mal > registros - completos_ok THEN 'precio_mal_leido' WHEN registros > completos_ok THEN 'sobrante' END AS error_dominante,
    {_RELIABILITY_LABEL} AS etiqueta FROM m"""))
def _(spark, sf):
    return evaluation.store_metrics(evaluation.current_run(_runs(spark, sf)))


@check("current_run_info", _with({"run": _RUN}, f"""SELECT '2026-03-02' AS fecha, 'c-en' AS "commit", 'dev' AS split,
    CAST(sum(articulos_con_precio) AS BIGINT) AS paginas_evaluadas, CAST(count(*) AS INT) AS tiendas_en_split, CAST(count(*) AS INT) AS tiendas_medidas,
    {rnd('CAST(sum(completos_ok) AS DOUBLE) / sum(registros)', 4)} AS precision_global,
    {rnd('CAST(sum(completos_ok) AS DOUBLE) / sum(articulos_con_precio)', 4)} AS recall_global FROM run"""))
def _(spark, sf):
    return evaluation.run_info(evaluation.current_run(_runs(spark, sf))).drop("archivo")


_CASE = "CASE WHEN toxic = 1 THEN 'precio_mal_leido' WHEN quality = 0 THEN 'asociacion_producto' ELSE 'ok' END"


@check("article_cases", f"""SELECT source || '/' || lang || '#' || doc_id AS clave, source AS tienda,
    CASE WHEN n_chars % 5 = 0 THEN 'ocr_no_leido' ELSE {_CASE} END AS estado FROM ({_LABELLED}) x""")
def _(spark, sf):
    pairs, lost = _cases(spark, sf)
    return evaluation.article_cases(pairs, lost, ["source", "lang"])


def _cases(spark, sf):
    rows = _labelled(spark, sf).withColumns({
        "tienda": F.col("source"), "id": F.col("doc_id"), "registro": F.col("doc_id"),
        "completo_ok": (F.col("toxic") == 0) & (F.col("quality") == 1),
        "error": F.when(F.col("toxic") == 1, "precio_mal_leido").when(F.col("quality") == 0, "asociacion_producto")})
    lost = rows.filter("n_chars % 5 = 0").withColumn("codigo", F.lit("ocr_no_leido"))
    return rows.filter("n_chars % 5 <> 0"), lost


@check("record_cases", f"""SELECT source || '/' || lang || '|' || n_chars || '|' || doc_id || ',' || n_chars % 7 AS clave, source AS tienda,
    CASE WHEN n_chars % 5 = 0 THEN 'ocr_no_leido' ELSE {_CASE} END AS estado FROM ({_LABELLED}) x""")
def _(spark, sf):
    pairs, leftover = _cases(spark, sf)
    records = _labelled(spark, sf).select("source", "lang", F.col("doc_id").alias("registro"), F.col("n_chars").alias("precio"),
                                          F.col("doc_id").alias("x"), (F.col("n_chars") % 7).alias("y"))
    return evaluation.record_cases(pairs, leftover, records, ["source", "lang"])


# -- written tables and loads ---------------------------------------------------------------------

_STAR = ("tiendas", "folletos", "paginas", "eventos_promo", "errores_carga")


@check("written_star", star_query(" UNION ALL ".join(
    [f"SELECT '{t}' AS tabla, CAST(NULL AS VARCHAR) AS tipo, count(*) AS filas, count(DISTINCT id) AS ids FROM {t}" for t in _STAR]
    + ["SELECT 'extracciones', tipo, count(*), count(DISTINCT id) FROM extracciones GROUP BY tipo"])))
def _(spark, sf):
    path = shared_folder(spark, "star")
    writers.write_star(star_of(spark, sf), path)
    back = star.from_parquet(spark, path)
    n = [F.count(F.lit(1)).alias("filas"), F.count_distinct("id").alias("ids")]
    rows = back.extracciones.groupBy("tipo").agg(*n).select(F.lit("extracciones").alias("tabla"), "tipo", "filas", "ids")
    for t in _STAR:
        rows = rows.unionByName(getattr(back, t).agg(*n).select(F.lit(t).alias("tabla"), F.lit(None).cast("string").alias("tipo"), "filas", "ids"))
    return rows


@check("written_runs", f"""SELECT r AS run_id, source AS tienda, count(*) AS casos, CAST(sum(quality) AS BIGINT) AS buenos
    FROM ({_LABELLED}) x, (VALUES ('a'), ('b')) v(r) WHERE r = 'a' OR toxic = 0 GROUP BY 1, 2""")
def _(spark, sf):
    path, cases = shared_folder(spark, "run-tables"), _labelled(spark, sf).select("doc_id", "source", "quality", "toxic")
    stores = cases.groupBy("source").agg(F.count(F.lit(1)).alias("casos"), F.sum("quality").cast("bigint").alias("buenos"))
    writers.write_run({"casos": cases, "tiendas": stores}, path, "a")
    clean = cases.filter("toxic = 0")
    writers.write_run({"casos": clean}, path, "b")
    return spark.read.parquet(f"{path}/casos").groupBy("run_id", F.col("source").alias("tienda")).agg(
        F.count(F.lit(1)).alias("casos"), F.sum("quality").cast("bigint").alias("buenos"))


@check("stored_pages", star_query("""SELECT e.pagina_id, count(*) AS filas FROM extracciones e WHERE e.tipo = 'PRECIO' AND e.pagina_id NOT IN
    (SELECT pagina_id FROM extracciones WHERE tipo = 'PRECIO' AND metodo_norm = 'fuzzy_bajo' AND length(texto_norm) * 20 > 300) GROUP BY 1"""))
def _(spark, sf):
    good, _ = ingest.split_rejected(_with_long_texts(spark, sf))
    return good.groupBy("pagina_id").agg(F.count(F.lit(1)).alias("filas"))


def _with_long_texts(spark, sf):
    return star_of(spark, sf).precios().withColumn("texto_norm", F.when(
        F.col("metodo_norm") == "fuzzy_bajo", F.repeat("texto_norm", F.lit(20))).otherwise(F.col("texto_norm")))


@check("error_log", star_query("""SELECT categoria, count(*) AS n, CAST(coalesce(sum(filas), 0) AS BIGINT) AS filas FROM (SELECT categoria, NULL AS filas
    FROM errores_carga UNION ALL SELECT 'tamano_excesivo', count(*) FROM extracciones WHERE tipo = 'PRECIO' AND metodo_norm = 'fuzzy_bajo'
    AND length(texto_norm) * 20 > 300 GROUP BY pagina_id) x GROUP BY 1"""))
def _(spark, sf):
    _, bad = ingest.split_rejected(_with_long_texts(spark, sf))
    log = ingest.append_errors(star_of(spark, sf).errores_carga, bad.select("categoria", "filas"))
    return log.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("filas"), F.lit(0)).cast("bigint").alias("filas"))


@check("page_upsert", star_query("""SELECT folleto_id, numero_pagina, archivo_imagen, total_productos + CASE WHEN folleto_id % 2 = 0 THEN 1 ELSE 0 END
    AS total_productos, CASE WHEN folleto_id % 2 = 0 THEN 0.5 ELSE tasa_util END AS tasa_util FROM paginas"""))
def _(spark, sf):
    pages = star_of(spark, sf).paginas
    again = pages.filter("folleto_id % 2 = 0").withColumns({
        "total_productos": F.col("total_productos") + 1, "tasa_util": F.lit(0.5), "archivo_imagen": F.concat(F.lit("z_"), "archivo_imagen")})
    return ingest.upsert_pages(pages.filter("folleto_id % 3 <> 0 OR folleto_id % 2 = 1"), again).withColumn(
        "archivo_imagen", F.regexp_replace("archivo_imagen", "^z_", "")).select(
        "folleto_id", "numero_pagina", "archivo_imagen", "total_productos", "tasa_util")


@check("store_upsert", star_query("""SELECT slug, nombre, CASE WHEN cadena IS NOT NULL THEN cadena WHEN slug = 'supplier_000000002' THEN NULL END AS cadena
    FROM tiendas"""))
def _(spark, sf):
    stores = star_of(spark, sf).tiendas.select("slug", "nombre", "cadena")
    known = stores.filter("nombre NOT LIKE '%7' OR cadena IS NOT NULL")
    return ingest.upsert_stores(known, stores.withColumn("cadena", F.lit(None).cast("string")))


# Every line of an order is a version of its flyer; the one that ships last, then the larger one, counts.
@check("landed_stream", """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'tiendeo' ELSE 'ofertomat' END AS fuente, CAST(l_orderkey AS VARCHAR) AS folleto_id,
    max(ROW(l_shipdate, l_partkey, l_linenumber))[1] AS landed_at, 'Parte ' || lpad(CAST(max(ROW(l_shipdate, l_partkey, l_linenumber))[2] AS VARCHAR), 12, '0')
    AS titulo, CAST(max(ROW(l_shipdate, l_partkey, l_linenumber))[3] AS INT) AS total_paginas FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    path, table = shared_folder(spark, "landed"), shared_folder(spark, "flyers")
    lines.select(
        F.when(F.col("l_orderkey") % 2 == 0, "tiendeo").otherwise("ofertomat").alias("fuente"), F.col("l_orderkey").cast("string").alias("folleto_id"),
        F.concat(F.lit("Parte "), F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("titulo"),
        F.col("l_linenumber").alias("total_paginas"), F.col("l_shipdate").cast("timestamp").alias("landed_at"),
    ).repartition(6).write.json(path)
    keys = ["fuente", "folleto_id"]
    changing = ["titulo", "total_paginas", "landed_at"]
    empty = lambda s: s.createDataFrame([], landing.LANDED).select(*keys, *changing)
    merge = lambda old, new: ingest.merge(old, new.select(*keys, *changing), keys, ["titulo"], update=tuple(changing))
    upsert = landing.parquet_upsert(table, merge, empty, buckets=16)
    # two starts with new stream checkpoints: the second sees every file again and changes nothing
    for attempt in ("first", "again"):
        query = landing.load_available(landing.landed_flyers(spark, path, files_per_batch=3), upsert, f"{path}-{attempt}")
        query.awaitTermination()
    return landing.latest_version(spark, table).select(*keys, *changing)


@check("catalogue_cards", """SELECT 'tiendeo' AS fuente, CAST(p_partkey AS VARCHAR) AS folleto_id, 'Tienda ' || p_size AS tienda, p_name AS titulo,
    'http://example.com/Catalogos/' || p_partkey AS url_folleto, 'http://i/volantini/big_' || p_partkey || '_webp_desktop.webp' AS url_preview,
    DATE '1995-01-01' + CAST(p_partkey % 300 AS INT) AS fecha_inicio, DATE '1995-01-08' + CAST(p_partkey % 300 AS INT) AS fecha_fin
    FROM part WHERE p_partkey % 10 <> 3""")
def _(spark, sf):
    part, key = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_partkey").cast("string")
    day = lambda start: F.date_add(F.to_date(F.lit(start)), (F.col("p_partkey") % 300).cast("int")).cast("string")
    tag = lambda t, c: F.concat(F.lit(f"<{t}> "), c, F.lit(f"</{t}>"))
    names = F.when(F.col("p_partkey") % 10 == 3, "").otherwise(
        F.concat(tag("h4", F.concat(F.lit("Tienda "), F.col("p_size").cast("string"))), tag("h3", F.col("p_name"))))
    card = F.concat(F.lit('<a class="c" href="/Catalogos/'), key, F.lit('?v=1"><img alt="Folleto '), day("1995-01-01"),
                    F.lit('T00:00:00Z - '), day("1995-01-08"), F.lit('T00:00:00Z" src="http://i/volantini/small_'), key,
                    F.lit('_webp.webp">'), names, F.lit("</a> <a href='/ayuda'>Ayuda</a>"))
    pages = part.groupBy(F.floor(F.col("p_partkey") / 10).alias("page_id")).agg(F.concat_ws("\n", F.collect_list(card)).alias("html"))
    # the first half of a page is linked from the next one too
    again = pages.select((F.col("page_id") + 1000000).alias("page_id"), F.expr("left(html, length(html) DIV 2)").alias("html"))
    return listings.catalogue_cards(pages.unionByName(again), "http://example.com")
