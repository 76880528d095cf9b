"""JSON documents: read blocks, classified flyers, the register, ground truth and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import page_number, parse_date, parse_timestamp

# Folders that hold production flyers; others are trials and backups.
SOURCES = ("tiendeo", "ofertomat")

BOX = "struct<x:int,y:int,ancho:int,alto:int>"
BLOCK_DOCUMENT = (
    "fuente string, tienda string, folleto_id string, motor_ocr string, perfil_imagen string, total_paginas int, "
    "paginas array<struct<pagina:string,ancho_pagina:int,confianza_prom:double,"
    f"bloques:array<struct<texto:string,confianza:double,bbox:{BOX},motor:string>>>>, _corrupt string")
_TEXT = f"texto:string,confianza:double,bbox:{BOX}"
CLASSIFIED_DOCUMENT = (
    "fuente string, tienda string, folleto_id string, total_paginas int, paginas array<struct<pagina:string,"
    f"productos:array<struct<{_TEXT},categoria:string>>,precios:array<struct<{_TEXT},valor:double>>,"
    f"precios_anteriores:array<struct<{_TEXT},valor:double,candidatos:array<double>>>,"
    f"ahorros:array<struct<{_TEXT},valor:double>>,promos:array<struct<{_TEXT}>>,"
    f"eventos_promo:array<struct<{_TEXT}>>,atributos:array<struct<{_TEXT},categoria:string>>>>, _corrupt string")
REGISTER_ENTRY = ("struct<fuente:string,folleto_id:string,tienda:string,titulo:string,fecha_inicio:string,"
                  "fecha_fin:string,procesado_at:string,url_folleto:string>")
TRUTH_DOCUMENT = (
    "folleto_id string, paginas array<struct<pagina:string,articulos:array<struct<id:int,producto:string,"
    "categoria:string,precio:double,precio_anterior:double,promocion:string>>,"
    "promociones_pagina:array<struct<texto:string,notas:string>>>>, _corrupt string")
_STORE = ("struct<conteos:map<string,bigint>,precision:double,precision_ic95:array<double>,recall:double,"
          "errores_registro:map<string,bigint>>")
RUN_DOCUMENT = (
    "meta struct<fecha:string,split:string,tienda:string,ocr_exp:string,"
    "codigo:struct<commit:string,cambios_sin_commit:boolean>>, integridad struct<valida:boolean>, "
    f"metricas struct<global:{_STORE},tiendas:map<string,{_STORE}>>, _corrupt string")

_FOLDER = r"(?:\w+=)?([^/]+)"

# list of a classified page -> kind of its blocks
PAGE_LISTS = {
    "productos": "PRODUCTO", "precios": "PRECIO", "precios_anteriores": "PRECIO_ANTERIOR", "ahorros": "AHORRO",
    "promos": "PROMO", "eventos_promo": "EVENTO_PROMO", "atributos": "ATRIBUTO",
}


def _read(spark: SparkSession, paths, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(paths)
        .withColumn("ruta", F.col("_metadata.file_path"))
    )


def _from_path(df: DataFrame) -> DataFrame:
    """Identity from ``<source>/<store>/<flyer>/<file>`` where the document lacks it.

    Folders may be named ``key=value``, as Spark writes them.
    """
    parts = rf"{_FOLDER}/{_FOLDER}/{_FOLDER}/[^/]+$"
    for i, c in enumerate(("fuente", "tienda", "folleto_id"), 1):
        df = df.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), F.regexp_extract("ruta", parts, i)))
    return df


def _files_of(root: str, sources, files: str) -> str:
    """One pattern for all sources, so that a source without a folder has no documents."""
    return f"{root}/{files.format(source='{' + ','.join(sources) + '}')}"


def classified_documents(spark: SparkSession, root: str, sources=SOURCES,
                         files: str = "{source}/*/*/nlp_resultado.json") -> DataFrame:
    """Classified flyers of the production folders; unreadable ones keep ``_corrupt``."""
    return _from_path(_read(spark, _files_of(root, sources, files), CLASSIFIED_DOCUMENT))


def block_documents(spark: SparkSession, root: str, sources=SOURCES,
                    files: str = "{source}/*/*/ocr_resultado.json") -> DataFrame:
    """Read blocks of the production folders, one document per flyer."""
    return _from_path(_read(spark, _files_of(root, sources, files), BLOCK_DOCUMENT))


def text_blocks(documents: DataFrame) -> DataFrame:
    """One row per text block, numbered in page order."""
    pages = documents.filter("_corrupt IS NULL").select(
        "fuente", "tienda", "folleto_id", F.explode("paginas").alias("p"))
    blocks = pages.select("fuente", "tienda", "folleto_id", F.col("p.pagina").alias("pagina"),
                          F.col("p.ancho_pagina").alias("ancho_pagina"), F.posexplode("p.bloques").alias("bloque", "b"))
    return blocks.select(
        "fuente", "tienda", "folleto_id", "pagina", "bloque", "ancho_pagina", F.col("b.texto").alias("texto"),
        F.col("b.confianza").alias("confianza"), *[F.col(f"b.bbox.{c}").alias(c) for c in ("x", "y", "ancho", "alto")])


def reading_metrics(documents: DataFrame) -> DataFrame:
    """Blocks and mean confidence of each page; missing or unreadable flyers have no row."""
    pages = documents.filter("_corrupt IS NULL").select("fuente", "folleto_id", F.explode("paginas").alias("p"))
    return pages.select(
        "fuente", "folleto_id", F.col("p.pagina").alias("pagina"),
        F.size(F.coalesce("p.bloques", F.array())).alias("total_bloques_ocr"),
        F.col("p.confianza_prom").alias("confianza_ocr_prom"))


def classified_blocks(documents: DataFrame) -> DataFrame:
    """One row per classified block; missing lists are empty."""
    pages = documents.filter("_corrupt IS NULL").select(
        "fuente", "tienda", "folleto_id", F.explode("paginas").alias("p"))
    kinds = []
    for name, kind in PAGE_LISTS.items():
        value = "b.valor" if kind in ("PRECIO", "PRECIO_ANTERIOR", "AHORRO") else "cast(null as double)"
        readings = "b.candidatos" if kind == "PRECIO_ANTERIOR" else "cast(array() as array<double>)"
        category = "b.categoria" if kind in ("PRODUCTO", "ATRIBUTO") else "cast(null as string)"
        kinds.append(
            f"transform(coalesce(p.{name}, array()), (b, i) -> named_struct('tipo', '{kind}', 'orden', i, 'texto', b.texto,"
            f" 'confianza', b.confianza, 'valor', {value}, 'candidatos', coalesce({readings}, array()),"
            f" 'categoria', {category}, 'x', b.bbox.x, 'y', b.bbox.y, 'ancho', b.bbox.ancho, 'alto', b.bbox.alto))")
    rows = pages.select("fuente", "tienda", "folleto_id", F.col("p.pagina").alias("pagina"),
                        F.posexplode(F.expr(f"concat({', '.join(kinds)})")).alias("bloque", "b"))
    return rows.select("fuente", "tienda", "folleto_id", "pagina", "bloque", "b.*")


def flyer_register(spark: SparkSession, path: str, indent: int | None = 2) -> DataFrame:
    """Metadata of scraped flyers from a JSON object keyed ``source:flyer``.

    ``indent`` is the number of blanks before an entry.  The file is cut where its entries end, so
    many tasks read a large register: JSON strings hold no line breaks and deeper objects are
    indented further, so such an end is found nowhere else.  A compact register is a single row,
    as is any with ``indent`` None.  An entry that cannot be read is left out alone; a key that
    occurs twice gives two rows.
    """
    ends = {"wholetext": True} if indent is None else {"lineSep": "\n" + " " * indent + "}"}
    raw = spark.read.text(path, **ends)
    fields = F.regexp_replace("value", r"^[\s{},]+", "")
    # the last piece, or a register without such ends, closes its own braces
    closed = F.col("value").rlike(r"(^|\n)\}\s*$") | ~F.contains("value", F.lit("\n"))
    entry = F.when(closed, F.concat(F.lit("{"), fields)).otherwise(F.concat(F.lit("{"), fields, F.lit("}}")))
    entries = raw.filter(fields != "").select(F.explode(F.from_json(entry, f"map<string,{REGISTER_ENTRY}>")).alias("clave", "e"))
    return register_rows(entries)


def register_rows(entries: DataFrame) -> DataFrame:
    """Renames the fields of (clave, e) register entries and reads their dates."""
    return entries.select(
        F.split_part("clave", F.lit(":"), F.lit(1)).alias("fuente"),
        F.split_part("clave", F.lit(":"), F.lit(2)).alias("folleto_id"),
        F.col("e.titulo").alias("titulo"),
        parse_date(F.col("e.fecha_inicio")).alias("fecha_inicio"),
        parse_date(F.col("e.fecha_fin")).alias("fecha_fin"),
        parse_timestamp(F.col("e.procesado_at")).alias("scrapeado_at"),
        F.col("e.url_folleto").alias("url_origen"))


def ground_truth(spark: SparkSession, root: str, files: str = "*/*_contenido.json") -> tuple[DataFrame, DataFrame]:
    """Labelled articles, and page promotions as text followed by notes."""
    docs = _read(spark, f"{root}/{files}", TRUTH_DOCUMENT).filter("_corrupt IS NULL")
    pages = docs.select(F.regexp_extract("ruta", rf"{_FOLDER}/[^/]+$", 1).alias("tienda"),
                        F.col("folleto_id").alias("folleto"), F.explode("paginas").alias("p"))
    key = ["tienda", "folleto", F.col("p.pagina").alias("pagina")]
    articles = pages.select(*key, F.inline("p.articulos")).withColumn("producto", F.coalesce("producto", F.lit("")))
    promotions = pages.select(*key, F.posexplode("p.promociones_pagina").alias("promo", "o")).select(
        "tienda", "folleto", "pagina", "promo",
        F.concat_ws(" ", F.nullif("o.texto", F.lit("")), F.nullif("o.notas", F.lit(""))).alias("texto"))
    return articles, promotions


def evaluation_runs(spark: SparkSession, root: str) -> DataFrame:
    """Readable runs.  A file name that already says it is dirty or not dev is skipped
    before its content is parsed."""
    name = F.regexp_extract("ruta", r"([^/]+)$", 1)
    runs = _read(spark, f"{root}/*.json", RUN_DOCUMENT).withColumn("archivo", name)
    unfit = name.rlike(r"^\d{8}_\d{6}_[^_]+-sucio_[a-z]+\.json$") | (
        name.rlike(r"^\d{8}_\d{6}_[^_]+_[a-z]+\.json$") & ~name.rlike(r"_dev\.json$"))
    return runs.filter(~unfit & F.col("_corrupt").isNull() & F.col("meta").isNotNull()).select(
        "archivo", "meta", "integridad", "metricas")


def page_rows(documents: DataFrame) -> DataFrame:
    """Pages of classified flyers with their number from the file name."""
    pages = documents.filter("_corrupt IS NULL").select("fuente", "folleto_id", F.explode("paginas").alias("p"))
    return pages.select("fuente", "folleto_id", F.col("p.pagina").alias("archivo_imagen"),
                        page_number(F.col("p.pagina")).alias("numero_pagina"))
