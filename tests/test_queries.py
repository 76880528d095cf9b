"""Every query that has SQL gives the same rows at the smallest scale, and small properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import compare
from octavilla.functions import promos
from octavilla.plans import filters, panels

SF = "/root/testdata/sf0.001"
# The whole set runs with ``python -m checks.compare``; these cover each area.
QUICK = ("current_prices_filtered", "price_comparison_in_flyer", "store_reliability", "store_coverage", "promotions",
         "errors_by_category", "comparison_by_key", "similar_texts_summary", "previous_price_pairs", "nearest_product",
         "line_edges", "product_by_region", "evaluation_metrics", "text_recall", "flyer_split", "flyer_upsert", "validity_dates")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    ok, message, _ = compare.compare(spark, compare.duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_entry(spark):
    assert len(entry.entry(spark).take(1)) == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_event_classes(spark):
    cases = {
        "julioregaladods": ("campania", "julio_regalado"), "hot_sale": ("campania", "hot_sale"), "buenfin": ("campania", "buen_fin"),
        "back_to_school_100_hojas": ("producto", None), "figura_navidad_c_ml": ("producto", None),
        "excepto_cdigos_de_liquidacin": ("legal", None), "liquidacin": ("campania", "liquidacion"),
        "precio_especial": ("lema", None), "gran_venta": ("otro", None), None: ("otro", None), " Navidad ": ("campania", "navidad"),
        "da_de_muertos": ("campania", "halloween_dia_de_muertos"), "fiestaspatrias": ("campania", "fiestas_patrias"),
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    rows = df.select("n", promos.event_class(F.col("n")).alias("c"), promos.event_campaign(F.col("n")).alias("s")).collect()
    assert {r["n"]: (r["c"], r["s"]) for r in rows} == cases


def test_promotion_panel(spark):
    events = [(1, 10, "julio_regalado", "JULIO"), (2, 10, "julioregalado", " JULIO"), (3, 10, "hot_sale", None),
              (4, 11, "navidad", "N"), (5, 12, "precio_especial", "P")]
    flyers = [(10, 1, "a", "tiendeo"), (11, 2, "b", "tiendeo"), (12, 1, "c", "tiendeo")]
    stores = [(1, "Uno", "uno", None, True), (2, "Dos", "dos", None, True)]
    prices = [(f"{f}-{i}", f, "PRECIO", "x", 1.0, "cat") for f, n in ((10, 5), (11, 2), (12, 3)) for i in range(n)]

    class Star:
        eventos_promo = spark.createDataFrame(events, "id int, folleto_id int, nombre_evento string, texto_raw string")
        folletos = spark.createDataFrame(flyers, "id int, tienda_id int, folleto_id_fuente string, fuente string").withColumns({
            "fecha_inicio": F.to_date(F.lit("2026-01-01")), "fecha_fin": F.when(F.col("id") == 11, F.to_date(F.lit("2026-01-02"))).otherwise(
                F.to_date(F.lit("2026-02-01"))), "scrapeado_at": F.to_timestamp(F.lit("2026-01-01")), "titulo": F.lit("t"),
            "total_paginas": F.lit(1), "url_origen": F.lit(None).cast("string")})
        tiendas = spark.createDataFrame(stores, "id int, nombre string, slug string, cadena string, activa boolean")
        extracciones = spark.createDataFrame(prices, "id string, folleto_id int, tipo string, texto_norm string, valor double, categoria_nlp string")
        paginas = spark.createDataFrame([(1, 10, 2), (2, 10, 1)], "id int, folleto_id int, numero_pagina int")
    star = Star()
    rows = panels.promotions(star, "2026-01-15")
    kpis = panels.promotion_kpis(rows).first().asDict()
    assert kpis == {"filas": 3, "folletos": 2, "precios_en_folletos": 7, "vigentes": 1, "campanias": 3, "tiendas": 2}
    first = rows.filter("campania = 'julio_regalado'").first()
    assert (first["eventos"], first["textos_detectados"], first["primera_pagina_id"]) == (2, ["JULIO"], 2)
    everything = filters.by_promotion(star.extracciones, star, promotion="sin", level="bancaria", mode="extraccion")
    assert everything.count() == 10
    assert filters.by_promotion(star.extracciones, star, promotion="con", level="bancaria", mode="extraccion").count() == 0
    assert filters.by_promotion(star.extracciones, star, level="campania", mode="extraccion").count() == 10
    con = filters.by_promotion(star.extracciones, star, campaigns=["navidad"], mode="extraccion").count()
    sin = filters.by_promotion(star.extracciones, star, "sin", campaigns=["navidad"], mode="extraccion").count()
    assert (con, sin) == (2, 8)
    with pytest.raises(ValueError):
        filters.by_promotion(star.extracciones, star, "con", mode="otro")


@pytest.mark.parametrize("value", ["si", "no", " SI ", "No", None, "", "todos"])
def test_category_filter_parameter(value):
    assert filters.normalize_with_category(value) == {"si": "si", "no": "no"}.get((value or "").strip().lower())


def test_category_kpi(spark):
    def pct(c, base, wanted=None):
        cols = panels.category_kpi(F.lit(1), F.lit(c).cast("bigint"), F.lit(base), wanted)
        return spark.range(1).select(cols["pct_con_categoria"].alias("p")).first()["p"]
    assert [pct(12495, 32073), pct(104, 409), pct(5, 0), pct(5, 10, "no")] == [39.0, 25.4, None, None]


def test_boxes(spark):
    from octavilla.functions import geometry
    box = geometry.box_percent(F.lit(180), F.lit(100), F.lit(360), F.lit(50), 1800, 1000)
    assert spark.range(1).select(*box.values()).first() == (10.0, 10.0, 20.0, 5.0)
    cases = [((0, 0, 10, 10), (0, 0, 10, 10), True), ((0, 0, 10, 10), (5, 0, 10, 10), True), ((0, 0, 10, 10), (6, 0, 10, 10), False),
             ((0, 0, 0, 10), (0, 0, 10, 10), False)]
    for a, b, want in cases:
        got = spark.range(1).select(geometry.boxes_coincide(tuple(map(F.lit, a)), tuple(map(F.lit, b)))).first()[0]
        assert got == want


def test_views_answer_sql(spark):
    from checks.common import AS_OF, star_of
    from octavilla.plans.views import register_views
    register_views(star_of(spark, SF), AS_OF)
    row = spark.sql("SELECT count(*) AS n, count(DISTINCT tienda) AS t FROM v_precios_actuales").first()
    assert row["n"] > 0 and row["t"] == 10
    assert spark.sql("SELECT * FROM v_folletos_vigencia WHERE vigente").count() >= 0
