"""The judge on small pages."""

import pytest
from pyspark.sql import functions as F

from octavilla.operators import fuzzy
from octavilla.plans import evaluation as E

PAGE = ["pagina"]
REC = ("pagina string, tienda string, registro int, precio double, precio_texto string, producto string,"
       " producto_texto string, categoria string, precio_anterior double, x int, y int")
ART = "pagina string, tienda string, id int, producto string, categoria string, precio double, precio_anterior double"


def rec(p, i, precio, producto, texto=None, anterior=None, categoria=None, store="tienda_uno"):
    return (p, store, i, precio, texto or f"${precio}", producto, producto, categoria, anterior, 10 * i, 20)


def art(p, i, producto, precio, anterior=None, categoria=None, store="tienda_uno"):
    return (p, store, i, producto, categoria, precio, anterior)


RECORDS = [
    rec("iguales", 0, 25.0, "Leche Lala entera"), rec("iguales", 1, 25.0, "Arroz Verde Valle"),
    rec("nombre", 0, 30.0, "Detergente Foca"),
    rec("duplicado", 0, 25.0, "Leche entera"), rec("duplicado", 1, 25.0, "Otra cosa distinta"),
    rec("ocr", 0, 18.0, "Platano chiapas"),
    rec("antes", 0, 50.0, "Cafe soluble", anterior=70.0, categoria="alimentos"),
    rec("promo", 0, 11.0, "3x2 gratis"),
    rec("mal", 0, 999.0, "Figura", texto="s2990"),
    rec("tienda", 0, 12.0, "Alsuper Kg", store="alsuper"),
    rec("sin nombre", 0, 44.0, None),
]
ARTICLES = [
    art("iguales", 1, "Arroz Verde Valle 1 kg", 25.0), art("iguales", 2, "Leche entera Lala", 25.0),
    art("nombre", 1, "Suavizante Ensueño", 30.0),
    art("duplicado", 1, "Leche entera", 25.0),
    art("ocr", 1, "Piatano chiapas", 18.0),
    art("antes", 1, "Cafe soluble", 50.0, anterior=65.0, categoria="alimentos"),
    art("promo", 1, "Jabon", 99.0),
    art("mal", 1, "Sandwichera", 29.9),
    art("tienda", 1, "Queso poroso Alsuper", 80.0, store="alsuper"),
    art("sin nombre", 1, "Tortillas", 44.0),
    art("sin precio", 1, "Nada", None),
]


@pytest.fixture(scope="module")
def run(spark):
    records, articles = spark.createDataFrame(RECORDS, REC), spark.createDataFrame(ARTICLES, ART)
    pages = articles.select("pagina", "tienda").distinct()
    promotions = spark.createDataFrame([("promo", "jueves de frescura")], "pagina string, texto string")
    blocks = spark.createDataFrame([
        ("mal", 0, "s2990"), ("promo", 0, "nada"), ("sin nombre", 0, "$44"), ("tienda", 0, "$12"),
    ], "pagina string, bloque int, texto string")
    classified = spark.createDataFrame([
        ("mal", 0, "PRECIO", "s2990", 299.0), ("sin nombre", 0, "PRECIO", "$44", 44.0),
        ("sin nombre", 1, "PRODUCTO", "Tortillas de maiz", None),
    ], "pagina string, bloque int, tipo string, texto string, valor double")
    accepted = spark.createDataFrame([], "pagina string, texto string")
    out = E.evaluate(pages, records, articles, promotions, blocks, classified, accepted, PAGE)
    return {k: v.collect() for k, v in out.items()}


def _pair(run, page, record):
    return next((r for r in run["pares"] if r["pagina"] == page and r["registro"] == record), None)


def test_equal_prices_are_told_by_name(run):
    assert (_pair(run, "iguales", 0)["id"], _pair(run, "iguales", 1)["id"]) == (2, 1)
    assert all(_pair(run, "iguales", i)["completo_ok"] for i in (0, 1))


def test_right_price_with_wrong_name_is_an_association_error(run):
    p = _pair(run, "nombre", 0)
    assert p["precio_ok"] and not p["producto_ok"] and p["error"] == "asociacion_producto"


def test_reading_errors_in_a_name_are_tolerated(run):
    assert _pair(run, "ocr", 0)["similitud"] == 1.0


def test_wrong_previous_price(run):
    p = _pair(run, "antes", 0)
    assert p["basico_ok"] and p["error"] == "asociacion_antes" and p["categoria_ok"]


def test_leftover_codes(run):
    codes = {(r["pagina"], r["registro"]): r["codigo"] for r in run["sobrantes"]}
    assert codes == {("duplicado", 1): "duplicado", ("promo", 0): "promo_como_producto", ("mal", 0): "precio_mal_leido",
                     ("tienda", 0): "precio_huerfano"}


def test_lost_articles(run):
    codes = {(r["pagina"], r["id"]): r["codigo"] for r in run["perdidos"]}
    assert codes == {("promo", 1): "ocr_no_leido", ("mal", 1): "precio_mal_leido", ("tienda", 1): "ocr_no_leido",
                     ("sin nombre", 1): "producto_descartado"}


def test_counts_and_totals(run):
    rows = {r["tienda"]: r for r in run["metricas"]}
    total = rows[None]
    assert total["paginas"] == 9 and total["paginas_sin_precio_gt"] == 1
    assert total["articulos_con_precio"] == 10 and total["registros_dashboard"] == 10
    assert total["completos_ok"] == 4 and total["precision"] == 0.4
    assert total["registros_dashboard"] == rows["tienda_uno"]["registros_dashboard"] + rows["alsuper"]["registros_dashboard"]


def test_wilson_and_z(spark):
    df = spark.createDataFrame([(385, 1162), (0, 0), (5, 5)], "a int, n int").select("a", E.wilson(F.col("a"), F.col("n")).alias("w"))
    got = {r["a"]: r["w"] for r in df.collect()}
    assert got[385] == [0.3049, 0.3589] and got[0] is None and got[5][1] == 1.0
    z = spark.range(1).select(E.two_share_z(F.lit(50), F.lit(100), F.lit(30), F.lit(100)).alias("z")).first()["z"]
    assert z == pytest.approx(-2.887, abs=1e-3)


def test_regressions(spark):
    def side(p, hits, n):
        return [("uno", p, p, hits, n, n), (None, p, p, hits, n, n), ("chica", p, p, 1, 5, 5)]
    cols = "tienda string, precision double, recall double, completos_ok int, registros_dashboard int, articulos_con_precio int"
    out = E.compare_runs(spark.createDataFrame(side(0.5, 100, 200), cols), spark.createDataFrame(side(0.3, 60, 200), cols))
    rows = {(r["ambito"], r["metrica"]): r for r in out.collect()}
    assert rows["uno", "precision"]["delta_pts"] == -20.0 and rows["uno", "precision"]["significativa"]
    assert rows["chica", "recall"]["regresion"] and not rows["chica", "recall"]["bloquea"]


def test_reliability_labels(spark):
    cases = [(None, None, 100, "Sin medir"), (0.5, 0.4, 0, "Sin medir"), (0.5, 0.4, 29, "Muestra insuficiente"),
             (0.09, 0.0, 30, "Baja"), (0.10, 0.05, 30, "Media"), (0.25, 0.15, 30, "Aceptable"),
             (0.25, 0.1499, 30, "Media"), (0.30, None, 30, "Media")]
    df = spark.createDataFrame(cases, "p double, l double, n int, e string")
    assert df.filter(E.reliability_label(F.col("p"), F.col("l"), F.col("n")) != F.col("e")).count() == 0


def test_valid_run_choice_and_dominant_error(spark):
    meta = "struct<fecha:string,split:string,tienda:string,ocr_exp:string,codigo:struct<commit:string,cambios_sin_commit:boolean>>"
    store = "struct<conteos:map<string,bigint>,precision:double,precision_ic95:array<double>,recall:double,errores_registro:map<string,bigint>>"
    schema = f"archivo string, meta {meta}, integridad struct<valida:boolean>, metricas struct<global:{store},tiendas:map<string,{store}>>"
    one = ({"paginas": 4, "articulos_con_precio": 40, "registros_dashboard": 35}, 0.3, [0.2, 0.4], 0.2, {"a": 3, "b": 3, "c": 1})
    empty = ({"paginas": 0}, None, None, None, None)

    def run(name, fecha="2026-01-01", split="dev", tienda=None, dirty=False, valid=True):
        return (name, (fecha, split, tienda, None, ("abc", dirty)), (valid,), (one, {"uno": one, "dos": empty}))
    runs = spark.createDataFrame([run("a"), run("b", "2026-02-01"), run("c", "2026-03-01", dirty=True),
                                  run("d", "2026-03-02", split="holdout"), run("e", "2026-03-03", tienda="uno"),
                                  run("f", "2026-03-04", valid=False)], schema)
    best = E.current_run(runs)
    assert best.first()["archivo"] == "b"
    rows = {r["tienda_slug"]: r for r in E.store_metrics(best).collect()}
    assert rows["uno"]["etiqueta"] == "Aceptable" and rows["uno"]["error_dominante"] == "b"
    assert rows["dos"]["etiqueta"] == "Sin medir" and rows["dos"]["precision"] is None
    assert E.run_info(best).first()["tiendas_medidas"] == 1


def test_similar_words_equal_brute_force(spark):
    words = ["platano", "piatano", "leche", "lecha", "leches", "detergente", "detergnte", "detrjente", "acondicionador",
             "acondklonador", "jabon", "jamon", "arroz", "aros", "suavizante", "savizante", "pan", "pam", "mayonesa", "maonesa"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["wa"], r["wb"]) for r in fuzzy.similar_words(df, df).collect()}
    want = {(a, b) for a in words for b in words if a == b or (
        min(len(a), len(b)) >= 4 and fuzzy.indel_ratio(a, b) >= 85)}
    assert got == want


def test_splits_agreement_and_seals(spark):
    arts = [(f"t{t}", f"f{t}{f}", i, 1.0 if f == 2 else None) for t, n in ((1, 3), (2, 7)) for f in range(n) for i in range(f + 1)]
    split = E.split_flyers(spark.createDataFrame(arts, "tienda string, folleto string, id int, precio_anterior double"), "s")
    held = {(r["tienda"], r["folleto"]) for r in split.filter("split = 'holdout'").collect()}
    assert held == {("t1", "f12"), ("t2", "f22")}
    sample = spark.createDataFrame([("c1", "p1", True, True), ("c2", "p1", False, True), ("c3", "p2", True, True),
                                    ("c4", "p1", True, True)], "caso string, pagina string, juez_producto_ok boolean, juez_precio_ok boolean")
    answers = spark.createDataFrame([("c1", "si", "si"), ("c2", "si", "si"), ("c3", "si", "si"), ("c4", "dudoso", "si")],
                                    "caso string, r_producto string, r_precio string")
    row = E.agreement(sample, answers, spark.createDataFrame([("p2",)], "pagina string")).first()
    assert row.asDict() == {"evaluados": 2, "acuerdos": 1, "dudosos": 1, "excluidos": 1, "concordancia": 0.5}
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "archivo string, huella string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "archivo string, huella string")
    assert {(r["archivo"], r["estado"]) for r in E.seal_drift(a, b).collect()} == {
        ("y", "modificado"), ("z", "falta"), ("w", "nuevo")}


def test_fingerprints_tell_changed_pages(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "x")], "pagina string, n int, t string")
    b = spark.createDataFrame([("p", 2, "y"), ("p", 1, "x"), ("q", 1, "z"), ("r", 1, None)], "pagina string, n int, t string")
    diff = E.fingerprint_differences(E.page_fingerprints(a, PAGE), E.page_fingerprints(b, PAGE), PAGE)
    assert {(r["pagina"], r["estado"]) for r in diff.collect()} == {("q", "distinta"), ("r", "solo_b")}


def test_case_changes(spark):
    base = spark.createDataFrame([("a", "t", "ok"), ("b", "t", "duplicado"), ("c", "t", "ok")], "clave string, tienda string, estado string")
    new = spark.createDataFrame([("a", "t", "duplicado"), ("b", "t", "ok"), ("d", "t", "precio_huerfano"), ("c", "t", "ok")],
                                "clave string, tienda string, estado string")
    changes = E.case_changes(base, new, "no_existe")
    assert {(r["clave"], r["antes"], r["despues"]) for r in changes.collect()} == {
        ("a", "ok", "duplicado"), ("b", "duplicado", "ok"), ("d", "no_existe", "precio_huerfano")}
    row = E.change_summary(changes, changes).first()
    assert (row["registros_ganados"], row["registros_perdidos"], row["registros_nuevos_mal"]) == (1, 1, 1)


def test_layout_catalogue(spark):
    arts = spark.createDataFrame([("p", "t", 1, "Leche entera", None, 25.0, None), ("p", "t", 2, "Jabon azul", None, 30.0, None),
                                  ("p", "t", 3, "Arroz", None, 9.0, None)], ART)
    prices = spark.createDataFrame([("p", 0, 25.0, 500, 1000, 100, 60), ("p", 1, 30.0, 900, 1000, 100, 60)],
                                   "pagina string, bloque int, valor double, x int, y int, ancho int, alto int")
    blocks = spark.createDataFrame([("p", 10, "Leche entera 1 L", 500, 900, 120, 30), ("p", 11, "Leche", 500, 100, 120, 30)],
                                   "pagina string, bloque int, texto string, x int, y int, ancho int, alto int")
    rows = {r["id"]: r for r in E.layout_catalogue(arts, prices, blocks, PAGE).collect()}
    assert rows[1]["estado"] == "completo" and rows[1]["posicion"] == "arriba" and rows[1]["alcanzable"]
    assert rows[2]["estado"] == "sin_nombre_ocr" and rows[3]["estado"] == "sin_precio_nlp"


def test_field_scores(spark):
    arts = spark.createDataFrame([("p", "t", 1, "Leche entera Lala", None, 25.0, None), ("p", "t", 2, "Jabon azul", None, 30.0, None)], ART)
    promos = spark.createDataFrame([("p", 1, "segunda a mitad de precio")], "pagina string, promo int, texto string")
    blocks = spark.createDataFrame([("p", 0, "leche entera"), ("p", 1, "jabones")], "pagina string, bloque int, texto string")
    cl = spark.createDataFrame([("p", 0, "PRODUCTO", "Leche entera", None), ("p", 1, "PRECIO", "$25", 25.0),
                                ("p", 2, "AHORRO", "Ahorra 30", 30.0), ("p", 3, "PROMO", "mitad de precio", None)],
                               "pagina string, bloque int, tipo string, texto string, valor double")
    row = E.field_scores(arts, promos, blocks, cl, PAGE).first().asDict()
    assert (row["productos_total"], row["productos_ocr_ok"], row["productos_nlp_ok"]) == (2, 2, 1)
    assert (row["precios_total"], row["precios_ok"], row["precios_mal_clasificados"]) == (2, 1, 1)
    assert (row["promos_ok"], row["productos_nlp_correctos"], row["precios_nlp_correctos"], row["promos_nlp_correctos"]) == (1, 1, 1, 1)


def test_similar_words_of_any_length(spark):
    """Random edits of random words, and tokens of 200 letters, against all pairs."""
    import random
    rng = random.Random(5)
    words = {"".join(rng.choices("aeioulmnrst", k=rng.randint(1, 14))) for _ in range(60)}
    words |= {"".join(rng.choices("abcdefghij", k=200)), "a" * 200}
    for w in sorted(words):
        letters = list(w)
        for _ in range(max(1, len(w) // 9)):
            k = rng.randrange(len(letters))
            rng.choice((lambda: letters.pop(k), lambda: letters.insert(k, "x"), lambda: letters.__setitem__(k, "y")))()
            letters = letters or ["z"]
        words.add("".join(letters))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for edits in (False, True):
        got = {(r["wa"], r["wb"]) for r in fuzzy.similar_words(df, df, edits=edits).collect()}
        want = {(a, b) for a in words for b in words if a == b or min(len(a), len(b)) >= 4 and (
            fuzzy.indel_ratio(a, b) >= 85 or edits and min(len(a), len(b)) >= 6 and fuzzy.edit_similarity(a, b) >= 0.78)}
        assert got == want, sorted(got ^ want)[:5]


def test_recall_with_long_words_and_parts(spark):
    items = spark.createDataFrame([("p", 1, "leche entera"), ("p", 2, "z" * 150), ("p", 3, "queso")], "pagina string, id int, producto string")
    corpus = spark.createDataFrame([("p", "superlecheentera"), ("p", "w" * 300 + "z" * 160), ("p", "ques o")], "pagina string, texto string")
    got = {r["id"]: r["cobertura"] for r in E.recall_in_corpus(items, "producto", corpus, ["pagina"], ["id"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


def test_similar_words_that_share_the_fewest_pairs(spark):
    """Six of 23 letters left out one by one: 10 of 22 pairs are shared, and these are the commonest."""
    long = "abcdefghijklmnopqrstuvw"
    short = "".join(ch for ch in long if ch not in "behknq")
    df = spark.createDataFrame([(long,), (short,)], "w string")
    assert (long, short) in {(r["wa"], r["wb"]) for r in fuzzy.similar_words(df, df).collect()}
