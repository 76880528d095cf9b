"""Scores what was read from flyers against hand-labelled articles.

Records: page keys, ``registro``, ``precio``, ``precio_texto``, ``producto``,
``producto_texto``, ``categoria``, ``precio_anterior``.  Articles: page keys, ``id``,
``producto``, ``categoria``, ``precio``, ``precio_anterior``.  Both carry ``tienda``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_text
from ..functions.columns import half_up, same_cents, same_cents_or_both_null, sha_order
from ..functions.names import base_text, significant_words, words_of
from ..operators import fuzzy
from ..operators.assignment import best_one_to_one
from ..operators.cut import cut_lineage
from .panels import count_where

# Weights and thresholds of the judge.
PRODUCT_SIMILARITY = 0.5
CANDIDATE_SIMILARITY = 0.3
PRICE_WEIGHT, NAME_WEIGHT = 0.6, 0.4
RECALL_SHARE = 0.5
REGRESSION_POINTS = 2.0
MIN_SAMPLE = 20
Z_95 = 1.96
RECORD_ERRORS = ("precio_mal_leido", "asociacion_producto", "asociacion_antes", "promo_como_producto", "duplicado",
                 "precio_huerfano")
ARTICLE_ERRORS = ("ocr_no_leido", "clasificacion", "precio_mal_leido", "producto_descartado", "asociacion_producto",
                  "asociacion_antes")
# Reliability labels and their limits.
MIN_RECORDS, MEDIUM_PRECISION, GOOD_PRECISION, GOOD_LOWER_BOUND = 30, 0.10, 0.25, 0.15
HEURISTIC_BASE_PCT = 20.0


# -- matching ------------------------------------------------------------------------------

def store_words(store: Column) -> Column:
    return significant_words(F.replace(F.replace(store, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit("")))


def _words(text: Column, store: Column | None = None) -> Column:
    words = significant_words(F.coalesce(text, F.lit("")))
    return words if store is None else F.filter(words, lambda w: ~F.array_contains(store_words(store), w))


def _cents(price: Column) -> Column:
    return F.round(price.cast("decimal(18,6)") * 100, 0).cast("bigint")


def _near_cents(price: Column) -> Column:
    c = _cents(price)
    return F.explode(F.array(c - 1, c, c + 1))


def word_pairs(a: DataFrame, b: DataFrame, page: list[str], a_id: str, b_id: str) -> DataFrame:
    """(page, a_id, b_id, similitud) of rows that share a word or one like it.

    Both frames have the word list ``_w``.  Like words are found once in the distinct
    vocabulary; rows meet on (page, word), and a common word is as many keys as pages.  The
    similarity is the F1 of the words that found a partner; repeated words count as often as
    they occur.
    """
    def words(df: DataFrame, ident: str, name: str) -> DataFrame:
        each = df.select(*page, ident, "_w", F.size("_w").alias(f"n_{name}"), F.explode(F.array_distinct("_w")).alias(name))
        times = F.size(F.filter("_w", lambda w: w == F.col(name)))
        return each.withColumn(f"m_{name}", F.struct(F.col(name).alias("w"), times.alias("m"))).drop("_w")

    ra, rb = words(a, a_id, "wa"), words(b, b_id, "wb")
    like = fuzzy.similar_words(ra.select(F.col("wa").alias("w")), rb.select(F.col("wb").alias("w")))
    # equal words need no list of like ones; the words of a page are few beside its rows
    unlike = like.filter("wa <> wb")
    on_page = rb.select(*page, "wb").distinct().join(unlike, "wb").select(*page, "wa", "wb")
    same = ra.join(rb.withColumn("wa", F.col("wb")), [*page, "wa"])
    other = ra.join(on_page, [*page, "wa"]).join(rb, [*page, "wb"])
    met = same.unionByName(other.select(*same.columns))
    count = lambda c: F.aggregate(F.collect_set(c), F.lit(0), lambda t, s: t + s["m"]).cast("double")
    sums = met.groupBy(*page, a_id, b_id).agg(
        (count("m_wa") / F.first("n_wa")).alias("_p"), (count("m_wb") / F.first("n_wb")).alias("_q"))
    return sums.select(*page, a_id, b_id, (2 * F.col("_p") * F.col("_q") / (F.col("_p") + F.col("_q"))).alias("similitud"))


def candidate_pairs(records: DataFrame, articles: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of equal price or similar name, with both facts and the score."""
    # six steps read the words of each side, so they are told once and written
    words = _words(F.col("producto"), F.col("tienda")).alias("_w")
    r = cut_lineage(records.select(*page, "registro", "precio", words))
    a = cut_lineage(articles.select(*page, "id", "precio", words))
    key = [*page, "registro", "id"]
    priced = r.select(*page, "registro", "precio", _near_cents(F.col("precio")).alias("_c")).join(
        a.select(*page, "id", F.col("precio").alias("_price"), _cents(F.col("precio")).alias("_c")), [*page, "_c"])
    priced = priced.filter(same_cents(F.col("precio"), F.col("_price"))).select(*key, F.lit(True).alias("precio_ok"))
    pairs = word_pairs(r, a, page, "registro", "id").join(priced, key, "full_outer").withColumns({
        "precio_ok": F.coalesce("precio_ok", F.lit(False)), "similitud": F.coalesce("similitud", F.lit(0.0))})
    score = PRICE_WEIGHT * F.col("precio_ok").cast("double") + NAME_WEIGHT * F.col("similitud")
    return pairs.filter(F.col("precio_ok") | (F.col("similitud") >= CANDIDATE_SIMILARITY)).select(
        *key, "precio_ok", "similitud", score.alias("_score"))


def match_records(records: DataFrame, articles: DataFrame, page: list[str]) -> DataFrame:
    """One-to-one pairs with the greatest total score of each page, with every verdict."""
    shown = records.filter("precio IS NOT NULL AND producto IS NOT NULL")
    priced = articles.filter("precio IS NOT NULL")
    taken = best_one_to_one(candidate_pairs(shown, priced, page), [*page, "registro"], [*page, "id"], "_score").drop("_score")
    left = shown.select(*page, "tienda", "registro", *[F.col(c).alias(f"r_{c}") for c in (
        "precio", "producto", "producto_texto", "categoria", "precio_anterior")])
    right = priced.select(*page, "id", *[F.col(c).alias(f"a_{c}") for c in (
        "precio", "producto", "categoria", "precio_anterior")])
    rows = taken.join(left, [*page, "registro"]).join(right, [*page, "id"])
    return rows.withColumns({
        "producto_ok": F.col("similitud") >= PRODUCT_SIMILARITY,
        "anterior_ok": same_cents_or_both_null(F.col("r_precio_anterior"), F.col("a_precio_anterior")),
        "categoria_ok": F.when(F.col("a_categoria").isNotNull(), F.col("r_categoria").eqNullSafe(F.col("a_categoria"))),
    }).withColumns({
        "basico_ok": F.col("precio_ok") & F.col("producto_ok"),
        "completo_ok": F.col("precio_ok") & F.col("producto_ok") & F.col("anterior_ok"),
        "error": pair_error(F.col("precio_ok"), F.col("producto_ok"), F.col("anterior_ok")),
    })


def pair_error(price_ok: Column, product_ok: Column, previous_ok: Column) -> Column:
    return (F.when(~price_ok, "precio_mal_leido").when(~product_ok, "asociacion_producto")
            .when(~previous_ok, "asociacion_antes"))


def price_signatures(price: Column) -> Column:
    """How an amount can appear in read text: 29.90 as ``2990`` or ``29``."""
    total = _cents(price)
    whole, cents = F.floor(total / 100).cast("bigint"), total % 100
    text = whole.cast("string")
    full = F.when(cents != 0, F.concat(text, F.lpad(cents.cast("string"), 2, "0")))
    short = F.when((F.length(text) >= 2) | (cents == 0), text)
    return F.filter(F.array(full, short), lambda s: s.isNotNull())


def _parts(text: Column, size: int) -> Column:
    """Every run of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def _digit_runs(text: Column, lengths: list[int]) -> Column:
    """Every run of so many digits inside those of a text, so that "contains" becomes equality."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    runs = [_parts(digits, k) for k in lengths]
    return F.array_distinct(F.flatten(F.array(*runs))) if runs else F.array().cast("array<string>")


def holding_signature(texts: DataFrame, signed: DataFrame, page: list[str], text_id: list[str], sign_id: list[str],
                      text: str, least: int = 1) -> DataFrame:
    """(page, text_id, sign_id) where the digits of a text hold a signature."""
    signs = signed.select(*page, *sign_id, F.explode(price_signatures(F.col("precio"))).alias("_s")).filter(F.length("_s") >= least)
    # as many numbers as signatures have different lengths: a few
    lengths = sorted(r["n"] for r in signs.select(F.length("_s").alias("n")).distinct().collect())
    runs = texts.select(*page, *text_id, F.explode(_digit_runs(F.col(text), lengths)).alias("_s"))
    return runs.join(signs, [*page, "_s"]).select(
        *page, *text_id, *sign_id).distinct()


def leftover_records(records: DataFrame, articles: DataFrame, pairs: DataFrame, promotions: DataFrame,
                     page: list[str]) -> DataFrame:
    """Shown records without an article, each with the first reason that holds."""
    key = [*page, "registro"]
    priced = articles.filter("precio IS NOT NULL")
    judged = priced.select(*page).distinct()
    rest = records.filter("precio IS NOT NULL AND producto IS NOT NULL").join(judged, page, "left_semi").join(
        pairs.select(*key), key, "left_anti")
    promo = lambda c: block_text.strong_promotion(c) | block_text.weak_promotion(c)
    texts = rest.select(*key, F.explode(F.array_distinct(F.filter(
        F.array("producto", "producto_texto"), lambda t: t.isNotNull()))).alias("_t"))
    told = texts.withColumn("_w", _words(F.col("_t")))
    offers = promotions.select(*page, F.col("texto").alias("_p"), _words(F.col("texto")).alias("_w"))
    near = word_pairs(told.withColumn("_id", F.struct("registro", "_t")), offers.withColumn("_pid", F.col("_p")),
                      page, "_id", "_pid")
    named = near.filter(F.col("similitud") >= PRODUCT_SIMILARITY).select(
        *page, F.col("_id.registro").alias("registro")).distinct()
    good = pairs.filter("completo_ok").select(*page, _cents(F.col("r_precio")).alias("_c")).distinct()
    double = rest.select(*key, _near_cents(F.col("precio")).alias("_c")).join(good, [*page, "_c"], "left_semi").select(
        *key).distinct()
    misread = holding_signature(rest, priced, page, ["registro"], [], "precio_texto", least=3).select(*key).distinct()
    flag = lambda df, n: df.withColumn(n, F.lit(True))
    rows = rest.join(flag(named, "_n"), key, "left").join(flag(double, "_d"), key, "left").join(
        flag(misread, "_m"), key, "left")
    is_promo = promo(F.coalesce("producto", F.lit(""))) | promo(F.coalesce("producto_texto", F.lit("")))
    code = (F.when(is_promo | F.coalesce("_n", F.lit(False)), "promo_como_producto").when(F.col("_d"), "duplicado")
            .when(F.col("_m"), "precio_mal_leido").otherwise("precio_huerfano"))
    return rows.withColumn("codigo", code).drop("_n", "_d", "_m")


def lost_articles(articles: DataFrame, pairs: DataFrame, blocks: DataFrame, classified: DataFrame, records: DataFrame,
                  accepted: DataFrame, page: list[str]) -> DataFrame:
    """Articles without a record, each with the first stage that lost it."""
    key = [*page, "id"]
    lost = articles.filter("precio IS NOT NULL").join(pairs.select(*key), key, "left_anti")
    prices = classified.filter("tipo = 'PRECIO'")
    read = holding_signature(blocks, lost, page, [], ["id"], "texto")
    in_price = holding_signature(prices, lost, page, [], ["id"], "texto")
    by_value = lambda df, c: lost.select(*key, _near_cents(F.col("precio")).alias("_c")).join(
        df.filter(F.col(c).isNotNull()).select(*page, _cents(F.col(c)).alias("_c")).distinct(),
        [*page, "_c"], "left_semi").select(*key).distinct()
    valued = by_value(prices, "valor")
    orphan = by_value(records.filter("producto IS NULL"), "precio")
    products = classified.filter("tipo IN ('PRODUCTO', 'ATRIBUTO')")
    found = recall_in_corpus(lost, "producto", products, page, ["id"]).filter("encontrado").select(*key)
    kept = recall_in_corpus(lost, "producto", accepted, page, ["id"]).filter("encontrado").select(*key)
    rows = lost
    for name, df in (("_read", read), ("_price", in_price), ("_value", valued), ("_orphan", orphan),
                     ("_found", found), ("_kept", kept)):
        rows = rows.join(df.withColumn(name, F.lit(True)), key, "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    code = (F.when(~has("_read"), "ocr_no_leido")
            .when(~has("_value"), F.when(has("_price"), "precio_mal_leido").otherwise("clasificacion"))
            .when(has("_orphan") & has("_found") & ~has("_kept"), "producto_descartado")
            .otherwise("asociacion_producto"))
    return rows.withColumn("codigo", code).drop("_read", "_price", "_value", "_orphan", "_found", "_kept")


# -- metrics -------------------------------------------------------------------------------

def rate(part: Column, whole: Column) -> Column:
    return half_up(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 4)


def wilson(hits: Column, n: Column) -> Column:
    """Bounds of the 95 % interval of a share, as array [low, high]; NULL without cases."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits.cast("double") / m, Z_95 * Z_95
    center = (p + z2 / (2 * m)) / (1 + z2 / m)
    margin = Z_95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    low, high = half_up(F.greatest(F.lit(0.0), center - margin), 4), half_up(F.least(F.lit(1.0), center + margin), 4)
    return F.when(m.isNotNull(), F.array(low, high))


def f1(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, 0.0).otherwise(half_up(2 * p * r / F.nullif(p + r, F.lit(0.0)), 4))


def two_share_z(a1: Column, n1: Column, a2: Column, n2: Column) -> Column:
    """z of the difference of two shares; NULL without cases or spread."""
    m1, m2 = F.nullif(n1.cast("double"), F.lit(0.0)), F.nullif(n2.cast("double"), F.lit(0.0))
    p = (a1 + a2) / (m1 + m2)
    spread = F.sqrt(p * (1 - p) * (1 / m1 + 1 / m2))
    return (a2 / m2 - a1 / m1) / F.nullif(spread, F.lit(0.0))


COUNTS = ("paginas", "paginas_sin_precio_gt", "registros_dashboard", "registros_sin_producto", "articulos_con_precio",
          "pares", "completos_ok", "basicos_ok", "pares_precio_ok", "pares_producto_ok", "registros_con_antes",
          "antes_ok", "articulos_con_antes", "categoria_evaluable", "categoria_ok", "embudo_ocr", "embudo_precio_nlp")


def store_counts(pages: DataFrame, records: DataFrame, articles: DataFrame, pairs: DataFrame, leftover: DataFrame,
                 lost: DataFrame, page: list[str]) -> DataFrame:
    """Every count per store; each table is counted by itself before the stores meet."""
    priced = articles.filter("precio IS NOT NULL")
    judged = priced.select(*page).distinct()
    flagged = pages.select(*page, "tienda").distinct().join(judged.withColumn("_j", F.lit(True)), page, "left")
    seen = records.join(judged, page, "left_semi")
    shown = F.col("precio").isNotNull() & F.col("producto").isNotNull()
    c = F.col
    parts = [
        flagged.groupBy("tienda").agg(
            count_where(c("_j")).alias("paginas"), count_where(c("_j").isNull()).alias("paginas_sin_precio_gt")),
        seen.groupBy("tienda").agg(
            count_where(shown).alias("registros_dashboard"),
            count_where(c("precio").isNotNull() & c("producto").isNull()).alias("registros_sin_producto"),
            count_where(shown & c("precio_anterior").isNotNull()).alias("registros_con_antes")),
        priced.groupBy("tienda").agg(
            F.count(F.lit(1)).alias("articulos_con_precio"),
            count_where(c("precio_anterior").isNotNull()).alias("articulos_con_antes")),
        pairs.groupBy("tienda").agg(
            F.count(F.lit(1)).alias("pares"), count_where(c("completo_ok")).alias("completos_ok"),
            count_where(c("basico_ok")).alias("basicos_ok"), count_where(c("precio_ok")).alias("pares_precio_ok"),
            count_where(c("producto_ok")).alias("pares_producto_ok"),
            count_where(c("r_precio_anterior").isNotNull() & c("anterior_ok") & c("basico_ok")).alias("antes_ok"),
            count_where(c("categoria_ok").isNotNull() & c("producto_ok")).alias("categoria_evaluable"),
            count_where(c("categoria_ok") & c("producto_ok")).alias("categoria_ok"),
            *[count_where(c("error") == e).alias(f"_p_{e}") for e in ("precio_mal_leido", "asociacion_producto",
                                                                      "asociacion_antes")]),
        leftover.groupBy("tienda").agg(*[count_where(c("codigo") == e).alias(f"_r_{e}") for e in RECORD_ERRORS]),
        lost.groupBy("tienda").agg(*[count_where(c("codigo") == e).alias(f"_a_{e}") for e in ARTICLE_ERRORS]),
    ]
    rows = reduce(lambda a, b: a.join(b, "tienda", "full_outer"), parts)
    z = lambda n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) if n in rows.columns else F.lit(0).cast("bigint")
    plain = [z(n).alias(n) for n in COUNTS if not n.startswith("embudo")]
    read = z("articulos_con_precio") - z("_a_ocr_no_leido")
    return rows.select(
        "tienda", *plain, read.alias("embudo_ocr"),
        (read - z("_a_clasificacion") - z("_a_precio_mal_leido")).alias("embudo_precio_nlp"),
        *[(z(f"_p_{e}") + z(f"_r_{e}")).alias(f"reg_{e}") for e in RECORD_ERRORS],
        *[(z(f"_p_{e}") + z(f"_a_{e}")).alias(f"art_{e}") for e in ARTICLE_ERRORS])


def metrics(counts: DataFrame) -> DataFrame:
    """Rates of each store and, with a NULL store, of all of them."""
    names = [c for c in counts.columns if c != "tienda"]
    sums = counts.groupingSets([["tienda"], []], "tienda").agg(*[F.sum(n).alias(n) for n in names])
    c = F.col
    out = sums.withColumns({
        "precision": rate(c("completos_ok"), c("registros_dashboard")),
        "recall": rate(c("completos_ok"), c("articulos_con_precio")),
        "precision_basica": rate(c("basicos_ok"), c("registros_dashboard")),
        "recall_basico": rate(c("basicos_ok"), c("articulos_con_precio")),
        "exactitud_precio_en_pares": rate(c("pares_precio_ok"), c("pares")),
        "exactitud_producto_en_pares": rate(c("pares_producto_ok"), c("pares")),
        "precision_antes": rate(c("antes_ok"), c("registros_con_antes")),
        "recall_antes": rate(c("antes_ok"), c("articulos_con_antes")),
        "exactitud_categoria": rate(c("categoria_ok"), c("categoria_evaluable")),
        "_w": wilson(c("completos_ok"), c("registros_dashboard")),
    })
    return out.withColumns({
        "precision_ic95_inf": F.try_element_at("_w", F.lit(1)), "precision_ic95_sup": F.try_element_at("_w", F.lit(2)),
        "f1": f1(c("precision"), c("recall"))}).drop("_w")


def compare_runs(base: DataFrame, new: DataFrame) -> DataFrame:
    """Change per scope and metric, and whether it is a regression, significant or blocking."""
    pieces = (("precision", "completos_ok", "registros_dashboard"), ("recall", "completos_ok", "articulos_con_precio"))
    a = base.select(F.coalesce("tienda", F.lit("global")).alias("ambito"), *[
        F.col(x).alias(f"b_{x}") for x in ("precision", "recall", "completos_ok", "registros_dashboard", "articulos_con_precio")])
    b = new.select(F.coalesce("tienda", F.lit("global")).alias("ambito"), *[
        F.col(x).alias(f"n_{x}") for x in ("precision", "recall", "completos_ok", "registros_dashboard", "articulos_con_precio")])
    both = a.join(b, "ambito")
    rows = None
    for metric, hits, whole in pieces:
        n = F.least(f"b_{whole}", f"n_{whole}")
        z = two_share_z(F.col(f"b_{hits}"), F.col(f"b_{whole}"), F.col(f"n_{hits}"), F.col(f"n_{whole}"))
        delta = half_up((F.col(f"n_{metric}") - F.col(f"b_{metric}")) * 100, 2)
        one = both.select("ambito", F.lit(metric).alias("metrica"), F.col(f"b_{metric}").alias("base"),
                          F.col(f"n_{metric}").alias("nueva"), delta.alias("delta_pts"), n.alias("n"),
                          half_up(z, 2).alias("z"), (F.abs(z) >= Z_95).alias("_s"))
        rows = one if rows is None else rows.unionByName(one)
    worse = F.coalesce(F.col("delta_pts") < -REGRESSION_POINTS, F.lit(False))
    enough = F.col("n") >= MIN_SAMPLE
    return rows.withColumns({
        "regresion": worse,
        "significativa": worse & enough & F.coalesce("_s", F.lit(False)),
        "bloquea": worse & enough}).drop("_s")


# -- cases ---------------------------------------------------------------------------------

def article_cases(pairs: DataFrame, lost: DataFrame, page: list[str]) -> DataFrame:
    """State of every article under a key that is stable between runs."""
    key = F.concat(F.concat_ws("/", *page), F.lit("#"), F.col("id").cast("string")).alias("clave")
    state = F.when(F.col("completo_ok"), "ok").otherwise(F.col("error")).alias("estado")
    return pairs.select(key, "tienda", state).unionByName(lost.select(key, "tienda", F.col("codigo").alias("estado")))


def record_cases(pairs: DataFrame, leftover: DataFrame, records: DataFrame, page: list[str]) -> DataFrame:
    """State of every shown record; the key is its amount and the corner of its price."""
    corner = records.select(*page, "registro", F.concat(
        F.concat_ws("/", *page), F.lit("|"), F.col("precio").cast("string"), F.lit("|"),
        F.concat_ws(",", "x", "y")).alias("clave"))
    state = F.when(F.col("completo_ok"), "ok").otherwise(F.col("error")).alias("estado")
    rows = pairs.select(*page, "registro", "tienda", state).unionByName(
        leftover.select(*page, "registro", "tienda", F.col("codigo").alias("estado")))
    return rows.join(corner, [*page, "registro"]).select("clave", "tienda", "estado")


def case_changes(base: DataFrame, new: DataFrame, absent: str) -> DataFrame:
    """Cases whose state differs; a case of one run only has the state ``absent`` in the other."""
    b = base.select("clave", F.col("tienda").alias("_tb"), F.col("estado").alias("_eb"))
    n = new.select("clave", F.col("tienda").alias("_tn"), F.col("estado").alias("_en"))
    return b.join(n, "clave", "full_outer").select(
        "clave", F.coalesce("_tn", "_tb").alias("tienda"), F.coalesce("_eb", F.lit(absent)).alias("antes"),
        F.coalesce("_en", F.lit(absent)).alias("despues")).filter("antes <> despues")


def change_summary(articles: DataFrame, records: DataFrame) -> DataFrame:
    """Gains and losses per store."""
    after, before = F.col("despues") == "ok", F.col("antes") == "ok"
    a = articles.groupBy("tienda").agg(
        count_where(after).alias("articulos_ganados"), count_where(before).alias("articulos_perdidos"),
        count_where(~after & ~before).alias("articulos_cambio_error"))
    r = records.groupBy("tienda").agg(
        count_where(after).alias("registros_ganados"), count_where(before).alias("registros_perdidos"),
        count_where(~after & ~before & (F.col("antes") == "no_existe")).alias("registros_nuevos_mal"))
    zero = F.lit(0).cast("bigint")
    joined = a.join(r, "tienda", "full_outer")
    return joined.select("tienda", *[F.coalesce(c, zero).alias(c) for c in joined.columns if c != "tienda"])


def transitions(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.concat_ws(" -> ", "antes", "despues").alias("transicion")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "transicion")


def error_examples(cases: DataFrame, per_group: int = 10) -> DataFrame:
    """The first cases of each error and store."""
    w = Window.partitionBy("estado", "tienda").orderBy("clave")
    return cases.filter("estado <> 'ok'").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_group)


# -- field comparison ------------------------------------------------------------------------

def _pieces(word: Column, lengths: list[int]) -> Column:
    """Every part of a word that has one of so many letters."""
    return F.flatten(F.array(*[_parts(word, k) for k in lengths])) if lengths else F.array().cast("array<string>")


def recall_in_corpus(items: DataFrame, text: str, corpus: DataFrame, page: list[str], item_id: list[str],
                     corpus_text: str = "texto") -> DataFrame:
    """Share of the telling words of each item that the texts of its page hold.

    A telling word has no space, so it lies inside one word of the corpus; "contains" on
    the whole page text becomes an equality join on parts of its distinct words, in the
    lengths that are asked for.  Parts are many times the texts they are cut from, which no
    size estimate of the optimizer tells, so neither join may broadcast them.
    """
    key = [*page, *item_id]
    told = items.select(*key, F.posexplode(significant_words(F.coalesce(F.col(text), F.lit("")))).alias("_k", "_t"))
    words = corpus.select(*page, F.explode(words_of(base_text(F.coalesce(F.col(corpus_text), F.lit(""))))).alias("_w"))
    wanted = told.select(*page, F.col("_t")).distinct()
    lengths = sorted(r["n"] for r in wanted.select(F.length("_t").alias("n")).distinct().collect())
    parts = words.distinct().select(*page, F.explode(F.array_distinct(_pieces(F.col("_w"), lengths))).alias("_t"))
    held = wanted.join(parts.hint("merge"), [*page, "_t"], "left_semi").withColumn("_h", F.lit(1))
    share = told.join(held.hint("merge"), [*page, "_t"], "left").groupBy(*key).agg(
        (F.count("_h").cast("double") / F.count(F.lit(1))).alias("cobertura"))
    return items.select(*key).join(share, key, "left").select(
        *key, F.coalesce("cobertura", F.lit(0.0)).alias("cobertura"),
        (F.coalesce("cobertura", F.lit(0.0)) >= RECALL_SHARE).alias("encontrado"))


def _priced_in(items: DataFrame, price: str, others: DataFrame, other: str, page: list[str], item_id: list[str]) -> DataFrame:
    """Items whose price equals one of the other prices of the page to the cent."""
    key = [*page, *item_id]
    c = others.filter(F.col(other).isNotNull()).select(*page, _cents(F.col(other)).alias("_c")).distinct()
    asked = items.filter(F.col(price).isNotNull()).select(*key, _near_cents(F.col(price)).alias("_c"))
    return asked.join(c, [*page, "_c"], "left_semi").select(*key).distinct()


def field_scores(articles: DataFrame, promotions: DataFrame, blocks: DataFrame, classified: DataFrame,
                 page: list[str]) -> DataFrame:
    """Per page: found and correct products, prices and promotions, both ways.

    ``blocks`` are all read texts; ``classified`` has ``tipo``, ``texto``, ``valor`` and
    ``bloque``; ``promotions`` has ``promo`` (id) and ``texto`` (the mechanics).
    """
    products = classified.filter("tipo IN ('PRODUCTO', 'ATRIBUTO')")
    prices = classified.filter("tipo = 'PRECIO'")
    other = classified.filter("tipo IN ('PRECIO_ANTERIOR', 'AHORRO')")
    offers = classified.filter("tipo IN ('PROMO', 'EVENTO_PROMO')")
    named = articles.filter("producto IS NOT NULL AND producto <> ''")
    told = promotions.filter("texto IS NOT NULL AND texto <> ''")
    total = lambda df, n: df.groupBy(*page).agg(F.count(F.lit(1)).alias(n))
    hit = lambda df, n: total(df.filter("encontrado"), n)
    right = _priced_in(named, "precio", prices, "valor", page, ["id"])
    elsewhere = _priced_in(named, "precio", other, "valor", page, ["id"]).join(right, [*page, "id"], "left_anti")
    parts = [
        total(named, "productos_total"),
        hit(recall_in_corpus(named, "producto", blocks, page, ["id"]), "productos_ocr_ok"),
        hit(recall_in_corpus(named, "producto", products, page, ["id"]), "productos_nlp_ok"),
        total(named.filter("precio IS NOT NULL"), "precios_total"),
        total(right, "precios_ok"), total(elsewhere, "precios_mal_clasificados"),
        total(told, "promos_total"), hit(recall_in_corpus(told, "texto", offers, page, ["promo"]), "promos_ok"),
        total(products, "productos_nlp_clasificados"),
        hit(recall_in_corpus(products, "texto", articles, page, ["bloque"], "producto"), "productos_nlp_correctos"),
        total(prices, "precios_nlp_clasificados"),
        total(_priced_in(prices, "valor", articles, "precio", page, ["bloque"]), "precios_nlp_correctos"),
        total(offers, "promos_nlp_clasificados"),
        hit(recall_in_corpus(offers, "texto", told, page, ["bloque"]), "promos_nlp_correctos"),
    ]
    judged = articles.select(*page).unionByName(promotions.select(*page)).distinct()
    rows = reduce(lambda a, b: a.join(b, page, "left"), parts, judged)
    return rows.select(*page, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in rows.columns if c not in page])


# -- splits, agreement, seals ------------------------------------------------------------------

def split_flyers(articles: DataFrame, seed: str) -> DataFrame:
    """(tienda, folleto, split): one or two flyers of each store are held out.

    The flyer whose article count is closest to the store median is held out, two where
    a store has six or more, with a previous price if the store has any.
    """
    flyers = articles.groupBy("tienda", "folleto").agg(
        F.count("id").alias("articulos"), F.count("precio_anterior").alias("antes"))
    stores = flyers.groupBy("tienda").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("articulos", 0.5).alias("mediana"), F.max("antes").alias("_any"))
    rows = flyers.join(stores, "tienda").filter((F.col("_any") == 0) | (F.col("antes") > 0))
    w = Window.partitionBy("tienda").orderBy(
        F.abs(F.col("articulos") - F.col("mediana")), sha_order(F.lit(seed), F.col("folleto")))
    # the literal limit lets each task keep two flyers per store before any shuffle
    best = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    held = best.filter(F.col("_rn") <= F.when(F.col("n") >= 6, 2).otherwise(1)).select(
        "tienda", "folleto", F.lit("holdout").alias("_s"))
    return flyers.select("tienda", "folleto").join(held, ["tienda", "folleto"], "left").select(
        "tienda", "folleto", F.coalesce("_s", F.lit("dev")).alias("split"))


def quota_sample(cases: DataFrame, quotas: dict[str, int], key: str, seed: str) -> DataFrame:
    """Cases per group up to its quota, one per store in each round."""
    w = Window.partitionBy("grupo", "tienda").orderBy(sha_order(F.lit(seed), F.col(key)), key)
    quota = F.coalesce(*[F.when(F.col("grupo") == g, F.lit(q)) for g, q in quotas.items()], F.lit(0))
    most = max(quotas.values())
    rounds = cases.withColumn("vuelta", F.row_number().over(w)).filter(F.col("vuelta") <= most)
    order = Window.partitionBy("grupo").orderBy("vuelta", "tienda")
    ranked = rounds.withColumn("orden", F.row_number().over(order)).filter(F.col("orden") <= most)
    return ranked.filter(F.col("orden") <= quota)


def agreement(sample: DataFrame, answers: DataFrame, unjudged: DataFrame) -> DataFrame:
    """Agreement of the judge with a person; doubtful and unjudged cases do not count."""
    rows = sample.join(answers, "caso").join(
        unjudged.select("pagina").distinct().withColumn("_x", F.lit(True)), "pagina", "left")
    out = F.col("_x").isNotNull()
    doubt = ~out & F.coalesce(F.col("r_producto") == "dudoso", F.lit(False))
    counted = ~out & ~doubt
    person = F.coalesce((F.col("r_producto") == "si") & (F.col("r_precio") == "si"), F.lit(False))
    judge = F.coalesce(F.col("juez_producto_ok") & F.col("juez_precio_ok"), F.lit(False))
    agreed, total = count_where(counted & (person == judge)), count_where(counted)
    return rows.agg(total.alias("evaluados"), agreed.alias("acuerdos"), count_where(doubt).alias("dudosos"),
                    count_where(out).alias("excluidos"), rate(agreed, total).alias("concordancia"))


def seals(files: DataFrame) -> DataFrame:
    """(archivo, huella) of files read as ``binaryFile``; line ends do not matter."""
    text = F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n"))
    return files.select(F.col("path").alias("archivo"), F.sha2(text, 256).alias("huella"))


def seal_drift(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """Files that are new, missing or changed against the sealed list."""
    a = sealed.select("archivo", F.col("huella").alias("_a"))
    b = current.select("archivo", F.col("huella").alias("_b"))
    state = F.when(F.col("_a").isNull(), "nuevo").when(F.col("_b").isNull(), "falta").otherwise("modificado")
    return a.join(b, "archivo", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        "archivo", state.alias("estado"))


def page_fingerprints(rows: DataFrame, page: list[str]) -> DataFrame:
    """(page, filas, huella): one value per page that any changed row changes.

    Row hashes are added up in two 128-bit halves, so a page of any size is summed on
    the map side and the order of rows does not matter.
    """
    columns = [c for c in rows.columns if c not in page]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda k: F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*page).agg(F.count(F.lit(1)).alias("filas"), F.concat_ws(
        "-", *[half(k).cast("string") for k in (1, 16, 31, 46)]).alias("huella"))


def fingerprint_differences(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    left = a.select(*page, F.col("huella").alias("_a"))
    right = b.select(*page, F.col("huella").alias("_b"))
    state = F.when(F.col("_b").isNull(), "solo_a").when(F.col("_a").isNull(), "solo_b").otherwise("distinta")
    return left.join(right, page, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *page, state.alias("estado"))


# -- runs and reliability ------------------------------------------------------------------------

def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs over all of dev with clean code, production reading and intact seals."""
    c = F.col
    return runs.filter(
        (c("meta.split") == "dev") & (F.coalesce("meta.tienda", F.lit("")) == "")
        & (F.coalesce("meta.ocr_exp", F.lit("")) == "") & (c("meta.codigo.cambios_sin_commit") == F.lit(False))
        & (c("integridad.valida") == F.lit(True)) & (F.coalesce("meta.fecha", F.lit("")) != ""))


def current_run(runs: DataFrame) -> DataFrame:
    """The latest valid run, by date and file name."""
    return valid_runs(runs).agg(F.max_by(F.struct(*runs.columns), F.struct("meta.fecha", "archivo")).alias("r")).filter(
        "r IS NOT NULL").select("r.*")


def dominant_error(counts: Column) -> Column:
    """Most frequent error of a map, the larger name on a tie, NULL without any."""
    ranked = F.transform(F.map_entries(counts), lambda e: F.struct(F.coalesce(e["value"], F.lit(0)).alias("n"), e["key"].alias("k")))
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["k"])


def reliability_label(precision: Column, lower: Column, records: Column) -> Column:
    return (
        F.when(precision.isNull() | (F.coalesce(records, F.lit(0)) == 0), "Sin medir")
        .when(records < MIN_RECORDS, "Muestra insuficiente")
        .when(precision < MEDIUM_PRECISION, "Baja")
        .when((precision >= GOOD_PRECISION) & (F.coalesce(lower, F.lit(-1.0)) >= GOOD_LOWER_BOUND), "Aceptable")
        .otherwise("Media"))


def store_metrics(run: DataFrame) -> DataFrame:
    """Metrics per store of one run (map ``metricas.tiendas``); unmeasured stores keep NULLs."""
    rows = run.select(F.explode("metricas.tiendas").alias("tienda_slug", "m"))
    count = lambda k: F.try_element_at(F.col("m.conteos"), F.lit(k))
    measured = (F.coalesce(count("paginas"), F.lit(0)) > 0) & (F.coalesce(count("articulos_con_precio"), F.lit(0)) > 0)
    only = lambda c: F.when(measured, c)
    low = only(F.try_element_at("m.precision_ic95", F.lit(1)))
    records, precision = only(count("registros_dashboard")), only(F.col("m.precision"))
    return rows.select(
        "tienda_slug", precision.alias("precision"), low.alias("precision_ic95_inf"),
        only(F.try_element_at("m.precision_ic95", F.lit(2))).alias("precision_ic95_sup"),
        only(F.col("m.recall")).alias("recall"), records.alias("registros_evaluados"),
        only(count("articulos_con_precio")).alias("articulos_gt"), only(count("paginas")).alias("paginas_evaluadas"),
        only(dominant_error(F.col("m.errores_registro"))).alias("error_dominante"),
        reliability_label(precision, low, records).alias("etiqueta"))


def run_info(run: DataFrame) -> DataFrame:
    """What a panel shows about the run its labels come from."""
    measured = F.map_filter("metricas.tiendas", lambda _, m: F.coalesce(F.try_element_at(
        m["conteos"], F.lit("articulos_con_precio")), F.lit(0)) > 0)
    total = F.col("metricas.global")
    return run.select(
        "archivo", F.col("meta.fecha").alias("fecha"), F.col("meta.codigo.commit").alias("commit"),
        F.col("meta.split").alias("split"), F.try_element_at(total["conteos"], F.lit("paginas")).alias("paginas_evaluadas"),
        F.size("metricas.tiendas").alias("tiendas_en_split"), F.size(measured).alias("tiendas_medidas"),
        total["precision"].alias("precision_global"), total["recall"].alias("recall_global"))


def join_reliability(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Adds the metrics of a run to the store rows; stores without any are "Sin medir"."""
    return rows.join(measured, "tienda_slug", "left").withColumns({
        "etiqueta": F.coalesce("etiqueta", F.lit("Sin medir")),
        "base_heuristica": F.coalesce(F.col("pct_catalogo") < HEURISTIC_BASE_PCT, F.lit(False))})


# -- layout catalogue and rule impact --------------------------------------------------------------

def layout_catalogue(articles: DataFrame, prices: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """Where the name of each article stands relative to its price.

    Price blocks are met on the cent, text blocks on like words; the closest pair of
    centres tells the position.
    """
    from .association import name_position, name_reachable
    key = [*page, "id"]
    box = ("x", "y", "ancho", "alto")
    priced = articles.filter("precio IS NOT NULL").withColumn("_w", _words(F.col("producto"), F.col("tienda")))
    mine = priced.select(*key, _near_cents(F.col("precio")).alias("_c")).join(
        prices.filter("valor IS NOT NULL").select(*page, *box, F.col("bloque").alias("pb"), _cents(F.col("valor")).alias("_c")),
        [*page, "_c"])
    stores = articles.select(*page, "tienda").distinct()
    lines = blocks.drop("tienda").join(stores, page).withColumn("_w", _words(F.col("texto"), F.col("tienda")))
    near = word_pairs(priced, lines.withColumnRenamed("bloque", "nb"), page, "id", "nb").withColumnRenamed("similitud", "sim")
    texts = near.join(lines.select(*page, F.col("bloque").alias("nb"), *[F.col(c).alias(f"o_{c}") for c in box]), [*page, "nb"])
    best = texts.groupBy(*key).agg(F.max("sim").alias("_best"))
    told = texts.join(best, key).filter((F.col("sim") >= CANDIDATE_SIMILARITY) & (F.col("sim") >= F.col("_best") - 0.1))
    dx = (F.col("x") + F.col("ancho") / 2) - (F.col("o_x") + F.col("o_ancho") / 2)
    dy = (F.col("y") + F.col("alto") / 2) - (F.col("o_y") + F.col("o_alto") / 2)
    closest = mine.join(told, key).groupBy(*key).agg(F.min(F.struct(
        F.sqrt(dx * dx + dy * dy).alias("d"), "pb", "nb", "sim", name_position().alias("posicion"),
        name_reachable().alias("alcanzable"), (-dx).alias("dx"), (-dy / F.greatest(F.lit(1), F.col("alto"))).alias("dy_altos"),
    )).alias("m"))
    rows = priced.select(*key, "tienda").join(closest, key, "left").join(
        mine.select(*key).distinct().withColumn("_p", F.lit(True)), key, "left")
    state = (F.when(F.col("_p").isNull(), "sin_precio_nlp").when(F.col("m").isNull(), "sin_nombre_ocr")
             .when(F.col("m.sim") >= PRODUCT_SIMILARITY, "completo").otherwise("parcial"))
    return rows.select(*key, "tienda", state.alias("estado"), F.col("m.posicion").alias("posicion"),
                       half_up(F.col("m.sim"), 2).alias("sim"), half_up(F.col("m.dy_altos"), 2).alias("dy_altos"),
                       F.col("m.alcanzable").alias("alcanzable"))


def dominant_positions(catalogue: DataFrame, flyer: list[str]) -> DataFrame:
    """Most frequent position per flyer and its share."""
    counts = catalogue.filter("posicion IS NOT NULL").groupBy(*flyer, "posicion").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*flyer).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "posicion"))["posicion"].alias("posicion"),
        half_up(F.max("n").cast("double") / F.sum("n"), 2).alias("fraccion"), F.sum("n").alias("n"))


def rule_impact(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Prices that a change of rules created, lost or changed, with the shape of their text."""
    a = before.filter("tipo = 'PRECIO'").select(*key, F.col("valor").alias("antes"), F.col("texto").alias("_ta"))
    b = after.filter("tipo = 'PRECIO'").select(*key, F.col("valor").alias("despues"), F.col("texto").alias("_tb"))
    change = (F.when(F.col("antes").isNull(), "creado").when(F.col("despues").isNull(), "perdido")
              .when(~same_cents(F.col("antes"), F.col("despues")), "cambiado"))
    text = F.coalesce("_tb", "_ta")
    return a.join(b, key, "full_outer").withColumns({
        "cambio": change, "texto": text, "forma": F.regexp_replace(text, r"\d", "d")}).filter(
        "cambio IS NOT NULL").drop("_ta", "_tb")


def evaluate(pages: DataFrame, records: DataFrame, articles: DataFrame, promotions: DataFrame, blocks: DataFrame,
             classified: DataFrame, accepted: DataFrame, page: list[str]) -> dict[str, DataFrame]:
    """Pairs, leftovers, losses, counts and metrics of one run."""
    pairs = cut_lineage(match_records(records, articles, page))
    leftover = leftover_records(records, articles, pairs, promotions, page)
    lost = lost_articles(articles, pairs, blocks, classified, records, accepted, page)
    counts = store_counts(pages, records, articles, pairs, leftover, lost, page)
    return {"pares": pairs, "sobrantes": leftover, "perdidos": lost, "conteos": counts, "metricas": metrics(counts)}
