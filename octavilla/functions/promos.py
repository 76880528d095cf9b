"""Campaign names: reading order, event classes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Campaign slug -> display name, in order of presentation.
CAMPAIGNS = {
    "julio_regalado": "Julio Regalado",
    "hot_sale": "Hot Sale",
    "buen_fin": "Buen Fin",
    "regreso_a_clases": "Regreso a clases",
    "navidad": "Navidad",
    "halloween_dia_de_muertos": "Halloween / Día de Muertos",
    "liquidacion": "Liquidación",
    "aniversario": "Aniversario",
    "ofertones": "Ofertones",
    "fiestas_patrias": "Fiestas Patrias",
}

# Event classes and their display names.
EVENT_CLASSES = {
    "campania": "Campaña",
    "lema": "Lema de la tienda",
    "legal": "Texto legal",
    "producto": "Nombre de producto",
    "otro": "Otro",
}

# Promotion levels; only the first one has data.
LEVELS = ("campania", "producto", "bancaria")
LEVELS_WITH_DATA = ("campania",)

# Patterns of event names, in order of precedence.
PRODUCT_NAME = r"(vela|figura|bao_navidad|hojas|cumplea|diferentes_)"
LEGAL_TEXT = r"(excepto|participantes|sucursales|apllcan|aplican|restriccion)"
CAMPAIGN_PATTERNS = {
    "julio_regalado": r"julio_?regalad",
    "hot_sale": r"hot_?sale",
    "buen_fin": r"buen_?fin",
    "regreso_a_clases": r"(regreso_a_clases|back_to_school)",
    "halloween_dia_de_muertos": r"(halloween|muertos)",
    "navidad": r"navid",
    "liquidacion": r"liquidaci",
    "aniversario": r"aniversario",
    "ofertones": r"ofert(o)?n",
    "fiestas_patrias": r"fiestas?_?patrias",
}
SLOGAN = r"(precio|supercamp|calidad_a|oferta)"


def _first_match(name: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), F.lit(v)) for v, p in patterns.items()])


def event_campaign(event_name: Column) -> Column:
    """Campaign slug of an event name, NULL for anything that is not a campaign."""
    name = F.lower(F.trim(F.coalesce(event_name, F.lit(""))))
    blocked = name.rlike(f"{PRODUCT_NAME}|{LEGAL_TEXT}")
    return F.when(name.isin(*CAMPAIGNS), name).when(~blocked, _first_match(name, CAMPAIGN_PATTERNS))


def event_class(event_name: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(event_name, F.lit(""))))
    return (
        F.when(name.isin(*CAMPAIGNS), "campania")
        .when(name.rlike(PRODUCT_NAME), "producto")
        .when(name.rlike(LEGAL_TEXT), "legal")
        .when(_first_match(name, CAMPAIGN_PATTERNS).isNotNull(), "campania")
        .when(name.rlike(SLOGAN), "lema")
        .otherwise("otro")
    )


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def campaign_name(slug: Column) -> Column:
    return F.coalesce(_lookup(CAMPAIGNS, slug), slug)


def class_name(event_cls: Column) -> Column:
    return _lookup(EVENT_CLASSES, event_cls)


def campaign_rank(slug: Column) -> Column:
    """Position in the order of presentation; unknown slugs come last."""
    return F.coalesce(*[F.when(slug == s, F.lit(i)) for i, s in enumerate(CAMPAIGNS)], F.lit(len(CAMPAIGNS)))


def classify_events(events: DataFrame) -> DataFrame:
    """Adds ``clase`` and ``campania`` to rows with ``nombre_evento``."""
    return events.withColumns({
        "clase": event_class(F.col("nombre_evento")),
        "campania": event_campaign(F.col("nombre_evento")),
    })


def campaigns_by_flyer(events: DataFrame) -> DataFrame:
    """One row per flyer: its campaign slugs without repeats, in order of presentation."""
    slugs = classify_events(events).filter(F.col("campania").isNotNull())
    ranked = F.struct(campaign_rank(F.col("campania")).alias("r"), F.col("campania").alias("slug"))
    return slugs.groupBy("folleto_id").agg(
        F.transform(F.sort_array(F.collect_set(ranked)), lambda s: s["slug"]).alias("campanias")
    )


def attach_campaigns(rows: DataFrame, events: DataFrame, key: str = "folleto_id") -> DataFrame:
    """Adds the array ``campanias``; the events are grouped first, so no row is repeated."""
    labels = campaigns_by_flyer(events).withColumnRenamed("folleto_id", "_flyer")
    return (
        rows.join(labels, F.col(key) == F.col("_flyer"), "left")
        .withColumn("campanias", F.coalesce("campanias", F.array().cast("array<string>")))
        .drop("_flyer")
    )


def normalize_promotion(value) -> str | None:
    v = (value or "").strip().lower()
    return v if v in ("con", "sin") else None


def normalize_level(value) -> str | None:
    v = (value or "").strip().lower()
    return v if v in LEVELS else None


def normalize_campaigns(values) -> list[str]:
    """Known slugs without repeats, in order of presentation."""
    wanted = {v.strip().lower() for v in (values or []) if v}
    return [s for s in CAMPAIGNS if s in wanted]
