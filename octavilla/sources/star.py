"""The flyer star as lazy DataFrames."""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cut import cut_lineage
from . import tpch_star


class Star:
    """Seven star tables, each read on first use.

    ``loader`` maps a table name to a DataFrame; nothing is read, cached or collected
    until a query needs the table.
    """

    def __init__(self, loader, whole=None):
        self._loader = loader
        self._whole = whole

    @cached_property
    def tiendas(self) -> DataFrame:
        return self._loader("tiendas")

    @cached_property
    def folletos(self) -> DataFrame:
        return self._loader("folletos")

    @cached_property
    def paginas(self) -> DataFrame:
        return self._loader("paginas")

    @cached_property
    def extracciones(self) -> DataFrame:
        return self._loader("extracciones")

    @cached_property
    def eventos_promo(self) -> DataFrame:
        return self._loader("eventos_promo")

    @cached_property
    def errores_carga(self) -> DataFrame:
        return self._loader("errores_carga")

    @cached_property
    def productos_canonicos(self) -> DataFrame:
        return self._loader("productos_canonicos")

    def every_kind(self) -> DataFrame:
        """The extraction table for a reader of all its rows.

        ``whole`` may make it in another way than the loader, which is asked for one kind mostly.
        """
        return self._whole() if self._whole else self.extracciones

    def precios(self) -> DataFrame:
        """PRECIO rows of the extraction table."""
        return self.extracciones.filter(F.col("tipo") == "PRECIO")


def from_parquet(spark: SparkSession, root: str) -> Star:
    """A star written by :mod:`octavilla.sources.writers`."""
    return Star(lambda name: spark.read.parquet(f"{root}/{name}"))


def from_tpch(spark: SparkSession, sf_dir: str) -> Star:
    """A star derived from TPC-H shaped parquet files."""
    raw: dict[str, DataFrame] = {}

    def source(name: str) -> DataFrame:
        if name not in raw:
            raw[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return raw[name]

    def build(table: str) -> DataFrame:
        relation, columns, group = tpch_star.MAPPING[table]
        first, _, rest = relation.partition(" JOIN ")
        df = source(first)
        if rest:
            other, _, condition = rest.partition(" ON ")
            df = df.join(source(other), F.expr(condition))
        if table in tpch_star._WHERE:
            df = df.filter(tpch_star._WHERE[table])
        if group:
            keys = [k.strip() for k in group.split(",")]
            aggs = [F.expr(e).alias(n) for n, e in columns]
            return df.groupBy(*keys).agg(*aggs).drop(*keys)
        return df.selectExpr(*[f"{e} AS {n}" for n, e in columns])

    def load(name: str) -> DataFrame:
        if name == "extracciones":
            first, *others = [build(p) for p in tpch_star.EXTRACTION_PARTS]
            for other in others:
                first = first.unionByName(other)
            return first
        if name == "eventos_promo":
            base = build("eventos_base")
            one = base.selectExpr(*[f"{e} AS {n}" for n, e in tpch_star.EVENT_COLUMNS])
            two = base.filter(tpch_star.SECOND_EVENT_FILTER).selectExpr(
                *[f"{e} AS {n}" for n, e in tpch_star.SECOND_EVENT_COLUMNS])
            return one.unionByName(two)
        return build(name)

    def whole() -> DataFrame:
        # the kinds come from one join, which is made once and written instead of once per kind
        parts = [tpch_star.MAPPING[p] for p in tpch_star.EXTRACTION_PARTS]
        first, _, rest = parts[0][0].partition(" JOIN ")
        other, _, condition = rest.partition(" ON ")
        text = " ".join([condition, *[e for _, columns, _ in parts for _, e in columns],
                         *[tpch_star._WHERE.get(p, "") for p in tpch_star.EXTRACTION_PARTS]])
        joined = source(first).join(source(other), F.expr(condition))
        joined = cut_lineage(joined.select(*[c for c in joined.columns if c in set(re.findall(r"\w+", text))]))
        rows = [joined.filter(tpch_star._WHERE.get(p, "true")).selectExpr(*[f"{e} AS {n}" for n, e in columns])
                for p, (_, columns, _) in zip(tpch_star.EXTRACTION_PARTS, parts)]
        return reduce(DataFrame.unionByName, rows)

    return Star(load, whole)
