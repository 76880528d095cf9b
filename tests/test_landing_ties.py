from pyspark.sql import functions as F

from octavilla.plans import ingest
from octavilla.streaming import landing

KEYS, CHANGING = ["fuente", "folleto_id"], ["titulo", "total_paginas", "landed_at"]


def test_versions_of_one_time_give_one_table_in_any_order(spark, tmp_path):
    def version(day, title, pages):
        row = [("tiendeo", "1", title, pages, f"2026-01-0{day} 00:00:00")]
        return spark.createDataFrame(row, "fuente string, folleto_id string, titulo string, total_paginas int, landed_at string").withColumn(
            "landed_at", F.col("landed_at").cast("timestamp"))

    versions = [version(1, "A", 9), version(2, "C", 1), version(2, "B", 7), version(2, "C", 3)]
    empty = lambda s: s.createDataFrame([], landing.LANDED).select(*KEYS, *CHANGING)
    merge = lambda old, new: ingest.merge(old, new, KEYS, ["titulo"], update=tuple(CHANGING))
    for k, order in enumerate(([0, 1, 2, 3], [3, 2, 1, 0], [2, 3, 0, 1])):
        table = str(tmp_path / f"t{k}")
        upsert = landing.parquet_upsert(table, merge, empty, buckets=2)
        for number, i in enumerate([*order, *order]):
            upsert(versions[i], number)
        assert [(r.titulo, r.total_paginas) for r in landing.latest_version(spark, table).collect()] == [("C", 3)]
