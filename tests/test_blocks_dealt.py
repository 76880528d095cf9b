import re

from octavilla.sources import tpch_blocks, writers


def _tables(spark, folder):
    lines = [(o, n, 1 + (o * 3 + n) % 60, 1 + o % 7, 900.0 + o * 10 + n, 2.0, (o % 10) / 100, (n % 9) / 100) for o in range(0, 900, 5) for n in (1, 2)]
    spark.createDataFrame(lines + lines[:3], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
                          "l_quantity double, l_discount double, l_tax double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"hot bolt {i}", "STANDARD STEEL", i % 50) for i in range(1, 61)],
                          "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")


def test_blocks_of_a_group_are_dealt_once(spark, tmp_path):
    _tables(spark, str(tmp_path))
    told = {"fuente": "CASE WHEN pagina % 2 = 0 THEN 'a' ELSE 'b' END", "folleto_id": "CAST(floor(pagina / 40) AS STRING)"}
    group = ["fuente", "tienda", "folleto_id"]
    plain = tpch_blocks.blocks(spark, str(tmp_path)).selectExpr("*", *[f"{e} AS {n}" for n, e in told.items()])
    dealt = tpch_blocks.blocks(spark, str(tmp_path), group, told)
    assert dealt.columns == plain.columns
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) != []
    pages = writers.nested_pages(dealt.selectExpr(
        "*", "'PRECIO' AS tipo", "texto AS texto_norm", "1d AS valor", "array(1d) AS candidatos", "texto AS categoria"), group)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    # the rows of the two tables that meet, and the cells once: blocks were dealt again to be nested
    assert len(re.findall(r"Exchange hashpartitioning\((?!l_partkey|p_partkey)", plan)) == 1


def test_cells_are_dealt_before_texts_are_made(spark, tmp_path):
    _tables(spark, str(tmp_path))
    out = tpch_blocks.items(spark, str(tmp_path))
    assert out.columns == [n for n, _ in tpch_blocks.ITEM_COLUMNS]
    below = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(below) == 2 and "tienda_" in below[0] and "tienda_" not in below[1]
    assert out.groupBy("pagina", "pos").count().filter("count > 1").isEmpty()
