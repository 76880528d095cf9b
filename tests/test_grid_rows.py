from pyspark.sql import functions as F

from octavilla.operators import spatial


def test_boxes_are_dealt_without_rectangles(spark):
    a = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 900, 900), (2, 3, 0, 0)], "pagina int, bloque int, x int, y int")
    b = spark.createDataFrame([(1, 7, 30, 500), (1, 8, 5000, 0)], "pagina int, o_bloque int, o_x int, o_y int")
    x, y, ox, oy = (F.col(c) for c in ("x", "y", "o_x", "o_y"))
    out = spatial.boxes_meeting(a, b, ["pagina"], (x - 20, y, x + 40, y + 600), (ox, oy, ox, oy))
    assert out.columns == ["pagina", "bloque", "x", "y", "o_bloque", "o_x", "o_y"]
    assert [(r.bloque, r.o_bloque) for r in out.collect()] == [(1, 7)]
    assert "_x0" not in out._jdf.queryExecution().optimizedPlan().toString()
