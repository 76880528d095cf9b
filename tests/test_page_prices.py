import re

from octavilla.plans import panels
from octavilla.sources.star import Star


def test_page_prices_reads_its_rows_once(spark):
    boxes = "bbox_x int, bbox_y int, bbox_ancho int, bbox_alto int"
    schema = ("id string, tipo string, folleto_id long, pagina_id long, texto_norm string, valor double, valor_anterior double, "
              f"categoria_nlp string, confianza_ocr double, producto_extraccion_id string, metodo_norm string, {boxes}")
    price = lambda i, page, value: (i, "PRECIO", 1, page, "pan", value, None, None, 0.5, "p", None, 1, 1, 1, 1)
    rows = [price("a", 1, 2.0), price("b", 1, 2.0), price("c", 1, 3.0), price("d", 2, 2.0), price("e", None, 2.0),
            ("p", "PRODUCTO", 1, 1, "pan", None, None, None, 0.5, None, "exacto", 1, 1, 1, 1)]
    out = panels.page_prices(Star(lambda name: spark.createDataFrame(rows, schema)))
    assert sorted((r.id, r.repetido, r.es_catalogo) for r in out.collect()) == [
        ("a", True, True), ("b", True, True), ("c", False, True), ("d", False, True)]
    assert len(re.findall(r"Join ", out._jdf.queryExecution().optimizedPlan().toString())) == 1
