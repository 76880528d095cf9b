"""Registers read in pieces, folders of documents, and every read or written shape against SQL."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import compare, document_checks
from octavilla.operators.cut import shared_folder
from octavilla.sources import documents

SF = "/root/testdata/sf0.001"
FIELDS = ("titulo", "fecha_inicio", "fecha_fin", "procesado_at", "url_folleto")


@pytest.mark.parametrize("name", sorted(document_checks.QUERIES))
def test_query_equals_sql(spark, name):
    ok, message, _ = compare.compare(spark, compare.duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def _register(n):
    odd = ['a "}" b', "x },\n  }", "{", "  }", "\\", "ñ\u2028", ""]
    return {f"tiendeo:{k}": {"titulo": odd[k % len(odd)], "fecha_inicio": "2026-01-05", "url_folleto": None, "extra": {"a": [1, {}]}}
            for k in range(n)}


@pytest.mark.parametrize("indent, told", [(None, 2), (None, None), (1, 1), (1, None), (2, 2), (2, None), (4, 4), (4, 2), (4, None)])
def test_register_forms(spark, tmp_path, indent, told):
    wanted = _register(50) | {"ofertomat:vacio": {}, "ofertomat:fin": {}}
    (tmp_path / "r.json").write_text(json.dumps(wanted, indent=indent, ensure_ascii=False))
    rows = documents.flyer_register(spark, str(tmp_path / "r.json"), told).collect()
    assert {f"{r['fuente']}:{r['folleto_id']}": r["titulo"] for r in rows} == {k: v.get("titulo") for k, v in wanted.items()}
    assert len(rows) == len(wanted)


@pytest.mark.parametrize("text", ["", "{}", "{\n}", "no json"])
def test_register_without_entries(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert documents.flyer_register(spark, str(tmp_path / "r.json")).count() == 0


@pytest.mark.parametrize("size", [997, 4096, 20011])
def test_register_read_by_many_tasks(spark, tmp_path, size):
    """Whatever the place where a split begins, no entry is lost or read twice."""
    wanted = _register(2000)
    (tmp_path / "r.json").write_text(json.dumps(wanted, indent=2, ensure_ascii=False))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)
        rows = documents.flyer_register(spark, str(tmp_path / "r.json"))
        assert rows.rdd.getNumPartitions() > 5
        found = [(r["folleto_id"], r["titulo"]) for r in rows.select("folleto_id", "titulo").collect()]
    finally:
        for n, v in zip(names, old):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert sorted(found) == sorted((k.split(":")[1], v["titulo"]) for k, v in wanted.items())


def test_identity_from_folders(spark, tmp_path):
    for folder in ("tiendeo/alsuper/7", "fuente=tiendeo/tienda=alsuper/folleto_id=8"):
        d = tmp_path / folder
        d.mkdir(parents=True)
        (d / "ocr_resultado.json").write_text(json.dumps({"paginas": []}))
    # a source without a folder has no documents
    plain = documents.block_documents(spark, str(tmp_path)).first()
    keyed = documents.block_documents(spark, str(tmp_path), files="fuente={source}/*/*/*.json").first()
    assert [tuple(r[c] for c in ("fuente", "tienda", "folleto_id")) for r in (plain, keyed)] == [
        ("tiendeo", "alsuper", "7"), ("tiendeo", "alsuper", "8")]


def test_shared_folders_differ(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getCheckpointDir())


def test_written_documents_hold_whole_flyers(spark):
    docs = document_checks._block_documents(spark, SF)
    assert docs.filter("_corrupt IS NOT NULL OR size(paginas) <> total_paginas").count() == 0
    per = docs.groupBy("fuente", "tienda", "folleto_id").agg(F.count(F.lit(1)).alias("n"))
    assert per.filter("n <> 1").count() == 0


def test_classified_flyers_are_written_compressed_by_one_shuffle(spark):
    import glob

    from octavilla.sources import writers
    rows = [(f, t, str(p // 4), f"pagina_{p}.webp", b, "PRECIO" if b % 2 else "PRODUCTO", f"texto {p} {b}", 0.5, float(b), [], None, 1, 2, 3, 4)
            for p in range(20) for b in range(5) for f, t in (("tiendeo", "a"), ("ofertomat", None))]
    kinds = spark.createDataFrame(rows, "fuente string, tienda string, folleto_id string, pagina string, bloque int, tipo string, texto_norm string, "
                                  "confianza double, valor double, candidatos array<double>, categoria string, x int, y int, ancho int, alto int")
    path = shared_folder(spark, "written")
    writers.write_classified(kinds, path)
    files = glob.glob(f"{path.removeprefix('file:')}/*/*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.json(path)
    assert back.count() == 40
    found = back.selectExpr("folleto_id", "pagina", "inline(precios)").groupBy("pagina").agg({"texto": "count"}).collect()
    assert len(found) == 20 and all(n == 4 for _, n in found)
