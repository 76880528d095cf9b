import re

from octavilla.plans import evaluation


def test_parts_of_words_are_never_broadcast(spark, tmp_path):
    # small on disk, so that the optimizer would broadcast what is cut from it
    spark.createDataFrame([(1, 1, "leche entera"), (1, 2, "pan")], "p long, i long, texto string").write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    out = evaluation.recall_in_corpus(texts, "texto", texts.filter("i = 1"), ["p"], ["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin [^\n]*LeftSemi", plan)
    assert sorted((r.i, r.cobertura) for r in out.collect()) == [(1, 1.0), (2, 0.0)]
