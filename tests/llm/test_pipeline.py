"""The stages by themselves, and the pipeline against its stages one after the other."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from octavilla.llm import queries
from octavilla.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        frames.append(out)
        sizes.append(out.count())
    start, good, unique, cleaned, mixed = [{(r.doc_id, r.text) for r in f.collect()} for f in frames]
    assert good < start and unique < good
    assert {i for i, _ in cleaned} == {i for i, _ in unique} and mixed == cleaned and sizes[4] >= sizes[3]
    ratings = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {i for i, _ in good}
    assert all((i in kept) == (q == 1) for i, q in ratings.items() if any(i == d for d, _ in start))

    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, frames[-1], sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in frames[-1].collect())
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= tokens / 4096 * 1.02 + 1
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeated_passages", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(queries.QUERIES) >= {"pipeline"} and sum(n.startswith("op") for n in queries.QUERIES) == 13


def test_stages_take_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
