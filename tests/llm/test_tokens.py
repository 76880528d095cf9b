"""Token files and packing against the tokenizer itself and a plain best fit."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from octavilla.llm import packing, token_files, tokens
from octavilla.llm.common import shared_folder

FILES = {"byte_bpe_50k.json": 2, "word_bpe_49k.json": 1}


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, FILES[name]]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most", [20, 800_000])
def test_ids_are_those_of_the_tokenizer(name, most, texts, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", most)
    rnd, signs = random.Random(1), "ab Ab'sÉé \n\t  1²½٣.,!İſ文字́ \x0b\x1c\xa0\x85µª<|endoftext|>ǅßx"
    sample = ["".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(800)]
    sample += [t or "" for t in texts] + ["<|endoftext|>", "a<|endoftext|> b", "a <|STARTOFTEXT|>b <|EndOfText|>", "<|endoftext|", "y" * 5000 + " b"]
    signs = "'stmdrevl \t\nxÉ1,"
    sample += ["".join(rnd.choices(signs, k=rnd.randint(0, 12))) for _ in range(3000)]
    rnd.shuffle(sample)
    own, expected = tokens.Encoder(public_tokenizers.path(name), FILES[name]), plain(name)
    for portion in tokens.in_portions(sample, 3000):
        ids, offsets = own.encode(portion)
        for text, a, b in zip(portion, offsets, offsets[1:]):
            assert ids[a:b].tolist() == expected(text), text
    assert [len(x) for x in own.encode([])] == [0, 1]


def test_token_files(spark, docs, none):
    path = shared_folder(spark, "t")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, row_group=4096, page=1024)
    expected, start = [], 0
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for doc_id, text in rows:
        ids = np.array(plain("byte_bpe_50k.json")(text), "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    meta = token_files.token_metadata(spark, path).filter("doc_id = 9")
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in meta.select("doc_id", "start", "n_tokens").collect()] == [r[:3] for r in expected if r[0] == 9]
    some = token_files.read_tokens(spark, path, 3, 4).orderBy("doc_id").collect()
    assert [list(r.tokens) for r in some] == [plain("byte_bpe_50k.json")(t) for i, t in rows if i in (3, 4)]
    local = path.removeprefix("file://")
    dataset = pq.ParquetDataset(local)
    encodings, groups = {}, 0
    for f in dataset.fragments:
        m = pq.ParquetFile(f.path).metadata
        groups = max(groups, m.num_row_groups)
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                col = m.row_group(g).column(c)
                encodings.setdefault(col.path_in_schema.split(".")[0], set()).update(col.encodings)
                assert col.has_offset_index and col.has_column_index
    assert "RLE_DICTIONARY" in encodings["tokens"] and "DELTA_BINARY_PACKED" in encodings["doc_id"]
    empty = shared_folder(spark, "t")
    token_files.write_token_files(none, empty, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.token_digests(spark, empty).count() == 0


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect_left(gaps, length)
        if k < len(gaps):
            gap = gaps.pop(k)
        else:
            gap, n = capacity, n + 1
        if gap > length:
            insort(gaps, gap - length)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_are_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 20, 97])
    lengths = [min(rnd.choice([rnd.randint(1, capacity), 1, capacity, capacity // 2]), capacity) for _ in range(rnd.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.supersteps(counts, capacity)
    held, ranks = {}, {}
    for r in plan.itertuples():
        ranks.setdefault(r.length, []).extend(range(r.rank, r.rank + r.rows))
        for k in range(r.rows):
            held.setdefault(r.sequence + k, []).append((r.offset, r.length))
    assert all(sorted(v) == list(range(counts[n])) for n, v in ranks.items()) and set(ranks) == set(counts)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == best_fit(lengths, capacity)


def test_packing_documents(spark, docs, none, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 10)  # a length is ranked by many tasks
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 64)
    rows = out.collect()
    expected = []
    for r in docs.collect():
        ids = np.array(plain("word_bpe_49k.json")(r.text), "<u4")
        expected += [(r.doc_id, k, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r[:5])) for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    assert len(held) == best_fit([r[3] for r in expected], 64)
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json"), 1, 64).count() == 0
