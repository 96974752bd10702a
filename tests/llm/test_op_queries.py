"""The thin queries over the smallest tables: those with SQL against DuckDB, the others against plain versions."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from hazardspark.llm import queries as q
from tests.llm import brute
from tests.test_queries import rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def test_names():
    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, 14)) and set(q.oracle_sql()) <= set(q.queries())


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = q.queries()[name](spark, sf_dir)
    got = duck.execute(q.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(got.fetchall(), columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == want and want


def test_op1(spark, sf_dir, docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in q.op1_simhash(spark, sf_dir).collect()]
    assert sorted(got) == sorted((i, f"{f:016x}", c) for i, f, c in brute.simhash_groups([(r.doc_id, r.text) for r in docs]))


def test_op2(spark, sf_dir, docs):
    got = q.op2_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got) and len({r.keep for r in got}) == 2


def test_op3(spark, sf_dir, docs):
    langs = {r.doc_id: (r.lang, r.text) for r in docs}
    got = q.op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    plain = {i for i, (_, t) in langs.items() if not any(map(str.isalpha, t or ""))}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == plain
    held = [r.lang_pred == langs[r.doc_id][0] for r in got if r.held_out and langs[r.doc_id][0] and r.lang_pred != "und"]
    assert len(held) > 30 and np.mean(held) > 0.9


def ids_of(name, text, end):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    if name not in ids_of.__dict__:
        setattr(ids_of, name, Tokenizer.from_file(path(name)))
    return [*getattr(ids_of, name).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op7(spark, sf_dir, docs):
    want, start = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = ids_of("word_bpe_49k.json", r.text, 1)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in q.op7_token_files(spark, sf_dir).collect()) == sorted(want)


def test_op8(spark, sf_dir, docs):
    texts = {r.doc_id: ids_of("byte_bpe_50k.json", r.text, 0) for r in docs}
    pieces, fill = {}, {}
    for r in q.op8_packing(spark, sf_dir).collect():
        ids = texts[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in texts.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(ids)
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(fill) <= 1.05 * sum(map(len, texts.values())) / 1024 + 8


def test_op10(spark, sf_dir, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    got = q.op10_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    sources, shards = {r.doc_id: r.source for r in docs}, {}
    for r in got:
        shards.setdefault(sources[r.doc_id], Counter())[r.shard] += 1
    assert all(abs(c[s] - c.total() / 16) <= 2 for c in shards.values() for s in range(16))
