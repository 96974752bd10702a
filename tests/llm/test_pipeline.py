"""The corpus pipeline against plain versions of its stages, over the smallest tables and odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import frame, make_docs


def expected(docs, bench):
    """Ids that reach the packing stage. docs: (id, text)."""
    kept = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    texts = dict(kept)
    kept = [(r[0], texts[r[0]]) for r in brute.exact(kept) if r[3]]
    kept = [(i, texts[i]) for i, least in brute.similar_groups(kept).items() if i == least]
    return {r[0] for r in brute.contaminated(kept, bench) if not r[2]}


def check(rows, docs, ids):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == ids
    texts = dict(docs)
    for i, own in pieces.items():
        full = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(full)
            assert r.ids_crc32 == zlib.crc32(np.array(full[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(full)
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_and_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check(corpus_pipeline.run(spark, sf_dir).collect(), docs, expected(docs, bench))


def test_odd_documents(spark, tmp_path):
    docs = list({i: (i, t) for i, t in make_docs() if i is not None}.values())
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, docs[9][1]), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check(corpus_pipeline.run(spark, str(tmp_path)).collect(), docs, expected(docs, bench))


def test_own_columns_survive(spark):
    docs = frame(spark, [*((i, f"some words in text {i} and no other") for i in range(1, 12)), (20, "12 34")], ["lang_pred", "LANG_SCORE", "__keep_id", "__near_node", "n_words", "matches"])
    for stage in (corpus_pipeline.known_language, corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r["lang_pred"] for r in out.collect()} == {"clash"} and {r["__keep_id"] for r in out.collect()} == {"clash"}
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()} == set(range(1, 12))
