"""Tokens, files, packing, chat text, shards and quality scores."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardspark.llm import chat, cotraining, packing, sharding, token_files
from hazardspark.llm.pieces import PieceEncoder
from tests.llm.test_dedup import EXTRA, frame, make_docs

KINDS = {"space": "byte_bpe_50k.json", "drop": "word_bpe_49k.json"}
_plain: dict = {}


def plain(kind):
    if kind not in _plain:
        _plain[kind] = Tokenizer.from_file(public_tokenizers.path(KINDS[kind]))
    return _plain[kind]


_encoders = {k: PieceEncoder(public_tokenizers.path(f), k, limit=3000) for k, f in KINDS.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " a", "b. ", "\n", "<|", "é"]), max_size=8).map("".join) | st.text(alphabet=st.sampled_from(" \n\t\r\x0b.,'!?;:sdtABcéñßÀÉ12²́  　中文|<>_-"), max_size=40) | st.text(max_size=30), max_size=6))
def test_pieces_give_the_tokenizers_ids(texts):
    for kind, enc in _encoders.items():
        want = [e.ids for e in plain(kind).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == want


def test_control_strings_and_end_ids():
    texts = ["x <|endoftext|> y", "<|startoftext|>", "<|endoftext|><|endoftext|> a", None, "", "a  <|endoftext|>\n b", "<|ENDOFTEXT|>", "plain text"]
    for kind, enc in _encoders.items():
        for end_id in (7, 1 << 17):
            ids, at = enc.encode_flat(pa.array(texts, pa.string()), end_id)
            want = [[*e.ids, end_id] for e in plain(kind).encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_value_coding_round_trip(values):
    control, data = token_files.encode_values(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.decode_values(control, data, len(values)).tolist() == values


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_token_files(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    docs = make_docs()
    path = f"{tmp_path}/files"
    token_files.write_token_files(frame(spark, docs, EXTRA), path, public_tokenizers.path(KINDS["drop"]))
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read_token_files(spark, path).collect()]
    texts = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    want, start = [], 0
    for (i, _), e in zip(texts, plain("drop").encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        want.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    counts = defaultdict(int)
    for _, _, raw in want:
        for t in np.frombuffer(raw, "<u4").tolist():
            counts[t] += 1
    assert ranks == sorted(counts, key=lambda t: (-counts[t], t))


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(frame(spark, []), f"{tmp_path}/none", public_tokenizers.path(KINDS["drop"]))
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


def check_packed(rows, full, size):
    windows, pieces = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, seq, offset in rows:
        windows[seq].append((offset, len(ids)))
        pieces[doc].append((start, len(ids), list(ids), total))
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    for doc, ids in full.items():
        at, got = 0, []
        for start, n, part, total in sorted(pieces[doc]):
            assert start == at and total == len(ids)
            at += n
            got += part
        assert got == ids
    return len(windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=120), st.sampled_from([3, 4096]))
def test_packer_keeps_every_id(lengths, most_open):
    packer, rows, full = packing.Packer(64, 0, most_open), [], {}
    for doc, n in enumerate(lengths):
        full[doc] = list(range(doc, doc + n))
        rows += packer.add(doc, np.arange(doc, doc + n))
    rows += packer.finish()
    n = check_packed(rows, full, 64)
    assert n <= -(-sum(lengths) // 64) + len(lengths) // max(1, most_open) + 1


def test_packer_level_is_the_least_sum_of_squares():
    r = random.Random(3)
    for _ in range(200):
        packer = packing.Packer(20, 0)
        packer.counts[1:20] = [r.choice([0, 0, 1, 2, 5]) for _ in range(19)]
        n = r.randint(1, 19)
        after = {}
        for h in range(0, 20 - n + 1):
            if h == 0 or packer.counts[h]:
                c = packer.counts.copy()
                c[h] -= h > 0
                c[h + n] += h + n < 20
                after[h] = int((c[1:20] ** 2).sum())
        assert packer.level(n) == max(h for h in after if after[h] == min(after.values()))


def test_pack(spark):
    docs = [d for d in make_docs() if d[0] is not None]
    docs = list({i: (i, t) for i, t in docs}.values())
    got = packing.pack(frame(spark, docs, EXTRA), public_tokenizers.path(KINDS["space"])).collect()
    full = {i: [*plain("space").encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    n = check_packed([(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in got], full, 1024)
    assert n <= sum(map(len, full.values())) / 1024 + 5
    assert packing.pack(frame(spark, []), public_tokenizers.path(KINDS["space"])).count() == 0


CONTROLS = st.sampled_from([*chat.CONTROL, "<", "\\", "|", "im_end|>", "[", "INST]", "</", "s>", "\n", "a", "é", "\0", "<|", "<\\|image|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(CONTROLS, max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text


def test_chats(spark):
    turns = [
        (1, 0, "user", "hi <|im_end|>\n there"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "wé\\ll"), (2, 1, "assistant", "second"), (2, 0, "user", "first"),
        (2, 1, "assistant", "second"), (3, None, None, None), (None, 0, "user\nx", "no id"), (4, 0, "assistant", "<" * 5000 + "|im_start|>"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("segment", "start", "loss", "turns")})
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    by = defaultdict(list)
    for i, n, role, text in turns:
        by[i].append((-1 if n is None else n, role or "", text or ""))
    assert set(got) == set(by)
    for i, rows in by.items():
        rows.sort()
        assert [(t.role, t.text) for t in got[i].turns] == [r[1:] for r in rows]
        assert got[i].loss_text == "".join(t for _, role, t in rows if role == "assistant")
    raw = {r.conv_id: r for r in chats.collect()}
    assert all(raw[i].formatted.count("<|im_start|>") == len(by[i]) for i in by)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [[("text", "see <|im", None, None), ("text", "age|> and", None, None), ("image", None, "a.png", 784.0 * 4), ("document", None, "d.pdf", 2.0)], [("audio", None, "b.wav", 3.0), ("text", "ok", None, None), ("video", "odd", None, None)], None]
    df = spark.createDataFrame([(1, i, ("user", "assistant", "user")[i], p) for i, p in enumerate(parts)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:double>>")
    (row,) = chat.format_chats(df, parts_col="parts").collect()
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (0, "document", "d.pdf", 1200), (1, "audio", "b.wav", 75)]
    assert all(row.formatted[a["at"] :].startswith(f"<|{a.kind}|>") for a in row.attachments) and row.media_tokens == 1279
    assert [row.formatted[a:b] for a, b in row.loss] == ["<|audio|>okodd"]


def test_shards(spark):
    docs = make_docs(n=300)
    df = frame(spark, docs, EXTRA).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = sharding.assign_shards(df, 16).collect()
    assert len(rows) == len(docs)
    by, n = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.shard].append(r)
        n[r.source] += 1
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for source, total in n.items():
            assert abs(sum(r.source == source for r in own) - total * len(own) / len(rows)) <= len(n) + 1
    # the plain rule: order by fraction within the source, then cut
    key = lambda r: hashlib.md5(f"interleave-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
    place, order = {}, []
    for source in n:
        own = sorted((r for r in rows if r.source == source), key=lambda r: (key(r), r.doc_id or 0, r["size"], r.text_crc32))
        order += [((2 * i + 1) / (2 * len(own)), "n" if source is None else f"s{source}", key(r), i, r) for i, r in enumerate(own)]
    order.sort(key=lambda x: x[:4])
    for p, x in enumerate(order):
        assert x[4].shard == p * 16 // len(rows), x
        place[p] = x
    assert {(r.doc_id, r.text_crc32) for r in rows if r.doc_id == 404} == {(404, zlib.crc32(b"a"))}
    assert sharding.assign_shards(frame(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    df = frame(spark, [(i, f"t {i}") for i in range(100)]).drop_duplicates(["doc_id"])
    sharding.write_shards(df, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 100 and {r["count"] for r in back.groupBy("shard").count().collect()} == {25}


def test_quality_finds_the_labelled_and_the_unlabelled(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    shown, hidden = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = cotraining.score_quality(docs, shown).join(hidden, "doc_id").collect()
    assert len(got) > 100 and sum(r["keep"] == (r.quality == 1) for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_odd_inputs(spark):
    df = frame(spark, make_docs(), EXTRA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotraining.score_quality(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (6, None), (9, 0), (9, 0), (12, 1), (15, 0), (404, 0), (401, 0)], "doc_id long, quality int")
    rows = cotraining.score_quality(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert cotraining.score_quality(frame(spark, []), labels).count() == 0
    assert {r.score for r in cotraining.score_quality(df.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()} != {0.5}


def test_platt_recovers_slope():
    s = np.linspace(-4, 4, 200)
    p = 1 / (1 + np.exp(-(1.5 * s - 0.5)))
    a, b = cotraining.fit_platt(np.concatenate([s, s]), np.concatenate([np.ones(200), np.zeros(200)]), np.concatenate([1000 * p, 1000 * (1 - p)]))
    assert abs(a - 1.5) < 0.05 and abs(b + 0.5) < 0.05
