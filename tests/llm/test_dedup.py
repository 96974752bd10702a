"""Exact, near and line deduplication, decontamination and language id against plain versions, with odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import crossparse, decontam, exact_dedup, line_dedup, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["digest", "salt", "kept", "members", "h", "pos", "rid", "fp", "key", "mask", "n_lines", "n_words", "matches", "lang_pred", "component", "__rid", "__id", "__gone", "__lines", "__keep_id", "__keep_digest"]


def make_docs(seed=1, n=60):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgé" for b in ("a", "ou", "ing", "éra")]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
    shared = [line() + " shared line here" for _ in range(4)]
    docs = []
    for i in range(n):
        lines = [r.choice(shared) if r.random() < 0.2 else line() for _ in range(r.randint(1, 8))]
        docs.append((i * 3 % 101, "\n".join(lines)))
    docs += [(200 + k, docs[k % 5][1].replace(" ", "  \t")) for k in range(12)]  # copies but for white space
    docs += [(300 + k, docs[7][1] + f" tail{k}") for k in range(4)]
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, None), (404, "a"), (405, "A B"), (406, "...")]
    docs += [(410, "x <|endoftext|> y"), (411, "<|startoftext|>"), (412, "<|endoftext|>\n<|endoftext|> z")]
    docs += [(407, "x y z " * 40_000), (408, "one line\n" * 3000 + "LAST Line of it"), (409, "  last line of it\r\n")]
    docs += [docs[3], docs[3], (None, "no id at all"), (None, "no id at all"), (None, docs[0][1])]
    return docs


def frame(spark, docs, extra=()):
    rows = [(i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def docs():
    return make_docs()


def test_exact_groups(spark, docs):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup.exact_groups(frame(spark, docs, EXTRA)).collect()]
    assert sorted(got, key=str) == brute.exact(docs)


def test_exact_groups_with_salted_hot_group(spark):
    docs = [(i, "the same text") for i in range(500)] + [(1000 + i, f"text {i % 40}") for i in range(200)]
    got = exact_dedup.exact_groups(frame(spark, docs), least_hot=8).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=str) == brute.exact(docs)


def test_exact_rows_that_stay(spark, docs):
    left = exact_dedup.drop_exact_copies(frame(spark, docs, EXTRA))
    assert left.columns == frame(spark, docs, EXTRA).columns
    assert sorted((str(r.doc_id) for r in left.collect())) == sorted(str(x[0]) for x in brute.exact(docs) if x[3])


def test_line_dedup(spark, docs):
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        out = line_dedup.dedup_lines(frame(spark, docs, EXTRA), batches=batches, fanout=fanout)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute.line_dedup(docs)
    assert set(out.columns) == set(frame(spark, docs, EXTRA).columns) | {"n_dropped"}


def test_fingerprints_and_groups(spark, docs):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(frame(spark, docs, EXTRA)).collect()]
    assert sorted(got, key=str) == brute.simhash_groups(docs)


@pytest.mark.parametrize("most", [4, 2048])
def test_fingerprint_links_lose_none(spark, most):
    """Dense clusters of fingerprints, so that with small groups the narrower probes are used."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 3))))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(e.a % (1 << 64), e.b % (1 << 64)) for e in simhash.fingerprint_edges(df, 2, most).collect()]
    want = brute.components(list(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    pairs = set(edges) | {(b, a) for a, b in edges}
    assert brute.components(list(fps), lambda a, b: (a, b) in pairs) == want


def test_thresholds_cover_every_pair():
    """Whatever the shares of ones, the allocated thresholds sum to radius - parts + 1 and cost least of all choices."""
    from itertools import product

    r = random.Random(2)
    for m in (1, 2, 3):
        costs = [[0.0] + sorted(r.random() * 100 for _ in range(3)) for _ in range(m)]
        cost, ts = simhash.allocate(costs, 2 - m + 1)
        best = min(sum(costs[i][t + 1] for i, t in enumerate(c)) for c in product(range(-1, 3), repeat=m) if sum(c) == 2 - m + 1)
        assert sum(ts) == 2 - m + 1 and abs(cost - best) < 1e-9


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 32:] = bits[:, :32] ^ (rng.random((4000, 32)) < 0.02)
    parts = simhash.correlated_parts(4000, (bits.T @ bits).astype(float), 2)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert sum((b + 32) % 64 in p for p in parts for b in p) >= 60


BENCH = [(0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (1, "short item é"), (2, None), (3, ""), (None, "no id for these words at all but ten or more words in it"), (1, "short item é"), (4, "--- !!"), (5, "b b b b b b b b b b b b")]


def bench_docs():
    full = BENCH[0][1]
    words = full.split()
    return [
        (0, f"x y {full.upper()} z"), (1, " ".join(words[1:11]) + " q " + " ".join(words[2:12])), (2, " ".join(words[:9])), (3, "a SHORT, item-É? no: é vs É"), (4, "a Short, item é!"), (5, None), (6, ""), (7, "b " * 30),
        (8, "no id for these words at all but ten or more words in it"), (9, full + " " + full), (10, ("alpha " * 20_000) + full), (10, "short item é"), (None, "short item é"),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    docs = bench_docs()
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = decontam.find_matches(frame(spark, docs, EXTRA), bench, block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.hit, sorted({m.item_id for m in r.matches})) for r in out.withColumn("hit", decontam.n_hit(F.col("matches"))).collect()]
    assert sorted(got, key=str) == brute.contaminated(docs, BENCH)
    clean = decontam.drop_contaminated(frame(spark, docs, EXTRA), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in brute.contaminated(docs, BENCH) if not x[2])
    assert {r.n_words for r in clean.collect()} == {"clash"}


def test_longest_matches(spark):
    words = BENCH[0][1].lower().split()
    text = "q " + " ".join(words[1:13]) + " r " + " ".join(words[0:10])
    (found,) = decontam.find_matches(frame(spark, [(1, text)]), spark.createDataFrame(BENCH[:1], "item_id long, text string")).collect()
    assert sorted((m.item_word, m.doc_word, m.words) for m in found.matches) == [(0, 14, 10), (1, 1, 12)]


def test_cross_parsing_counts_phrases(monkeypatch):
    """Whole texts, also where segments are cut inside phrases and where a periodic text never joins its segments' own parses."""
    samples = {"a": "the cat sat on the mat and the dog ran", "b": "le chat est sur la table é", "c": "zzzz", "d": "abcabcabcabcabcabcabc"}
    parser = crossparse.CrossParser(samples)
    texts = ["the cat ran", "le chat", "", "q", "qqq the", "the mat est sur zz " * 700, "é", "abc" * 50, "z" * 99]
    for segment in (4096, 64, 7):
        monkeypatch.setattr(crossparse, "_SEGMENT", segment)
        got = parser.phrases(texts)
        for i, t in enumerate(texts):
            for j, lang in enumerate(parser.langs):
                assert got[i, j] == brute.phrases(t, samples[lang]), (segment, t[:20], lang)


def test_cross_parsing_with_a_large_alphabet():
    """Memory follows the sample, not states times letters; a text of 20,000 words is parsed whole."""
    r = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 15_000)]
    samples = {"zh": "".join(r.choices(letters, k=30_000)), "xx": "".join(r.choices("abcdefg hij", k=30_000))}
    parser = crossparse.CrossParser(samples)
    assert sum(a.cells.nbytes + a.start.nbytes for a in parser.automata) < 8 << 20
    text = " ".join("".join(r.choices(letters[:500] + list("abcdefghij") * 40, k=4)) for _ in range(20_000))
    assert parser.phrases([text]).tolist() == [[brute.phrases(text, samples[lang]) for lang in parser.langs]]


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = crossparse.identify(docs, crossparse.sample_texts(docs)).filter(crossparse.held_out()).select("lang", "lang_pred", "lang_score").collect()
    assert len(found) > 300 and sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.98
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_language_id_odd_inputs(spark, docs):
    df = frame(spark, docs, EXTRA)
    out = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in crossparse.identify(df, crossparse.sample_texts(df)).collect()}
    assert all((p == "und" and s == 0) == (t is None or not any(map(str.isalpha, t))) for (_, t), (p, s) in out.items())
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in crossparse.identify(none, crossparse.sample_texts(none)).collect()} == {"und"}


def test_empty_tables(spark):
    df = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0
    assert line_dedup.dedup_lines(df).count() == 0
    assert simhash.near_groups(df).count() == 0
    assert decontam.find_matches(df, bench).count() == 0
    assert crossparse.identify(df, crossparse.sample_texts(df)).count() == 0
    one = frame(spark, [(1, "a b")])
    assert decontam.find_matches(one, bench).collect()[0].n_words == 2


def test_rows_that_stay_are_dealt_out_once(spark, docs):
    """Nothing is exchanged above the join that finds them, repeated rows and null ids included."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        left = exact_dedup.drop_exact_copies(frame(spark, docs))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("SortMergeJoin")[0]
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x[0]) for x in brute.exact(docs) if x[3])
    finally:
        spark.conf.set(name, before)
