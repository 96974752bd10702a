"""The pipeline's near-copy stage on planted copies of known five-word similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazardspark.llm import near_copies
from tests.llm import brute
from tests.llm.test_dedup import EXTRA, frame, make_docs


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_planted_copies_of_similarity_08_to_097_go(spark):
    draw = random.Random(5)
    texts, copies, apart = [], set(), set()
    for k in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        changed = list(words)
        for at in draw.sample(range(10, 290), (1, 3, 6, 20)[k % 4]):
            changed[at] = f"x{k}"
        a, b = " ".join(words), " ".join(changed)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        texts += [(2 * k, a), (2 * k + 1, b)]
        (copies if j >= 0.8 else apart).add(2 * k + 1)
    assert len(copies) >= 40 and len(apart) >= 10
    docs = spark.createDataFrame([*texts, (500, "A short one"), (501, "a  SHORT one"), (None, None)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {None, 500, *range(0, 120, 2), *apart}


def edits(draw, words, n, tag):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"{tag}{at}"
    return " ".join(words)


@pytest.mark.parametrize(("window", "unit"), [(32, 2048), (2, 8)])
def test_large_groups_of_edits_of_edits_lose_no_link(spark, monkeypatch, window, unit):
    """Two bases with 120 copies each, of similarities from 0.5 to 1, among other texts; small windows and units make the probes hot."""
    monkeypatch.setattr(near_copies, "_WINDOW", window)
    monkeypatch.setattr(near_copies, "_UNIT", unit)
    draw = random.Random(9)
    docs = []
    for base in range(2):
        words = [f"b{base}w{draw.randrange(3000)}" for _ in range(160)]
        for k in range(120):
            docs.append((1000 * base + k, edits(draw, words, k % 12, f"e{k}x")))
    docs += [(3000 + k, " ".join(f"w{draw.randrange(4000)}" for _ in range(draw.randint(1, 200)))) for k in range(150)]
    want = brute.similar_groups(docs)
    got = {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i for i, least in want.items() if i == least}


def test_unlinked_texts_of_one_template_make_no_rows_of_pairs(spark, monkeypatch):
    """500 texts of one template with a passage of their own: all pairs have similarity 0.77 and meet in many probes. They go on as arrays
    in few blocks, nothing is linked, and the few pairs at 0.8 planted among them are."""
    made, apart = [], near_copies._met_apart
    monkeypatch.setattr(near_copies, "_met_apart", lambda *a: made.append(apart(*a)) or made[0])
    draw = random.Random(4)
    base = [f"t{draw.randrange(3000)}" for _ in range(200)]
    own = lambda k: [*base[:20], *(f"own{k}x{i}" for i in range(22)), *base[42:]]
    docs = [(k, " ".join(own(k))) for k in range(500)]
    docs += [(1000 + k, " ".join([*own(k)[:190], *(f"end{k}x{i}" for i in range(10))])) for k in range(20)]
    kept = {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(range(500))
    rows = made[0].selectExpr("count(*) n", "sum(size(a)) pairs", "count(distinct lo, hi) blocks").first()
    assert rows.pairs > 10_000 and rows.n < rows.pairs / 5 and rows.blocks < 300


def test_odd_rows(spark):
    docs = make_docs()
    df = frame(spark, docs, [*EXTRA, "__near_node", "__NEAR_ID", "part", "value", "node", "n"])
    out = near_copies.drop_near_copies(df)
    assert out.columns == df.columns
    some = list({i: (i, t) for i, t in docs if i is not None}.values())
    want = brute.similar_groups(some)
    kept = {r.doc_id for r in near_copies.drop_near_copies(frame(spark, some)).collect()}
    assert kept == {i for i, least in want.items() if i == least}
    rows = out.collect()
    assert {r.part for r in rows} == {"clash"} and sum(r.doc_id == docs[3][0] for r in rows) in (0, 3)
    assert near_copies.drop_near_copies(frame(spark, [])).count() == 0
    assert near_copies.drop_near_copies(df.filter(F.col("text").isNull())).count() == 2


def test_wide_fingerprints_are_majorities():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in (1, 0, 2, 254, 255, 256, 700, 3)]
    got = near_copies.wide_fingerprints(sets, 3)
    factors = np.random.default_rng(42).integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)
    for x, row in zip(sets, got):
        for k, factor in enumerate(factors):
            mixed = x * factor
            mixed ^= mixed >> np.uint64(32)
            assert int(row[k]) == sum(1 << b for b in range(64) if 2 * int(((mixed >> np.uint64(b)) & np.uint64(1)).sum()) > len(x))


def test_plan_meets_the_asked_recall():
    for n in (10, 10**5, 10**7, 10**9):
        plan = near_copies.make_plan(n, 0.8, 0.02)
        differ = 0.1515
        assert plan.words * (64 // plan.width) >= plan.needed
        assert (1 - (1 - differ) ** plan.width) ** plan.needed <= 0.0201
        assert n / 2**plan.width <= 4


@pytest.mark.parametrize("as_of", [None, 4_000_000])
def test_planted_recall_of_met_pairs(spark, monkeypatch, as_of):
    """Of 400 pairs with similarities from 0.8 to 0.97, at least 97 in 100 are linked, also by the wider parts of a large table."""
    if as_of:
        plan = near_copies.make_plan
        monkeypatch.setattr(near_copies, "make_plan", lambda n, s, m: plan(as_of, s, m))
    draw = random.Random(3)
    docs, pairs = [], 0
    for k in range(400):
        words = [f"w{draw.randrange(20000)}" for _ in range(300)]
        a, b = " ".join(words), edits(draw, words, (1, 3, 5, 6)[k % 4], f"y{k}x")
        x, y = brute.word_runs(a), brute.word_runs(b)
        pairs += len(x & y) >= 0.8 * len(x | y)
        docs += [(2 * k, a), (2 * k + 1, b)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert pairs >= 380 and 800 - kept >= 0.97 * pairs and 800 - kept <= pairs


def test_texts_of_shared_probes_are_named_where_they_meet(spark, monkeypatch):
    """Probes are dealt out once: every text of a probe that more than _WINDOW texts share comes from that pass, over batches of any size."""
    by_rows = near_copies._by_rows
    monkeypatch.setattr(near_copies, "_WINDOW", 4)
    draw = np.random.default_rng(2)
    sizes = {1: 1, 2: 4, 3: 5, 4: 6, 5: 40, 6: 3}
    rows = [(part, 7, 100 * part + k, 10, *map(int, draw.integers(-(1 << 63), 1 << 63, 2))) for part, n in sizes.items() for k in range(n)]
    probes = spark.createDataFrame(rows, "part int, value long, node long, n int, f1 long, f2 long")
    plan = near_copies.make_plan(100, 0.8, 0.02)
    for batch in (1, 3, 1 << 16):
        monkeypatch.setattr(near_copies, "_by_rows", lambda it, batch=batch: (x.slice(k, batch) for x in by_rows(it) for k in range(0, x.num_rows, batch)))
        got = near_copies._met(probes, plan, 0.8).collect()
        assert {(r.part, r.value, r.a) for r in got if r.kind == 1} >= {(r[0], 7, r[2]) for r in rows if sizes[r[0]] > 4}
        assert not {r.part for r in got} & {1, 2, 6} and len(got) == len({tuple(r) for r in got})


def test_few_texts_are_fetched_without_dealing_out_all(spark, monkeypatch):
    """Shingle sets of a few more texts: their ids go to the texts, so no exchange stands below the join."""
    plans, write = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rows = spark.createDataFrame([(k % 40, f"text number {k % 40} with a few words") for k in range(80)], "node long, text string")
    nodes = spark.createDataFrame([(3,), (5,), (99,)], "node long")
    for few in (True, False):
        got = {r.node: bytes(r.grams) for r in near_copies._shingle_sets(nodes, rows, 5, few).collect()}
        assert got == {k: near_copies.shingle_set(f"text number {k} with a few words", 5).tobytes() for k in (3, 5)}
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
