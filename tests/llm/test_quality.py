"""The two-round exchange of pseudo-labels against a plain version, row by row."""

import zlib

import numpy as np

from hazardspark.llm import cotraining


def fit(x, label):
    """Ridge by least squares on weighted rows, both classes at equal weight."""
    rows, want = [np.sqrt(1e-3) * np.eye(x.shape[1])], [np.zeros(x.shape[1])]
    for k in (0, 1):
        w = np.sqrt(1 / (2 * (label == k).sum()))
        rows.append(w * x[label == k])
        want.append(np.full((label == k).sum(), w * (1 if k else -1)))
    return np.linalg.lstsq(np.concatenate(rows), np.concatenate(want), rcond=None)[0]


def middles(scores):
    return (np.floor(np.clip(scores, -50, 50) / 0.05) + 0.5) * 0.05


def calibrate(scores, y):
    """Slope and offset by small steps up the penalised likelihood."""
    a, b, step = 0.0, 0.0, 1.0
    s = middles(scores)
    value = lambda a, b: -np.logaddexp(0, np.where(y == 1, -1, 1) * (a * s + b)).sum() - 5e-4 * a * a
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(a * s + b)))
        ga, gb = ((y - p) * s).sum() - 1e-3 * a, (y - p).sum()
        while step > 1e-12 and value(a + step * ga, b + step * gb) < value(a, b):
            step /= 2
        a, b, step = a + step * ga, b + step * gb, step * 1.5
    return a, b


def sure(scores, a, b, share=0.2, confidence=0.9):
    """Pseudo-labels of unlabelled rows: whole ranges of scores from either end."""
    out, s = np.full(len(scores), -1), middles(scores)
    p = 1 / (1 + np.exp(-(a * s + b)))
    for k, order in ((0, sorted(set(s))), (1, sorted(set(s), reverse=True))):
        n = 0
        for v in order:
            n += (s == v).sum()
            if n > share * len(s) or (p[s == v][0] > 1 - confidence if k == 0 else p[s == v][0] < confidence):
                break
            out[s == v] = k
    return out


def test_exchange_against_rows(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()
    gold = {r.doc_id: r.quality for r in labels.collect()}
    x = [
        np.array([cotraining.text_features(r.text).astype(np.float16) for r in rows], np.float64),
        np.array([cotraining.page_features(r.lang, r.source, r.n_chars).astype(np.float16) for r in rows], np.float64),
    ]
    y = np.array([gold.get(r.doc_id, -1) for r in rows])
    fold0 = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    known, held, free = (y >= 0) & ~fold0, (y >= 0) & fold0, y < 0
    label = [np.where(known, y, -1), np.where(known, y, -1)]
    for _ in range(3):
        weights = [fit(x[v], label[v]) for v in (0, 1)]
        scores = [x[v] @ weights[v] for v in (0, 1)]
        lines = [calibrate(scores[v][held], y[held]) for v in (0, 1)]
        label = [np.where(known, y, -1), np.where(known, y, -1)]
        for v in (0, 1):
            label[v][free] = sure(scores[1 - v][free], *lines[1 - v])
    assert (label[0][free] >= 0).sum() > 20
    z = [a * s + b for s, (a, b) in zip(scores, lines)]
    base = np.log(((y[held] == 1).sum() + 1) / ((y[held] == 0).sum() + 1))
    want = 1 / (1 + np.exp(-(z[0] + z[1] - base)))
    got = {r.doc_id: r for r in cotraining.score_quality(docs, labels).collect()}
    off = np.array([abs(got[r.doc_id].score - p) for r, p in zip(rows, want)])
    assert len(got) == len(rows) and (off < 0.02).mean() > 0.99 and np.mean([got[r.doc_id].keep == (p >= 0.5) for r, p in zip(rows, want)]) > 0.995


def labelled(spark, n, positive):
    """300 documents with texts by class, of which n have a label; `positive` says which of those are good."""
    text = lambda k: ("good clean prose of a careful writer " if k % 2 else "BUY now!!! $$$ click click ") * (3 + k % 5) + str(k)
    docs = spark.createDataFrame([(k, text(k), "en", f"s{k % 7}", 100) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, [(k, int(k % 2)) for k in range(300) if positive(k)][:n]


def in_fold0(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_few_labels_and_none_in_the_first_fold(spark):
    for n, pick in ((1, lambda k: True), (2, lambda k: True), (3, lambda k: not in_fold0(k)), (8, lambda k: True), (30, lambda k: not in_fold0(k)), (30, lambda k: in_fold0(k) and k % 2 == 0 or not in_fold0(k) and k % 2), (30, in_fold0)):
        docs, labels = labelled(spark, n, pick)
        got = cotraining.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 300
        if len({y for _, y in labels}) == 2:
            assert len(labels) < 30 or np.mean([r.keep == (r.doc_id % 2 == 1) for r in got]) > 0.9, (n, labels)
            assert len({round(r.score, 3) for r in got}) > 1, (n, labels)
        else:
            ones = sum(y for _, y in labels)
            assert all(abs(r.score - (ones + 1) / (len(labels) + 2)) < 1e-9 for r in got)


def test_no_documents_and_no_labels(spark):
    docs, _ = labelled(spark, 0, lambda k: True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.keep) for r in cotraining.score_quality(docs, none).collect()} == {(0.5, True)}
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert cotraining.score_quality(docs.limit(0), some).count() == 0
