"""Quality scores by co-training a classifier of the text and one of the page's metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, text_batches, written

WORDS, LANGS, SOURCES = 128, 16, 64
#: Bytes whose shares are features: ASCII marks one by one, then upper case, lower case, digits, white space and all beyond ASCII.
_MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_CLASSES = [(65, 91), (97, 123), (48, 58), (9, 14), (32, 33), (128, 256)]
TEXT_WIDTH = 1 + WORDS + len(_MARKS) + len(_CLASSES) + 3
PAGE_WIDTH = 1 + LANGS + SOURCES + 12
_BIN = 0.05


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = zlib.crc32(word) % WORDS
        return found


_buckets = _Buckets()


def text_features(text: str | None) -> np.ndarray:
    """1, root shares of hashed words, root shares of marks and classes of bytes, and three measures of repetition and size."""
    raw = (text or "").encode()
    x = np.zeros(TEXT_WIDTH, dtype=np.float32)
    x[0] = 1
    if not raw:
        return x
    words = raw.lower().split()
    n = max(len(words), 1)
    x[1 : 1 + WORDS] = np.sqrt(np.bincount(list(map(_buckets.__getitem__, words)), minlength=WORDS) / n) if words else 0
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [*counts[_MARKS], *(counts[a:b].sum() for a, b in _CLASSES)]
    x[1 + WORDS : -3] = np.sqrt(np.array(shares) / len(raw))
    lines = raw.split(b"\n")
    x[-3:] = len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(n) / 10
    return x


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """1, hashed language and source, and the page's size as a number and in ranges."""
    x = np.zeros(PAGE_WIDTH, dtype=np.float32)
    x[0] = 1
    x[1 + zlib.crc32(b"" if lang is None else b"l" + lang.encode()) % LANGS] = 1
    x[1 + LANGS + zlib.crc32(b"" if source is None else b"s" + source.encode()) % SOURCES] = 1
    size = np.log1p(max(n_chars or 0, 0))
    x[1 + LANGS + SOURCES] = size / 10
    x[2 + LANGS + SOURCES + min(int(size), 10)] = 1
    return x


@dataclass
class View:
    """A linear score and its calibration: probability = 1 / (1 + exp(-(a s + b)))."""

    weights: np.ndarray
    a: float = 0.0
    b: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.scores(x) + self.b


def fit_linear(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], width: int, ridge: float = 1e-3) -> np.ndarray:
    """Ridge regression on labels -1 and +1 with both classes at equal weight, from n, the sum and the outer products of each class."""
    left, right = np.eye(width) * ridge, np.zeros(width)
    for y, (n, total, outer) in sums.items():
        left += outer / n / 2
        right += (1 if y else -1) * total / n / 2
    return np.linalg.solve(left, right)


def fit_platt(scores: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small penalty on the slope, on counted scores."""
    total = n.sum()
    p0 = ((n * labels).sum() + 1) / (total + 2)
    a, b = 0.0, float(np.log(p0 / (1 - p0)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(n * (labels - p) * scores).sum() - 1e-3 * a, (n * (labels - p)).sum()])
        h = np.array([[(w * scores**2).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def _matrices(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(b["text_x"].to_pylist()), np.float16).reshape(-1, TEXT_WIDTH).astype(np.float64)
    page = np.frombuffer(b"".join(b["page_x"].to_pylist()), np.float16).reshape(-1, PAGE_WIDTH).astype(np.float64)
    return text, page


def _features(docs: DataFrame, labels: DataFrame, cols: dict[str, str], folds: int) -> DataFrame:
    """(doc_id, text_x, page_x, y, fold): y is 0 or 1 or null; one fold of the labelled rows is for calibration."""
    c = {k: F.col(v) if v in docs.columns else F.lit(None) for k, v in cols.items()}
    rows = docs.select(
        c["id"].cast("long").alias("doc_id"), c["text"].cast("string").alias("text"), c["lang"].cast("string").alias("lang"), c["source"].cast("string").alias("source"), c["n_chars"].cast("long").alias("n_chars")
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it):
            text = pa.array([text_features(t).astype(np.float16).tobytes() for t in b["text"].to_pylist()], pa.binary())
            page = pa.array([page_features(*r).astype(np.float16).tobytes() for r in zip(*(b[k].to_pylist() for k in ("lang", "source", "n_chars")), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], text, page], ["doc_id", "text_x", "page_x"])

    gold = labels.groupBy(F.col(cols["id"]).cast("long").alias("doc_id")).agg(F.avg(cols["label"]).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL AND y <> 0.5")
    gold = gold.select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    found = rows.mapInArrow(batches, "doc_id long, text_x binary, page_x binary")
    return found.join(gold, "doc_id", "left").withColumn("fold", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds).cast("int"))


def _calibration_fold(features: DataFrame, folds: int) -> tuple[int | None, list[int]]:
    """The first fold with labels of both classes inside and outside it (null where there is none), and the labels of each class."""
    found = {(r["fold"], r["y"]): r["count"] for r in features.filter("y IS NOT NULL").groupBy("fold", "y").count().collect()}  # two rows a fold
    total = [sum(n for (_, y), n in found.items() if y == k) for k in (0, 1)]
    good = (f for f in range(folds) if all(0 < found.get((f, y), 0) < total[y] for y in (0, 1)))
    return next(good, None), total


def _class_sums(features: DataFrame, views: tuple[View, View] | None, cuts: list[tuple[float, float]] | None, calibration: int | None) -> list[dict]:
    """For each view and class: rows, sum and outer products over the labelled rows outside the calibration fold, and over the unlabelled rows of
    which the other view is sure. Tasks send their sums, of a size fixed by the number of features."""
    widths = (TEXT_WIDTH, PAGE_WIDTH)
    upper = [np.triu_indices(w) for w in widths]

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros(len(upper[v][0])) for _ in (0, 1)] for v in (0, 1)]
        for b in it:
            xs = _matrices(b)
            y = b["y"].to_numpy(zero_copy_only=False).astype(np.float64)
            train = ~np.isnan(y) & (b["fold"].to_numpy() != (-1 if calibration is None else calibration))
            for v in (0, 1):
                label = np.where(train, y, -1)
                if views is not None:
                    s = views[1 - v].scores(xs[1 - v])
                    label = np.where(np.isnan(y), np.where(s <= cuts[1 - v][0], 0, np.where(s >= cuts[1 - v][1], 1, -1)), label)
                for k in (0, 1):
                    x = xs[v][label == k]
                    total[v][k] += (x.T @ x)[upper[v]]
        at = np.arange(sum(2 * len(u[0]) for u in upper))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([t for v in total for t in v]))], ["at", "s"])

    rows = features.mapInArrow(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).filter("s <> 0").collect()
    flat = np.zeros(sum(2 * len(u[0]) for u in upper))
    for r in rows:
        flat[r["at"]] = r["s"]
    out, at = [], 0
    for v in (0, 1):
        classes = {}
        for k in (0, 1):
            outer = np.zeros((widths[v], widths[v]))
            outer[upper[v]] = flat[at : at + len(upper[v][0])]
            outer = outer + outer.T - np.diag(np.diag(outer))
            classes[k] = (outer[0, 0], outer[0], outer)  # feature 0 is 1: its products are the count and the sums
            at += len(upper[v][0])
        out.append(classes)
    return out


def _histograms(features: DataFrame, views: tuple[View, View], calibration: int | None) -> list[dict]:
    """For each view: number of rows by score range, of class 0, 1 (in the calibration fold, or all) and of unlabelled rows."""

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            xs = _matrices(b)
            y = b["y"].to_numpy(zero_copy_only=False).astype(np.float64)
            held = np.full(len(y), True) if calibration is None else b["fold"].to_numpy() == calibration
            kind = np.where(np.isnan(y), 2, np.where(held, y, 3)).astype(np.int64)
            for v in (0, 1):
                bins = np.floor(np.clip(views[v].scores(xs[v]), -50, 50) / _BIN).astype(np.int64)
                keys, n = np.unique(np.stack([kind, bins]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), v)), pa.array(keys[0]), pa.array(keys[1]), pa.array(n)], ["v", "kind", "bin", "n"])

    rows = features.mapInArrow(counts, "v long, kind long, bin long, n long").groupBy("v", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    return [{k: {r["bin"]: r["n"] for r in rows if (r["v"], r["kind"]) == (v, k)} for k in (0, 1, 2)} for v in (0, 1)]


def _calibrated(view: View, hist: dict) -> View:
    bins = [(b, y, n) for y in (0, 1) for b, n in hist[y].items()]
    if not bins:
        return view
    b, y, n = (np.array(c, dtype=np.float64) for c in zip(*bins, strict=True))
    return View(view.weights, *fit_platt((b + 0.5) * _BIN, y, n))


def _sure(view: View, hist: dict, share: float, confidence: float) -> tuple[float, float]:
    """Scores up to and from which unlabelled rows take a pseudo-label: at most `share` of them on either side, and only where the
    calibrated probability is at least `confidence`."""
    bins = sorted(hist[2].items())
    most, low, high = share * sum(n for _, n in bins), -np.inf, np.inf
    p = {b: 1 / (1 + np.exp(-np.clip(view.a * (b + 0.5) * _BIN + view.b, -30, 30))) for b, _ in bins}
    n = 0
    for b, k in bins:
        n += k
        if n > most or p[b] > 1 - confidence:
            break
        low = (b + 1) * _BIN - 1e-12
    n = 0
    for b, k in reversed(bins):
        n += k
        if n > most or p[b] < confidence:
            break
        high = b * _BIN
    return low, high


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars",
    label_col: str = "quality", rounds: int = 2, share: float = 0.2, confidence: float = 0.9, folds: int = 5,
) -> DataFrame:
    """(doc_id, text_score, page_score, score, keep) of every row of docs.

    The text view sees the whole text, the page view language, source and size; the id is an input of neither. Both are fitted on
    all labelled rows outside one fold. In each round, each view labels the unlabelled rows it is surest of, for the other view's next
    fit. The fold calibrates each view; score adds both views' evidence to the labels' base rate, keep is score >= 0.5.

    Calibration takes the first of the `folds` folds that has labels of both classes, with both also outside it. Where no fold has (few
    labels, or few of one class), views are fitted and calibrated on all labelled rows, and their scores are surer than they should be.
    Without labels of both classes every score is the base rate, (ones + 1) / (labels + 2).

    Rows are used in place: a fit is one pass that sends sums of a fixed size, so no sample is drawn and nothing grows on the driver.
    Texts and metadata may be null; rows that repeat an id, null ids among them, get a score each; a label table with repeated ids gives
    the majority (a tie: no label). An empty table of documents gives no rows, one of labels the base rate 0.5.
    """
    text_batches(docs.sparkSession)
    cols = {"id": id_col, "text": text_col, "lang": lang_col, "source": source_col, "n_chars": size_col, "label": label_col}
    features = written(_features(docs, labels, cols, folds), "quality-features")
    calibration, n = _calibration_fold(features, folds)
    if min(n) == 0:
        prior = F.lit(float((n[1] + 1) / (sum(n) + 2)))
        return features.select("doc_id", prior.alias("text_score"), prior.alias("page_score"), prior.alias("score"), (prior >= 0.5).alias("keep"))
    sums = _class_sums(features, None, None, calibration)
    for step in range(rounds + 1):
        views = tuple(View(fit_linear(sums[v], w)) for v, w in enumerate((TEXT_WIDTH, PAGE_WIDTH)))
        hists = _histograms(features, views, calibration)
        views = tuple(_calibrated(view, hist) for view, hist in zip(views, hists, strict=True))
        if step < rounds:
            sums = _class_sums(features, views, [_sure(view, hist, share, confidence) for view, hist in zip(views, hists, strict=True)], calibration)
    held = [sum(hists[0][k].values()) for k in (0, 1)]
    base = float(np.log((held[1] + 1) / (held[0] + 1)))

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for b in it:
            text, page = (view.logits(x) for view, x in zip(views, _matrices(b), strict=True))
            both = prob(text + page - base)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(prob(text)), pa.array(prob(page)), pa.array(both), pa.array(both >= 0.5)], ["doc_id", "text_score", "page_score", "score", "keep"])

    return features.select("doc_id", "text_x", "page_x").mapInArrow(scores, "doc_id long, text_score double, page_score double, score double, keep boolean")
