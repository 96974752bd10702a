"""Hard negatives by threshold joins: an inverted index without the dimensions that norm bounds cover, partial scores pruned by what
remains, and thresholds that fall until an anchor's windows are full."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import held, new_path, written

_STEP = 8  # dimensions added between two prunings
_ROWS, _ANCHORS = 8192, 256  # pairs that a task holds at once
_LIMIT = 1 << 27  # of a quantised component
_NONE = -(1 << 62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, id, label, q): rows that take part, each component x as floor(scale * x), clipped at 2^27 either way.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out. `row` numbers the rows of the written
    table, so rows that repeat an id stay apart.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.floor(c.cast("double") * scale))).cast("int"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("q"))
    return written(rows, "negatives-rows")


def _matrix(column: pa.Array, dims: np.ndarray) -> np.ndarray:
    """The vectors with their dimensions in the order of dims; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), len(dims)), np.int64)
    out[np.arange(len(dims)) < sizes[:, None]] = column.flatten().to_numpy()
    return out[:, dims]


def _rest(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row after 0, 8, 16 ... dimensions."""
    squares = np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, ::_STEP], np.zeros((len(x), 1))], axis=1))


def scores_from(q: np.ndarray, q_rest: np.ndarray, x: np.ndarray, x_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score): all pairs of anchors q and rows x whose inner product is at least the anchor's threshold.

    A row's last dimensions are not indexed where their norm times any anchor's stays below its threshold. Indexed dimensions are summed
    eight at a time, for all pairs while many are alive and for a list of pairs then; a pair goes once its sum and the norms of what
    remains cannot reach the threshold. The dimensions left out are added to the pairs that are left.
    """
    steps = q_rest.shape[1] - 1
    slack = 1e-9 * q_rest[:, 0].max(initial=0) * x_rest[:, 0].max(initial=0) + 1e-6
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.nan_to_num((least - slack) / q_rest[:, 0], nan=-np.inf, posinf=np.inf, neginf=-np.inf).min(initial=np.inf)
    depth = (x_rest[:, :-1] >= reach).sum(1)
    order = np.argsort(-depth, kind="stable")
    x, x_rest, depth = x[order], x_rest[order], depth[order]
    n = int((depth > 0).sum())
    total = np.zeros((len(q), n), q.dtype)
    alive = np.ones((len(q), n), bool)
    step = 0
    while step < steps and n and (step == 0 or 8 * np.count_nonzero(alive) >= alive.size):
        d, m = slice(step * _STEP, (step + 1) * _STEP), int((depth[:n] > step).sum())
        total[:, :m] += q[:, d] @ x[:m, d].T
        step += 1
        at = np.minimum(step, depth[:n])
        alive &= total + q_rest[:, at] * x_rest[np.arange(n), at] >= (least - slack)[:, None]
    a, b = np.nonzero(alive)
    score = total[a, b]
    done = np.minimum(step, depth[b])
    for k in range(step, steps):
        on = depth[b] > k
        d = slice(k * _STEP, (k + 1) * _STEP)
        score[on] += np.einsum("ij,ij->i", q[a[on], d], x[b[on], d])
        done[on] = k + 1
        ok = score + q_rest[a, done] * x_rest[b, done] >= least[a] - slack
        a, b, score, done = a[ok], b[ok], score[ok], done[ok]
    for k in range(steps):
        on = done <= k
        d = slice(k * _STEP, (k + 1) * _STEP)
        score[on] += np.einsum("ij,ij->i", q[a[on], d], x[b[on], d])
    ok = score >= least[a]
    return a[ok], order[b[ok]], score[ok]


def _first(key: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key, by score from the highest and then by tie."""
    order = np.lexsort((tie, -score, key))
    sorted_key = key[order]
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])[: len(order)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(starts, at, 0)) < k]


class _Anchors:
    """A block of anchors in a worker: vectors, labels, thresholds, and windows [low, high] of scores for each."""

    def __init__(self, block: dict, dims: np.ndarray):
        exact = len(dims) * float(np.abs(block["q"]).max(initial=1)) * block["most"] < 2**53  # then sums of doubles are whole
        self.kind = np.float64 if exact else np.int64
        self.q = block["q"][:, dims].astype(self.kind)
        self.rest = _rest(self.q)
        self.row, self.label, self.same = block["row"], block["label"], block["same"]
        self.low, self.high = block["low"], block["high"]
        self.least = self.low.min(axis=1).astype(float)


def _searcher(shared, name: str, dims: np.ndarray, k: int):
    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = held(("anchors", name), lambda: _Anchors(shared.value, dims))
        windows = anchors.low.shape[1]
        best = [np.zeros(0, np.int64) for _ in range(4)]  # window of an anchor, score, id, row
        for batch in it:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                x = _matrix(part["q"], dims).astype(anchors.kind)
                x_rest, label, ids, row = _rest(x), *(part[c].to_numpy() for c in ("label", "id", "row"))
                found = [best]
                for start in range(0, len(anchors.q), _ANCHORS):
                    own = slice(start, start + _ANCHORS)
                    a, b, score = scores_from(anchors.q[own], anchors.rest[own], x, x_rest, anchors.least[own])
                    a, score = a + start, score.astype(np.int64)
                    ok = ((anchors.label[a] == label[b]) == anchors.same) & (anchors.row[a] != row[b])
                    a, b, score = a[ok], b[ok], score[ok]
                    for w in range(windows):
                        ok = (score >= anchors.low[a, w]) & (score <= anchors.high[a, w])
                        new = [a[ok] * windows + w, score[ok], ids[b[ok]], row[b[ok]]]
                        keep = _first(*new[:3], k)
                        found.append([v[keep] for v in new])
                best = [np.concatenate(v) for v in zip(*found, strict=True)]
                keep = _first(*best[:3], k)
                best = [v[keep] for v in best]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), ["window", "score", "id", "row"])

    return search


def _pass(rows: DataFrame, anchors: dict, dims: np.ndarray, k: int) -> dict[int, list]:
    """The first k rows (score, id) of each window of a block of anchors: each task keeps k a window, and so does the merge."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    found = rows.mapInArrow(_searcher(shared, uuid.uuid4().hex, dims, k), "window long, score long, id long, row long")
    at = Window.partitionBy("window").orderBy(F.desc("score"), "id", "row")
    out: dict[int, list] = {}
    for r in found.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= k).orderBy("window", "at").collect():  # k a window
        out.setdefault(r["window"], []).append((r["score"], r["id"]))
    shared.destroy()
    return out


def _positives(rows: DataFrame, block: dict, dims: np.ndarray, most_norm: float, levels: tuple[float, ...], k: int) -> list[list]:
    """The first k rows of each anchor's label: thresholds fall by level, for the anchors that have fewer."""
    norms = np.sqrt((block["q"].astype(float) ** 2).sum(1))
    out: list[list] = [[] for _ in norms]
    open_ = np.arange(len(norms))
    for level in (*levels, None):
        if not len(open_):
            break
        low = np.full(len(open_), _NONE) if level is None else np.floor(level * norms[open_] * most_norm).astype(np.int64)
        some = _some(block, open_) | {"same": True, "low": low[:, None], "high": np.full((len(open_), 1), 1 << 62)}
        for i, found in _pass(rows, some, dims, k).items():
            out[open_[i]] = found
        open_ = open_[[len(out[i]) < k for i in open_]]
    return out


def _some(block: dict, at: np.ndarray) -> dict:
    return {c: block[c][at] for c in ("row", "label", "q")} | {"most": block["most"]}


def _negatives(rows: DataFrame, block: dict, dims: np.ndarray, positives: list[list], percent: int, levels: tuple[int, ...], k: int) -> dict[tuple[int, int], list]:
    """The first k rows of other labels in each window [percent of the positive's score, that score]."""
    out: dict[tuple[int, int], list] = {}
    width = max(map(len, positives), default=0)
    high = np.array([[s for s, _ in p] + [_NONE] * (width - len(p)) for p in positives], np.int64).reshape(len(positives), width)
    todo = high >= 0  # a negative score lies above its own percentage
    for level in (*(x for x in levels if x > percent), percent):
        open_ = np.flatnonzero(todo.any(axis=1))
        if not len(open_):
            break
        low = np.where(todo[open_], high[open_] // 100 * level - (-(high[open_] % 100) * level // 100), 1 << 62)  # rounded up, without overflow
        some = _some(block, open_) | {"same": False, "low": low, "high": high[open_]}
        for i, found in _pass(rows, some, dims, k).items():
            at = (int(open_[i // width]), i % width)
            out[at] = found
            todo[at] &= len(found) < k
    return out


def mine_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, levels: tuple[float, ...] = (0.5, 0.3, 0.15), window_levels: tuple[int, ...] = (90,), block_bytes: int = 8 << 20
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors from `quantised` (anchors: some of rows).

    An anchor's positives are the first `positives` other rows of its label by integer inner product, then by smaller id. For each, the
    first `negatives` rows of other labels whose score is at most the positive's and at least `percent` of it. Fewer rows give all of
    them; an empty table gives none; rows that repeat an id are rows of their own. Scores are exact for components within 2^27 and up to 256 dimensions.

    Anchors are taken in blocks of about block_bytes, the only data that is broadcast (and whose firsts reach the driver); each
    threshold is a pass over all rows for the block's anchors that still lack rows. Every task keeps the first few of each window, so
    rows alike by the thousand need no more memory or network than others. Results are written block by block.
    """
    spark = rows.sparkSession

    def energy(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            q = _matrix(b["q"], np.arange(int(b["q"].value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))).astype(float) ** 2
            dims = q.shape[1]
            norms, size = np.full(dims, q.sum(1).max(initial=0)), np.full(dims, q.max(initial=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(q.sum(0)), pa.array(norms), pa.array(size)], ["at", "energy", "norm", "size"])

    by_dim = rows.mapInArrow(energy, "at long, energy double, norm double, size double").groupBy("at").agg(F.sum("energy").alias("energy"), F.max("norm").alias("norm"), F.max("size").alias("size"))
    found = sorted(by_dim.collect(), key=lambda r: r["at"])  # a row a dimension
    dims = np.argsort([-r["energy"] for r in found], kind="stable")
    most_norm, most = (max((r[c] for r in found), default=0.0) ** 0.5 for c in ("norm", "size"))

    n = anchors.count()
    blocks = max(1, -(-n * max(1, len(found)) * 8 // block_bytes))
    path = new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for number in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).collect()  # about block_bytes
        q = np.zeros((len(part), len(found)), np.int64)
        for i, r in enumerate(part):
            q[i, : len(r["q"])] = r["q"]
        block = {"q": q, "row": np.array([r["row"] for r in part], np.int64), "label": np.array([r["label"] for r in part], np.int64), "most": most}
        first = _positives(rows, block, dims, most_norm, levels, positives) if part else []
        mined = _negatives(rows, block, dims, first, percent, window_levels, negatives)
        out = [
            (part[a]["id"], first[a][p][1], rank, negative, first[a][p][0], score)
            for (a, p), of in mined.items()
            for rank, (score, negative) in enumerate(of, 1)
        ]
        spark.createDataFrame(out, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
