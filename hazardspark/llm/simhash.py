"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, text_batches, written
from hazardspark.operators.components import connected_components

BITS = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of all word shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the hashes of all word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.from_numpy_dtype(np.int64)), ("fp", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it):
            fps = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(fps.view(np.int64))], schema=schema)

    return rows.mapInArrow(batches, "doc_id long, fp long")


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits in how many both are 1."""

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in it:
            bits = np.unpackbits(b["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["at", "n"])

    sums = fps.select("fp").mapInArrow(grams, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4096 rows at most
    gram = np.zeros(BITS * BITS)
    for r in sums:
        gram[r["at"]] = r["n"]
    return fps.count(), gram.reshape(BITS, BITS)


def correlated_parts(n: int, gram: np.ndarray, m: int) -> list[list[int]]:
    """m parts of the bits: each starts with the free bit most correlated with the others and takes its closest free bits."""
    p = np.diag(gram) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(gram / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: corr[b, free].sum())]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: corr[b, part].sum()))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of at least -1 that sum to `total` at the least cost; costs[i][t + 1] is that of threshold t for part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                found = (c + row[t + 1], [*ts, t])
                if s + t not in step or found < step[s + t]:
                    step[s + t] = found
        best = step
    return best[total]


def plan_probes(fps: DataFrame, radius: int) -> list[int]:
    """Masks such that any two fingerprints within `radius` bits agree under one of them.

    For 1 to radius + 1 parts of correlated bits, thresholds t_i (-1: part unused) with sum radius - parts + 1 are chosen by
    dynamic programming on the estimated work: a threshold t costs C(width, t) probes a fingerprint and the pairs within t bits,
    taken from the exact count of equal pairs in the part, carried to t bits as if bits differed independently. The cheapest
    division wins: many narrow parts for small sets, few wide ones, probed with flips, for large sets.
    """
    n, gram = _bit_counts(fps)
    p = np.diag(gram) / max(n, 1)
    differ = 2 * p * (1 - p)
    divisions = [correlated_parts(n, gram, m) for m in range(1, radius + 2)]
    masks = {(d, i): sum(1 << b for b in part) for d, parts in enumerate(divisions) for i, part in enumerate(parts)}
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for (d, i), m in masks.items()])).alias("k")
    sizes = fps.select(keys).select("k.*").groupBy("d", "i", "v").count().groupBy("d", "i").agg(F.sum((F.col("count") * F.col("count")).cast("double")).alias("pairs"))
    equal = {(r["d"], r["i"]): r["pairs"] for r in sizes.collect()}
    found = []
    for d, parts in enumerate(divisions):
        costs = []
        for i, part in enumerate(parts):
            dist = np.ones(1)
            for b in part:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            within = np.cumsum(dist)[: radius + 1]
            grow = within / max(within[0], 1e-300)
            costs.append([0.0, *(n * comb(len(part), t) + min(equal.get((d, i), 0.0) * grow[t], float(n) * n) for t in range(radius + 1))])
        found.append((*allocate(costs, radius - len(parts) + 1), d))
    _, thresholds, d = min(found)
    return [masks[d, i] & ~sum(1 << b for b in gone) for i, t in enumerate(thresholds) if t >= 0 for gone in combinations(divisions[d][i], t)]


def _narrower(mask: int, radius: int) -> list[int]:
    """The same principle on the bits outside the mask: radius + 1 parts with threshold 0."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[k :: radius + 1]) for k in range(radius + 1)]


def group_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links every fingerprint to the smallest one it reaches inside the group by steps of at most radius bits."""
    x = np.sort(fps.view(np.uint64))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(axis=1)
        if (low == label).all():
            break
        label = low
    signed = x.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in enumerate(label) if i != j]


def fingerprint_edges(fps: DataFrame, radius: int = 2, most: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, no repeats) with the components of all links of at most radius bits.

    A probe is a mask; fingerprints that agree under it form a group. Groups of up to `most` are verified in one task. A larger
    group is probed again by the bits that its mask leaves out, so groups shrink until they are small; as fingerprints are
    distinct, the last level cannot exceed 2^(bits left). Work is linear in the fingerprints and no link is given up.
    """
    spark = fps.sparkSession
    masks = plan_probes(fps, radius)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    edges = []

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple[int, int]] = []
            for group in b["fps"]:
                out += group_edges(group.values.to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(keyed.groupBy("mask", "key").count().filter("count > 1"), "probe-sizes")
        small = keyed.join(sizes.filter(F.col("count") <= most), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges.append(written(small.select("fps").mapInArrow(verify, "a long, b long").distinct(), "probe-edges"))
        hot = sizes.filter(F.col("count") > most)
        if hot.isEmpty():
            break
        masks = sorted({r["mask"] for r in hot.select("mask").distinct().collect()})  # at most as many as there are probes
        finer = spark.createDataFrame([(m, _signed(x)) for m in masks for x in _narrower(m % (1 << 64), radius)], "mask long, finer long")
        rows = written(keyed.join(hot, ["mask", "key"]).join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct(), "probe-rows")
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return all_edges.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest id linked to it by fingerprints that differ in at most
    `radius` bits, step by step).

    A null or wordless text has fingerprint 0, linked like any other. Rows that share an id keep one row each; a null id gets its
    component's smallest id (null where all are null). An empty table gives no rows. Texts are hashed whole, however long (a million
    words take about 30 MB in a task); only the two named columns are read, whatever the others are called.
    """
    hashed = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-set")
    linked = connected_components(fingerprint_edges(fps.select("fp"), radius), written)
    labelled = fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    first = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(first, "component").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")
