"""Near copies by similarity: wide SimHash fingerprints, generalised pigeonhole probes, then exact similarity of the shingle sets.

A 64-bit fingerprint cannot tell five-word similarity 0.8 (about 10 of 64 bits differ) from chance, so texts are linked here through
fingerprints of many words, whose bits are grouped into parts by correlation; thresholds of the parts come from `simhash.allocate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, free_names, text_batches, written
from hazardspark.llm.simhash import allocate, correlated_parts, shingle_hashes
from hazardspark.operators.components import connected_components

_LANES = np.uint64(0x0101010101010101)
_CHUNK = 255  # a byte counts so many shingles
_WINDOW, _UNIT, _SHINGLES = 32, 2048, 512
_FEW = 1 << 20  # nodes, 8 MB of ids


@dataclass(frozen=True)
class Plan:
    """Parts of `width` bits; `needed` is the sum of (threshold + 1) over the parts: pairs within needed - 1 bits are met for sure, and
    pairs of the asked similarity are missed with probability `miss` at most. A link differs in `near` of 128 bits at most."""

    width: int
    needed: int
    words: int
    near: int


def make_plan(n: int, similarity: float, miss: float) -> Plan:
    """For n texts. Parts have about log2(n) bits, so a text meets few others by chance, whatever n; the parts needed for the asked
    recall grow with the width. Words hold an eighth more parts than needed, for the allocation to choose from."""
    differ = acos(2 * similarity / (1 + similarity)) / pi  # of a bit, for two sets of one size; sets of other sizes are closer
    width = min(32, max(16, ceil(log2(max(n, 2))) - 2))
    needed = ceil(log(miss) / log(1 - (1 - differ) ** width))
    words = ceil(1.125 * needed / (64 // width))
    return Plan(width, needed, words, int(_most(np.ones(1), np.ones(1), 128, similarity)[0]))


def _most(m: np.ndarray, n: np.ndarray, bits: int, similarity: float) -> np.ndarray:
    """Bits in which sets of m and n hashes with that similarity differ, and three deviations."""
    cosine = similarity / (1 + similarity) * (m + n) / np.sqrt(m.astype(float) * n)
    differ = np.arccos(np.minimum(cosine, 1)) / np.pi
    return np.ceil(bits * differ + 3 * np.sqrt(bits * differ * (1 - differ)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A row of words for each set of hashes: majority bits of words that are mixed from each hash. Bits are summed as bytes of a
    word, over at most 255 hashes at a time; an empty set has zeros."""
    n = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), words), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    flat, sizes = np.concatenate([sets[i] for i in full]), n[full]
    chunks = -(-sizes // _CHUNK)
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(np.cumsum(sizes) - sizes - _CHUNK * first, chunks) + _CHUNK * np.arange(int(chunks.sum()))
    factors = np.random.default_rng(42).integers(0, 1 << 64, words, np.uint64, endpoint=False) | np.uint64(1)
    bits = np.zeros((len(full), 8, 8), bool)
    for k, factor in enumerate(factors):
        x = flat * factor
        x ^= x >> np.uint64(32)
        for s in range(8):
            lanes = np.add.reduceat((x >> np.uint64(s)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            bits[:, :, s] = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > sizes[:, None]
        out[full, k] = np.packbits(bits.reshape(len(full), 64), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def plan_masks(sketches: DataFrame, n: int, plan: Plan) -> list[tuple[int, int]]:
    """Probes as (word, mask). Bits of a word are grouped by their correlation over all fingerprints (bits beyond the width of a part are left
    out); thresholds of the parts are
    chosen by dynamic programming on the estimated pairs that agree, from the share of ones of each bit over all fingerprints."""
    words = plan.words

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, 64, 64))
        for b in it:
            fps = _words(b["fp"], words)
            for k in range(words):
                bits = np.unpackbits(np.ascontiguousarray(fps[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "n"])

    gram = np.zeros(words * 64 * 64)
    for r in sketches.select("fp").mapInArrow(grams, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4096 rows a word
        gram[r["at"]] = r["n"]
    parts, costs = [], []
    for k, own in enumerate(gram.reshape(words, 64, 64)):
        p = np.diag(own) / max(n, 1)
        same = p * p + (1 - p) ** 2
        for part in (x[: plan.width] for x in correlated_parts(n, own, 64 // plan.width)):
            dist = np.ones(1)
            for b in part:
                dist = np.convolve(dist, [same[b], 1 - same[b]])
            within = np.cumsum(dist)
            parts.append((k, part))
            costs.append([0.0, *(n * comb(len(part), t) + float(n) * n / 2 * within[t] for t in range(2))])
    _, thresholds = allocate(costs, plan.needed - len(parts))
    return [(k, sum(1 << b for b in part if b not in gone)) for (k, part), t in zip(parts, thresholds, strict=True) if t >= 0 for gone in combinations(part, t)]


def _fits(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16)  # of a signed number it would count the absolute value's bits


def _probes(sketches: DataFrame, masks: list[tuple[int, int]], plan: Plan) -> DataFrame:
    """(part, value, node, n, f1, f2): a row for each probe of each text."""
    at, mask = [k for k, _ in masks], np.array([m for _, m in masks], np.uint64)

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = _words(b["fp"], plan.words)
            values = (fps[:, at] & mask).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * len(at), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([b["node"], b["n"], *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in (0, 1)), lists], ["node", "n", "f1", "f2", "values"])

    found = sketches.mapInArrow(keys, "node long, n int, f1 long, f2 long, values array<long>")
    return found.select(F.posexplode("values").alias("part", "value"), "node", "n", "f1", "f2")


def _by_rows(it: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    waiting, n = [], 0
    for b in it:
        waiting.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(waiting)
            waiting, n = [], 0
    if n:
        yield pa.concat_batches(waiting)


def _met(probes: DataFrame, plan: Plan, similarity: float) -> DataFrame:
    """(kind, part, value, a, b) of texts that agree in a probe. kind 0: a pair (a, b) that may be similar, b the closest that a has met
    among the 32 places before it in the probe's order. kind 1: a text (a) of a probe with further pairs that may be similar, or of one
    that 33 texts or more share; so probes are dealt out only here. Memory holds a batch and the last 32 rows, however many texts share a probe."""
    names = ("part", "value", "node", "n", "f1", "f2")

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in _by_rows(it):
            own = {c: b[c].to_numpy() for c in names}
            x = own if last is None else {c: np.concatenate([last[c], own[c]]) for c in names}
            old = 0 if last is None else len(last["node"])
            last = {c: v[-_WINDOW:].copy() for c, v in x.items()}
            i = np.arange(max(old, 1), len(x["node"]))
            ends, starts, fars = [], [], []
            for d in range(1, _WINDOW + 1):
                i = i[i >= d]
                i = i[(x["value"][i] == x["value"][i - d]) & (x["part"][i] == x["part"][i - d])]
                if not len(i):
                    break
                j = i - d
                far = sum(_differ(x[f][i], x[f][j]) for f in ("f1", "f2"))
                ok = (far <= plan.near) & _fits(x["n"][i], x["n"][j], similarity)
                ends.append(i[ok])
                starts.append(j[ok])
                fars.append(far[ok])
            end, start, far = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (ends, starts, fars))
            order = np.lexsort((far, end))
            end, start = end[order].astype(np.int64), start[order].astype(np.int64)
            first = np.concatenate([[True], end[1:] != end[:-1]])[: len(end)]
            shared = np.zeros(len(x["node"]) + 1, np.int64)  # i: rows of the probe of the row _WINDOW places before them
            np.add.at(shared, i - _WINDOW, 1)
            np.add.at(shared, i + 1, -1)
            more = np.unique(np.concatenate([end[~first], start[~first], np.flatnonzero(np.cumsum(shared))]))
            a, c, none = x["node"][end[first]], x["node"][start[first]], np.zeros
            sizes = [len(a), len(more)]
            columns = [
                np.repeat(np.array([0, 1], np.int32), sizes),
                np.concatenate([none(sizes[0], np.int32), x["part"][more]]),
                np.concatenate([none(sizes[0], np.int64), x["value"][more]]),
                np.concatenate([np.minimum(a, c), x["node"][more]]),
                np.concatenate([np.maximum(a, c), none(sizes[1], np.int64)]),
            ]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["kind", "part", "value", "a", "b"])

    dealt = probes.repartition("part", "value").sortWithinPartitions("part", "value", "f1", "node")
    return dealt.mapInArrow(near, "kind int, part int, value long, a long, b long").distinct()


def _met_apart(met: DataFrame, named: DataFrame, sketches: DataFrame, masks: list[tuple[int, int]], plan: Plan, similarity: float) -> DataFrame:
    """(lo, hi, nodes, a, b): all further pairs (a[i], b[i]) of different components that agree in a probe and may be similar by their
    whole fingerprints, each once: in the first probe in which they agree. A probe's texts are cut by hash into chunks of about 2048
    texts and a million shingles, and each pair of chunks is one unit of work, so no task holds a probe whole.

    A unit gives its pairs as arrays, by the places of their two texts: a text's place is a chunk of the texts that share a probe with
    the same lowest text, so the texts of a group have few places and their shingle sets go to few blocks (lo, hi) for the exact check."""
    rows = met.filter("kind = 1").select("part", "value", F.col("a").alias("node"))
    labels = named.select(F.col("node").alias("__n"), "component")
    rows = rows.join(labels, rows["node"] == labels["__n"], "left").withColumn("component", F.coalesce("component", "node")).drop("__n")
    rows = written(rows.join(sketches.select("node", "n"), "node"), "near-apart")
    chunks = F.ceil(F.greatest(F.count("*") / _UNIT, F.sum("n") / (_UNIT * _SHINGLES))).cast("int").alias("m")
    sizes = rows.groupBy("part", "value").agg(chunks, F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("first"))
    rows = written(rows.join(sizes.filter("lo <> hi").drop("lo", "hi"), ["part", "value"]), "near-mixed")
    leader = written(rows.groupBy("node").agg(F.min("first").alias("leader"), F.first("n").alias("n")), "near-leaders")
    leads = leader.groupBy("leader").agg(chunks)
    home = leader.join(leads, "leader")
    place = F.xxhash64("leader", F.pmod(F.xxhash64("node"), "m"))
    known = home.select("node", place.alias("place")).join(sketches.select("node", "fp"), "node")
    rows = rows.drop("first").join(known, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), "m").cast("int"))
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    units = units.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})

    def compare(table: pa.Table) -> pa.Table:
        x = {c: table[c].to_numpy() for c in ("node", "n", "component", "chunk", "place")}
        fps = _words(table["fp"], plan.words)
        alone, part, out = table["i"][0] == table["j"][0], table["part"][0].as_py(), []
        for first in range(0, len(fps), 128):
            r = slice(first, first + 128)
            far = sum(np.bitwise_count(fps[r, None, k] ^ fps[None, :, k]).astype(np.int16) for k in range(plan.words))
            ok = (far <= _most(x["n"][r, None], x["n"][None, :], 64 * plan.words, similarity)) & (x["component"][r, None] != x["component"][None, :]) & _fits(x["n"][r, None], x["n"][None, :], similarity)
            ok &= (x["node"][r, None] < x["node"][None, :]) & (alone or (x["chunk"][r, None] != x["chunk"][None, :]))
            a, b = np.nonzero(ok)
            a += first
            before = np.zeros(len(a), bool)
            for k, mask in masks[:part]:
                before |= (fps[a, k] ^ fps[b, k]) & np.uint64(mask) == 0
            out.append((a[~before], b[~before]))
        a, b = (np.concatenate([p[i] for p in out]) for i in (0, 1))
        lo, hi = np.minimum(x["place"][a], x["place"][b]), np.maximum(x["place"][a], x["place"][b])
        order = np.lexsort((hi, lo))
        a, b, lo, hi = a[order], b[order], lo[order], hi[order]
        starts = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(lo)])
        ends = np.append(starts[1:], len(lo))[: len(starts)]
        lists = [[x["node"][v[s:e]] for s, e in zip(starts, ends, strict=True)] for v in (a, b)]
        nodes = [np.unique(np.concatenate(p)) for p in zip(*lists, strict=True)]
        kind = pa.list_(pa.int64())
        return pa.table({"lo": lo[starts], "hi": hi[starts], "nodes": pa.array(nodes, kind), "a": pa.array(lists[0], kind), "b": pa.array(lists[1], kind)})

    found = units.select("part", "value", "i", "j", "node", "n", "fp", "component", "chunk", "place").groupBy("part", "value", "i", "j")
    return written(found.applyInArrow(compare, "lo long, hi long, nodes array<long>, a array<long>, b array<long>"), "near-rest")


def _similar_in_blocks(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of `_met_apart` whose shingle sets have at least that Jaccard similarity. A block gets each text's set once and its pairs
    as arrays, so a pair is a row only if it is a link."""
    texts = found.select(F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"), F.explode("nodes").alias("node")).distinct().join(sets, "node")

    def verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        out = []
        if pairs.num_rows and texts.num_rows:
            node = texts["node"].to_numpy()
            grams = [np.frombuffer(v.as_buffer(), np.uint64) for v in texts["grams"]]
            sizes = np.array([len(g) for g in grams])
            starts = np.cumsum(sizes) - sizes
            vocab, flat = np.unique(np.concatenate(grams), return_inverse=True)
            order = np.argsort(node)
            a, b = (order[np.searchsorted(node[order], pairs[c].combine_chunks().flatten().to_numpy())] for c in "ab")
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            own, first = np.unique(a, return_index=True)
            marked = np.zeros(len(vocab), bool)
            for x, s, e in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
                mine = flat[starts[x] : starts[x] + sizes[x]]
                marked[mine] = True
                for part in np.split(b[s:e], np.flatnonzero(np.diff(np.cumsum(sizes[b[s:e]]) >> 20)) + 1):
                    at = np.cumsum(sizes[part]) - sizes[part]
                    places = np.arange(int(sizes[part].sum())) + np.repeat(starts[part] - at, sizes[part])
                    common = np.add.reduceat(marked[flat[places]], at, dtype=np.int64)
                    ok = common >= similarity * (sizes[x] + sizes[part] - common)
                    out.append((np.full(int(ok.sum()), node[x]), node[part[ok]]))
                marked[mine] = False
        return pa.table({k: np.concatenate([np.zeros(0, np.int64), *(p[i] for p in out)]) for i, k in enumerate("ab")})

    both = found.select("lo", "hi", "a", "b").groupBy("lo", "hi").cogroup(texts.groupBy("of_lo", "of_hi"))
    return written(both.applyInArrow(verify, "a long, b long"), "near-links")


def _shingle_sets(nodes: DataFrame, rows: DataFrame, shingle: int, few: bool = False) -> DataFrame:
    """(node, grams): the shingle sets of the texts of some nodes. Few nodes (_FEW at most) go to the texts, else texts go to them."""

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it):
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([shingle_set(t, shingle).tobytes() for t in b["text"].to_pylist()], pa.binary())], ["node", "grams"])

    some = rows.join(nodes.hint("broadcast" if few else "merge"), "node", "left_semi").dropDuplicates(["node"])  # texts cross the network once
    return written(some.mapInArrow(grams, "node long, grams binary"), "near-sets")


def _sides(df: DataFrame, column: str) -> list[DataFrame]:
    return [df.select(F.col("node").alias(k), F.col(column).alias(f"{column}_{k}")).hint("merge") for k in "ab"]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    ga, gb = _sides(sets, "grams")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it, "grams_a"):
            keep = []
            for x, y in zip(b["grams_a"], b["grams_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(pairs.join(ga, "a").join(gb, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(verify, "a long, b long"), "near-links")


def near_nodes(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, miss: float = 0.02) -> DataFrame:
    """(node, component) of the nodes with a link; rows: node, text (rows of one node are alike).

    1. A text's wide fingerprint is written, probes are planned, and texts that agree in a probe meet.
    2. Shingle sets of each text and its closest in each probe are compared; links give components.
    3. All other pairs that met and are still in different components are compared by their whole fingerprints and then by their
       shingle sets, both in bounded units, which give out links only. Pairs inside a component need no comparison, so groups of
       copies cost about a pair a text and probe.
    So a linked pair is lost only if it meets in no probe or its bits lie beyond 3 deviations of what its similarity makes likely.
    """
    text_batches(rows.sparkSession)
    n = rows.count()
    plan = make_plan(n, similarity, miss)

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it, limit=2 << 20):
            found = [shingle_set(t, shingle) for t in b["text"].to_pylist()]
            sizes = np.array([len(x) for x in found], np.int32)
            some = pa.array(sizes > 0)
            fps = pa.array([x.tobytes() for x in wide_fingerprints(found, plan.words)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["node"].filter(some), pa.array(sizes).filter(some), fps.filter(some)], ["node", "n", "fp"])

    sketches = written(rows.select("node", "text").mapInArrow(sketch, "node long, n int, fp binary").dropDuplicates(["node"]), "wide-fingerprints")
    masks = plan_masks(sketches, n, plan)
    met = written(_met(_probes(sketches, masks, plan), plan, similarity), "near-met")
    closest = met.filter("kind = 0 AND a <> b").select("a", "b")
    ends = F.explode(F.array("a", "b")).alias("node")
    sets = _shingle_sets(closest.select(ends).distinct(), rows, shingle)
    links = _similar(closest, sets, similarity)
    named = written(connected_components(links, written), "near-named")
    rest = _met_apart(met, named, sketches, masks, plan, similarity)
    unknown = rest.select(F.explode("nodes").alias("node")).distinct().join(sets.select("node"), "node", "left_anti")
    if new := unknown.count():
        sets = sets.unionByName(_shingle_sets(unknown, rows, shingle, new <= _FEW))
    more = _similar_in_blocks(rest, sets, similarity)
    if more.isEmpty():
        return named
    return connected_components(links.unionByName(more), written)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose id is the smallest among the texts linked to it, step by step, by at least that similarity of their word
    shingles (distinct, A-Z in lower case, ASCII white space between words).

    Rows alike in id and text stay or go together; rows that share the smallest id all stay; a null id counts as the largest. A text
    without words is linked to none. An empty table gives no rows. Columns of docs are kept whatever their names.
    """
    node, least = free_names(docs, "__near_node", "__near_id")
    keyed = docs.withColumns({node: F.xxhash64(F.col(id_col), F.col(text_col)), least: F.col(id_col)})
    rows = keyed.select(F.col(node).alias("node"), F.col(least).alias("doc_id"), F.col(text_col).alias("text"))
    linked = near_nodes(rows.select("node", "text"), shingle, similarity)
    named = written(rows.select("node", "doc_id").distinct().join(linked, "node"), "near-ids")
    first = named.groupBy("component").agg(F.min("doc_id").alias("first"))
    gone = named.join(first, "component").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("node").alias("__gone_node"), F.col("doc_id").alias("__gone_id"))
    same = (keyed[node] == gone["__gone_node"]) & keyed[least].eqNullSafe(gone["__gone_id"])
    return keyed.join(gone, same, "left_anti").select(docs.columns)
