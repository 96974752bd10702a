"""Benchmark decontamination: suffix arrays over the documents, searched for every suffix of the benchmark that holds a window."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import by_bytes, held, text_batches, written

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PAIRS = 1 << 20  # looked at together
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("words", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: ASCII letters and digits, and all beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class TestSuffixes:
    """The suffixes of a block of benchmark items that hold a window: word numbers (0 ends an item), and the first words of each suffix
    as a key (big-endian, so bytes sort as the words do)."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width, self.vocab, self.items = width, _Ids(), [i for i, _ in items]
        flat: list[int] = [0]
        at, item, word, words = [], [], [], []
        for number, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            k = min(width, len(ids))
            n = len(ids) - k + 1 if ids else 0
            at += range(len(flat), len(flat) + n)
            item += [number] * n
            word += range(n)
            words += [k] * n
            flat += [*ids, 0]
        self.ids = np.array(flat + [0] * width, np.int32)
        self.at, self.item, self.word, self.words = (np.array(x, np.int64) for x in (at, item, word, words))
        self.least = int(self.words.min(initial=width))
        first = np.where(np.arange(width) < self.words[:, None], self.ids[self.at[:, None] + np.arange(width)], 0)
        keys, key_of = np.unique(_keys(first, width), return_inverse=True)
        self.by_key = np.argsort(key_of, kind="stable")  # suffixes with one key follow one another
        self.starts = np.searchsorted(key_of[self.by_key], np.arange(len(keys) + 1))
        self.low = keys
        last = first[self.by_key[self.starts[:-1]]]
        self.high = _keys(np.where(np.arange(width) < self.words[self.by_key[self.starts[:-1]], None], last, -1), width)

    def search(self, docs: list[list[bytes]]) -> list[list[tuple[str, int, int, int]]]:
        """Longest verbatim matches (item, its word, the document's word, words) of each document of a shard.

        The shard's suffix array is sorted by the first `width` words. Suffixes of fewer than `least` words of the benchmark's
        vocabulary are left out of it: no window can begin there. Both ends of each test suffix's range are found by binary search;
        a match that can be extended to the left belongs to a longer one, the others are extended to the right word by word.
        """
        out: list[list[tuple[str, int, int, int]]] = [[] for _ in docs]
        if not len(self.low) or not docs:
            return out
        gap = [0] * self.width
        flat: list[int] = [0]
        starts = []
        for words in docs:
            starts.append(len(flat))
            flat.extend(map(self.vocab.__getitem__, words))
            flat.extend(gap)
        ids = np.array(flat, dtype=np.int32)
        unknown = np.flatnonzero(ids == 0)
        known = np.flatnonzero(ids)
        run = unknown[np.searchsorted(unknown, known)] - known
        at = known[run >= self.least]
        if not len(at):
            return out
        ids = np.concatenate([ids, np.zeros(self.width, np.int32)])
        suffix = _keys(ids[at[:, None] + np.arange(self.width)], self.width)
        order = np.argsort(suffix, kind="stable")
        at, suffix = at[order], suffix[order]
        lo, hi = np.searchsorted(suffix, self.low, "left"), np.searchsorted(suffix, self.high, "right")
        begin = np.array(starts)
        met = np.flatnonzero(hi > lo)
        each = (hi - lo)[met] * np.diff(self.starts)[met]
        for group in np.split(met, np.flatnonzero(np.diff(np.cumsum(each) // _PAIRS)) + 1):
            p, q = self._maximal(ids, at, lo, hi, group)
            n = self.words[q].copy()
            on = np.arange(len(p))
            while len(on):
                on = on[(self.ids[self.at[q[on]] + n[on]] == ids[p[on] + n[on]]) & (ids[p[on] + n[on]] > 0)]
                n[on] += 1
            owner = np.searchsorted(begin, p, "right") - 1
            for d, item, word, first, length in zip(owner.tolist(), self.item[q].tolist(), self.word[q].tolist(), (p - begin[owner]).tolist(), n.tolist(), strict=True):
                out[d].append((self.items[item], word, first, length))
        return out

    def _maximal(self, ids: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in the shard, test suffix) under the keys whose words before differ."""
        found_p, found_q = [], []
        for key in keys.tolist():
            p, q = at[lo[key] : hi[key]], self.by_key[self.starts[key] : self.starts[key + 1]]
            before = self.ids[self.at[q] - 1]
            for first in range(0, len(p), max(1, _PAIRS // len(q))):
                part = p[first : first + max(1, _PAIRS // len(q))]
                i, j = np.nonzero((ids[part - 1][:, None] != before[None, :]) | (before[None, :] == 0))
                found_p.append(part[i])
                found_q.append(q[j])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_p or none), np.concatenate(found_q or none)


def _keys(words: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(words.astype(">i4")).view(f"S{4 * width}").ravel()


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with `n_words` (long) and `matches` (columns of these names are replaced): all longest verbatim matches of at least
    `window` words with an item, or of a whole item that has fewer.

    The benchmark is taken in blocks of about block_bytes of text, the only data that is broadcast; with more than one block the
    documents are written between passes. Each batch of documents is a shard with a suffix array of its own. Documents stay where
    they are: nothing is shuffled. Null texts have no words; a null item id counts as an empty one; repeated items count once. Rows
    that repeat an id are searched each for itself; an empty benchmark leaves `matches` empty, an empty table gives no rows. A phrase that a
    document repeats and many items share gives a match for each place and item. The session's Arrow batches stay at 1,000 rows or fewer.
    """
    spark = docs.sparkSession
    text_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = docs.drop("n_words", "matches").withColumns({"n_words": F.lit(0).cast("long"), "matches": F.array().cast(MATCHES)})
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part])
        rows = rows.mapInArrow(_searcher(shared, uuid.uuid4().hex, window, text_col), rows.schema)
        if block + 1 < blocks:
            rows = written(rows, "matches")
            shared.destroy()
    return rows


def _searcher(shared, name: str, window: int, text_col: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = held(("test suffixes", name), lambda: TestSuffixes(shared.value, window))
        for b in by_bytes(it, text_col, 4 << 20):
            docs = [words_of(t) for t in b[text_col].to_pylist()]
            new = [[dict(zip(("item_id", "item_word", "doc_word", "words"), m, strict=True)) for m in found] for found in suffixes.search(docs)]
            old = b["matches"].to_pylist()
            kind = b.schema.field("matches").type
            columns = {n: b[n] for n in b.schema.names} | {"n_words": pa.array(map(len, docs), pa.int64()), "matches": pa.array([(o or []) + n for o, n in zip(old, new, strict=True)], kind)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return batches


def n_hit(matches):
    """Words inside any match: length of the union of the intervals."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["words"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.aggregate(spans, zero, step, lambda s: s["n"]).cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a match."""
    clean = find_matches(docs.withColumns({f"__{c}": F.col(c) for c in ("n_words", "matches") if c in docs.columns}), benchmark, text_col).filter(F.size("matches") == 0)
    return clean.select(*[F.col(f"__{c}").alias(c) if c in ("n_words", "matches") else F.col(c) for c in docs.columns])
