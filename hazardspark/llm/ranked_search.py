"""Ranked lexical search without random access: impact-sorted lists are read in order, with an interval of scores for every document."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, held, new_path, text_batches, written
from hazardspark.llm.decontam import words_of

_SHARD = 1 << 20  # postings of a shard
_FALL = 4  # a round reads down to this part of the last round's bound


class Lists:
    """The postings of a shard of documents: of each term, documents by falling impact (the part of the score beside the term's weight)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, docs: int, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0, equal ones by smaller tie.

        Each round reads every list down to one bound of the score. A document's lower end is the sum of what was read of it, its upper
        end adds the next unread score of every list in which it was not met. Once no unmet document can enter, only those whose upper
        end reaches the k-th lower end stay, and lists are read on for them until no interval is open, so ties and scores are exact.
        """
        lists = [(int(self.starts[t]), int(self.starts[t + 1]), float(w)) for t, w in zip(terms, weights, strict=True) if w > 0 and self.starts[t + 1] > self.starts[t]]
        lower = np.zeros(docs)
        if not lists:
            return np.zeros(0, np.int64), lower[:0]
        at = [a for a, _, _ in lists]
        bound = max(w * self.impact[a] for a, _, w in lists)
        first = True
        read: list[tuple[int, np.ndarray]] = []
        while True:
            for i, (_, end, w) in enumerate(lists):
                part = self.impact[at[i] : end]
                # lists fall, so what reaches the bound is a beginning of the list
                n = len(part) - int(np.searchsorted(part[::-1], bound / w, "left"))
                if n:
                    met = self.doc[at[i] : at[i] + n]
                    lower[met] += w * part[:n]
                    read.append((i, met))
                    at[i] += n
            unread = np.array([w * self.impact[p] if p < end else 0.0 for p, (_, end, w) in zip(at, lists, strict=True)])
            least = float(np.partition(lower, docs - k)[docs - k]) if docs >= k else 0.0
            if unread.sum() < max(least, 1.0):  # scores are whole numbers
                break
            bound = min(bound / _FALL, unread.max())
            first = False
        known = np.zeros(docs)
        for i, met in read:
            known[met] += unread[i]
        upper = lower + unread.sum() - known
        stay = (upper >= least) & (lower > 0)
        while unread.any() and (upper[stay] > lower[stay]).any():
            for i, (_, end, w) in enumerate(lists):
                if at[i] < end:
                    met, part = self.doc[at[i] : end], self.impact[at[i] : end]
                    own = stay[met]
                    lower[met[own]] += w * part[own]
                    at[i] = end
            unread[:] = 0
            upper = lower
        left = np.flatnonzero(stay)
        best = left[np.lexsort((tie[left], -lower[left]))[:k]]
        return best, lower[best]


def _counter(shared, name: str, doc_col: str, text_col: str):
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(("search words", name), lambda: shared.value)
        for b in by_bytes(it, text_col):
            n, ids, tfs = [], [], []
            for text in b[text_col].to_pylist():
                words = words_of(text)
                n.append(len(words))
                found = Counter(map(vocab.get, words))
                found.pop(None, None)
                ids.append(np.fromiter(found.keys(), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b[doc_col], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return count


def _searcher(shared, name: str, n_docs: int, n_terms: int, k: int):
    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = held(("search items", name), lambda: shared.value)
        for b in _by_postings(it):
            sizes = b["terms"].value_lengths().to_numpy(zero_copy_only=False)
            doc, term = np.repeat(np.arange(len(sizes)), sizes), b["terms"].flatten().to_numpy()
            tf, n = b["tfs"].flatten().to_numpy().astype(np.int64), b["n"].to_numpy()
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            lists = Lists(term, doc, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), len(weights))
            tie = pc.rank(b["doc_id"], sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            item, place, score = [], [], []
            for i, terms in enumerate(items):
                best, scores = lists.search(terms, weights[terms], len(sizes), tie, k)
                item += [i] * len(best)
                place.append(best)
                score.append(scores.astype(np.int64))
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *place]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), b["doc_id"].take(rows), pa.array(np.concatenate([np.zeros(0, np.int64), *score]))], ["item", "doc_id", "score"])

    return search


def _by_postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about _SHARD postings, one document at least."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        ends = np.cumsum(b["terms"].value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _SHARD - size, "right")))
            waiting.append(b.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= _SHARD or start < b.num_rows:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each item, equal scores by ascending doc_id.

    Terms: ASCII letters and digits (A-Z in lower case) and all beyond ASCII. N: documents with a term, L: all their terms, n: one
    document's, df: documents that hold a term, tf: how often. Weight: floor(1000 ln((2N+2)/(2df+1))); m = 10 + 90 n N div L; a term adds
    weight * (10^9 tf div (1000 tf + 8 m)).

    Null and empty texts have no terms: such documents are found by no item, such items find nothing. Rows that repeat an id are
    documents of their own and null ids come last among equal scores; items alike in id and text count once, and items that share an
    id but not the text have ranks of their own. Empty tables give no rows. Only the named columns are read.

    Items are taken in blocks of about block_bytes of text, the only data that is broadcast: their words and, once counted over all
    documents, the words' weights. For each block one pass counts the block's words in every document, and one reads those counts as
    shards of about a million postings, each with its impact-sorted lists; a shard's firsts are merged by Spark. Texts are not moved.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    path = new_path(spark, "ranked")
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id {id_type}, score long"
    totals = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        vocab: dict[bytes, int] = {}
        terms = [np.array([vocab.setdefault(w, len(vocab)) for w in dict.fromkeys(words_of(r["text"]))], np.int64) for r in part]
        words, name = spark.sparkContext.broadcast(vocab), uuid.uuid4().hex
        counts = written(rows.mapInArrow(_counter(words, name, "doc_id", "text"), f"doc_id {id_type}, n long, terms array<int>, tfs array<int>"), "search-counts")
        if totals is None:
            totals = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        weight = F.floor(1000 * F.log((2 * totals["N"] + 2) / (2 * F.count("*") + 1))).cast("long").alias("weight")
        weights = np.zeros(len(vocab), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(weight).collect():  # a row a word of the block
            weights[r["term"]] = r["weight"]
        shared = spark.sparkContext.broadcast((terms, weights))
        found = counts.filter("size(terms) > 0").mapInArrow(_searcher(shared, name, totals["N"], totals["L"], k), f"item int, doc_id {id_type}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], f"item int, item_id {item_type}")
        best.join(names, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        words.destroy()
        shared.destroy()
    return spark.read.schema(schema).parquet(path)
