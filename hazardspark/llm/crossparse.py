"""Language identification by cross-parsing entropy: the language whose text parses a document into the fewest phrases, each of the size
of a place in that text, wins."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import by_bytes, text_batches

_SEGMENT, _LANES = 4096, 2048
_NONE = (1 << 31) - 1


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = 48, chars: int = 768) -> dict[str, str]:
    """The labelled sample of each language: `chars` code points of each of `texts` documents in the order of a hash of id and text,
    from an offset in the whole text that the hash fixes, so that bodies count and not only openings; never of held-out rows. So a language has at most texts * chars code points, whatever the size of docs."""
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy("k", "part")
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    start = F.pmod(hashed, F.greatest(F.char_length(text_col) - chars, F.lit(0)) + 1) + 1
    rows = rows.select(F.col(lang_col).alias("lang"), hashed.alias("k"), F.col(text_col).substr(start.cast("int"), F.lit(chars)).alias("part"))
    found: dict[str, list[str]] = {}
    for r in rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= texts).orderBy("lang", "n").collect():
        found.setdefault(r["lang"], []).append(r["part"])
    return {lang: "\n".join(parts).lower() for lang, parts in found.items()}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text: a string can be read from state 0 just if it occurs in text."""
    nexts: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Automaton:
    """A suffix automaton as one compact table by row displacement: a state is its own offset, and cell state + symbol holds the state
    that the cell belongs to and the next one. So memory follows the transitions (under three for each code point of the sample),
    whatever the alphabet. `start` has the state after the first symbol of a phrase; in state `dead` every symbol begins a phrase."""

    def __init__(self, nexts: list[dict[str, int]], at: dict[str, int]):
        width = len(at) + 1
        rows = [np.array(sorted(at[c] for c in moves), np.int64) for moves in nexts]
        size = sum(map(len, rows)) + 4 * len(rows) + 2 * width + (1 << 16)
        self._used, self._taken = np.zeros(2 * size, bool), np.zeros(2 * size, bool)
        base = np.zeros(len(rows), np.int64)
        alone: dict[int, list[int]] = defaultdict(list)
        low: dict[int, int] = defaultdict(int)
        for s in sorted(range(1, len(rows)), key=lambda s: -len(rows[s])):
            if len(rows[s]) == 1:
                alone[int(rows[s][0])].append(s)
            else:
                base[s] = low[len(rows[s])] = self._place(rows[s], low[len(rows[s])])
        for c, states in alone.items():
            base[states] = self._places(c, len(states))
        self.dead = self._place(rows[0][:0], 0)
        base[0] = self.dead
        end = int(base.max()) + width + 1
        if end >= _NONE:
            raise ValueError("the language sample is too large")
        self.cells = np.full(end, _NONE << 32, np.int64)
        for s, moves in enumerate(nexts[1:], 1):
            for c, q in moves.items():
                self.cells[base[s] + at[c]] = base[s] << 32 | base[q]
        self.start = np.full(width, self.dead, np.int64)
        for c, q in nexts[0].items():
            self.start[at[c]] = base[q]
        del self._used, self._taken

    def _place(self, codes: np.ndarray, low: int) -> int:
        """The first free offset from low on, at which no cell of the row is used."""
        while True:
            free = ~self._taken[low : low + 1024]
            for c in codes.tolist():
                free &= ~self._used[low + c : low + c + 1024]
            if free.any():
                found = low + int(free.argmax())
                self._taken[found] = True
                self._used[found + codes] = True
                return found
            low += 1024

    def _places(self, code: int, n: int) -> np.ndarray:
        """Offsets of n rows with one cell each, of the same symbol."""
        found = np.flatnonzero(~self._taken[: len(self._taken) - code] & ~self._used[code:])[:n]
        self._taken[found] = self._used[found + code] = True
        return found

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether the symbol begins a phrase."""
        cell = self.cells[state + codes]
        begins = (cell >> 32) != state
        return np.where(begins, self.start[codes], cell & 0xFFFFFFFF), begins


class CrossParser:
    """The automata of all languages over one alphabet; symbols that no sample has share one code."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.place_bits = np.log2([max(2, len(samples[lang])) for lang in self.langs])
        at = {c: i + 1 for i, c in enumerate(sorted({c for t in samples.values() for c in t}))}
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in at]] = list(at.values())
        self.automata = [Automaton(suffix_automaton(samples[lang]), at) for lang in self.langs]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language, over whole texts: each phrase is the longest that occurs in the language's sample
        (one symbol at least) and the next begins at the symbol that ended it.

        To advance many lanes together, texts are cut into segments, which are first parsed from their own starts. Then each segment's
        parse is carried on past its end until it begins a phrase where the following text's own parse does too; from there on both
        are one. So the counts are those of one parse of the whole text.
        """
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        if not len(codes):
            return out
        n = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(n)
        segments = -(-n // _SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        first_of = np.cumsum(segments) - segments
        begin = (ends - n)[owner] + _SEGMENT * (np.arange(len(owner)) - first_of[owner])
        stop = np.minimum(begin + _SEGMENT, ends[owner])
        for lang, automaton in enumerate(self.automata):
            marks, state = np.zeros(len(codes), bool), np.full(len(owner), automaton.dead, np.int64)
            order = np.argsort(begin - stop, kind="stable")
            for first in range(0, len(order), _LANES):
                lanes = order[first : first + _LANES]  # the longest first, so those still running come first
                at, size, now = begin[lanes], (stop - begin)[lanes], state[lanes]
                for step, a in enumerate(np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()):
                    p = at[:a] + step
                    now[:a], marks[p] = automaton.step(now[:a], codes[p])
                state[lanes] = now
            total = np.concatenate([[0], np.cumsum(marks)])
            whole = segments == 1
            out[whole, lang] = (total[ends] - total[ends - n])[whole]
            if not whole.all():
                extra, joins = self._carried(automaton, codes, marks, state, stop, ends[owner])
                for t in np.flatnonzero(segments > 1).tolist():
                    k, at = int(first_of[t]), int(begin[first_of[t]])
                    while at < ends[t]:
                        out[t, lang] += total[stop[k]] - total[at] + extra[k]
                        at = int(joins[k])
                        k = int(first_of[t] + (at - begin[first_of[t]]) // _SEGMENT)
        return out

    @staticmethod
    def _carried(automaton: Automaton, codes: np.ndarray, marks: np.ndarray, state: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, how many phrases its carried-on parse begins before it joins the text's own parse, and where it joins
        (the text's end if it does not)."""
        extra, joins = np.zeros(len(stop), np.int64), end.copy()
        lanes = np.flatnonzero(stop < end)
        at, now = stop[lanes], state[lanes]
        while len(lanes):
            now, begins = automaton.step(now, codes[at])
            joined = begins & marks[at]
            joins[lanes[joined]] = at[joined]
            extra[lanes] += begins & ~joined
            at = at + 1
            on = ~joined & (at < end[lanes])
            lanes, at, now = lanes[on], at[on], now[on]
        return extra, joins


def predict(texts: list[str | None], parser: CrossParser) -> list[tuple[str, float]]:
    """The language and the score of each text. A language costs its phrases times log2 of its sample's length (what a pointer into the
    sample takes; over the text's length this estimates the cross entropy), so a language with a short sample, which needs more phrases
    because it knows less, is not held against long ones by bare counts. The least cost wins; the score is 1 less its ratio to the second
    least; with one language, 1 less phrases per code point. ('und', 0) if the text is null or has no letter, or nothing was learned."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    lowered = [t.lower() if t else "" for t in texts]
    ask = [i for i, t in enumerate(lowered) if any(map(str.isalpha, t))] if parser.langs else []
    if ask:
        counts = parser.phrases([lowered[i] for i in ask])
        for i, row in zip(ask, counts * parser.place_bits, strict=True):
            best = int(row.argmin())
            rest = np.delete(row, best)
            bits = float(parser.place_bits[best])
            ratio = row[best] / (rest.min() if len(rest) else max(len(lowered[i]) * bits, row[best]))
            out[i] = (parser.langs[best], float(1 - ratio))
    return out


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """docs with pred_col and score_col added (columns of these names are replaced), predicted from text_col alone.

    Null texts, texts without a letter and all texts when there is no labelled row are 'und' with score 0. Equal costs go to the
    language whose name comes first (equal samples always do). An empty table gives no rows. Rows stay where they are: nothing is shuffled. The automata are built once, from the bounded
    samples, and sent to the workers (8 bytes a transition and 4.5 MB of symbol codes)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))
    rows = docs.drop(pred_col, score_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(it, text_col, 4 << 20):
            found = predict(b[text_col].to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, pred_col, score_col]
            )

    return rows.mapInArrow(batches, schema)
