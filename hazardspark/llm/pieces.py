"""Whole texts to token ids by the tokenizers library, with the ids of recurring pieces kept.

Both tokenizers cut a text into pieces before any merge, and no cut depends on what lies beyond the neighbouring white
space, so the ids of a text are those of its pieces in order. Arrow cuts and counts the pieces of a batch; only words
not met lately go through the tokenizer.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hazardspark.llm.common import held

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_STEM_RE2 = rf"^(?P<stem> ?[{_LATIN}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)$"
_WORD_RE2 = rf"^ ?[{_LATIN}]+$"
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_WHITE_RE2 = re.sub(r"\\u(\w{4})", r"\\x{\1}", _WHITE)
_IRREGULAR = f" [{_WHITE_RE2}]|[{_WHITE_RE2}] "
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = np.arange(256, dtype="<u2")
_ALPHABET[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_ALPHABET[10] = 10  # a line feed stands between words on their way to this alphabet


class PieceEncoder:
    """kind 'space': a space belongs to the word after it (byte-level BPE); 'drop': white space has no ids.

    `known` lists words and odd pieces in the order of their learning, `blobs` their ids. In kind 'space' a piece stands for itself
    with a space before it; one that really begins with a space stands for the rest without one (no cut piece holds a space).
    Control strings of the tokenizer get their own ids wherever they stand in a text, as in the plain library call.
    """

    def __init__(self, path: str, kind: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.limit = kind, limit
        self.controls = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.control = "|".join(map(re.escape, self.controls))
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.width = np.dtype(self.dtype).itemsize
        self.known = pa.array([], pa.string())
        self.blobs = pa.array([], pa.binary())

    def _tokenized(self, pieces: pa.Array) -> pa.Array:
        """Words of letters are one pre-token each: they go to the model alone, other pieces through the whole tokenizer."""
        word = pc.match_substring_regex(pieces, _WORD_RE2).to_numpy(zero_copy_only=False)
        texts = pieces.to_pylist()
        if self.kind == "space":
            texts = [p[1:] if p[:1] == " " else f" {p}" for p in texts]
        out: list = [None] * len(texts)
        words, rest = np.flatnonzero(word).tolist(), np.flatnonzero(~word).tolist()
        if words:
            joined = "\n".join([texts[i] for i in words])
            raw = (joined.lower() if self.kind == "drop" else joined).encode()
            tokenize = self.model.tokenize
            for i, w in zip(words, _ALPHABET[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split("\n"), strict=True):
                out[i] = [t.id for t in tokenize(w)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        ends = np.zeros(len(out) + 1, np.int32)
        np.cumsum([len(x) for x in out], out=ends[1:])
        ids = np.fromiter(chain.from_iterable(out), self.dtype, int(ends[-1]))
        return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends * np.int32(self.width)), pa.py_buffer(ids)])

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces (no repeats); those not known are learned."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            new = pc.is_null(at)
            places = at.fill_null(0).to_numpy().copy()
            places[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(at.null_count)
            learned = pieces.filter(new)
            self.known = pa.concat_arrays([self.known, learned])
            self.blobs = pa.concat_arrays([self.blobs, self._tokenized(learned)])
            at = pa.array(places)
        return self.blobs.take(at)

    def _taken(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and where each piece's begin (one more for the end). The marks after a word are a
        pre-token of their own, so words and marks are looked up apart."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        cut = pc.extract_regex(distinct, _STEM_RE2)
        stems = pc.coalesce(pc.struct_field(cut, "stem"), distinct).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(cut, "marks"), "").dictionary_encode()
        tails = pc.binary_join_element_wise("", marks.dictionary, " ") if self.kind == "space" else marks.dictionary
        blobs = pc.binary_join_element_wise(self._ids_of(stems.dictionary).take(stems.indices), self._ids_of(tails).take(marks.indices), pa.scalar(b"", pa.binary()))
        got = blobs.take(coded.indices)
        at = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1, got.offset * 4)
        data = got.buffers()[2]
        return (np.frombuffer(data, self.dtype, at[-1] // self.width) if data is not None and at[-1] else np.zeros(0, self.dtype)), at // self.width

    def encode_flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, end_id (if given) after each, and where each text's begin (one more for the end);
        null counts as empty."""
        if len(self.known) > self.limit:
            self.known, self.blobs = self.known[len(self.known) // 2 :], self.blobs[len(self.blobs) // 2 :]
        texts = pc.fill_null(texts, "")
        parts, last = texts, np.arange(len(texts))
        after = np.full(len(texts), -1 if end_id is None else end_id, np.int64)
        if self.control and pc.any(pc.match_substring_regex(texts, self.control)).as_py():
            split = [re.split(f"({self.control})", t) for t in texts.to_pylist()]
            parts = pa.array([p for s in split for p in s[::2]], pa.string())
            last = np.cumsum([len(s) // 2 + 1 for s in split]) - 1
            after = np.array([x for s in split for x in (*(self.controls[c] for c in s[1::2]), -1 if end_id is None else end_id)], np.int64)
        ids, at = self._parts(parts)
        follows = after >= 0
        if follows.any():
            ids = np.insert(ids.astype(self.dtype if after.max() <= np.iinfo(self.dtype).max else np.uint32, copy=False), at[1:][follows], after[follows])
            at = at + np.concatenate([[0], np.cumsum(follows)])
        return ids, np.concatenate([[0], at[1:][last]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        ids, at = self.encode_flat(texts)
        return np.split(ids, at[1:-1]) if len(texts) else []

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "drop":
            lists = pc.ascii_split_whitespace(texts)
        else:
            odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            lists = _first_bare(pc.split_pattern(texts.filter(pa.array(~odd)), " "))
            if odd.any():
                place = np.argsort(np.argsort(odd, kind="stable"), kind="stable")
                irregular = pa.array([_irregular(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
                lists = pa.concat_arrays([lists, irregular]).take(pa.array(place))
        ids, at = self._taken(lists.flatten())
        return ids, at[lists.offsets.to_numpy()]


def _irregular(text: str) -> list[str]:
    """The pieces of a text with a space beside other white space, cut by the tokenizer's own rule for white space."""
    return [p[1:] if p[0] == " " and len(p) > 1 and p[1] != " " and not p[1].isspace() else f" {p}" for p in _PIECE.findall(text)]


def _first_bare(lists: pa.Array) -> pa.Array:
    """The first piece of each text has no space before it."""
    flat, ends = lists.flatten(), lists.offsets
    mask = np.zeros(len(flat), dtype=bool)
    mask[ends.to_numpy()[:-1]] = True
    return pa.ListArray.from_arrays(ends, pc.replace_with_mask(flat, pa.array(mask), pc.binary_join_element_wise("", flat.take(ends[:-1]), " ")))


def encoder(path: str, kind: str, limit: int = 600_000) -> PieceEncoder:
    """Kept in the worker process across its tasks."""
    return held(("pieces", path, kind, limit), lambda: PieceEncoder(path, kind, limit))
