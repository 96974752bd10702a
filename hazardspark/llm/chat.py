"""Chat text from turns of typed content parts, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of common chat templates, this one's among them; none survives inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_ADD = re.compile("(" + "|".join(sorted({re.escape(c[0]) for c in CONTROL})) + r")(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_REMOVE = re.compile("(" + "|".join(sorted({re.escape(c[0]) for c in CONTROL})) + r")\\(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.DoubleType())])
ATTACHMENT = T.StructType(
    [T.StructField("turn_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]
)
#: Tokens that a placeholder stands for: of an image by 28 x 28 pixel tiles (units: pixels), of audio by second, of a document by page.
TOKENS_PER_UNIT = {"image": 1 / 784, "audio": 25.0, "document": 600.0}


def escape(text: str) -> str:
    """One backslash goes behind the first character of every control string, and of every string that only backslashes there keep
    from being one; so nothing in the result is a control string and `unescape` gives the text back."""
    return _ADD.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _REMOVE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one turn in order: text is escaped, any other part becomes its placeholder and an attachment."""

    out: list[str] = field(default_factory=list)
    at: int = 0
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._put(part.get("text") or "")

    def _attach(self, kind: str, part: dict) -> None:
        self.attachments.append((kind, part.get("ref"), self.at, max(1, round((part.get("units") or 0) * TOKENS_PER_UNIT[kind]))))
        self._put("\0")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def flatten(parts: list[dict]) -> tuple[str, list[tuple[str, str | None, int, int]]]:
    """Body text of a turn and its attachments (kind, reference, place of the placeholder in the body, expanded tokens)."""
    seen = Flattener()
    for p in parts:
        seen.visit(p)
    body, moved, last = [], [], 0
    length = 0
    raw = "".join(seen.out)
    for kind, ref, at, tokens in seen.attachments:
        for s in (escape(raw[last:at]), f"<|{kind}|>"):
            place = length
            body.append(s)
            length += len(s)
        moved.append((kind, ref, place, tokens))
        last = at + 1
    body.append(escape(raw[last:]))
    return "".join(body), moved


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, media_tokens) of every conversation.

    A turn is `<|im_start|>role\\n body <|im_end|>\\n`. Its body is text_col (null: empty), or parts_col, an array of typed parts:
    text, image, audio and document; an unknown type counts as text. loss holds [start, end) in code points of each body whose
    role is `learn`; attachments hold turn number, kind, reference, place in `formatted` and expanded tokens. Turns are ordered by
    turn (nulls first), then role and text; a null role is empty; a null id is a conversation of its own. Turns are formatted row
    by row before the shuffle, which moves each formatted turn once; only a conversation's own turns are put together. Turns that
    repeat all of turn, role and text stay, each once more; an empty table gives no rows; columns that are not named are not read.
    """
    spark_parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), spark_parts.cast(T.ArrayType(PART)).alias("parts"))
    found = T.ArrayType(T.StructType(ATTACHMENT.fields[1:]))
    schema = T.StructType([rows.schema["conv_id"], rows.schema["turn"], T.StructField("role", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("body_at", T.LongType()), T.StructField("body_chars", T.LongType()), T.StructField("found", found)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
        for b in it:
            segments, at, chars, media = [], [], [], []
            for role, parts in zip(b["role"].to_pylist(), b["parts"].to_pylist(), strict=True):
                body, moved = flatten(parts or [])
                head = f"<|im_start|>{escape_role(role)}\n"
                segments.append(f"{head}{body}<|im_end|>\n")
                at.append(len(head))
                chars.append(len(body))
                media.append([{"kind": k, "ref": r, "at": len(head) + p, "tokens": n} for k, r, p, n in moved])
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["turn"], b["role"], pa.array(segments, pa.string()), pa.array(at, pa.int64()), pa.array(chars, pa.int64()), pa.array(media, kind)], schema.names
            )

    before = Window.partitionBy("conv_id").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.mapInArrow(batches, schema).withColumn("start", F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)))
    convs = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "start", "body_at", "body_chars", "found"))).alias("turns"))
    body = lambda t: t["start"] + t["body_at"]
    spans = F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: F.array(body(t), body(t) + t["body_chars"]))
    media = F.flatten(F.transform("turns", lambda t, i: F.transform(t["found"], lambda m: F.struct(i.alias("turn_no"), m["kind"].alias("kind"), m["ref"].alias("ref"), (t["start"] + m["at"]).alias("at"), m["tokens"].alias("tokens")))))
    return convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), spans.alias("loss"), media.alias("attachments")).withColumn(
        "media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, m: s + m["tokens"])
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars): roles and texts read back from `formatted`, and the unescaped text under the loss mask."""
    schema = T.StructType([chats.schema["conv_id"], T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in it:
            texts = b["formatted"].to_pylist()
            turns = [[{"role": unescape_role(m[1]), "text": unescape(m[2])} for m in _TURN.finditer(t)] for t in texts]
            loss = ["".join(unescape(t[a:e]) for a, e in spans) for t, spans in zip(texts, b["loss"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return chats.select("conv_id", "formatted", "loss").mapInArrow(batches, schema)
