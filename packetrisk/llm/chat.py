"""Chat formatting: typed content parts, reversible escapes, loss spans.

A message is a list of parts (text, image, audio, document).  A visitor flattens
them in order: text is escaped, every other part becomes a placeholder whose
reference and expanded token count are recorded.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.textops import column

TURN, END = "<s>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings with a meaning in the template, or in templates that a tokenizer may know.
CONTROL = [TURN, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *PLACEHOLDERS.values()]
_CONTROL = "|".join(re.escape(c) for c in CONTROL)
_ESCAPE = re.compile(rf"\\|(?={_CONTROL})")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TOKENS = re.compile(rf"\\.|({_CONTROL})", re.S)

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = (
    "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<turn:long,kind:string,ref:string,start:long,tokens:long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    """Put a backslash before every backslash and every control string."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one message; keeps what the placeholders stand for."""

    def __init__(self, patch: int = 28, audio_rate: int = 25, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.found: list[tuple[str, str | None, int, int]] = []
        self.at = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def emit(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.found.append((kind, part.get("ref"), self.at, tokens))
        self.emit(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self.emit(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 448, part.get("height") or 448
        self.attach("image", part, math.ceil(w / self.patch) * math.ceil(h / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        """A part of an unknown type is kept as its JSON text."""
        self.emit(escape(json.dumps({k: v for k, v in part.items() if v is not None}, sort_keys=True)))


def format_turns(turns: Iterator[tuple[str, str | None, list[dict] | None]]) -> tuple[int, str, list, list, int]:
    """(number of turns, formatted text, loss spans, attachments, tokens of all attachments)."""
    out, at, loss, attached, n = [], 0, [], [], 0
    for n, (role, text, parts) in enumerate(turns, 1):
        head = TURN + escape(role).replace("\n", "\\\n") + "\n"
        visitor = PartVisitor()
        for part in parts if parts is not None else [{"type": "text", "text": text}]:
            visitor.visit(part)
        body = "".join(visitor.out)
        begin = at + len(head)
        attached += [{"turn": n - 1, "kind": k, "ref": r, "start": begin + p, "tokens": t} for k, r, p, t in visitor.found]
        if role == "assistant":
            loss.append({"start": begin, "end": begin + len(body)})
        out += [head, body, END]
        at = begin + len(body) + len(END)
    return n, "".join(out), loss, attached, sum(a["tokens"] for a in attached)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; placeholders stay as they are in the text."""
    turns, begin = [], None
    for m in _TOKENS.finditer(formatted):
        if m[1] == TURN:
            begin = m.end()
        elif m[1] == END:
            turn = formatted[begin : m.start()]
            cut = re.match(r"(?:\\.|[^\\\n])*", turn, re.S).end()
            turns.append((unescape(turn[:cut]), unescape(turn[cut + 1 :])))
    return turns


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments (columns ``FORMATTED``).

    Rows are ordered by turn (null first), then role, then text, so ties and repeated
    rows have a fixed order; a null role or text is empty; rows with a null conversation
    form one conversation with a null id; other columns are ignored; no rows give no rows.
    The rows of a conversation are sorted by Spark and read as a stream; only the one being
    formatted is held.
    """
    kept = df.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(parts) if parts else F.lit(None)).cast(PARTS).alias("parts"),
    )
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()),
        ])
        now, held, done, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            if held:
                done.append((now, *format_turns(iter(held))))
                size += len(done[-1][2])
                held.clear()

        for batch in batches:
            rows = zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text", "parts")))
            for c, r, t, p in rows:
                if held and c != now:
                    close()
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*done), schema)], schema=schema)
                        done, size = [], 0
                now = c
                held.append((r, t, p))
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*done), schema)], schema=schema)

    return ordered.mapInArrow(run, FORMATTED)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The digests of what a reader of the formatted text gets back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            texts, spans = column(batch, "formatted").to_pylist(), column(batch, "loss").to_pylist()
            turns = [read_back(t) for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in ss) for t, ss in zip(texts, spans)]
            yield pa.RecordBatch.from_pydict({
                "conv_id": column(batch, "conv_id"), "n_turns": pa.array(map(len, turns), pa.int64()), "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns],
                "loss_chars": pa.array(map(len, loss), pa.int64()), "loss_sha256": [sha(x) for x in loss], "formatted_chars": pa.array(map(len, texts), pa.int64()), "expanded_tokens": column(batch, "expanded_tokens"),
            })

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_digests(format_chats(rows)).drop("expanded_tokens")
