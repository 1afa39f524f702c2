r"""Chat formatting: conversations are rebuilt from an event log, then rendered with a template and a loss mask.

Events (conv_id, seq, message_id, event, role, text) in order of seq:

* ``message``: a message with a role and a text; a later one of the same message_id replaces it in place
* ``delta``: a streamed piece, appended to the message
* ``edit``: the message's text is replaced; deltas that follow extend the new text
* ``regenerate``: the text so far is discarded; deltas that follow make the new one
* ``delete``: the message goes, unless a later event brings it back

The fold runs for each message, not for each conversation: a message's last reset is found by an aggregate that is combined
before its shuffle, and the pieces after it are joined in order. So a conversation of any length is split over tasks until
its turns are put together into the one string that is the output.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` a turn. In roles and texts a backslash is doubled and every control string
of this and other common templates (``<|...``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) has one
set behind its first character, so none remains; ``unescape`` takes the character behind each backslash. Loss spans are
code points [start, end) of the escaped assistant texts within the formatted string.

Defined results: null texts and roles count as empty. An empty text makes a turn (and an empty loss span for an assistant).
Events of a null conversation form one conversation with null id. A null seq (or turn) comes after all others. Ties of seq go by event name, then text. Repeated
``delta`` events count each. Events of an unknown kind are ignored; a message with no ``message`` event has an empty role
unless another event names one. A conversation whose messages are all deleted gives no row; an empty log gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
_RESETS = ("message", "edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, place, message_id, role, text): the final messages. ``place``: whether the seq of a message's first event is null, and
    that seq."""
    seq = F.struct(F.col("seq").isNull(), F.col("seq"))
    e = events.select(
        "conv_id", seq.alias("seq"), "message_id", F.col("event").cast("string").alias("event"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where(F.col("event").isin(*_RESETS, "delta"))
    order = F.struct("seq", "event", "text")
    reset = F.col("event").isin(*_RESETS)
    state = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("place"),
        F.max(F.when(reset, F.struct("seq", "event", "text"))).alias("reset"),
        F.max(F.when(F.col("role").isNotNull(), F.struct(F.col("seq"), F.col("role")))).alias("named"),
        # Pieces that come after a message's last reset are picked below; most messages have a few events only.
        F.collect_list(F.when(F.col("event") == "delta", order)).alias("pieces"),
    )
    later = F.sort_array(F.filter("pieces", lambda p: F.col("reset").isNull() | (p["seq"] > F.col("reset.seq"))))
    base = F.when(F.col("reset.event").isin("message", "edit"), F.col("reset.text")).otherwise(F.lit(""))
    gone = (F.col("reset.event") == "delete") & (F.size(later) == 0)
    text = F.concat(base, F.array_join(F.transform(later, lambda p: p["text"]), ""))
    return state.where(~F.coalesce(gone, F.lit(False))).select("conv_id", "place", "message_id", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation of (conv_id, place, message_id, role, text)."""
    head = F.concat(F.lit(START), F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", F.struct("place", "message_id", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == TRAINED_ROLE).alias("trained")).alias("t"))
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    tune(messages.sparkSession)
    names = messages.schema["conv_id"].dataType.simpleString()

    # The mask is a running sum over the turns of one string; it is made where the string is.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for heads, bodies, trained in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                at, parts, mask = 0, [], []
                for h, x, y in zip(heads, bodies, trained):
                    at += len(h)
                    if y:
                        mask.append({"start": at, "end": at + len(x)})
                    at += len(x) + len(END)
                    parts += [h, x, END]
                texts.append("".join(parts))
                spans.append(mask)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_spans"])

    flat = got.select("conv_id", F.col("t.head"), F.col("t.body"), F.col("t.trained"))
    return flat.mapInArrow(run, f"conv_id {names}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    out = []
    for turn in formatted.split(START)[1:]:
        m = re.match(r"((?:[^\\\n]|\\.)*)\n", turn, re.DOTALL)
        out.append((unescape(m[1]), unescape(turn[m.end() : -len(END)])))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and their masks say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                told = hashlib.sha256()
                for role, x in turns:
                    told.update(f"{role}\n{x}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for c, v in zip(cols, (len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {names}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text): one ``message`` event for each row.

    Rows of the same conversation and turn (repeats included) stay messages of their own, ordered by role and text.
    """
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.struct(F.col("turn"), n.alias("n")).alias("message_id"), F.lit("message").alias("event"), "role", "text")
