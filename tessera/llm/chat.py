"""Chat formatting by event-sourced reconstruction: logs of deltas, edits and regenerations fold into messages, then render."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Events of a log. message opens a turn with a text; delta adds to a turn; edit replaces its text; regenerate empties it
#: for the deltas that follow; delete takes the turn away.
EVENTS = ("message", "delta", "edit", "regenerate", "delete")
# Fixed values of the template: a turn is "### Role: text </turn>\n". In roles and texts a backslash goes before every one of these.
OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
LOSS_ROLE = "assistant"
#: Code points of a delta; in log_of() the steps of one turn's events, and the step of the first delta that lasts.
CHUNK, _TURN, _FINAL = 512, 1 << 24, 16
RENDERED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(x: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], x)


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1", x)


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of a chat service that would have led to it.

    Turns are numbered per conversation by turn, role and text, so repeated rows are turns of their own; each is opened by a
    message without text and streamed as deltas of CHUNK code points. By a hash of its place every eighth turn streams a
    draft first and is regenerated, every eighth streams a draft that an edit mends after the next turns have
    begun, every eighth follows a turn that is deleted again. The rows come last event first: only seq has the order.
    A row without conv_id is a conversation of its own, without any of these.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lone.alias("lone"))
    n = F.row_number().over(Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("n", F.coalesce(F.col("lone"), n)).withColumn("kind", F.when(F.col("lone").isNull(), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))).otherwise(7))

    def event(name: str, step, text, target=F.col("n")):
        return F.struct((F.col("n") * _TURN + step).alias("seq"), target.alias("target"), F.lit(name).alias("event"), (F.col("role") if name == "message" else F.lit(None).cast("string")).alias("role"), text.alias("text"))

    def stream(text, first: int):
        """Deltas of a text from that step on."""
        starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(CHUNK))
        return F.transform(F.filter(starts, lambda at: at < F.length(text)), lambda at: event("delta", F.lit(first) + (at / CHUNK).cast("long"), F.substring(text, at + 1, F.lit(CHUNK))))

    none, text, draft = F.lit(None).cast("string"), F.col("text"), F.col("draft")
    rows = rows.withColumn("draft", F.when(F.col("kind") < 3, F.concat(F.lit("draft: "), F.substring(text, 1, 2 * CHUNK))))
    opened, late = event("message", F.lit(1), none), F.lit(2 * _TURN + 3)
    plain = F.concat(F.array(opened), stream(text, _FINAL))
    log = (
        F.when(F.col("kind") == 0, F.concat(F.array(opened, event("regenerate", F.lit(_FINAL - 1), none)), stream(draft, 2), stream(text, _FINAL)))
        .when(F.col("kind") == 1, F.concat(F.array(opened, event("edit", late, text)), stream(draft, 2)))
        .when(F.col("kind") == 2, F.concat(F.array(event("message", F.lit(0), draft, -F.col("n") - 1), event("delete", F.lit(_FINAL - 1), none, -F.col("n") - 1)), plain))
        .otherwise(plain)
    )
    out = rows.select("conv_id", F.explode(F.reverse(log)).alias("e"))
    return out.select("conv_id", "e.seq", "e.target", "e.event", "e.role", "e.text")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


class _Fold:
    """One conversation's turns while its events stream by in order. Turns are known by the seq that opened them."""

    def __init__(self) -> None:
        self.turns: dict[object, list] = {}
        self.n = 0

    def take(self, seq, target, event, role, text) -> None:
        at = seq if target is None else target
        if event == "message":
            self.n += 1
            self.turns[(at, self.n) if at in self.turns else at] = [role or "", [text or ""]]
        elif event == "delete":
            self.turns.pop(at, None)
        elif event in ("delta", "edit", "regenerate"):
            turn = self.turns.setdefault(at, [role or LOSS_ROLE, []])
            if event != "delta":
                turn[1].clear()
            turn[1].append(text or "")

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.turns.values()]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The text of a conversation, and the spans of it, escapes included, that carry loss."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role)}: ", escape(text)
        if role == LOSS_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages back from a rendered text."""
    out, at = [], 0
    token = re.compile(r"\\(?:\\|###|</turn>|:)|" + re.escape(CLOSE) + r"|: ")
    while at < len(formatted):
        at += len(OPEN)
        head, colon = at, -1
        for m in token.finditer(formatted, at):
            if m[0] == ": " and colon < 0:
                colon = m.start()
            elif m[0] == CLOSE:
                out.append((unescape(formatted[head:colon]), unescape(formatted[colon + 2 : m.start()])))
                at = m.end()
                break
        else:
            raise ValueError("not a rendered conversation")
    return out


def format_chats(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, target, event, role, text) to one row per conversation: RENDERED.

    Events are dealt by conversation and sorted by seq, then target, event, role, text (nulls first), which settles
    ties; repeated message rows are turns of their own. They are folded as they stream by, so that memory holds the
    turns of one conversation, never a partition. A null text or role is empty; an unknown event changes nothing; a
    delta, edit or regeneration of a turn that was never opened opens it for the assistant. Events without conv_id
    can't be told to belong together: those of one target (or seq, where it is null) are a conversation each, so that they never gather in one task.
    A conversation left without turns renders to an empty text. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        done, size, fold, now, held = [], 0, None, None, None

        def close() -> None:
            nonlocal size
            text, spans = render(messages := fold.messages())
            done.append({"conv_id": now, "n_turns": len(messages), "formatted": text, "loss_spans": spans})
            size += len(text)

        for lone, conv, *event in _sorted_runs(batches):
            if fold is None or (conv, lone) != held:
                if fold is not None:
                    close()
                    if len(done) >= 2000 or size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                fold, now, held = _Fold(), conv, (conv, lone)
            fold.take(*event)
        if fold is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    order = ["conv_id", "seq", "target", "event", "role", "text"]
    lone = F.when(F.col("conv_id").isNull(), F.coalesce("target", "seq")).alias("lone")
    return events.select(lone, *order).repartition("conv_id", "lone").sortWithinPartitions("conv_id", "lone", *order[1:]).mapInArrow(run, RENDERED)


def chat_digests(rendered: DataFrame) -> DataFrame:
    """Per conversation what its rendered text says when it is read back: turns, text under the loss mask, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(formatted)
                loss = [unescape(formatted[s["start"] : s["end"]]) for s in spans]
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), digest.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rendered.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted(spark: SparkSession) -> DataFrame:
    """The conversation of the contract whose texts look like the template."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def sql_escaped(column: Column) -> Column:
    """escape() as a column expression."""
    return F.regexp_replace(column, r"(\\|###|</turn>|:)", r"\\\\$1")
