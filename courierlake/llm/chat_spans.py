"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from turns to text. The operator renders each
prefix of a conversation, compares consecutive outputs and takes what was added
as the turn's span; a template whose output for a prefix is not a prefix of the
next output rewrites history and is reported, with the first turn at which it
does. Inside its span, a turn's text is located by a second render with one
unused character in its place: what stands around that is frame, the rest is
text.

The built-in template writes `### Role: text</turn>` lines and puts a
backslash before every backslash, number sign and less-than sign of a role or
text, so no control string can come from them and unescaping is exact.

A conversation is one record: its turns meet in one row (a shuffle by
conversation), and rendering prefixes costs the square of its turns in time,
but memory only for two outputs. A worker holds one conversation at a time.

Defined results: a null text or role is empty; each row with a null conv_id is
a conversation of its own, as no two are known to belong together; turns go by turn number (null first), then role and
text, so ties and repeated rows have one order; very long texts are formatted
whole; an empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
SPECIAL = re.compile(r"[\\#<]")
ESCAPED = re.compile(r"\\(.)", re.S)
LINE = re.compile(r"### (?P<role>(?:[^\\#<:]|\\.)*): (?P<text>(?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """Turns of a text in the built-in template."""
    found, place = [], 0
    while place < len(formatted):
        m = LINE.match(formatted, place)
        if not m:
            raise ValueError(f"no turn at {place}")
        found.append((unescape(m["role"]), unescape(m["text"])))
        place = m.end()
    return found


def unused(text: str) -> str:
    """A private-use character that the text lacks, or a run of one that is longer than any in it."""
    for c in map(chr, range(0xE000, 0xF900)):
        if c not in text:
            return c
    return "\ue000" * (1 + max(map(len, re.findall("\ue000+", text))))


@dataclass
class Rendered:
    """Output, (start, end) of each turn and of its text, and the first turn at which the template rewrote history (-1: never)."""

    formatted: str
    turns: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewrites_at: int = -1


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # binary search: slices compare at memory speed
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def render(turns: list[Turn], template: Template) -> Rendered:
    """Render successive prefixes and locate what each turn added."""
    before, out = template([]), Rendered("", [], [])
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            out.rewrites_at = k if out.rewrites_at < 0 else out.rewrites_at
            start = shared_prefix(before, now)
        else:
            start = len(before)
        out.turns.append((start, len(now)))
        probe = unused(f"{before}{now}{role}")
        shown = template([*turns[:k], (role, probe)])
        at = shown.find(probe)
        head, tail = shown[:at], shown[at + len(probe) :]
        if at >= 0 and now.startswith(head) and now.endswith(tail) and len(head) + len(tail) <= len(now):
            out.texts.append((len(head), len(now) - len(tail)))
        else:
            out.texts.append((start, start))
        before = now
    out.formatted = before
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    small_batches(rows.sparkSession)
    turn = F.struct(rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"))
    own = rows.select(rows["conv_id"].cast("long").alias("conv_id"), turn.alias("t"))
    grouped = own.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.unionByName(own.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    return grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))


SCHEMA = "conv_id long, formatted string, turn_spans array<struct<start: long, end: long>>, loss_spans array<struct<start: long, end: long>>, rewrites_at long"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, so that a worker holds the text of one as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def format_chats(turns: DataFrame, template: Template = marked, learn: str = "assistant") -> DataFrame:
    """The formatted text of each conversation, its turn spans, and the spans under the loss mask (texts of the role to learn)."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", SPANS), ("loss_spans", SPANS), ("rewrites_at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in rows(b):
                said = list(zip(one["roles"], one["texts"], strict=True))
                r = render(said, template)
                spans = [{"start": a, "end": z} for a, z in r.turns]
                loss = [{"start": a, "end": z} for (role, _), (a, z) in zip(said, r.texts, strict=True) if role == learn]
                yield pa.RecordBatch.from_pylist([{"conv_id": one["conv_id"], "formatted": r.formatted, "turn_spans": spans, "loss_spans": loss, "rewrites_at": r.rewrites_at}], schema=schema)

    return conversations(turns).mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text of the built-in template and its spans read back to."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for one in rows(b):
                text = one["formatted"]
                turns = [t for s in one["turn_spans"] for t in read_back(text[s["start"] : s["end"]])]
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in one["loss_spans"])
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append({"conv_id": one["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
