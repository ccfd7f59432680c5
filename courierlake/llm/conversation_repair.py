"""Conversation structure repair by shortest paths with Dial's bucket queue.

A node is (rows behind, state): nothing yet, after a system row, after a user
row, after an assistant row. Its arcs are the edits: Keep (0), Rerole to user or
assistant (1), Delete (2, the only one for blank and repeated rows), Insert an
empty user or assistant row (5); a truncated row that stays adds 5. Roles must
come out as `(s?(ua)+)?`, so a state leaves no choice of role to Insert and
Rerole, and an audit (the edits' initials) names one path. Costs are small
integers: distances to the end come from a circular array of buckets, and the
audit is the walk from the start that takes the ASCII-least tight arc each time.

A conversation may hold a third of all rows, so none is gathered as rows:

1. Rows that repeat within a turn are counted before they are shuffled.
2. Rows are dealt by range of (conversation, turn, role, text), sorted, and
   numbered; each becomes one byte, and a fragment holds up to FRAGMENT of them.
3. Fragments of longer conversations give the least costs between all states at
   their ends; composed backwards over a conversation they give the distances at
   each fragment's end. Fragments are then walked each by itself from every
   state, and the walks are chained.
4. The repaired text is hashed as a stream of rows in order. SHA-256 goes through
   one conversation in one task by its nature; memory holds the audit only,
   as the result's row does.

Defined results: a null in any column is one space; null conv_ids are one
conversation, and come back null; rows go by turn (null first), then role, then
text; the audit of an empty conversation is empty; a role other than those that
begin with s, u or a is never kept; very long texts are hashed as they pass; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, small_batches

SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
FRAGMENT = 1 << 16
HEAD = 128
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: State after an inserted or reroled row, and the states that such a row can follow.
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: A row's byte: its initial's place in INITIALS (3: another), and what is wrong with it.
OTHER, GONE, TRUNCATED, BLANK, REPEATED = 3, 4, 8, 16, 32
FAR = 1 << 60
ENDS = [0, FAR, FAR, 0]


def kept_state(code: int, state: int) -> int:
    """The state after a row that is kept, or -1 where it can't be."""
    who = code & 3
    if who == 0:
        return SYSTEM if state == START else -1
    return -1 if who == OTHER or NEXT[state] != who + 1 else NEXT[state]


def distances(codes: bytes, ends: list[int]) -> list[int]:
    """Least cost from every node (STATES * rows behind + state) to the end, whose states cost `ends`."""
    n = len(codes)
    least = min(ends)
    seeds = {STATES * n + q: d - least for q, d in enumerate(ends) if d < FAR}
    width = max(REROLE + CUT_OFF, INSERT, *seeds.values()) + 1
    buckets: list[list[int]] = [[] for _ in range(width)]
    out = [FAR] * (STATES * (n + 1))
    for node, d in seeds.items():
        out[node] = d
        buckets[d].append(node)
    waiting, d = len(seeds), 0
    while waiting:
        bucket = buckets[d % width]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != d:
                continue
            i, state = divmod(node, STATES)
            arcs = [(STATES * i + p, d + INSERT) for p in BEFORE[state]]
            if i:
                code, back = codes[i - 1], STATES * (i - 1)
                arcs.append((back + state, d + DELETE))
                if not code & GONE:
                    cost = d + (CUT_OFF if code & TRUNCATED else 0)
                    arcs += [(back + p, cost + REROLE) for p in BEFORE[state]]
                    arcs += [(back + p, cost) for p in range(STATES) if kept_state(code, p) == state]
            for to, cost in arcs:
                if cost < out[to]:
                    out[to] = cost
                    buckets[cost % width].append(to)
                    waiting += 1
        d += 1
    return [x + least for x in out]


def walk(codes: bytes, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits along tight arcs from `state`, and the state they end in; inserts at the end are the next fragment's."""
    n, i, out = len(codes), 0, []
    while i < n or last and dist[STATES * n + state]:
        here = dist[STATES * i + state]
        row = i < n
        to = NEXT[state]
        if row and here == DELETE + dist[STATES * (i + 1) + state]:
            out.append("D")
            i += 1
        elif here == INSERT + dist[STATES * i + to]:
            out.append("I")
            state = to
        else:
            kept = kept_state(codes[i], state)
            extra = CUT_OFF if codes[i] & TRUNCATED else 0
            if kept >= 0 and here == extra + dist[STATES * (i + 1) + kept]:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = to
            i += 1
    return "".join(out), state


def between(codes: bytes) -> list[int]:
    """Least costs from every state before the rows (STATES * from + to) to every state after them."""
    out = [FAR] * (STATES * STATES)
    for to in range(STATES):
        dist = distances(codes, [0 if q == to else FAR for q in range(STATES)])
        for state in range(STATES):
            out[STATES * state + to] = dist[state]
    return out


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PIECES = "c string, at long, nth long, codes binary"
PIECES_SCHEMA = pa.schema([("c", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("codes", pa.binary())])


def fragments(batches: Iterator[pa.RecordBatch], size: int = FRAGMENT) -> Iterator[pa.RecordBatch]:
    """Bytes of consecutive rows of a conversation, from rows (c, at, code, copies) in order of at; (at, nth copy) says where each begins."""
    c, start, follows, held = None, (0, 0), -1, bytearray()
    for b in batches:
        out = []
        for row_c, at, code, copies in zip(*(b.column(x).to_pylist() for x in ("c", "at", "code", "copies")), strict=True):
            done, again = 0, code if code & GONE else (code & 3) | GONE | REPEATED
            while done < copies:
                if held and (row_c != c or (not done and at != follows) or len(held) >= size):
                    out.append((c, *start, bytes(held)))
                    held = bytearray()
                if not held:
                    c, start = row_c, (at, done)
                if not done:
                    held.append(code)
                    done = 1
                else:
                    more = min(copies - done, size - len(held))
                    held += bytes([again]) * more
                    done += more
            follows = at + 1
        if out:
            yield table(out, PIECES_SCHEMA)
    if held:
        yield table([(c, *start, bytes(held))], PIECES_SCHEMA)


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least costs between the states at both ends of each fragment."""
    schema = pa.schema([("c", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("costs", pa.list_(pa.int64()))])
    for b in batches:
        yield table([(row["c"], row["at"], row["nth"], between(row["codes"])) for row in b.to_pylist()], schema)


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances at each fragment's end, from all fragments' costs of a conversation in order."""
    schema = pa.schema([("c", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("ends", pa.list_(pa.int64()))])
    for b in batches:
        for row in b.to_pylist():
            out, ends = [], distances(b"", ENDS)
            for part in reversed(row["parts"]):
                out.append((row["c"], part["at"], part["nth"], ends))
                ends = [min(part["costs"][STATES * p + q] + ends[q] for q in range(STATES)) for p in range(STATES)]
            yield table(out, schema)


WALKS = "c string, at long, nth long, cost long, audits array<string>, exits array<int>, first int, last int, n long, legal long, blank long, duplicate long, truncated long"
WALKS_SCHEMA = pa.schema([("c", pa.string()), *((n, pa.int64()) for n in ("at", "nth", "cost")), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("first", pa.int32()), ("last", pa.int32()), *((n, pa.int64()) for n in ("n", "legal", "blank", "duplicate", "truncated"))])
#: Initials that may stand side by side.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks of fragments (c, at, nth, codes, ends, opens, closes): from the start if it opens its conversation, else from every state."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            codes = row["codes"]
            dist = distances(codes, row["ends"])
            walks = [walk(codes, dist, q, row["closes"]) if q == START or not row["opens"] else ("", q) for q in range(STATES)]
            whos = [x & 3 for x in codes]
            legal = sum(pair in LEGAL for pair in zip(whos, whos[1:]))
            faults = [sum(bool(x & flag) for x in codes) for flag in (BLANK, REPEATED, TRUNCATED)]
            out.append((row["c"], row["at"], row["nth"], dist[START], [x[0] for x in walks], [x[1] for x in walks], whos[0], whos[-1], len(codes), legal, *faults))
        yield table(out, WALKS_SCHEMA)


def damaged(rows: DataFrame) -> DataFrame:
    """c (the conversation's key), turn, role, text, and times: how often the row is there after damage."""
    key = F.concat(F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(rows["turn"].cast("string"), F.lit(" ")))
    own = rows.select(
        F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")).alias("c"),
        rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(rows["text"].cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return own.select("c", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.cast("long").alias("times"))


def coded(first: Column) -> Column:
    """A row's byte. first: whether no earlier turn has its role and text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(bare == "", GONE | BLANK).when(~first, GONE | REPEATED).when(~F.substring(bare, -1, 1).isin(*".!?"), TRUNCATED).otherwise(0)
    return (who + fault).cast("int")


def in_order(rows: DataFrame) -> DataFrame:
    """c, at, role, text, code, copies: damaged rows numbered in order; equal rows of a turn are one."""
    counted = cut(rows.where("times > 0").groupBy("c", "turn", "role", "text").agg(F.sum("times").alias("copies")))
    digest = F.unhex(F.md5(F.encode("text", "UTF-8")))
    again = counted.groupBy("c", "role", digest.alias("digest")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = counted.withColumn("digest", digest).join(again.drop("n"), ["c", "role", "digest"], "left")
    first = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))
    found = found.select("c", "turn", "role", "text", "copies", coded(first).alias("code"))
    # samples of the key go through the driver, so long texts are dealt by their beginnings; these sort as the texts do
    head = F.substring("text", 1, HEAD)
    dealt = found.repartitionByRange("c", "turn", F.substring("role", 1, HEAD), head).sortWithinPartitions("c", "turn", "role", "text")
    out = cut(dealt.select("c", F.monotonically_increasing_id().alias("at"), "role", "text", "code", "copies"))
    drop(counted)
    return out


HASHED = "c string, repaired_sha256 string"


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows, from its audit (at -1) and its rows in order."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])
    c, audit, place, state, digest, begun = None, "", 0, START, hashlib.sha256(), False

    def say(role: str, text: str) -> None:
        nonlocal begun
        digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
        begun = True

    def inserts() -> None:
        nonlocal place, state
        while audit[place : place + 1] == "I":
            state = NEXT[state]
            say(ROLE[state], "")
            place += 1

    for b in batches:
        out = []
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            if row["at"] < 0:
                if c is not None:
                    inserts()
                    out.append((c, digest.hexdigest()))
                c, audit, place, state, digest, begun = row["c"], row["text"], 0, START, hashlib.sha256(), False
                continue
            for _ in range(row["copies"]):
                inserts()
                edit, place = audit[place], place + 1
                if edit == "K":
                    state = kept_state(INITIALS.index(row["role"][0]), state)
                    say(row["role"], row["text"])
                elif edit == "R":
                    state = NEXT[state]
                    say(ROLE[state], row["text"])
        if out:
            yield table(out, schema)
    if c is not None:
        inserts()
        yield table([(c, digest.hexdigest())], schema)


PART = ["c", "at", "nth"]


def solved(pieces: DataFrame) -> DataFrame:
    """Walks of all fragments, along distances that hold for the whole conversation."""
    whole = pieces.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("at", "nth")).alias("first"), F.max(F.struct("at", "nth")).alias("last"))
    costs = pieces.join(whole.where("n > 1").select("c"), "c", "left_semi").mapInArrow(told, "c string, at long, nth long, costs array<long>")
    parts = costs.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "costs"))).alias("parts"))
    ends = parts.mapInArrow(composed, "c string, at long, nth long, ends array<long>")
    here = F.struct("at", "nth")
    known = pieces.join(whole, "c").join(ends, PART, "left").select(*PART, "codes", F.coalesce("ends", F.array(*(F.lit(x).cast("long") for x in ENDS))).alias("ends"), (here == F.col("first")).alias("opens"), (here == F.col("last")).alias("closes"))
    # bytes say little about the work here: as many tasks as the session sets, not as few as hold the bytes
    dealt = known.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PART)
    return dealt.mapInArrow(walked, WALKS)


def chained(walks: DataFrame) -> DataFrame:
    """c, audit, cost, illegal and fault counts of conversations from their fragments' walks."""
    order = F.array_sort(F.collect_list(F.struct("at", "nth", "exits", "first", "last"))).alias("parts")
    listed = walks.groupBy("c").agg(order, F.min_by("cost", F.struct("at", "nth")).alias("cost"), *(F.sum(n).alias(n) for n in ("n", "legal", "blank", "duplicate", "truncated")))
    seams = F.aggregate(F.transform("parts", lambda x, i: F.when((F.get("parts", i - 1)["last"] * 10 + x["first"]).isin(*(a * 10 + b for a, b in LEGAL)), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    listed = cut(listed.withColumn("illegal", F.col("n") - 1 - F.col("legal") - seams))
    step = F.struct(F.lit(START).alias("state"), F.array().cast("array<int>").alias("entries"))
    entries = F.aggregate("parts", step, lambda a, x: F.struct(F.get(x["exits"], a["state"]).alias("state"), F.concat(a["entries"], F.array(a["state"])).alias("entries")), lambda a: a["entries"])
    entered = listed.select("c", F.explode(F.arrays_zip(F.col("parts"), entries.alias("entries"))).alias("x")).select("c", "x.parts.at", "x.parts.nth", F.col("x.entries").alias("entry"))
    audits = walks.select(*PART, "audits").join(entered, PART).select(*PART, F.get("audits", F.col("entry")).alias("audit"))
    audits = audits.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "audit"))).alias("audits"))
    audits = audits.select("c", F.array_join(F.transform("audits", lambda x: x["audit"]), "").alias("audit"))
    return listed.select("c", "cost", "illegal", "blank", "duplicate", "truncated").join(audits, "c")


def repair(rows: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows, after damage."""
    small_batches(rows.sparkSession)
    harmed = damaged(rows)
    ordered = in_order(harmed)
    pieces = cut(ordered.select("c", "at", "code", "copies").mapInArrow(lambda batches: fragments(batches, fragment), PIECES))
    walks = cut(solved(pieces))
    drop(pieces)
    done = cut(chained(walks))
    drop(walks)
    opening = done.select("c", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    stream = ordered.select("c", "at", "role", "text", "copies").unionByName(opening).repartition("c").sortWithinPartitions("c", "at")
    hashed = stream.mapInArrow(repaired, HASHED)
    turns = harmed.groupBy("c", "turn").agg(F.max(F.when(F.col("times") > 0, F.col("turn"))).alias("turn_left"))
    gaps = turns.groupBy("c").agg(F.coalesce(F.max("turn_left") - F.min("turn_left") + 1 - F.count("turn_left"), F.lit(0)).cast("long").alias("gaps"))
    found = gaps.join(done, "c", "left").join(hashed, "c", "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    conv_id = F.when(F.col("c") != " ", F.col("c")).cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return found.select(conv_id, "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
