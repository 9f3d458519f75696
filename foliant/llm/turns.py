"""Repair of conversation structure: the cheapest edits after which roles read (s?(ua)+)?.

The states are what the repaired roles read so far: nothing, a system turn, a user turn last, an assistant turn last. Costs
are a tensor of time x conversation x state. Conversations are bucketed by length; the costs of all conversations of a bucket are updated
a turn at a time, from the last to the first, and kept; the edits are then traced for all of them, a turn at a time.

A conversation of usual size is solved where a shuffle brings its rows together. Longer ones (LONG_ROWS, LONG_BYTES) are dealt by range and
cut into segments. A segment's costs from each state to each are a small matrix; the matrices of a conversation give the costs that
follow each segment, with which it is traced from every state apart from the others; the traces then follow from one
another. So no task holds a long conversation; only its SHA-256, which is sequential by definition, is made by one task, as its turns stream by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, release, small_batches

LONG_ROWS, LONG_BYTES = 4096, 8 << 20
#: Rows of a long conversation that are solved at once.
SEGMENT = 1 << 16
#: Ids of long conversations that are broadcast; more are joined.
BROADCAST_IDS = 100_000

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "?uas"  # by code; 0 is any other
#: The state after a user or assistant turn that follows a state, and that of a kept turn by its code; -1: may not be kept.
TURN = np.array([USER, USER, ASSISTANT, USER])
KEEP = np.array([[-1, USER, -1, SYSTEM], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 48
ACCEPT = np.array([0, NEVER, NEVER, 0])
OPS = np.frombuffer(b"DIKR", np.uint8)
LEGAL = np.zeros((4, 4), bool)
LEGAL[[3, 1, 2], [1, 2, 1]] = True


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs (..., state) when turns may be inserted first; a third is never of use."""
    return np.minimum(costs, np.minimum(INSERT + costs[..., TURN], 2 * INSERT + costs[..., TURN[TURN]]))


def choices(after: np.ndarray, code: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (n, state) of deleting, keeping and reroling a turn, by the costs after it."""
    stay = np.where(fault == TRUNCATED, LEFT_TRUNCATED, np.where(fault > 0, NEVER, 0))[:, None]
    to = KEEP.T[code]
    kept = np.where(to < 0, NEVER, np.take_along_axis(after, np.maximum(to, 0), axis=1))
    return DELETE + after, kept + stay, REROLE + after[:, TURN] + stay


def backward(code: np.ndarray, fault: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (time + 1, n, state) to go before each turn, of code and fault (time, n) whose columns have `lengths` turns; end (n, state) is what follows them."""
    out = np.empty((len(code) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(code) - 1, -1, -1):
        d, k, r = choices(out[t + 1], code[t], fault[t])
        before = np.minimum(inserted(np.minimum(np.minimum(d, k), r)), NEVER)
        out[t] = np.where((t < lengths)[:, None], before, out[t + 1])
    return out


def trace(costs: np.ndarray, code: np.ndarray, fault: np.ndarray, lengths: np.ndarray, state: np.ndarray, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edits (n, steps) as ASCII, 0 between them, and the states they end in: the ASCII-least of the cheapest. closing: turns may be inserted at the end."""
    n, line = len(state), np.arange(len(state))
    out = np.zeros((len(costs), 3, n), np.uint8)
    state = state.copy()
    for t in range(len(code)):
        d, k, r = choices(costs[t + 1], code[t], fault[t])
        here = t < lengths
        for step in range(3):
            best, to = costs[t][line, state], TURN[state]
            fit = np.stack([d[line, state] == best, INSERT + costs[t][line, to] == best, k[line, state] == best, r[line, state] == best])
            op = np.where(fit.any(axis=0), fit.argmax(axis=0), 0)
            out[t, step] = np.where(here, OPS[op], 0)
            after = np.choose(op, [state, to, KEEP[state, code[t]], to])
            state = np.where(here, after, state)
            here &= op == 1
    for step in range(3 if closing else 0):
        more = costs[-1][line, state] > 0
        out[-1, step] = np.where(more, OPS[1], 0)
        state = np.where(more, TURN[state], state)
    return out.reshape(-1, n).T, state


class Solved(NamedTuple):
    cost: np.ndarray
    audit: np.ndarray  # objects: bytes
    state: np.ndarray


def padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of values as columns, time first."""
    at = starts + np.minimum(np.arange(lengths.max(initial=0))[:, None], np.maximum(lengths - 1, 0))
    return values[np.minimum(at, len(values) - 1)] if len(values) else np.zeros((0, len(starts)), values.dtype)


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of runs whose lengths have the same number of bits."""
    size = np.frexp(lengths)[1]
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def solve(code: np.ndarray, fault: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: np.ndarray, state: np.ndarray, closing: bool = True) -> Solved:
    """Cheapest edits of each run of turns, from `state` on to costs `end` (n, state)."""
    cost, audit, last = np.zeros(len(starts), np.int64), np.empty(len(starts), object), state.copy()
    for use in buckets(lengths):
        c, f = padded(code, starts[use], lengths[use]), padded(fault, starts[use], lengths[use])
        costs = backward(c, f, lengths[use], inserted(end[use]) if closing else end[use])
        cost[use] = costs[0][np.arange(len(use)), state[use]]
        edits, last[use] = trace(costs, c, f, lengths[use], state[use], closing)
        audit[use] = [row[row > 0].tobytes() for row in edits]
    return Solved(cost, audit, last)


def matrices(code: np.ndarray, fault: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, from, to): the cheapest edits of each run between states, without insertions at its end."""
    out = np.empty((len(starts), 4, 4), np.int64)
    for use in buckets(lengths):
        c, f = padded(code, starts[use], lengths[use]), padded(fault, starts[use], lengths[use])
        for to in range(4):
            end = np.full((len(use), 4), NEVER)
            end[:, to] = 0
            out[use, :, to] = backward(c, f, lengths[use], end)[0]
    return out


def emitted(audit: bytes, code: np.ndarray, state: int) -> Iterator[tuple[int, str]]:
    """Of each turn that the edits give: the number of the turn it was, or -1, and its new role, or empty where it keeps its own."""
    turn = 0
    for op in audit.decode():
        if op == "K":
            state = int(KEEP[state, code[turn]])
            yield turn, ""
        elif op != "D":
            state = int(TURN[state])
            yield (turn if op == "R" else -1), ROLES[state]
        turn += op != "I"


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as they are after damage, chosen by CRC-32 of `conv_id:turn`; `present` is false for a dropped turn, which still names its conversation.

    Of 20 cases 0 drops a turn, 1 empties its text, 2 removes `.!?` from it, 3 repeats it, 4 makes it a user's. Nulls are one space each.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(case == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (case != 0).alias("present"), copies.alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """With the code of each role, what its text alone shows (0, BLANK, TRUNCATED) and a digest of both."""
    body = F.expr(r"trim(TRAILING '\u0020\u0009\u000a\u000b\u000c\u000d' FROM text)")
    code = F.greatest(F.instr(F.lit(INITIALS[1:]), F.substring("role", 1, 1)), F.lit(0))
    code = F.when(F.col("role") == "", 0).otherwise(code).cast("int")
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "present", code.alias("code"), fault.cast("int").alias("fault"), digest.alias("digest"))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(rows: pa.Table) -> dict:
    """The columns of REPORT and the conversations' first rows, of rows whose conversations lie together, each in order."""
    codes = pc.fill_null(rows["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    n = len(first)
    present = np.flatnonzero(rows["present"].to_numpy())
    of = (np.searchsorted(first, np.arange(rows.num_rows), "right") - 1)[present]
    rows = rows.take(pa.array(present))
    code, fault, turn = rows["code"].to_numpy().astype(np.int64), rows["fault"].to_numpy().astype(np.int64), rows["turn"]
    digest = rows["digest"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    again = np.ones(len(of), bool)
    again[np.unique(of * (len(of) + 1) + digest, return_index=True)[1]] = False
    fault = np.where(fault == BLANK, BLANK, np.where(again, DUPLICATE, fault))
    together = of[1:] == of[:-1]
    tell = lambda which: np.bincount(of[which], minlength=n)
    numbered = pc.is_valid(turn).to_numpy()
    turns, whose = turn.drop_null().to_numpy(), of[numbered]
    new = np.diff(whose, prepend=-1) != 0
    distinct = np.bincount(whose[new | (np.diff(turns, prepend=turns[:1]) != 0)], minlength=n)
    gaps = np.zeros(n, np.int64)
    last = np.append(new[1:], True)[: len(new)]
    gaps[whose[new]] = turns[last] - turns[new] + 1 - distinct[whose[new]]
    lengths = np.bincount(of, minlength=n)
    starts = np.cumsum(lengths) - lengths
    found = solve(code, fault, starts, lengths, np.broadcast_to(ACCEPT, (n, 4)), np.full(n, START))
    role, text = rows["role"].to_pylist(), rows["text"].to_pylist()
    hashed = []
    for i, s in enumerate(starts.tolist()):
        lines = [(r or role[s + k]) + ":" + (text[s + k] if k >= 0 else "") for k, r in emitted(found.audit[i], code[s:], START)]
        hashed.append(hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())
    illegal = np.flatnonzero(together)[~LEGAL[code[:-1], code[1:]][together]]
    counts = [gaps, *(tell(fault == k) for k in (BLANK, DUPLICATE, TRUNCATED)), tell(illegal), found.cost, [a.decode() for a in found.audit], hashed]
    return {"first": first} | dict(zip((c.split()[0] for c in REPORT.split(", ")), counts, strict=True))


def _together(rows: DataFrame) -> DataFrame:
    """The report of each conversation of rows, which come by conversation and in order; one that a batch cuts waits for the next."""
    conv = rows.schema["conv_id"]
    from pyspark.sql.types import StructType

    target = StructType([conv, *StructType.fromDDL(REPORT)])

    def made(part: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
        found = _report(part)
        ids = part["conv_id"].take(pa.array(found.pop("first"))).combine_chunks()
        return pa.RecordBatch.from_arrays([ids.cast(schema[0].type), *(pa.array(v, schema.field(c).type) for c, v in found.items())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(target), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held else table
            ids = pc.fill_null(held["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
            new = np.flatnonzero(np.diff(ids))
            if len(new):
                yield made(held.slice(0, int(new[-1]) + 1), schema)
                held = held.slice(int(new[-1]) + 1)
        if held:
            yield made(held, schema)
        del held
        release()

    return rows.mapInArrow(run, target)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment: int = SEGMENT) -> DataFrame:
    """A report of each conversation of rows (conv_id, turn, role, text, present; see damage).

    Turns are taken in order, null turns first; turns with one number by a digest of role and text. A turn's first fault counts: blank (white space alone), duplicate (role and text
    seen earlier), truncated (its last character that is no white space is not `.!?`). gaps are the numbers missing between the least and the largest turn.
    illegal counts neighbours whose roles do not start su, ua or au. cost and audit are those of the cheapest edits (Keep, Rerole, Delete, Insert), ties to the
    ASCII-least; repaired_sha256 is that of the repaired `role:text` lines.

    A conversation without a present turn has zeros, an empty audit and the hash of nothing; rows with a null conv_id are one conversation; a role of another initial, or empty, can't be kept.
    Repeated rows are duplicates; an empty table gives none. Conversations of over long_rows rows or long_bytes bytes go in segments.
    """
    small_batches(rows.sparkSession)
    marked = _marked(rows)
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    long = marked.groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("bytes")).where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))
    ids = materialise(long.select(F.col("conv_id").alias("long_id")), "long-conversations")
    many = ids.count()
    if many:
        ids = F.broadcast(ids) if many <= BROADCAST_IDS else ids
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        short, long = marked.join(ids, same, "left_anti"), marked.join(ids, same, "left_semi")
    else:
        short, long = marked, None
    found = _together(short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest"))
    return found if long is None else found.unionByName(_segmented(long, segment))


def _segmented(rows: DataFrame, segment: int) -> DataFrame:
    """The report of long conversations; see the module's head."""
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "long-rows")
    first = rows.where("present").groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    judged = rows.where("present").join(first, "row", "left").select("conv_id", "turn", "digest", "row", "code", fault.alias("fault"))
    n = rows.count()
    order = ["conv_id", "turn", "digest", "row"]
    dealt = judged.repartitionByRange(max(1, -(-n // segment), int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    ordered = materialise(_cut(dealt, segment), "long-order")
    pieces = materialise(ordered.groupBy("conv_id", "part", "seg").agg(F.sort_array(F.collect_list(F.struct("seq", "code", "fault", "row"))).alias("turns")), "segments")
    conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
    costs = materialise(map_batches(pieces, f"{conv}, part int, seg int, moves array<long>, first int, last int, illegal long", _moves), "moves")
    listed = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "moves", "first", "last", "illegal"))).alias("parts"))
    after = materialise(map_batches(listed, f"{conv}, illegal long, cost long, ends array<struct<part int, seg int, after array<long>, closing boolean>>", _ends), "ends")
    each = after.select("conv_id", F.explode("ends").alias("e")).select(F.col("conv_id").alias("of"), "e.*")
    at = pieces.join(each, pieces.conv_id.eqNullSafe(each.of) & (pieces.part == each.part) & (pieces.seg == each.seg)).select(pieces.conv_id, pieces.part, pieces.seg, "turns", "after", "closing")
    traced = materialise(map_batches(at, f"{conv}, part int, seg int, audits array<string>, states array<int>", _traces), "traces")
    listed = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "states"))).alias("parts"))
    entered = map_batches(listed, f"{conv}, ways array<struct<part int, seg int, state int>>", _ways).select(F.col("conv_id").alias("of"), F.explode("ways").alias("w")).select("of", "w.*")
    chosen = traced.join(entered, traced.conv_id.eqNullSafe(entered.of) & (traced.part == entered.part) & (traced.seg == entered.seg)).select(traced.conv_id, traced.part, traced.seg, "state", F.col("audits")[F.col("state")].alias("audit"))
    chosen = materialise(chosen, "edits")
    lines = map_batches(pieces.join(chosen.withColumnsRenamed({"conv_id": "of", "part": "p", "seg": "s"}), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s"))).select("conv_id", "part", "seg", "turns", "state", "audit"), f"{conv}, part int, seg int, place int, row long, new string", _lines)
    lines = lines.join(rows.select("row", "role", "text"), "row", "left")
    line = F.concat(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")), F.lit(":"), F.coalesce("text", F.lit("")))
    hashed = _hashed(lines.select("conv_id", "part", "seg", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "place"))
    tell = lambda k, name: F.count(F.when(F.col("fault") == k, 1)).alias(name)
    counts = judged.groupBy("conv_id").agg(tell(BLANK, "blank"), tell(DUPLICATE, "duplicate"), tell(TRUNCATED, "truncated"))
    numbers = judged.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    audit = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("part", "seg", "audit"))), lambda x: x["audit"])).alias("audit")
    edits = chosen.groupBy("conv_id").agg(audit)
    out = rows.select("conv_id").distinct()
    for more in (numbers, counts, after.select("conv_id", "illegal", "cost"), edits, hashed):
        out = out.join(more.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _cut(rows: DataFrame, segment: int) -> DataFrame:
    """Rows in order with their partition, their number there and that of their segment: of one conversation and at most `segment` rows."""
    from pyspark.sql.types import StructType

    target = StructType([*rows.schema, *StructType.fromDDL("part int, seg int, seq long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(target), TaskContext.get().partitionId()
        seq = seg = n = 0
        held: object = run  # no conversation
        for batch in batches:
            segs = np.empty(batch.num_rows, np.int32)
            for i, conv in enumerate(batch["conv_id"].to_pylist()):
                if conv != held or n == segment:
                    seg, n, held = seg + 1, 0, conv
                segs[i] = seg
                n += 1
            columns = {"part": np.full(batch.num_rows, part, np.int32), "seg": segs, "seq": np.arange(seq, seq + batch.num_rows)}
            seq += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(columns[f.name], f.type) for f in list(schema)[-3:])], schema=schema)

    return rows.mapInArrow(run, target)


def _turns(column: pa.Array) -> tuple[np.ndarray, ...]:
    """code, fault, row of all turns of a column of segments, and where each starts and how many it has."""
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    code, fault, row = (flat.field(k).to_numpy().astype(np.int64) for k in ("code", "fault", "row"))
    return code, fault, row, np.cumsum(lengths) - lengths, lengths


def _moves() -> Callable:
    def step(batch: pa.RecordBatch) -> dict:
        code, fault, _, starts, lengths = _turns(batch["turns"])
        of = np.repeat(np.arange(len(starts)), lengths)
        wrong = (of[1:] == of[:-1]) & ~LEGAL[code[:-1], code[1:]]
        illegal = np.bincount(of[1:][wrong], minlength=len(starts))
        return {c: batch[c] for c in ("conv_id", "part", "seg")} | {"moves": list(matrices(code, fault, starts, lengths).reshape(-1, 16)), "first": code[starts].astype(np.int32), "last": code[starts + lengths - 1].astype(np.int32), "illegal": illegal}

    return step


def _ends() -> Callable:
    """The costs that follow each segment of a conversation, from its last to its first, and the whole's cost."""

    def step(batch: pa.RecordBatch) -> dict:
        out, illegal, total = [], [], []
        for parts in batch["parts"].to_pylist():
            after, ends = inserted(ACCEPT), []
            for k, p in enumerate(reversed(parts)):
                ends.append({"part": p["part"], "seg": p["seg"], "after": after.tolist(), "closing": not k})
                after = np.minimum((np.array(p["moves"]).reshape(4, 4) + after).min(axis=1), NEVER)
            out.append(ends)
            total.append(int(after[START]))
            illegal.append(sum(p["illegal"] for p in parts) + sum(not LEGAL[a["last"], b["first"]] for a, b in zip(parts, parts[1:], strict=False)))
        return {"conv_id": batch["conv_id"], "illegal": illegal, "cost": total, "ends": out}

    return step


def _traces() -> Callable:
    """The edits of each segment and the state they end in, from each state."""

    def step(batch: pa.RecordBatch) -> dict:
        code, fault, _, starts, lengths = _turns(batch["turns"])
        n, audits, states = len(starts), [], []
        end = batch["after"].flatten().to_numpy().reshape(n, 4)
        closing = batch["closing"].to_numpy(zero_copy_only=False)
        for state in range(4):
            audit, last = np.empty(n, object), np.zeros(n, np.int32)
            for close in (False, True):
                use = np.flatnonzero(closing == close)
                if len(use):
                    found = solve(code, fault, starts[use], lengths[use], np.broadcast_to(ACCEPT, (len(use), 4)) if close else end[use], np.full(len(use), state), close)
                    audit[use], last[use] = found.audit, found.state
            audits.append(audit)
            states.append(last)
        return {c: batch[c] for c in ("conv_id", "part", "seg")} | {"audits": [[a[i].decode() for a in audits] for i in range(n)], "states": np.stack(states, axis=1).tolist() if n else []}

    return step


def _ways() -> Callable:
    """The state in which each segment of a conversation is entered."""

    def step(batch: pa.RecordBatch) -> dict:
        out = []
        for parts in batch["parts"].to_pylist():
            state, ways = START, []
            for p in parts:
                ways.append({"part": p["part"], "seg": p["seg"], "state": state})
                state = p["states"][state]
            out.append(ways)
        return {"conv_id": batch["conv_id"], "ways": out}

    return step


def _lines() -> Callable:
    """The turns that a segment's edits give: row is null for an inserted one, new is empty where the role stays."""

    def step(batch: pa.RecordBatch) -> dict:
        code, _, row, starts, _ = _turns(batch["turns"])
        index, place, rows, new = [], [], [], []
        for i, (audit, state) in enumerate(zip(batch["audit"].to_pylist(), batch["state"].to_pylist(), strict=True)):
            for k, (turn, role) in enumerate(emitted(audit.encode(), code[starts[i] :], state)):
                index.append(i)
                place.append(k)
                rows.append(int(row[starts[i] + turn]) if turn >= 0 else None)
                new.append(role)
        return {c: batch[c].take(pa.array(index, pa.int64())) for c in ("conv_id", "part", "seg")} | {"place": place, "row": rows, "new": new}

    return step


def _hashed(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines, which come in order; one digest is held at a time."""
    from pyspark.sql.types import StructType

    target = StructType([lines.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, digest = to_arrow_schema(target), None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if digest is not None and conv == held:
                    digest.update(b"\n")
                else:
                    done += [(held, digest.hexdigest())] if digest is not None else []
                    held, digest = conv, hashlib.sha256()
                digest.update(line.as_py().encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], schema[i].type) for i in (0, 1)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], schema[0].type), pa.array([digest.hexdigest()])], schema=schema)

    return lines.mapInArrow(run, target)
