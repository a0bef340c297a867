"""Repair of conversation structure (operator 12): one grammar for all conversations, one transfer matrix for each of its rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import discard, materialize

#: Role initials s, u, a and all others, by number; faults by number. A symbol is 4 * initial + fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What has been said: nothing, a system row, a user row, an assistant row. Nothing and an assistant row may end it.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Symbols in a segment of a conversation, rounds of pairs, pairs looked at in a round.
SEGMENT, ROUNDS, PAIRS = 4096, 8, 1024
#: Results of so many sequences of up to so many symbols are kept in a task.
KNOWN, SHORT = 100_000, 64

#: An audit: letters, or two audits one after the other; rules share those of their parts.
Rope = str | tuple["Rope", "Rope"]
#: Least cost and its least audit from each state to each; None where no edits lead there.
Matrix = tuple[tuple[tuple[int, Rope] | None, ...], ...]


def letters(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += (part[1], part[0])
    return "".join(out)


def _least(found: list[tuple[int, Rope]]) -> tuple[int, Rope] | None:
    """The cheapest, of these the one of least letters. No audit of as many rows and equal cost is the beginning of another."""
    if not found:
        return None
    cost = min(c for c, _ in found)
    tied = [rope for c, rope in found if c == cost]
    return cost, tied[0] if len(tied) == 1 else min(tied, key=letters)


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus: first ``left``, then ``right``."""
    return tuple(
        tuple(_least([(x[0] + y[0], (x[1], y[1])) for q in STATES if (x := left[p][q]) and (y := right[q][r])]) for r in STATES) for p in STATES
    )


def _said(state: int) -> int:
    """The state after the one user or assistant row that may follow ``state``."""
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def _inserted() -> Matrix:
    """Rows put in before a row: none, one or two."""
    table: list[list] = [[None] * 4 for _ in STATES]
    for p in STATES:
        at = p
        for n in range(3):
            if table[p][at] is None:
                table[p][at] = (n * COST[INSERT], INSERT * n)
            at = _said(at)
    return tuple(map(tuple, table))


def _edited(symbol: int) -> Matrix:
    """What may be done with one row."""
    initial, fault = divmod(symbol, 4)
    table: list[list] = [[None] * 4 for _ in STATES]
    for p in STATES:
        table[p][p] = (COST[DELETE], DELETE)
        if fault in (BLANK, DUPLICATE):
            continue
        stays = int(fault == TRUNCATED)
        table[p][_said(p)] = (COST[REROLE] + stays, REROLE)
        keeps = {SYSTEM: p == START, USER: p != AFTER_USER, ASSISTANT: p == AFTER_USER, OTHER: False}[initial]
        if keeps:
            table[p][AFTER_SYSTEM if initial == SYSTEM else _said(p)] = (COST[KEEP] + stays, KEEP)
    return tuple(map(tuple, table))


SYMBOLS: list[Matrix] = [product(_inserted(), _edited(x)) for x in range(16)]
#: From each state, the rows put in at the end.
ENDS = [min(x for q in (START, AFTER_ASSISTANT) if (x := _inserted()[p][q])) for p in STATES]


class Grammar(NamedTuple):
    """Rules by rounds: (left symbol, right symbol); symbols from 16 on are the rules in this order."""

    rounds: list[list[tuple[int, int]]]

    def matrices(self) -> list[Matrix]:
        """One transfer matrix for each symbol, bottom-up."""
        out = list(SYMBOLS)
        for pairs in self.rounds:
            out += [product(out[left], out[right]) for left, right in pairs]
        return out

    def compressed(self, sequences: Sequence[bytes]) -> np.ndarray:
        """All ``sequences`` with the rules applied; -1 stands after each."""
        flat = np.full(sum(map(len, sequences)) + len(sequences), -1, np.int64)
        ends = np.cumsum([len(s) + 1 for s in sequences])
        holds = np.ones(len(flat), bool)
        holds[ends - 1] = False
        flat[holds] = np.frombuffer(b"".join(sequences), np.uint8)
        first = len(SYMBOLS)
        for pairs in self.rounds:
            flat = _replaced(flat, pairs, first)
            first += len(pairs)
        return flat


def _pairs(flat: np.ndarray) -> np.ndarray:
    """Each two neighbours as one number; -1 across the end of a sequence."""
    return np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 31 | flat[1:], -1)


def _replaced(flat: np.ndarray, pairs: list[tuple[int, int]], first: int) -> np.ndarray:
    """``flat`` with symbol first + i in place of pair i; where two overlap, the lower number goes first."""
    keys = np.array([left << 31 | right for left, right in pairs], np.int64)
    order = np.argsort(keys)
    while len(flat) > 1:
        found = _pairs(flat)
        at = np.minimum(np.searchsorted(keys[order], found), len(keys) - 1)
        rank = np.where(keys[order][at] == found, order[at], len(pairs))
        fresh = np.concatenate(([True], rank[1:] != rank[:-1]))  # one symbol many times: pairs overlap with themselves
        begin = np.flatnonzero(fresh)
        plateau = np.cumsum(fresh) - 1
        around = np.concatenate(([len(pairs)], rank[begin], [len(pairs)]))
        lowest = (around[1:-1] < len(pairs)) & (around[1:-1] <= around[:-2]) & (around[1:-1] <= around[2:])
        take = lowest[plateau] & ((np.arange(len(rank)) - begin[plateau]) % 2 == 0)
        if not take.any():
            break
        flat = flat.copy()
        place = np.flatnonzero(take)
        flat[place] = first + rank[place]
        flat = np.delete(flat, place + 1)
    return flat


def learn_grammar(segments: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> Grammar:
    """Re-Pair over the ``symbols`` (binary) of all segments, in rounds.

    A round counts all neighbours in the sequences as they are by then, sums the counts, and makes rules of the most
    frequent pairs that stand twice or more; of the first ``pairs`` those are taken that cannot overlap with one
    taken before. Only these few counts reach the driver. Any grammar gives the same repairs.
    """
    grammar = Grammar([])
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], known: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _pairs(known.compressed(batch.column(0).to_pylist()))
                pair, n = np.unique(found[found >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        counted = segments.select("symbols").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        chosen, lefts, rights = [], set(), set()
        for row in counted.orderBy(F.desc("n"), "pair").limit(pairs).collect():
            left, right = row["pair"] >> 31, row["pair"] & ((1 << 31) - 1)
            if left not in rights and right not in lefts:
                chosen.append((left, right))
                if left != right:
                    lefts.add(left)
                    rights.add(right)
        if not chosen:
            break
        grammar = Grammar([*grammar.rounds, chosen])
    return grammar


def solved(segments: DataFrame, grammar: Grammar) -> DataFrame:
    """(_c, seg, costs, ranks, audits) of each segment, from each state to each (4 * from + to; cost -1: no way).

    ranks orders the audits from one state. The matrices of the rules go along with the tasks (a bounded number); a
    segment takes one product for each symbol that is left of it, and segments of equal symbols one result.
    """
    shared = segments.sparkSession.sparkContext.broadcast((grammar, grammar.matrices()))

    def whole(symbols: Sequence[int], matrices: list[Matrix]) -> tuple[list[int], list[int], list[str | None]]:
        total = matrices[symbols[0]]
        for x in symbols[1:]:
            total = product(total, matrices[x])
        entries = [x for row in total for x in row]
        audits = [None if x is None else letters(x[1]) for x in entries]
        ranks = [-1 if x is None else sum(y is not None and y < x for y in audits[4 * (i // 4) : 4 * (i // 4) + 4]) for i, x in enumerate(audits)]
        return [-1 if x is None else x[0] for x in entries], ranks, audits

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, matrices = shared.value
        known: dict[tuple[int, ...], tuple] = {}
        for batch in batches:
            flat = rules.compressed(batch.column(2).to_pylist())
            out = []
            for part in np.split(flat, np.flatnonzero(flat < 0) + 1)[:-1]:
                symbols = tuple(part[:-1].tolist())
                result = known.get(symbols) or whole(symbols, matrices)
                if len(part) <= SHORT:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[symbols] = result
                out.append(result)
            costs, ranks, audits = zip(*out, strict=True) if out else ((), (), ())
            made = [pa.array(costs, pa.list_(pa.int32())), pa.array(ranks, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["_c", "seg", "costs", "ranks", "audits"])

    return segments.select("_c", "seg", "symbols").mapInArrow(solve, "_c string, seg long, costs array<int>, ranks array<int>, audits array<string>")


def _facts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """What is needed of each row: its conversation as a key, turn, role, a digest of role and text, and its own faults."""
    narrow = rows.select(conversation_key(F.col(conv)).alias("_c"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    narrow = narrow.withColumn("mark", F.md5(F.concat("role", F.lit("\x00"), "text")))
    return narrow.withColumn("row", F.md5(F.concat_ws("\x00", "_c", F.coalesce(F.col("turn").cast("string"), F.lit("null")), "mark")))


def _cells(facts: DataFrame) -> DataFrame:
    """One row for each different (conversation, turn, role, text): its symbol, the symbol of its further copies, and their number."""
    end = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    said = facts.select("_c", "turn", "role", "mark", "row", (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"))
    cells = said.groupBy("_c", "turn", "role", "mark", "row").agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("ended").alias("ended"))
    cells = materialize(cells, "conversation-cells")
    turns = cells.groupBy("_c", "mark").agg(F.count(F.lit(1)).alias("turns"), F.max(F.col("turn").isNull()).alias("some_null"), F.min("turn").alias("least"))
    turns = materialize(turns.where("turns > 1").drop("turns"), "conversation-repeats")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("some_null") | (F.col("turn") > F.col("least"))), F.lit(False))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(NONE)
    later = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    marked = cells.join(turns, ["_c", "mark"], "left")
    return marked.select("_c", "turn", "role", "mark", "row", "n", (4 * initial + fault).cast("int").alias("symbol"), (4 * initial + later).cast("int").alias("later"))


_SEGMENTS = (
    "_c string, seg long, symbols binary, rows array<string>, blank long, duplicate long, truncated long, illegal long, "
    "first int, last int, n_turns long, first_turn long, last_turn long"
)


def _segments(cells: DataFrame, length: int) -> DataFrame:
    """The rows of each conversation in order, cut where a task ends and after ``length`` symbols; ``seg`` rises within a conversation.

    All rows are sorted by conversation and turn, in ranges, so a conversation of any size is dealt over as many tasks as it takes.
    """
    ordered = cells.orderBy("_c", F.asc_nulls_first("turn"), "role", "mark").select("_c", "turn", "row", "n", "symbol", "later", F.spark_partition_id().alias("part"))
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]

    def closed(conv: str, seg: int, symbols: bytearray, rows: list, turns: list) -> tuple:
        faults = [x & 3 for x in symbols]
        initials = [x >> 2 for x in symbols]
        illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
        known = [t for t in turns if t is not None]
        distinct = len(known) and 1 + sum(a != b for a, b in zip(known, known[1:], strict=False))
        ends = (known[0], known[-1]) if known else (None, None)
        return conv, seg, bytes(symbols), rows, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, initials[0], initials[-1], distinct, *ends

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, number, symbols, rows, turns = None, 0, bytearray(), [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for key, turn, row, n, symbol, later, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != conv and symbols:
                    out.append(closed(conv, number, symbols, rows, turns))
                    symbols, rows, turns = bytearray(), [], []
                number = max(number, part << 32)
                conv = key
                while n:
                    if len(symbols) >= length:
                        out.append(closed(conv, number, symbols, rows, turns))
                        symbols, rows, turns = bytearray(), [], []
                    if not symbols:
                        number += 1
                    if row is not None:
                        symbols.append(symbol)
                        rows.append(row)
                        turns.append(turn)
                        row, n = None, n - 1
                        continue
                    more = min(n, length - len(symbols))
                    symbols += bytes([later]) * more
                    rows += [None] * more
                    turns.append(turn)
                    n -= more
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if symbols:
            out.append(closed(conv, number, symbols, rows, turns))
        yield batch_of(out)

    return ordered.mapInArrow(cut, _SEGMENTS)


_STATS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "n_turns", "first_turn", "last_turn")


def _folded(parts: list[dict]) -> dict:
    """The way through the segments of one conversation, by costs and ranks alone, from the last segment to the first and back."""
    to_go = [x[0] for x in ENDS]
    choices = []
    for part in reversed(parts):
        best = []
        for p in STATES:
            ways = [(part["costs"][4 * p + q] + to_go[q], part["ranks"][4 * p + q], q) for q in STATES if part["costs"][4 * p + q] >= 0]
            best.append(min(ways))
        choices.append([q for _, _, q in best])
        to_go = [cost for cost, _, _ in best]
    state, path = START, []
    for chosen in reversed(choices):
        path.append((state, chosen[state]))
        state = chosen[state]
    known = [x for x in parts if x["n_turns"]]
    n_turns = sum(x["n_turns"] for x in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    between = sum((a["last"], b["first"]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    return {
        "gaps": known[-1]["last_turn"] - known[0]["first_turn"] + 1 - n_turns if known else 0, **{c: sum(x[c] for x in parts) for c in _STATS[:3]},
        "illegal": sum(x["illegal"] for x in parts) + between, "cost": to_go[START],
        "way": [{"seg": x["seg"], "start": p, "place": 4 * p + q, "tail": ENDS[state][1] if i == len(parts) - 1 else ""} for i, (x, (p, q)) in enumerate(zip(parts, path, strict=True))],
    }


def _reported(segments: DataFrame, found: DataFrame) -> DataFrame:
    """(_c, gaps, blank, duplicate, truncated, illegal, cost, way) of each conversation: some numbers for each of its segments meet."""
    # Costs and ranks travel, audits stay with their segments.
    joined = segments.select("_c", "seg", *_STATS).join(found.select("_c", "seg", "costs", "ranks"), ["_c", "seg"])
    grouped = joined.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("seg", "costs", "ranks", *_STATS))).alias("parts"))
    schema = "_c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, way array<struct<seg:bigint,start:int,place:int,tail:string>>"
    way = pa.list_(pa.struct([("seg", pa.int64()), ("start", pa.int32()), ("place", pa.int32()), ("tail", pa.string())]))
    kinds = pa.schema([("_c", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("way", way)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"_c": c, **_folded(parts)} for c, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return grouped.mapInArrow(fold, schema)


def _edits(pieces: DataFrame) -> DataFrame:
    """(_c, seg, pos, role, row) of the rows that stay or are put in; role is null for a row that keeps its own, row for one put in."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, seg, audit, state, symbols, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for pos, letter in enumerate(audit):
                    if letter == DELETE:
                        at += 1
                        continue
                    kept_system = letter == KEEP and symbols[at] >> 2 == SYSTEM
                    state = AFTER_SYSTEM if kept_system else _said(state)
                    role = None if letter == KEEP else "user" if state == AFTER_USER else "assistant"
                    out.append((conv, seg, pos, role, None if letter == INSERT else rows[at]))
                    at += letter != INSERT
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_c", "seg", "pos", "role", "row"])

    return pieces.select("_c", "seg", "audit", "start", "symbols", "rows").mapInArrow(walk, "_c string, seg long, pos long, role string, row string")


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: a report, and the repaired rows.

    Rows stand by turn (nulls first), within a turn by role and a digest of role and text. A row's first fault
    counts: blank text; duplicate (its role and text were there earlier); truncated (its last character is none
    of ``.!?``). Edits: keep 0, rerole to user or assistant 2, delete 3 (blank and duplicate rows must go),
    insert an empty user or assistant row 2; a truncated row that stays adds 1. Role initials of the result read
    ``(s?(ua)+)?``. Of the cheapest repairs the one counts whose edits' initials are least in ASCII.

    Report: _c (key of the conversation, see ``conversation_key``), gaps, blank, duplicate, truncated, illegal
    (neighbours whose initials are not su, ua or au), cost, audit. Repaired rows: _c, seg, pos (their order), role, text.

    Equal rows are counted before anything is sorted. Sorted by ranges, conversations become segments of at most
    ``segment`` symbols; Re-Pair makes one grammar for the segments of all conversations, each rule has one
    min-plus matrix with audit ropes, and a segment's matrix is the product of the rules that it consists of. Of
    a conversation only the costs and the order of its segments' audits meet, so one that holds a third of
    all rows is split like the rest; texts join the repaired rows last.

    Null roles and texts are one space, null turns come first, null conversations are one. Other columns are not
    looked at. Empty and very long texts count whole. No rows: empty results.
    """
    facts = _facts(rows, conv_col, turn_col, role_col, text_col)
    segments = materialize(_segments(_cells(facts), segment), "conversation-segments")
    found = materialize(solved(segments, learn_grammar(segments)), "conversation-matrices")
    report = materialize(_reported(segments, found), "conversation-report")
    way = report.select("_c", F.inline("way"))
    audit = F.concat(F.element_at("audits", F.col("place") + 1), "tail")
    pieces = found.select("_c", "seg", "audits").join(way, ["_c", "seg"]).select("_c", "seg", "start", audit.alias("audit"))
    pieces = materialize(pieces, "conversation-audits")
    audits = pieces.groupBy("_c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    edits = materialize(_edits(pieces.join(segments.select("_c", "seg", "symbols", "rows"), ["_c", "seg"])), "conversation-edits")
    discard(found)
    own = facts.select("row", F.col("role").alias("own"), "text").dropDuplicates(["row"])
    kept = edits.where("row is not null").join(own, "row").select("_c", "seg", "pos", F.coalesce("role", "own").alias("role"), "text")
    put_in = edits.where("row is null").select("_c", "seg", "pos", "role", F.lit("").alias("text"))
    return report.drop("way").join(audits, "_c"), kept.union(put_in)


def conversation_key(conv: Column) -> Column:
    """The key ``_c`` of a conversation's id."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string")))


def digests(repaired: DataFrame) -> DataFrame:
    """(_c, repaired_sha256): SHA-256 of ``role:text`` of a conversation's rows in order, joined by line feeds.

    Such a digest reads one conversation from its first byte to its last, so that is one task's work; rows
    stream through it sorted and nothing of them is held.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str]] = []
        conv, state = None, None
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, lines in groupby(rows, key=lambda x: x[0]):
                if key != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = key, None
                for _, line in lines:
                    if state is None:
                        state = hashlib.sha256(line.encode())
                    else:
                        state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["_c", "repaired_sha256"])
            done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["_c", "repaired_sha256"])

    lines = repaired.select("_c", "seg", "pos", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("_c").sortWithinPartitions("_c", "seg", "pos")
    return ordered.select("_c", "line").mapInArrow(digest, "_c string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; null roles and texts one space) with the faults that a checksum of conv_id and turn names."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    hurt = rows.withColumn("kind", kind).where("kind <> 0").withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(text("role")))
    hurt = hurt.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")))
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = repair_conversations(damaged(rows))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = rows.select("conv_id").distinct().withColumn("_c", conversation_key(F.col("conv_id")))
    found = every.join(report, "_c", "left").join(digests(repaired), "_c", "left")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
