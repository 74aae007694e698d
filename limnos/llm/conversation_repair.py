"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, in order of turn, are edited until their roles read: at most one system row, then user and assistant in
turns. Edits of a row are Keep, Rerole and Delete, and rows may be Inserted before any row and at the end. The search goes depth first in
ASCII order of the edits' initials under a bound on the cost. What a failed state is proven to cost at least is kept in a table,
so that no state is searched again without a larger budget, and the next bound is what the start is proven to cost. The first
accepting path is the answer: the cheapest edits, ties to the least string.

Rows are dealt by range of conversation and turn and cut into segments of bounded size. A conversation that lies whole in one
segment, as nearly all do, is searched at once. A longer one is searched segment by segment between every two states; the
costs, with the order of the edits, are merged in groups of neighbouring segments until one is left, and the chosen states handed down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from limnos.functions.nulls import col
from limnos.llm.shared import numbered_in_place, text_slices
from limnos.session import staged

#: Rows and bytes of text at which a segment ends.
SEGMENT_ROWS = 32
SEGMENT_BYTES = 1 << 20
#: Neighbouring segments that are merged at once, as a power of two.
MERGE_BITS = 6
#: Searches a task remembers.
REMEMBERED = 50_000

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States: the last role so far.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after a role of some initial is kept, and after a role is given or inserted.
AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows inserted at the end of a conversation, by the state they start from.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "."
_SPACE = " \t\n\v\f\r"


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, dropped`` with faults planted by the CRC-32 of ``conv_id:turn``; nulls there, and null roles and texts, are one space.

    Dropped rows stay, marked, so that their conversation is known. A repeated row follows itself with the same turn.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    r = rows.select(col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"), space(col(role)).alias("role"), space(col(text)).alias("text"),
                    (F.crc32(F.concat(space(col(conv_id)), F.lit(":"), space(col(turn))).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return (r.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                     F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                     (kind == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


@lru_cache(REMEMBERED)
def search(initials: str, faults: str, entry: int, target: int | None) -> tuple[int, str] | None:
    """Least cost and edits from a state before the rows to ``target`` after them, None if there are none.

    Without a target the rows end the conversation: rows may be inserted behind them, and an accepting state is reached.
    """
    return _deepen(initials, faults, entry, target, {})


def _deepen(initials: str, faults: str, entry: int, target: int | None, proven: dict[tuple[int, int], int]) -> tuple[int, str] | None:
    """The search; ``proven`` holds what a row and state cost at least on the way to the target, whatever the entry."""
    n = len(initials)
    if target is not None and not _reachable(initials, faults, entry, target):
        return None
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + _least(initials[i], faults[i])
    path: list[str] = []

    def descend(i: int, state: int, left: int) -> bool:
        if i == n and (state == target if target is not None else state in (START, ASSISTANT)):
            return True
        best = None
        for edit, cost, at, after in _edits(initials, faults, i, state, target is None):
            if cost + proven.get((at, after), rest[at]) <= left:
                path.append(edit)
                if descend(at, after, left - cost):
                    return True
                path.pop()
            least = cost + proven.get((at, after), rest[at])
            best = least if best is None else min(best, least)
        proven[i, state] = left + 1 if best is None else max(best, left + 1)
        return False

    bound = proven.get((0, entry), rest[0])
    while not descend(0, entry, bound):
        bound = proven[0, entry]
    edits = "".join(path)
    return _cost(edits, faults), edits


def _reachable(initials: str, faults: str, entry: int, target: int) -> bool:
    if entry == target:
        return True  # delete every row
    if target == SYSTEM:
        return entry == START and any(r == "s" and f in (SOUND, CUT) for r, f in zip(initials, faults))
    return target in (USER, ASSISTANT) and bool(initials)  # insert before the first row, delete every row


def _least(initial: str, fault: str) -> int:
    """Least cost of a row in any state."""
    if fault in (BLANK, DUPLICATE):
        return DELETE
    return min(DELETE, (KEEP if initial in "sua" else REROLE) + (TRUNCATED if fault == CUT else 0))


def _edits(initials: str, faults: str, i: int, state: int, at_end: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edit, cost, next row and next state, in ASCII order of the edits."""
    if i == len(initials):
        if at_end:
            yield "I", INSERT, i, GIVEN[state]
        return
    yield "D", DELETE, i + 1, state
    yield "I", INSERT, i, GIVEN[state]
    if faults[i] not in (BLANK, DUPLICATE):
        more = TRUNCATED if faults[i] == CUT else 0
        if (initials[i], state) in AFTER:
            yield "K", KEEP + more, i + 1, AFTER[initials[i], state]
        yield "R", REROLE + more, i + 1, GIVEN[state]


def _cost(edits: str, faults: str) -> int:
    rows = iter(faults)
    return sum(INSERT if e == "I" else DELETE if e == "D" else (REROLE if e == "R" else KEEP) + (TRUNCATED if f == CUT else 0)
               for e in edits for f in ("" if e == "I" else next(rows),))


def apply_edits(edits: str, entry: int, initials: str, roles: Sequence[str], texts: Sequence[str]) -> str:
    """Repaired rows as ``role:text``, joined by newlines."""
    out, i, state = [], 0, entry
    for e in edits:
        if e == "I":
            state = GIVEN[state]
            out.append(NAMES[state] + ":")
            continue
        if e == "K":
            state = AFTER[initials[i], state]
            out.append(f"{roles[i]}:{texts[i]}")
        elif e == "R":
            state = GIVEN[state]
            out.append(f"{NAMES[state]}:{texts[i]}")
        i += 1
    return "\n".join(out)


# Rows to segments

def _marked(rows: DataFrame) -> DataFrame:
    """Rows with ``initial`` and ``fault``; ``at`` numbers them and ``digest`` stands for role and text."""
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id())
                  .withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    # The repeated role-text pairs of a conversation, and the first row of each; equal rows combine before the shuffle.
    twice = staged(rows.where(~F.col("dropped")).groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "at"))["at"].alias("first")).where("n > 1").drop("n"))
    joined = rows.join(twice, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    initial = F.left("role", F.lit(1))
    fault = (F.when(body == "", BLANK).when(F.col("at") != F.col("first"), DUPLICATE)
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND))
    return joined.select("conv_id", "turn", "role", "text", "dropped", "digest", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"))


def _cut(key_type: pa.DataType, segment_rows: int):
    """Sorted rows to segments; ``whole`` says that the segment is all of its conversation."""
    fields = [("conv_id", key_type), ("whole", pa.bool_()), ("initials", pa.string()), ("faults", pa.string()), ("turns", pa.list_(pa.int64())),
              ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        done_bytes = held_bytes = 0
        key, rows, state = None, [], "none"  # state: the edge of the partition, a new conversation or a cut one

        def close(whole: bool) -> None:
            nonlocal done_bytes, held_bytes
            done.append((key, whole, "".join([r[2] for r in rows]), "".join([r[3] for r in rows]), [r[4] for r in rows], [r[0] for r in rows], [r[1] for r in rows]))
            done_bytes += held_bytes
            held_bytes = 0
            rows.clear()

        def out() -> pa.RecordBatch:
            nonlocal done_bytes
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*done), fields)]
            done.clear()
            done_bytes = 0
            return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

        for batch in batches:
            for part, texts in text_slices(batch, 3):
                for k, turn, role, text, dropped, initial, fault in zip(*[part.column(i).to_pylist() for i in range(3)], texts, *[part.column(i).to_pylist() for i in (4, 5, 6)]):
                    if state == "none":
                        key, state = k, "edge"
                    elif k != key:
                        close(state == "new")
                        key, state = k, "new"
                    elif len(rows) >= segment_rows or held_bytes >= SEGMENT_BYTES:
                        close(False)
                        state = "cut"
                    if not dropped:
                        rows.append((role, text, initial, fault, turn))
                        held_bytes += len(text)
                    if len(done) >= 4_096 or done_bytes >= SEGMENT_BYTES:
                        yield out()
        if state != "none":
            close(False)
        if done:
            yield out()
    return run


# One segment

def _facts(initials: str, faults: str, turns: Sequence[int | None]) -> dict:
    """Counts of a segment that can be merged with those of its neighbours."""
    known = [t for t in turns if t is not None]
    return {"first": initials[:1] or None, "last": initials[-1:] or None, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "low": known[0] if known else None, "high": known[-1] if known else None, "n_turns": len(set(known))}


def _gaps(low: int | None, high: int | None, n_turns: int) -> int:
    return 0 if low is None else high - low + 1 - n_turns


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = [("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names])


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for initials, faults, turns, roles, texts in _rows_of(batch, "initials", "faults", "turns", "roles", "texts"):
            facts = _facts(initials, faults, turns)
            cost, audit = search(initials, faults, START, None)
            out.append((_gaps(facts["low"], facts["high"], facts["n_turns"]), *[facts[c] for c in _COUNTS], cost, audit,
                        _digest(apply_edits(audit, START, initials, roles, texts))))
        columns = list(zip(*out)) if out else [[] for _ in _RESULT]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, (_, t) in zip(columns, _RESULT)]], names=["conv_id", *[n for n, _ in _RESULT]])


# Many segments

def segment_table(initials: str, faults: str) -> tuple[list[int | None], list[int | None]]:
    """Least cost between every two states (entry times 4 plus exit), and the place of its edits among those of the same entry."""
    costs: list[int | None] = []
    places: list[int | None] = []
    proven: list[dict] = [{} for _ in STATES]  # shared by the entries of a target
    for entry in STATES:
        found = [_deepen(initials, faults, entry, t, proven[t]) for t in STATES]
        order = sorted(t for t in STATES if found[t] is not None)
        order.sort(key=lambda t: found[t][1])
        costs += [f[0] if f else None for f in found]
        places += [order.index(t) if t in order else None for t in STATES]
    return costs, places


def merge_tables(tables: Sequence[tuple[Sequence[int | None], Sequence[int | None]]]) -> tuple[list[int | None], list[int | None], list[dict]]:
    """Table of segments behind each other, and for each the state before it by (entry, state after it).

    No edit string of a segment begins with another of the same entry: both have a letter for each row and end with the last
    row's. So strings of joined segments compare as their first differing parts do, and places stand for the strings.
    """
    best = {(e, e): (0, 0) for e in STATES}
    back = []
    for costs, places in tables:
        step: dict[tuple[int, int], tuple] = {}
        for (e, mid), (cost, place) in best.items():
            for t in STATES:
                if costs[mid * 4 + t] is not None:
                    new = (cost + costs[mid * 4 + t], place, places[mid * 4 + t], mid)
                    if (e, t) not in step or new < step[e, t]:
                        step[e, t] = new
        back.append({k: v[3] for k, v in step.items()})
        best = {}
        for e in STATES:
            order = sorted((v[1:3], t) for (x, t), v in step.items() if x == e)
            best.update({(e, t): (step[e, t][0], i) for i, (_, t) in enumerate(order)})
    flat = lambda k: [best[e, t][k] if (e, t) in best else None for e in STATES for t in STATES]
    return flat(0), flat(1), back


def _merge_facts(rows: Sequence[dict]) -> dict:
    out = {"first": None, "last": None, "low": None, "high": None, "n_turns": 0, **dict.fromkeys(_COUNTS, 0)}
    for r in rows:
        for c in (*_COUNTS, "n_turns"):
            out[c] += r[c]
        if out["last"] and r["first"]:
            out["illegal"] += out["last"] + r["first"] not in LEGAL
        if out["high"] is not None and out["high"] == r["low"]:
            out["n_turns"] -= 1
        out["first"], out["last"] = out["first"] or r["first"], r["last"] or out["last"]
        out["low"] = r["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if r["high"] is None else r["high"]
    return out


_NODE = [("idx", pa.int64()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()),
         ("high", pa.int64()), ("n_turns", pa.int64()), *[(c, pa.int64()) for c in _COUNTS]]
_NODE_SQL = ("idx long, costs array<long>, places array<int>, first string, last string, low long, high long, n_turns long, "
             "blank long, duplicate long, truncated long, illegal long")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for idx, initials, faults, turns in _rows_of(batch, "idx", "initials", "faults", "turns"):
            costs, places = segment_table(initials, faults)
            rows.append({"idx": idx, "costs": costs, "places": places, **_facts(initials, faults, turns)})
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array([r[n] for r in rows], t) for n, t in _NODE]], names=["conv_id", *[n for n, _ in _NODE]])


def _merge_up(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        found = rows.sort_by("idx").to_pylist()
        costs, places, _ = merge_tables([(r["costs"], r["places"]) for r in found])
        node = {"idx": found[0]["idx"] >> bits, "costs": costs, "places": places, **_merge_facts(found)}
        return pa.table([rows["conv_id"].slice(0, 1), *[pa.array([node[n]], t) for n, t in _NODE]], names=["conv_id", *[n for n, _ in _NODE]])
    return run


def _hand_down(rows: pa.Table) -> pa.Table:
    """States before and after each of the neighbouring segments, given those of all of them together."""
    found = rows.sort_by("idx").to_pylist()
    _, _, back = merge_tables([(r["costs"], r["places"]) for r in found])
    entry, after, states = found[0]["entry"], found[0]["target"], []
    for step in reversed(back):
        before = step[entry, after]
        states.append((before, after))
        after = before
    states.reverse()
    return pa.table({"conv_id": rows.sort_by("idx")["conv_id"], "idx": pa.array([r["idx"] for r in found], pa.int64()),
                     "entry": pa.array([s[0] for s in states], pa.int32()), "target": pa.array([s[1] for s in states], pa.int32())})


def _choose_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result of a conversation's counts, and the state its last segment ends in."""
    names = ["low", "high", "n_turns", "costs", "places", *_COUNTS]
    for batch in batches:
        rows = []
        for low, high, n_turns, costs, places, *counts in _rows_of(batch, *names):
            cost, _, target = min((costs[t] + INSERT * len(TAIL[t]), places[t], t) for t in STATES if costs[t] is not None)
            rows.append((_gaps(low, high, n_turns), *counts, cost, 0, START, target))
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "gaps", *_COUNTS, "cost", "idx", "entry", "target"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired rows of each segment."""
    for batch in batches:
        edits, texts = [], []
        for last, entry, target, initials, faults, roles, body in _rows_of(batch, "final", "entry", "target", "initials", "faults", "roles", "texts"):
            edits.append(search(initials, faults, entry, target)[1] + (TAIL[target] if last else ""))
            texts.append(apply_edits(edits[-1], entry, initials, roles, body))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("idx"), pa.array(edits, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "idx", "edits", "piece"])


def _stream(key_type: pa.DataType):
    """Pieces in order to the edits and the digest of each conversation; no more than a slice of texts is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, empty, edits, digest = None, False, True, [], hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array(["".join(edits)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])
        for batch in batches:
            for part, pieces in text_slices(batch, 2):
                for k, e, piece in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), pieces):
                    if started and k != key:
                        yield row()
                    if not started or k != key:
                        key, started, empty, edits, digest = k, True, True, [], hashlib.sha256()
                    edits.append(e)
                    if piece:
                        digest.update((piece if empty else "\n" + piece).encode("utf-8", "surrogatepass"))
                        empty = False
        if started:
            yield row()
    return run


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"])


def _repair_long(parts: DataFrame, kind: str, key_type: pa.DataType, bits: int) -> DataFrame:
    """Conversations of several segments, by merging the segments' tables."""
    spans = staged(parts.groupBy("conv_id").agg(F.min("seg").alias("low_seg"), F.count(F.lit(1)).alias("n")))
    placed = staged(parts.join(spans, _same(parts, spans)).select(parts["*"], (F.col("seg") - F.col("low_seg")).alias("idx"), (F.col("seg") - F.col("low_seg") == F.col("n") - 1).alias("final")))
    levels = [staged(placed.select("conv_id", "idx", "initials", "faults", "turns").mapInArrow(_nodes, f"conv_id {kind}, {_NODE_SQL}"))]
    most = spans.agg(F.max("n")).first()[0] or 0
    while most > 1:
        above = levels[-1].groupBy("conv_id", F.shiftright("idx", bits)).applyInArrow(_merge_up(bits), f"conv_id {kind}, {_NODE_SQL}")
        levels.append(staged(above))
        most = -(-most // (1 << bits))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    ends = staged(levels[-1].mapInArrow(_choose_end, f"conv_id {kind}, gaps long, {counts}, cost long, idx long, entry int, target int"))
    states = ends.select("conv_id", "idx", "entry", "target")
    for level in reversed(levels[:-1]):
        given = level.join(states.withColumnRenamed("idx", "up"), _same(level, states) & (F.shiftright(level["idx"], bits) == F.col("up"))).select(level["*"], "entry", "target")
        states = staged(given.groupBy("conv_id", F.shiftright("idx", bits)).applyInArrow(_hand_down, f"conv_id {kind}, idx long, entry int, target int"))
    known = placed.join(states, _same(placed, states) & (placed["idx"] == states["idx"])).select(placed["*"], "entry", "target")
    pieces = staged(known.mapInArrow(_pieces, f"conv_id {kind}, idx long, edits string, piece string"))
    streamed = (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "idx").select("conv_id", "edits", "piece")
                .mapInArrow(_stream(key_type), f"conv_id {kind}, audit string, repaired_sha256 string"))
    return ends.join(streamed, _same(ends, streamed)).select(ends["conv_id"], "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, merge_bits: int = MERGE_BITS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation in the rows of ``damage``.

    Rows are taken by turn, null first; rows of one turn by role, then by a digest of role and text. A null conv_id is a conversation
    like any other. A row without a character but white space is blank (null texts are one space), an empty role has no legal
    neighbour and cannot be kept; a repeated row is a duplicate of the first; very long texts and conversations are read whole. A conversation without rows
    left has zeros, an empty audit and the digest of an empty string. An empty table gives an empty result; other columns are not read.

    The digest of a long conversation's text is one chain of bytes, so a single task reads its pieces, in order, holding one
    slice at a time.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = _marked(rows)
    order = ["conv_id", "turn", "role", "digest", "at"]
    key_type = to_arrow_type(rows.schema["conv_id"].dataType)
    cut = (marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "dropped", "initial", "fault")
           .mapInArrow(_cut(key_type, segment_rows), f"conv_id {kind}, whole boolean, initials string, faults string, turns array<long>, roles array<string>, texts array<string>"))
    segments = numbered_in_place(cut, "seg")
    whole = segments.where("whole").select("conv_id", "initials", "faults", "turns", "roles", "texts").mapInArrow(_repair_whole, f"conv_id {kind}, {_RESULT_SQL}")
    return whole.unionByName(_repair_long(segments.where("not whole"), kind, key_type, merge_bits))
