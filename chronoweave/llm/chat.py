"""Conversations repaired into legal role sequences at the least cost, and rendered.

Legal: an optional system turn, then user and assistant in turn, an assistant last. Every input turn is kept: it is
given a role (its own for nothing, another at a cost) and either opens a turn of its own, after empty turns where the
automaton asks for some, or is merged into the turn before. Dynamic programming over the automaton's four states finds
the cheapest repair of a whole conversation.

Turns of a conversation are ordered by (turn, hash of role and text, role, text). Conversations are dealt out by ranges of that
order, so one that is too long for a task lies in several ranges: for each of its pieces the costs between entry and exit
states (a 4 x 4 matrix) are computed first, chained on the driver (two pieces a range at most), and every piece is then
repaired from the entry to the exit state of the best chain. The result is that of one run over the conversation. Only
keys and roles are stored and dealt out for the ranges and the chain; the texts are read and moved once.

A conv_id may be of any type that can be text. Null and unknown roles count as unknown (cheap to relabel), null texts as empty,
rows with a null conv_id are one conversation, a null turn (or one that is no whole number) comes first. Repeated turns are
kept and merged or parted like others. Marks of turns inside a text are broken by a blank (``<| im_end|>``), so no text
opens or ends a turn. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_stream, materialize, small_batches
from .ranges import LOW, ranges_of

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
ROLE = {v: k for k, v in NAMES.items()}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 10**15
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_MARKS = re.compile(r"<\|(?=im_(?:start|end)\|>)")


def _between(state: int, role: int) -> tuple[int, ...] | None:
    """The empty turns to insert before a turn of this role may follow; None if it never may."""
    paths = [((), state)]
    for path, at in paths:
        if role in NEXT[at]:
            return path
        if len(path) < 2:
            paths += [((*path, n), n) for n in NEXT[at] if n != SYSTEM]
    return None


def _moves(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state, state after, cost, action, inserted) for an input turn of this role."""
    out = []
    for s in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            label = 0 if q == role else UNKNOWN if not role else RELABEL
            path = _between(s, q)
            if path is not None:
                out.append((s, q, label + INSERT * len(path), "relabel" if label else "keep", path))
            if s == q:
                out.append((s, s, label + MERGE, "merge_relabel" if label else "merge", ()))
    return sorted(out, key=lambda m: (m[2], m[3], m[1]))


MOVES = {r: _moves(r) for r in range(4)}
CLOSING: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def transfer(roles: list[int]) -> list[list[int]]:
    """Least cost from each entry state to each exit state."""
    best = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for r in roles:
        best = [_after(row, r)[0] for row in best]
    return best


def _after(costs: list[int], role: int) -> tuple[list[int], list[tuple | None]]:
    out, by = [FAR] * 4, [None] * 4
    for m in MOVES[role]:
        c = costs[m[0]] + m[2]
        if c < out[m[1]]:
            out[m[1]], by[m[1]] = c, m
    return out, by


def best_path(roles: list[int], entry: int, leave: int | None) -> list[tuple]:
    """The moves of the cheapest repair from a state; to a given state, or to the one that closes at the least cost."""
    costs = [0 if s == entry else FAR for s in range(4)]
    trail = []
    for r in roles:
        costs, by = _after(costs, r)
        trail.append(by)
    if leave is None:
        leave = min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), -s))
    out = []
    for by in reversed(trail):
        out.append(by[leave])
        leave = by[leave][0]
    return out[::-1]


def _empty(role: int) -> str:
    return f"{OPEN}{ROLE[role]}\n{CLOSE}"


def chain(pieces: list[tuple[int, object, int, list[list[int]]]]) -> dict[tuple[int, object], tuple[int, int | None, bool, int]]:
    """pieces: (range, conversation, turns, transfer). For each piece of a conversation of several: entry, exit, if it is the last, and turns before it."""
    by: dict[object, list] = {}
    for p in sorted(pieces, key=lambda p: p[0]):
        by.setdefault(p[1], []).append(p)
    out = {}
    for conv, own in by.items():
        if len(own) < 2:
            continue
        costs, backs = [0, FAR, FAR, FAR], []
        for _, _, _, m in own:
            step = [min((costs[i] + m[i][j], i) for i in range(4)) for j in range(4)]
            costs = [c for c, _ in step]
            backs.append([i for _, i in step])
        leave = min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), -s))
        ends = []
        for back in reversed(backs):
            ends.append((back[leave], leave))
            leave = back[leave]
        before = 0
        for (r, _, n, _), (entry, exit_) in zip(own, ends[::-1], strict=True):
            out[r, conv] = (entry, exit_, r == own[-1][0], before)
            before += n
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversations of each range, with their transfer costs."""
    rows: list[tuple] = []
    inner: list[tuple] = []

    def closed() -> Iterator[tuple]:
        """Of the runs of a range: those of its first and its last key h (several conversations only if hashes of ids collide)."""
        ends = {inner[0][1], inner[-1][1]} if inner else set()
        for r, h, c, roles in inner:
            if h in ends:
                yield r, h, c, len(roles), sum(transfer(roles), [])

    for (r, h, c), parts in grouped_stream(batches, ["range", "h", "c"]):
        if inner and inner[-1][0] != r:
            rows += closed()
            inner = []
        first = inner[0][1] if inner else h
        # what is neither of the first key nor of the last one so far isn't needed
        inner = [x for x in inner if x[1] in (first, h)]
        inner.append((r, h, c, [x for p in parts for x in p.column(3).to_pylist()]))
    rows += closed()
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["range", "h", "c", "n", "costs"])


_OUT = {"turn": pa.int64(), "place": pa.int64(), "input_role": pa.string(), "role": pa.string(), "action": pa.string(), "n_inserted": pa.int64(), "cost": pa.int64(), "rendered": pa.string()}
_SQL = {pa.int64(): "long", pa.string(): "string"}


def repair_conversations(conversations: DataFrame, rows_per_range: int = 20_000, least_ranges: int = 64) -> DataFrame:
    """conversations: (conv_id, turn, role, text, ...). Returns (conv_id, turn, place, input_role, role, action, n_inserted, cost, rendered), a row for each input turn.

    ``rendered`` holds what the turn adds to its conversation; joined in the order of ``place``, they are the whole.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    kind = dict(conversations.dtypes)["conv_id"]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    conv, turn = F.col("conv_id"), F.expr("try_cast(turn as bigint)")
    h = F.when(conv.isNull(), LOW).otherwise(conv.cast("long") if whole else F.xxhash64(conv.cast("string")))
    # sets null apart from any value, and values apart whose hashes are alike
    c = F.when(conv.isNull(), "").otherwise(F.lit("=") if whole else F.concat(F.lit("="), conv.cast("string")))
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    names = {**NAMES, **ALIASES}
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), role), F.lit(0))
    order = ["h", "c", "d", "t"]
    keys = [h.alias("h"), c.alias("c"), F.coalesce(turn, F.lit(LOW)).alias("d"), F.xxhash64("role", "text").alias("t")]
    keyed = materialize(conversations.select(*keys, code.cast("byte").alias("code"), (F.octet_length(F.coalesce("text", F.lit(""))) + 64).cast("long").alias("size")), "turns")
    ranges = ranges_of(keyed, ["h", "d", "t"], least_ranges, rows_per_range)
    dealt = keyed.drop("size").withColumn("range", ranges.column()).repartition("range").sortWithinPartitions("range", *order, "code")
    found = dealt.select("range", "h", "c", "code").mapInArrow(_edges, "range int, h long, c string, n long, costs array<long>").collect()
    ends = chain([(r["range"], (r["h"], r["c"]), r["n"], [r["costs"][4 * i : 4 * i + 4] for i in range(4)]) for r in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r, h, c), parts in grouped_stream(batches, ["range", "h", "c"]):
            held = pa.Table.from_batches(parts)
            t = held.select(["code", "turn", "role", "text"]).to_pydict()
            entry, leave, last, before = ends.get((r, (h, c)), (START, None, True, 0))
            path = best_path(t["code"], entry, leave)
            out = []
            for i, (text, (s, q, cost, action, inserted)) in enumerate(zip(t["text"], path, strict=True)):
                text = _MARKS.sub("<| ", text or "")
                piece = f"\n\n{text}" if action.startswith("merge") else (CLOSE if s != START else "") + "".join(map(_empty, inserted)) + f"{OPEN}{ROLE[q]}\n{text}"
                n = len(inserted)
                if last and i == len(path) - 1:
                    piece += CLOSE + "".join(map(_empty, CLOSING[q]))
                    n += len(CLOSING[q])
                    cost += INSERT * len(CLOSING[q])
                out.append((t["turn"][i], before + i, t["role"][i], ROLE[q], action, n, cost, piece))
            cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), _OUT.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([held.column("conv_id").combine_chunks(), *cols], ["conv_id", *_OUT])

    texts = conversations.select(*keys, "conv_id", turn.alias("turn"), "role", "text", code.cast("byte").alias("code")).withColumn("range", ranges.column())
    ordered = texts.repartition("range").sortWithinPartitions("range", *order, "code", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.select("range", "h", "c", "code", "conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} {_SQL[k]}" for n, k in _OUT.items()))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repair_conversations(table(spark, sf_dir, "conversations"))
