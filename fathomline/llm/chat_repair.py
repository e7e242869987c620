"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is: at most one system turn at the start, then user and assistant turns in alternation, the last of
them the assistant's. Each turn keeps its role or gets another (`relabel`), joins the turn before it (`merge`), and empty
turns may go between (`insert`), also at the end. Dynamic programming over the automaton of legal turns finds the
choice of least cost.

A turn's effect is a small matrix over the automaton's states in (min, +) algebra, so a conversation is cut into blocks by
turn number: block matrices are multiplied first, then each block is solved between its two boundary states. A block with
far more rows than turns (null or equal turns, as where many rows lack an id) is cut further, by turn, role and ranges of a
hash of the text, which is the order of its rows. No task holds a whole conversation, however long, in texts: pass 1
reads only roles, pass 2 one matrix of 16 numbers for each block, pass 3 a block. Texts are moved once, in pass 3, together
with a row for each block that holds its boundary states; repeated rows of a partition are dropped before that, the others
where they meet.

Rows of a conversation are ordered by turn, then role (system, user, assistant, then others), then a hash of the text;
exactly repeated rows count once. Defined cases: a null turn comes first (block 0); a null or unknown role has to be
relabelled; null text renders as empty; conversations with a null id are one conversation; an empty table gives no rows;
other columns are not read. Equal costs are decided in a fixed order: keep before merge before relabel, then fewer
insertions, then the order of the states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

ROLES = ("system", "user", "assistant")
STATES = ("start", *ROLES)
COSTS = {"relabel": 4, "merge": 3, "insert": 5}
BLOCK = 1024
FAR = 1 << 40
_STRUCT = "struct<number: long, turn: long, rank: int, k: long>"
_BLOCK = pa.struct([("number", pa.int64()), ("turn", pa.int64()), ("rank", pa.int32()), ("k", pa.int64())])

#: What may directly follow a state.
_NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def _inserted(before: str, role: str) -> list[str] | None:
    """The fewest empty turns between a state and a role; system turns are never made up."""
    paths: list[tuple[str, list[str]]] = [(before, [])]
    for _ in range(3):
        for at, made in paths:
            if role in _NEXT[at]:
                return made
        paths = [(r, [*made, r]) for at, made in paths for r in _NEXT[at] if r != "system"]
    return None


#: (state, role) -> empty turns between, or None; and the empty turns that end a conversation.
BETWEEN = {(s, r): _inserted(s, r) for s in STATES for r in ROLES}
ENDING = {"start": [], "system": ["user", "assistant"], "user": ["assistant"], "assistant": []}


def choices(role: str | None, costs: dict[str, int] = COSTS) -> list[tuple[int, int, int, str, list[str]]]:
    """(from state, to state, cost, action, inserted roles) for a turn, best first among equals."""
    out = []
    for s, before in enumerate(STATES):
        for t, after in enumerate(ROLES, 1):
            change = 0 if role == after else costs["relabel"]
            made = BETWEEN[before, after]
            ways = []
            if made is not None:
                ways.append((change + len(made) * costs["insert"], "relabel" if change else "keep", made))
            if before == after:
                ways.append((change + costs["merge"], "merge_relabel" if change else "merge", []))
            out += [(s, t, c, action, made) for c, action, made in sorted(ways, key=lambda w: (w[0], ("keep", "merge", "relabel", "merge_relabel").index(w[1])))[:1]]
    return out


def _matrix(role: str | None, costs: dict[str, int]) -> np.ndarray:
    m = np.full((len(STATES), len(STATES)), FAR, dtype=np.int64)
    for s, t, c, _, _ in choices(role, costs):
        m[s, t] = min(m[s, t], c)
    return m


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def solve(roles: list[str | None], start: int, end: int | None, costs: dict[str, int] = COSTS) -> list[tuple[int, str, list[str]]]:
    """The cheapest (state, action, inserted roles) of each turn, from one state to another (None: to any, with its ending)."""
    ways = {r: choices(r, costs) for r in set(roles)}
    best = [0 if s == start else FAR for s in range(len(STATES))]
    back: list[list[tuple[int, str, list[str]] | None]] = []
    for r in roles:
        now, came = [FAR] * len(STATES), [None] * len(STATES)
        for s, t, c, action, made in ways[r]:
            if best[s] + c < now[t]:
                now[t], came[t] = best[s] + c, (s, action, made)
        best = now
        back.append(came)
    if end is None:
        end = min(range(len(STATES)), key=lambda s: (best[s] + costs["insert"] * len(ENDING[STATES[s]]), s))
    out = []
    for came in reversed(back):
        before, action, made = came[end]
        out.append((end, action, made))
        end = before
    return out[::-1]


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], done) -> Iterator[pa.RecordBatch]:
    """done(key, rows) for each run of rows with equal keys in a sorted partition."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(tuple(row[k].values()) if isinstance(row[k], dict) else row[k] for k in keys)
            if key != at:
                if held:
                    yield done(at, held)
                at, held = key, []
            held.append(row)
    if held:
        yield done(at, held)


ORDER = ["turn", "rank", "h", "was"]  # of the rows of a block


def _ordered(turns: DataFrame, block: int) -> DataFrame:
    """turns with the role that is known, its rank, a hash of the text, and `block`: (number, and for parts of a full one turn, rank and range of the hash)."""
    known = F.when(F.lower(F.trim("role")).isin(*ROLES), F.lower(F.trim("role")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known.alias("role"), F.col("role").alias("was"), "text")
    rank = F.coalesce(*(F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)), F.lit(len(ROLES)))
    return rows.withColumns({"rank": rank, "h": F.xxhash64("text"), "number": F.coalesce(F.floor(F.col("turn") / block), F.lit(0)).cast("long")})


def _full(turns: DataFrame, block: int) -> DataFrame | None:
    """conv_id, number, turn, rank and bits (of the hash) of the cells of blocks with over four times as many rows as turns; None without any."""
    cell = ["conv_id", "number", "turn", "rank"]
    cells = checkpoint(_ordered(turns, block).groupBy(*cell).count().withColumn("all", F.sum("count").over(Window.partitionBy("conv_id", "number"))).filter(F.col("all") > 4 * block))
    if cells.isEmpty():
        return None
    return cells.select(*cell, F.ceil(F.log2(F.greatest(F.col("count") / block, F.lit(1.0)))).cast("int").alias("bits"))


def _placed(rows: DataFrame, full: DataFrame | None) -> DataFrame:
    """rows with `block`. The cells of full blocks are few; Spark sends them to all tasks if they are small when they are known."""
    part = lambda turn, rank, k: F.struct(F.col("number").alias("number"), turn.cast("long").alias("turn"), rank.cast("int").alias("rank"), k.cast("long").alias("k"))
    none = F.lit(None)
    if full is None:
        return rows.withColumn("block", part(none, none, none)).drop("number")
    c = full.select(*(F.col(x).alias(f"c_{x}") for x in full.columns))
    same = [F.col(x).eqNullSafe(F.col(f"c_{x}")) for x in ("conv_id", "number", "turn", "rank")]
    joined = rows.join(c, reduce(lambda a, b: a & b, same), "left")
    high = F.call_function("shiftrightunsigned", F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - F.col("c_bits"))  # in the order of h
    k = F.when(F.col("c_bits") > 0, high).otherwise(F.lit(0).cast("long"))
    cut = part(F.col("turn"), F.col("rank"), k)
    return joined.withColumn("block", F.when(F.col("c_bits").isNotNull(), cut).otherwise(part(none, none, none))).drop("number", *c.columns)


def once(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Without rows seen before in the partition; what was seen is forgotten when it is too much."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > limit:
            seen.clear()
        new = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "was", "text")), strict=True):  # the others follow from these
            digest = xxhash.xxh3_128_digest(repr(row).encode("utf-8", "surrogatepass"))
            new.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(new, pa.bool_()))


def boundaries(rows: DataFrame, costs: dict[str, int]) -> DataFrame:
    """conv_id, block, first (state before), last (state after; null in a conversation's last block). rows: conv_id, block, ORDER, role."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = {r: _matrix(r, costs) for r in (*ROLES, None)}

        def done(key, rows):
            m = one[rows[0]["role"]]
            for r in rows[1:]:
                m = _times(m, one[r["role"]])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([rows[0]["block"]], _BLOCK), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], ["conv_id", "block", "m"])

        return _blocks(batches, ("conv_id", "block"), done)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending = [costs["insert"] * len(ENDING[s]) for s in STATES]

        def done(key, rows):
            ms = [np.array(r["m"], dtype=np.int64).reshape(len(STATES), len(STATES)) for r in rows]
            best = [np.array([0] + [FAR] * (len(STATES) - 1))]
            for m in ms:
                best.append(np.minimum((best[-1][:, None] + m).min(axis=0), FAR))
            state = int(np.argmin(best[-1] + ending))
            states = [state]
            for m, before in zip(reversed(ms), reversed(best[:-1]), strict=True):
                state = int(np.argmin(before + m[:, state]))
                states.append(state)
            states = states[::-1]
            n = len(rows)
            last = [*states[1:-1], None]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([r["block"] for r in rows], _BLOCK), pa.array(states[:-1], pa.int32()), pa.array(last, pa.int32())], ["conv_id", "block", "first", "last"])

        return _blocks(batches, ("conv_id",), done)

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *ORDER)
    made = dealt.select("conv_id", "block", "role").mapInArrow(multiplied, f"conv_id long, block {_STRUCT}, m array<long>")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chosen, f"conv_id long, block {_STRUCT}, first int, last int")


def repair(turns: DataFrame, *, costs: dict[str, int] = COSTS, block: int = BLOCK) -> DataFrame:
    """A row for each turn: conv_id, turn, role, new_role, action, inserted (roles put before it), cost, rendered.

    The rendered pieces of a conversation, in the order of turn and place, are its text for training.
    """

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows):
            (first, last), rows = (rows[0]["first"], rows[0]["last"]), rows[1:]
            rows = [r for before, r in zip([None, *rows], rows, strict=False) if r != before]
            plan = solve([r["role"] for r in rows], first, last, costs)
            out = []
            open_turn = first > 0  # only the first block begins in the start state
            for i, (r, (state, action, made)) in enumerate(zip(rows, plan, strict=True)):
                role, merged = STATES[state], action.startswith("merge")
                head = "" if not open_turn else "\n\n" if merged else _CLOSE
                if not merged:
                    head += "".join(f"{_OPEN}{x}\n{_CLOSE}" for x in made) + f"{_OPEN}{role}\n"
                tail, ending = "", []
                if last is None and i == len(rows) - 1:
                    ending = ENDING[role]
                    tail = _CLOSE + "".join(f"{_OPEN}{x}\n{_CLOSE}" for x in ending)
                open_turn = True
                cost = (costs["relabel"] if "relabel" in action else 0) + (costs["merge"] if merged else 0) + costs["insert"] * (len(made) + len(ending))
                out.append((r["conv_id"], r["turn"], i, r["was"], role, action, made, ending, cost, head + (r["text"] or "") + tail))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn", "place", "role", "new_role", "action", "inserted", "ending", "cost", "rendered"])

        held: list[dict] = []  # each block begins with the row of its boundary states
        for batch in batches:
            for row in batch.to_pylist():
                if row["first"] is not None and held:
                    yield done(None, held)
                    held = []
                held.append(row)
        if held:
            yield done(None, held)

    rows = _placed(_ordered(turns, block), _full(turns, block)).select("conv_id", "block", *ORDER, "role", "text")
    edges = boundaries(rows.drop("text").distinct(), costs).withColumn("edge", F.lit(True))
    moved = rows.mapInArrow(once, rows.schema).withColumn("edge", F.lit(False))
    dealt = moved.unionByName(edges, allowMissingColumns=True).repartition("conv_id", "block")
    dealt = dealt.sortWithinPartitions("conv_id", "block", F.desc("edge"), *ORDER, "text")
    return dealt.select("conv_id", "turn", "role", "was", "text", "first", "last").mapInArrow(repaired, "conv_id long, turn long, place long, role string, new_role string, action string, inserted array<string>, ending array<string>, cost long, rendered string")


def query(turns: DataFrame) -> DataFrame:
    return repair(turns.select("conv_id", "turn", "role", "text")).withColumns({"inserted": F.array_join("inserted", ","), "ending": F.array_join("ending", ",")})
