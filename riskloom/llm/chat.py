"""Chat formatting: minimum-cost role repair, then rendering.

Legal conversations are an optional ``system`` turn, then ``user`` and ``assistant`` in turn, ending with ``assistant``: an
automaton of four states.  For each turn as found, a table gives the cheapest way from each state to each other (keep,
relabel, merge into the turn before, each perhaps after an inserted empty turn), and repair is a shortest path, by dynamic
programming.  The tables multiply as min-plus matrices, so a conversation is handled in chunks of CHUNK turn numbers: each
chunk's product is worked out where its turns are, the chunks' entry and exit states follow from the products alone, and the
path within each chunk is then found with its turns.  A conversation of any length is never in one task, also if its turn numbers are null
or equal; only its chunks' 4 x 4 tables are.

Each turn is rendered as a fragment; the fragments of a conversation in order of turn (turn, role, text) are the repaired
conversation.  Markers that occur in a text are broken by a zero-width space.

Defined results: an unknown or null role costs least to relabel; a null turn number comes first; turns of equal number follow
by role and text (where more than 4 * CHUNK turns share CHUNK numbers: by role, hash of the text and number among equal ones), repeated
ones all count; null text renders as empty; a row with a null conversation id is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

CHUNK = 1024
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: What changing a role costs, by role found and role given (3: unknown); a merge; an inserted empty turn.
RELABEL = {(0, 1): 3, (0, 2): 6, (1, 0): 8, (2, 0): 8, (1, 2): 4, (2, 1): 4, (3, 0): 6, (3, 1): 2, (3, 2): 2}
MERGE, INSERT = 2, 5
START, END, FAR = 0, 3, 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def step(state: int, role: int) -> int | None:
    """State after a turn; states are 0 (start) and 1 + the role of the last turn."""
    legal = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}[state]
    return role + 1 if role in legal else None


def ways(found: int) -> tuple[np.ndarray, dict]:
    """Least costs between states over one turn, and how: (inserted role or -1, role given, merged)."""
    cost, how = np.full((4, 4), FAR, np.int64), {}
    for state, put, role in product(range(4), (-1, 0, 1, 2), range(3)):
        at = state if put < 0 else step(state, put)
        if at is None:
            continue
        price = (INSERT if put >= 0 else 0) + (0 if role == found else RELABEL[found, role])
        options = [(price, step(at, role), (put, role, False))]
        if at == role + 1:
            options.append((price + MERGE, at, (put, role, True)))
        for c, to, what in options:
            if to is not None and (c, what) < (cost[state, to], how.get((state, to), (9,))):
                cost[state, to], how[state, to] = c, what
    return cost, how


WAYS = [ways(r) for r in range(4)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


#: Ends: 3 as it is; after a user turn an empty assistant turn; after system both.
FINAL = np.array([0, 2 * INSERT, INSERT, 0])


def product_of(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = times(m, WAYS[r][0])
    return m


def passages(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the cheapest path through all (ties: the least state)."""
    forward = [np.where(np.arange(4) == START, 0, FAR)]
    for m in tables:
        forward.append(np.minimum((forward[-1][:, None] + m).min(0), FAR))
    at, out = int(np.argmin(forward[-1] + FINAL)), []
    for m, f in zip(reversed(tables), reversed(forward[:-1])):
        before = int(np.argmin(f + m[:, at]))
        out.append((before, at))
        at = before
    return out[::-1]


def path(roles: list[int], entry: int, exit_: int) -> list[tuple[int, int, bool]]:
    """For each turn what is done, from the entry to the exit state (ties: the least state)."""
    forward = [np.where(np.arange(4) == entry, 0, FAR)]
    for r in roles:
        forward.append(np.minimum((forward[-1][:, None] + WAYS[r][0]).min(0), FAR))
    at, out = exit_, []
    for r, f in zip(reversed(roles), reversed(forward[:-1])):
        before = int(np.argmin(f + WAYS[r][0][:, at]))
        out.append(WAYS[r][1][before, at])
        at = before
    return out[::-1]


def _clean(t: str | None) -> str:
    return (t or "").replace("<|im_", "<​|im_")


def render(texts: list[str | None], done: list[tuple[int, int, bool]], first: bool, last: bool, exit_: int) -> list[str]:
    """Fragments; each closes the turn before it if it doesn't merge into it, and the last of all closes itself."""
    out = []
    for k, (t, (put, role, merged)) in enumerate(zip(texts, done)):
        begins = first and k == 0
        head = "" if begins else f"{CLOSE}\n"
        if put >= 0:
            head += f"{OPEN}{ROLES[put]}\n" + ("" if merged else f"{CLOSE}\n")
            out.append(head + ("" if merged else f"{OPEN}{ROLES[role]}\n") + _clean(t))
        elif merged:
            out.append("\n\n" + _clean(t))
        else:
            out.append(head + f"{OPEN}{ROLES[role]}\n" + _clean(t))
    if last and out:
        out[-1] += f"{CLOSE}\n" + "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}\n" for r in ending(exit_))
    return out


def ending(state: int) -> tuple[int, ...]:
    """Roles of the empty turns added at the end."""
    return {0: (), 1: (1, 2), 2: (2,), 3: ()}[state]


def _code(role: Column) -> Column:
    name = F.lower(F.trim(role))
    code = F.lit(3)
    for k, r in enumerate(ROLES):
        code = F.when(name.isin(r, *[a for a, to in ALIASES.items() if to == r]), k).otherwise(code)
    return code


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with the same first ``keys`` values that follow each other."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield out()
            held.clear()
    if held:
        yield out()


OUT = [("conv", pa.int64()), ("turn", pa.int64()), *((x, pa.string()) for x in ("role", "repaired_role", "action", "inserted_before", "inserted_after", "fragment"))]
SCHEMA = "conv long, turn long, role string, repaired_role string, action string, inserted_before string, inserted_after string, fragment string"
KEYS = ["conv", "chunk", "sub", "part_of"]


def _repaired(conv: int | None, turns: list[tuple], entry: int, exit_: int, first: bool, last: bool) -> Iterator[tuple]:
    """Rows of the result for the turns (turn, role, code, text) of one chunk."""
    done = path([t[2] for t in turns], entry, exit_)
    made = render([t[3] for t in turns], done, first, last, exit_)
    for k, ((turn, role, code, _), (put, to, merged), fragment) in enumerate(zip(turns, done, made)):
        action = "merge" if merged else "keep" if to == code else "relabel"
        after = ",".join(ROLES[r] for r in ending(exit_)) if last and k == len(turns) - 1 else ""
        yield conv, turn, role, ROLES[to], action, ROLES[put] if put >= 0 else None, after or None, fragment


def _chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """Adds sub and part_of, 0 but where turns of so few numbers are so many that a chunk would be too large: there the chunk is cut by turn number,
    role and hash of the text, and rows alike in all by the number that they get when they are counted and listed again."""
    n = store.parts(rows.sparkSession)
    heavy = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * chunk)
    heavy = store.put(heavy.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.ceil(F.col("n") / chunk).alias("m")), "heavy")
    plain = rows.withColumn("sub", F.lit(0).cast("long")).withColumn("part_of", F.lit(0).cast("long"))
    if heavy.isEmpty():
        return plain
    same = (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k"))
    counted = rows.join(heavy, same).groupBy("conv", "chunk", "turn", "role", "code", "text", "m").agg(F.count(F.lit(1)).alias("n"))
    cut = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("part_of")).repartition(n, "conv", "text", "part_of")
    share = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") * F.lit(2.0**-53)
    sub = ((F.coalesce(F.col("turn") - F.col("chunk") * chunk, F.lit(0)) * 4 + F.col("code")) * F.col("m") + F.floor(share * F.col("m"))).cast("long")
    listed = cut.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk).cast("long"), F.col("n") - F.col("part_of") * chunk))))
    listed = listed.select(*rows.columns, sub.alias("sub"), "part_of")
    return plain.join(heavy, same, "left_anti").unionByName(listed)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, turn, role, repaired_role, action, inserted_before, inserted_after, fragment), a row for each turn."""
    store.lean(turns.sparkSession)
    n = store.parts(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.floor(F.col(turn_col) / chunk), F.lit(-(1 << 62))).cast("long").alias("chunk"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), _code(F.col(role_col)).alias("code"), F.col(text_col).alias("text"))

    def single(batches):
        def rows():
            for batch in batches:
                for turn, role, code, text in zip(*(c.to_pylist() for c in batch.columns)):
                    (entry, exit_), = passages([product_of([code])])
                    yield from _repaired(None, [(turn, role, code, text)], entry, exit_, True, True)

        yield from _batched(rows(), OUT, 500)

    alone = rows.where(F.col("conv").isNull()).select("turn", "role", "code", "text").mapInArrow(single, SCHEMA)
    rows = _chunked(rows.where(F.col("conv").isNotNull()), chunk)

    def multiply(batches):
        rows = ((*key, product_of([r[1] for r in group]).ravel().tolist()) for key, group in _groups(batches, 4))
        yield from _batched(rows, [*((k, pa.int64()) for k in KEYS), ("cost", pa.list_(pa.int64()))])

    light = rows.select(*KEYS, "turn", "code").repartition(n, *KEYS).sortWithinPartitions(*KEYS, "turn", "code")
    tables = light.mapInArrow(multiply, "conv long, chunk long, sub long, part_of long, cost array<long>")

    def lead(batches):
        def rows():
            for (conv,), group in _groups(batches, 1):
                found = passages([np.array(g[-1]).reshape(4, 4) for g in group])
                for k, ((*key, _), (entry, exit_)) in enumerate(zip(group, found)):
                    yield conv, *key, entry, exit_, k == 0, k == len(group) - 1

        yield from _batched(rows(), [*((k, pa.int64()) for k in KEYS), ("entry", pa.int32()), ("exit", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])

    plan = tables.repartition(n, "conv").sortWithinPartitions(*KEYS).mapInArrow(lead, "conv long, chunk long, sub long, part_of long, entry int, exit int, first boolean, last boolean")
    #: Each chunk's plan comes before its turns.
    plan = plan.select(*KEYS, F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("code"), F.lit(None).cast("string").alias("text"), F.struct("entry", "exit", "first", "last").alias("plan"))
    whole = rows.select(*KEYS, F.lit(1).alias("part"), "turn", "role", "code", "text").withColumn("plan", F.lit(None).cast("struct<entry:int,exit:int,first:boolean,last:boolean>"))
    dealt = plan.unionByName(whole).repartition(n, *KEYS).sortWithinPartitions(*KEYS, "part", "turn", "code", "text")

    def follow(batches):
        def rows():
            for (conv, *_), group in _groups(batches, 4):
                plan = group[0][5]
                yield from _repaired(conv, [t[1:5] for t in group[1:]], plan["entry"], plan["exit"], plan["first"], plan["last"])

        yield from _batched(rows(), OUT, 500)

    return dealt.mapInArrow(follow, SCHEMA).unionByName(alone)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(store.table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE_SQL: dict[str, str] = {}
