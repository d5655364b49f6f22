"""What each observation of a key finds, as a fold over what was written.

An observation that finds no entry under its key, an expired or a changed one, writes its own; one that is served writes nothing, so an
entry ages from when it was written, however often it is read.  Which entry an observation meets depends on all before it, which
no fixed look back can tell.  But where an entry ends depends on the entry alone: at the first later observation that finds it expired or
changed.  So each observation points at the one that would end its entry, and the entries really written are those on the chain from
the key's first observation.

Rows are sorted by key and time into blocks (range partitions, written with ``checkpoint``), whatever the keys, so a hot key lies in many
blocks.  Within a block pointers are followed at once.  For a key that goes on into other blocks, every entry that outlives its block asks
the block where its time runs out, and pointer doubling over these entries, in as many rounds as the logarithm of the blocks, finds
the ones on the chain.  Only a line a block reaches the driver: its first and last key, and in the end the entry open at its start.

Defined results: null keys are one key; rows of equal key, time and order come in any order; a row without a time is last of its key
and finds what its neighbours find at the end of time; an empty table gives an empty result; columns whose names begin with two
underscores are this module's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources import scratch

#: Rows of a block.
BLOCK = 400_000
_FAR = 1 << 60
_NONE = (1 << 62) - 1
OUTCOMES = ("absent", "renewed", "changed", "same", "held")


class Block:
    """Sorted rows of one block as arrays; seg: which key a row is of, end: where that key's rows end."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).combine_chunks()
        self.keys = np.array(column("__k").to_pylist(), object)
        self.t, self.keep, self.check = (column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__t", "__keep", "__check"))
        self.always = column("__always").to_numpy(zero_copy_only=False).astype(bool)
        self.marks = np.array(column("__mark").to_pylist(), object)
        n = len(self.t)
        self.code = pd.factorize(self.marks)[0].astype(np.int64)  # null: -1
        fresh = np.ones(n, bool)
        which = pd.factorize(self.keys, use_na_sentinel=False)[0]
        fresh[1:] = which[1:] != which[:-1]
        self.start = np.flatnonzero(fresh)
        self.seg = np.cumsum(fresh) - 1
        self.end = np.append(self.start[1:], n)[self.seg] if n else np.zeros(0, np.int64)
        self.times = np.unique(self.t)
        self.place = self.seg * (len(self.times) + 1) + np.searchsorted(self.times, self.t)
        turns = np.flatnonzero(fresh | np.append([True], (self.code[1:] != self.code[:-1]) | (self.code[1:] < 0))[:n]) if n else np.zeros(0, np.int64)
        at = np.searchsorted(turns, np.arange(n), "right")
        self.differs = np.minimum(np.append(turns, n)[at], self.end)  # first later row of the key with another mark

    def first_at(self, t: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """First row of that key at or after t; the key's end if there is none."""
        at = np.searchsorted(self.place, seg * (len(self.times) + 1) + np.searchsorted(self.times, t))
        return np.minimum(at, np.append(self.start[1:], len(self.t))[seg])

    def ended(self) -> tuple[np.ndarray, np.ndarray]:
        """The row that ends each row's entry (the key's end in this block: none does), and where its mark is first compared."""
        after = np.arange(len(self.t)) + 1
        by = np.maximum(self.first_at(self.t + self.keep, self.seg), after)
        compared = np.maximum(self.first_at(self.t + self.check + 1, self.seg), after)
        inside = np.minimum(compared, len(self.t) - 1)
        changed = np.where(compared >= self.end, self.end, np.where(self.code[inside] != self.code, compared, self.differs[inside]))
        by = np.where(self.check < _FAR, np.minimum(by, changed), by)
        return np.where(self.always, after, np.minimum(by, self.end)), compared

    def last_entries(self, ended: np.ndarray) -> np.ndarray:
        """The entry that is open at the key's end in this block, if each row's own is written."""
        to = np.where(ended < self.end, ended, np.arange(len(ended)))
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further


def _outcome(t: np.ndarray, keep: np.ndarray, check: np.ndarray, always: np.ndarray, differs: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What rows at ``now`` find, as places in OUTCOMES, given the entries they meet and whether their marks differ."""
    age = now - t
    return np.select([age >= keep, always, (age > check) & differs, age > check], [0, 1, 2, 3], 4)


def _sorted(rows: DataFrame, key: str, ts: str, order: str, keep: Column, check: Column | None, mark: Column | None, always: Column | None, block: int) -> DataFrame:
    spark = rows.sparkSession
    scratch.checkpoints(spark)
    time = F.coalesce(F.unix_micros(F.col(f"`{ts}`").cast("timestamp")), F.lit(_FAR))
    added = {
        "__k": F.col(f"`{key}`").cast("string"), "__t": time, "__keep": F.coalesce(keep.cast("long"), F.lit(0)),
        "__check": F.coalesce((F.lit(None) if check is None else check).cast("long"), F.lit(_FAR)),
        "__mark": (F.lit(None) if mark is None else mark).cast("string"), "__always": F.coalesce(F.lit(False) if always is None else always, F.lit(False)),
    }
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block))
    by = ["__k", "__t", f"`{order}`"]
    return rows.withColumns(added).repartitionByRange(n, *by).sortWithinPartitions(*by).checkpoint().withColumn("__block", F.spark_partition_id())


_READ = ["__block", "__k", "__t", "__keep", "__check", "__mark", "__always"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task, which are one block."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        yield table.column("__block")[0].as_py(), table


def _lines(rows: DataFrame) -> list[dict]:
    """One line a block, in order: first and last key, first time, first mark, where the mark first differs from it in the first key's rows, whether those are
    all, last mark, and the entry open at the end if the last key begins here."""
    kinds = "block int, first string, last string, t long, mark string, differs long, whole boolean, last_mark string, entry struct<t:long,keep:long,check:long,mark:string,always:boolean>"

    def run(batches):
        for number, table in _blocks(batches):
            b = Block(table)
            size = int(b.end[0])
            first = int(b.differs[0])
            e = int(b.last_entries(b.ended()[0])[b.start[-1]])
            entry = {"t": int(b.t[e]), "keep": int(b.keep[e]), "check": int(b.check[e]), "mark": b.marks[e], "always": bool(b.always[e])}
            line = {"block": number, "first": b.keys[0], "last": b.keys[-1], "t": int(b.t[0]), "mark": b.marks[0], "differs": first if first < size else -1, "whole": size == len(b.t), "last_mark": b.marks[-1], "entry": entry}
            fields = [("block", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("t", pa.int64()), ("mark", pa.string()), ("differs", pa.int64()), ("whole", pa.bool_()), ("last_mark", pa.string())]
            inner = pa.struct([("t", pa.int64()), ("keep", pa.int64()), ("check", pa.int64()), ("mark", pa.string()), ("always", pa.bool_())])
            yield pa.RecordBatch.from_pylist([line], schema=pa.schema([*fields, ("entry", inner)]))

    got = rows.select(*_READ).mapInArrow(run, kinds).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: r["block"])]


def _position(block: int, row: np.ndarray | int) -> np.ndarray:
    return np.int64(block) << 32 | np.asarray(row, np.int64)


class Course:
    """How keys go on from block to block; made from the lines."""

    def __init__(self, lines: list[dict]):
        self.follows: dict[int, int] = {}  # the block in which a block's last key goes on
        self.goes: dict[int, int] = {}  # the same, of blocks that hold one key only
        self.starts: dict[int, tuple[str | None, int]] = {}  # first mark of such a following block, and the first later row of the key with another one
        self.after: dict[int, int] = {}  # the first later row of a block's last key whose mark is another than its last one
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # the blocks of each key of several, and their first times
        self.opened: dict[int, tuple] = {}  # the entry open at the end of the first of them
        self.where: dict[int, tuple[int, int]] = {}  # of blocks whose last key goes on: which run, and the place in it
        by = {x["block"]: x for x in lines}
        for x, y in zip(lines, lines[1:]):
            if x["last"] == y["first"]:
                self.follows[x["block"]] = y["block"]
        for x, y in zip(reversed(lines[:-1]), reversed(lines[1:])):
            b, n = x["block"], y["block"]
            if b not in self.follows:
                continue
            further = self.after[n] if y["whole"] and n in self.follows else _NONE
            self.starts[n] = (y["mark"], int(_position(n, y["differs"])) if y["differs"] >= 0 else further)
            self.after[b] = self.from_start(n, x["last_mark"])
            if x["whole"]:
                self.goes[b] = n
        for b in sorted(self.follows):
            if b in self.where:
                continue
            mine, k = [b], b
            while k in self.follows and (k == b or by[k]["whole"]):
                k = self.follows[k]
                mine.append(k)
            for place, x in enumerate(mine[:-1]):
                self.where[x] = (len(self.runs), place)
            self.runs.append((np.array(mine), np.array([by[x]["t"] for x in mine])))
            self.opened[b] = tuple(by[b]["entry"])

    def from_start(self, block: int, mark: str | None) -> int:
        """First row of a following block's first key whose mark is another than this one."""
        first, differs = self.starts[block]
        return int(_position(block, 0)) if first is None or first != mark else differs


def _outliving(rows: DataFrame, course: Course) -> DataFrame:
    """All rows of keys in the blocks from which they go on: the entry open at the block's end if the row's own is written; and of entries that are open then, what they ask."""
    follows, after = course.follows, course.after
    begun = {int(blocks[0]) for blocks, _ in course.runs}
    where = {b for b, (run, _) in course.where.items() if len(course.runs[run][0]) > 2}

    def run(batches):
        for number, table in _blocks(batches):
            if number not in where:
                continue
            b = Block(table)
            ended, compared = b.ended()
            last = b.last_entries(ended)
            root = int(last[b.start[-1]]) if number in begun else -1  # the key's first row is here, so one entry is known to be open at the end
            for lo in range(int(b.start[-1]), len(b.t), 50_000):
                i = np.arange(lo, min(lo + 50_000, len(b.t)))
                known, compare = np.full(len(i), _NONE), np.full(len(i), _FAR)
                due = b.check[i] < _FAR
                inside = due & (compared[i] < b.end[i])  # equal up to the block's end
                known[inside] = after[number]
                compare[due & ~inside] = (b.t[i] + b.check[i] + 1)[due & ~inside]
                known[b.always[i]] = _position(follows[number], 0)
                yield pa.RecordBatch.from_pydict({
                    "id": _position(number, i), "last": _position(number, last[i]), "out": last[i] == i, "root": i == root, "expires": b.t[i] + b.keep[i], "compare": compare, "known": known,
                    "block": np.full(len(i), number), "t": b.t[i], "keep": b.keep[i], "check": b.check[i], "mark": pa.array(b.marks[i].tolist(), pa.string()), "always": b.always[i],
                })

    return rows.select(*_READ).mapInArrow(run, "id long, last long, out boolean, root boolean, expires long, compare long, known long, block long, t long, keep long, check long, mark string, always boolean").checkpoint()


def _asked(nodes: DataFrame, course: Course) -> DataFrame:
    """The asks of entries that are open at their block's end, each with the block that can tell: the last of the key that begins before then."""
    where, runs = course.where, course.runs

    def target(batches):
        for batch in batches:
            at, block = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            to = np.zeros(len(at), np.int64)
            for number in np.unique(block):
                mine = block == number
                blocks, times = runs[where[number][0]]
                from_ = where[number][1] + 1
                to[mine] = blocks[from_ + np.maximum(np.searchsorted(times[from_:], at[mine]) - 1, 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=["id", "at", "kind", "mark", "block", "to"])

    both = F.array(F.struct(F.col("expires").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("compare").alias("at"), F.lit(1).alias("kind")))
    asks = nodes.where("out AND NOT always").select("id", F.explode(both).alias("a"), "mark", "block").select("id", "a.at", "a.kind", "mark", "block")
    return asks.where(F.col("at") < F.lit(_FAR)).mapInArrow(target, "id long, at long, kind int, mark string, block long, to long")


def _answered(rows: DataFrame, asks: DataFrame, course: Course) -> DataFrame:
    """Each ask's first row.  A block sends each block that asks the rows between its least and its greatest time; blocks that ask follow each other in time, so their rows hardly overlap."""
    goes, after, from_start = course.goes, course.after, course.from_start
    hit: dict[int, list[tuple[int, int, int]]] = {}
    for r in asks.groupBy("to", "block").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect():  # a few lines a block
        hit.setdefault(r["to"], []).append((r["block"], r["lo"], r["hi"]))

    def slices(batches):
        for number, table in _blocks(batches):
            if number not in hit:
                continue
            b = Block(table)
            size = int(b.end[0])  # asks are about the block's first key
            for block, lo, hi in hit[number]:
                i, j = b.first_at(np.array([lo, hi]), np.zeros(2, np.int64))
                for k in range(int(i), min(int(j) + 1, size), 50_000):
                    at = np.arange(k, min(k + 50_000, int(j) + 1, size))
                    differs = np.where(b.differs[at] < size, b.differs[at], -1)
                    yield pa.RecordBatch.from_pydict({"to": np.full(len(at), number), "block": np.full(len(at), block), "row": at, "t": b.t[at], "m": pa.array(b.marks[at].tolist(), pa.string()), "differs": differs})

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        number = key[0].as_py()
        right = right.sort_by("row")
        t, row, marks, differs = (right.column(c).to_pylist() for c in ("t", "row", "m", "differs"))
        got = []
        for i, kind, mark in zip(np.searchsorted(np.array(t, np.int64), left.column("at").to_numpy()).tolist(), left.column("kind").to_pylist(), left.column("mark").to_pylist()):
            if i < len(t):
                if kind == 0 or marks[i] is None or marks[i] != mark:
                    got.append(int(_position(number, row[i])))
                else:
                    got.append(int(_position(number, differs[i])) if differs[i] >= 0 else after[number] if number in goes else _NONE)
            elif number not in goes:
                got.append(_NONE)
            else:
                got.append(int(_position(goes[number], 0)) if kind == 0 else from_start(goes[number], mark))
        return pa.table({"id": left.column("id"), "found": pa.array(got, pa.int64())})

    sent = rows.select(*_READ).mapInArrow(slices, "to long, block long, row long, t long, m string, differs long")
    return asks.groupBy("to", "block").cogroup(sent.groupBy("to", "block")).applyInArrow(answer, "id long, found long")


def _carried(rows: DataFrame, course: Course) -> dict[int, tuple]:
    """The entry open at the start of each block whose first key began in an earlier one."""
    by = dict(course.opened)
    if any(len(blocks) > 2 for blocks, _ in course.runs):
        by |= _open_at_ends(rows, course)
    carried: dict[int, tuple] = {}
    for blocks, _ in course.runs:
        open_ = None
        for b in blocks.tolist():
            if open_ is not None:
                carried[b] = open_
            open_ = by.get(b, open_) if b != blocks[-1] else None
    return carried


def _open_at_ends(rows: DataFrame, course: Course) -> dict[int, tuple]:
    """By block of the keys of more than two: the entry written there that is open at its end, if there is one."""
    nodes = _outliving(rows, course)
    answers = _answered(rows, _asked(nodes, course).checkpoint(), course)
    ends = nodes.where("out").select("id", F.col("known").alias("found")).unionByName(answers).groupBy("id").agg(F.min("found").alias("found"))
    # a row of a key's last block isn't a node: what is open at its end doesn't matter
    jumps = ends.where(F.col("found") < F.lit(_NONE)).join(nodes.select(F.col("id").alias("found"), F.col("last").alias("to")), "found").select(F.col("id").alias("from"), "to").checkpoint()
    reached = nodes.where("root").select(F.col("id").alias("from"))
    for _ in range(max(len(blocks) for blocks, _ in course.runs).bit_length()):
        reached = reached.unionByName(reached.join(jumps, "from").select(F.col("to").alias("from"))).distinct().checkpoint()
        jumps = jumps.join(jumps.select(F.col("from").alias("to"), F.col("to").alias("then")), "to").select("from", F.col("then").alias("to")).checkpoint()
    on_chain = nodes.join(reached.select(F.col("from").alias("id")), "id").select("block", "t", "keep", "check", "mark", "always").collect()  # one a block at most
    return {r["block"]: tuple(r)[1:] for r in on_chain}


def found(rows: DataFrame, key: str, ts: str, order: str, keep: Column, check: Column | None = None, mark: Column | None = None, always: Column | None = None, out: str = "outcome", block: int = BLOCK) -> DataFrame:
    """The rows with what each finds under its key (one of OUTCOMES).

    Of the entry that a row would write: ``keep`` is how long it stays, in microseconds (null: nothing is written); from an age beyond
    ``check`` on (null: never) its ``mark`` is compared with the observation's, and another or none ends it; ``always``: the next observation
    writes anew.  A column named like the outcome gives way.
    """
    columns = [c for c in rows.columns if c != out]
    table = _sorted(rows.select(*[f"`{c}`" for c in columns]), key, ts, order, keep, check, mark, always, block)
    lines = _lines(table)
    carried = _carried(table, Course(lines))
    schema = ", ".join([*(f"`{n}` {k}" for n, k in table.select(*[f"`{c}`" for c in columns]).dtypes), f"`{out}` string"])

    def run(batches):
        for number, t in _blocks(batches):
            b = Block(t)
            ended, _ = b.ended()
            n = len(b.t)
            meets = np.full(n, -1)  # the row whose entry a row meets
            result = np.zeros(n, np.int64)
            starts, ends = b.start.tolist(), np.append(b.start[1:], n).tolist()
            if number in carried:
                t0, keep0, check0, mark0, always0 = carried[number]
                size = ends[0]
                differs = np.array([m is None or m != mark0 for m in b.marks[:size]])
                one = lambda v: np.full(size, v)  # noqa: B023, E731
                got = _outcome(one(t0), one(keep0), one(check0), one(always0), differs, b.t[:size])
                stop = np.flatnonzero(got <= 2)
                upto = int(stop[0]) if len(stop) else size
                result[: min(upto + 1, size)] = got[: min(upto + 1, size)]
                starts[0] = upto
            writes = []
            to = ended.tolist()
            for i, end in zip(starts, ends):
                while i < end:
                    writes.append(i)
                    i = to[i]
            writes = np.array(writes, np.int64)
            if len(writes):
                at = np.searchsorted(writes, np.arange(n)) - 1  # the last write before each row
                meets = np.where((at >= 0) & (b.seg[writes[np.maximum(at, 0)]] == b.seg), writes[np.maximum(at, 0)], -1)
            some = np.flatnonzero(meets >= 0)
            m = meets[some]
            result[some] = _outcome(b.t[m], b.keep[m], b.check[m], b.always[m], (b.code[some] != b.code[m]) | (b.code[some] < 0), b.t[some])
            names = np.array(OUTCOMES, object)[result]
            yield from t.select(columns).append_column(out, pa.array(names, pa.string())).to_batches(max_chunksize=10_000)

    extra = [c for c in _READ if c not in columns]
    return table.select(*[f"`{c}`" for c in columns], *extra).mapInArrow(run, schema)
