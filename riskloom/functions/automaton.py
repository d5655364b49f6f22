"""Many words looked for at once: an automaton over the bytes of texts, whose cost doesn't depend on how many words it knows.

The words' bytes form a tree; each node's failure link leads to the longest other node that ends as it does, and with those filled in a
table of one row a node and one column a byte that words use (all others share one) says where every next byte leads.  A batch's
texts are laid end to end, each followed by a byte of no word, and cut into lanes; all lanes advance together, one byte a step, each
beginning as many bytes early as the longest word has, so that no word is lost at a cut.

Defined results: a null text gives null; a word that stands in a list twice counts twice; the empty word is in every text; words and texts are
compared as they are, so callers lower both; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that lanes are cut from at once, how many lanes that makes, and nodes that an automaton has at most.
PIECE, LANES, MOST_NODES = 1 << 21, 4096, 4_000_000


class Automaton:
    """Of named lists of words."""

    def __init__(self, lists: dict[str, Iterable[str]]):
        self.names = list(lists)
        pairs = [(k, w.encode()) for k, words in enumerate(lists.values()) for w in words if w is not None]
        words = sorted({w for _, w in pairs if w})
        place = {w: i for i, w in enumerate(words)}
        self.weights = np.zeros((len(words) + 1, len(self.names)), np.int64)  # how often each list has each word; the last: the empty one
        for k, w in pairs:
            self.weights[place.get(w, len(words)), k] += 1
        self.longest = max(map(len, words), default=1)
        self.words = [w.decode() for w in words]
        used = sorted({c for w in words for c in w})
        self.classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        parents, by, depths, own = [0], [0], [0], [-1]
        for i, w in enumerate(words):
            node = 0
            for c in self.classes[np.frombuffer(w, np.uint8)].tolist():
                if (to := children[node].get(c)) is None:
                    to = children[node][c] = len(children)
                    if to > MOST_NODES:
                        raise ValueError(f"the words need more than {MOST_NODES} nodes")
                    children.append({})
                    parents.append(node)
                    by.append(c)
                    depths.append(depths[node] + 1)
                    own.append(-1)
                node = to
            own[node] = i
        parents, by, depths, self.own = (np.array(x, np.int32) for x in (parents, by, depths, own))
        n = len(children)
        self.next = np.zeros((n, len(used) + 1), np.int32)
        fail, self.outer = np.zeros(n, np.int32), np.zeros(n, np.int32)  # outer: the nearest node along failure links at which a word ends; 0: none
        order = np.argsort(depths, kind="stable")
        ends = np.searchsorted(depths[order], np.arange(int(depths.max()) + 2))
        for d in range(int(depths.max()) + 1):
            level = order[ends[d] : ends[d + 1]]
            if d > 1:
                fail[level] = self.next[fail[parents[level]], by[level]]
            if d:
                self.next[level] = self.next[fail[level]]
                self.outer[level] = np.where(self.own[fail[level]] >= 0, fail[level], self.outer[fail[level]])
            below = order[ends[d + 1] : ends[d + 2]] if d + 2 < len(ends) else np.zeros(0, np.int64)
            self.next[parents[below], by[below]] = below
        self.tells = (self.own >= 0) | (self.outer > 0)
        self.width = self.next.shape[1]
        self.flat = self.next.ravel()

    def _run(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words end in a sequence of classes, and the node there."""
        n = len(c)
        lanes = max(1, min(LANES, n // (4 * self.longest) or 1))
        step = -(-n // lanes)
        back = self.longest - 1
        padded = np.zeros(back + lanes * step, c.dtype)
        padded[back : back + n] = c
        start = np.arange(lanes) * step
        node, places, nodes = np.zeros(lanes, np.int32), [], []
        for k in range(back + step):
            node = self.flat[node * self.width + padded[start + k]]
            if k >= back:
                hit = np.flatnonzero(self.tells[node])
                if len(hit):
                    places.append(start[hit] + (k - back))
                    nodes.append(node[hit])
        return (np.concatenate(places), np.concatenate(nodes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _pieces(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Classes of bytes of rows laid end to end, and the row of each; long rows come in overlapping parts."""
        column = column.fill_null("").cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
            if off[j] - off[i] > PIECE:  # one long row
                for lo in range(int(off[i]), int(off[j]), PIECE):
                    part = self.classes[data[max(int(off[i]), lo - self.longest + 1) : min(lo + PIECE, int(off[j]))]]
                    yield part, np.full(len(part), i)
            else:
                row = np.repeat(np.arange(i, j), np.diff(off[i : j + 1]) + 1)
                c = np.zeros(len(row), self.classes.dtype)
                inside = np.ones(len(row), bool)
                inside[np.cumsum(np.diff(off[i : j + 1]) + 1) - 1] = False
                c[inside] = self.classes[data[off[i] : off[j]]]
                yield c, row
            i = j

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a word (its place in ``words``) that stands in it, each once, in order."""
        keys = [np.zeros(0, np.int64)]
        if self.words:
            for c, row in self._pieces(column):
                at, node = self._run(c)
                key = np.unique(row[at] * np.int64(len(self.own)) + node)
                rows, node = key // len(self.own), key % len(self.own)
                while len(node):
                    here = self.own[node]
                    keys.append(rows[here >= 0] * len(self.words) + here[here >= 0])
                    further = self.outer[node] > 0
                    rows, node = rows[further], self.outer[node[further]]
        key = np.unique(np.concatenate(keys))
        return key // max(len(self.words), 1), key % max(len(self.words), 1)

    def count(self, column: pa.Array) -> np.ndarray:
        """(rows, lists): how many words of each list stand in each text."""
        rows, words = self.found(column)
        out = np.empty((len(column), len(self.names)), np.int64)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(rows, self.weights[words, k], len(column)) + self.weights[-1, k]
        return out

    def counts(self, text: Column) -> Column:
        """A struct of the lists' names: how many of each list's words the text contains."""
        names = self.names

        def run(t: pa.Array) -> pa.Array:
            got, none = self.count(t), pa.array(t.is_null())
            return pa.StructArray.from_arrays([pa.array(got[:, k], pa.int32()) for k in range(len(names))], names=names, mask=none)

        return F.arrow_udf(run, ", ".join(f"`{n}` int" for n in names))(text)


def of_table(words: DataFrame, name: str, word: str) -> Automaton:
    """The words of a table by list, in lower case; as many as MOST_NODES bytes, and no table beyond."""
    rows = words.select(F.col(name).cast("string").alias("n"), F.lower(word).alias("w")).where(F.col("n").isNotNull() & F.col("w").isNotNull())
    if (size := rows.agg(F.sum(F.octet_length("w"))).first()[0] or 0) > MOST_NODES:
        raise ValueError(f"{size} bytes of words, more than {MOST_NODES}")
    lists: dict[str, list[str]] = {}
    for n, w in sorted(map(tuple, rows.collect())):
        lists.setdefault(n, []).append(w)
    return Automaton(lists)
