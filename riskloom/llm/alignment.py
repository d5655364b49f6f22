"""Alignment of two tokenizers over the same bytes, by owner arrays.

``np.repeat`` writes over each byte of a text the index of the token that owns it, once for A and once for B.  Where the pair of owners
changes, two tokens overlap; where both change at once, the text is cut, and the tokens between two cuts are one group.  The last
tokens of a group end together and are linked.

A space between two visible characters starts a token in both (checked on the vocabularies when they are loaded), so a text is the
sequence of its chunks from such a space to the next.  Each task encodes and aligns a chunk once, and memory follows the chunks, not
the documents.  Tokenizers without that property get whole texts.

Counts of linked ids over the corpus need no shuffle of texts: each task adds up its own pairs.  Of two tokens that end together
one's bytes end the other's, so a vocabulary has at most ``most_pairs`` of them (under a million for the default ones), however large
the corpus; that table alone is collected and sent to the tasks that look up each document's links.

Defined results: null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens and no links; texts of
any length are read whole; repeated rows count as often as they stand there, whatever their ids; an empty table gives an empty
result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Chunks that a task remembers, characters of texts that it takes at once, and of chunks that it encodes as one text.
KEPT, AT_ONCE, JOINED = 300_000, 1 << 20, 1 << 13
#: Characters that no tokenizer counts as space (Latin, Greek, Cyrillic, ..., CJK, Hangul).
_SEEN = r"!-~\u00a1-\u167f\u3001-\ud7ff"
_CUT = re.compile(f"(?<=[{_SEEN}]) (?=[{_SEEN}])")
#: What can stand between two such cuts.
_SAFE = re.compile(f" [{_SEEN}](?:.*[{_SEEN}])?\\Z", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Both tokenizers, made from the bytes of their files, so that tasks need no path."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        spec, letters = json.loads(a_file), byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = piece.encode() if i in special else bytes(letters[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        name = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a_names = name(len(self.a_bytes), ","), name(len(self.a_bytes), "|")  # within a group, at its end
        self.b_names = name(len(self.b_bytes), ","), name(len(self.b_bytes), ";")
        split = spec.get("pre_tokenizer") or {}
        self.by_chunks = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and self._plain(b_file) and not any(re.search("[^▁]▁", p) for p in pieces)

    @staticmethod
    def _plain(b_file: bytes) -> bool:
        """Whether B reads texts as they are, but for a space in front."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b_file)
        n = model.normalizer_spec
        return not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix

    def most_pairs(self) -> int:
        """More pairs of ids than this can't end together: of each, one's bytes are the other's or the end of them."""
        a, b = ({}, {})
        for table, entries in ((a, self.a_bytes), (b, self.b_bytes)):
            for x in entries:
                table[x] = table.get(x, 0) + 1
        ends = lambda x: (x[i:] for i in range(len(x)))
        return sum(n * sum(b.get(e, 0) for e in ends(x)) for x, n in a.items()) + sum(n * sum(a.get(e, 0) for e in ends(x) if e != x) for x, n in b.items())

    def chunks(self, t: str) -> list[str]:
        """Of a space and the text."""
        if not self.by_chunks:
            return [" " + t]
        parts = _CUT.split(" " + t)
        return [parts[0], *(" " + p for p in parts[1:])]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A one chunk after the other, where each chunk's start, the same of B, and whether both give the chunk back (else it has none)."""
        safe = [bool(_SAFE.match(c)) for c in chunks] if self.by_chunks else [False] * len(chunks)
        runs, size = [], JOINED
        for k, ok in enumerate(safe):  # neighbours that can be encoded as one text, since they would be cut again where they meet
            if ok and size < JOINED:
                runs[-1].append(k)
                size += len(chunks[k])
            else:
                runs.append([k])
                size = len(chunks[k]) if ok else JOINED
        return self._encode(chunks, runs)

    def _encode(self, chunks: list[str], runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = ["".join([chunks[k] for k in r]) for r in runs]
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a, b = [e.ids for e in batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = [t.encode() for t in texts]
        back = [b"".join([self.a_bytes[i] for i in x]) == t and b"".join([self.b_bytes[i] for i in y]) == t for x, y, t in zip(a, b, raw)]
        if not all(back):
            again = [[k] for r, ok in zip(runs, back) for k in r if not ok and len(r) > 1]
            if again:  # one of a run's chunks isn't given back: each by itself
                return self._encode(chunks, [r for r, ok in zip(runs, back) if ok or len(r) == 1] + again)
            a, b = ([x if ok else [] for x, ok in zip(ids, back)] for ids in (a, b))
        order = np.fromiter((k for r in runs for k in r), np.int64, len(chunks))
        good = np.repeat(np.array(back, bool), [len(r) for r in runs])
        sizes = np.fromiter((len(chunks[k].encode()) for r in runs for k in r), np.int64, len(chunks))
        ends, out = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]), []
        for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
            at = np.concatenate([[0], np.cumsum(sizes[flat])])
            off = np.searchsorted(at, ends)
            if not np.array_equal(at[off], ends):
                raise ValueError("a token crosses a space between two visible characters")
            out += [flat, off]
        if np.array_equal(order, np.arange(len(chunks))):
            return (*out, good)
        place = np.argsort(order)
        return (*_reordered(out[0], out[1], place), *_reordered(out[2], out[3], place), good[place])


def _slices(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries off[i]:off[i + 1] of all i in ``at``, one after the other."""
    n = off[at + 1] - off[at]
    return np.repeat(off[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def _reordered(flat: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[_slices(off, at)], np.concatenate([[0], np.cumsum(np.diff(off)[at])])


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of tokens that share bytes (their indices in A, in B), and those that end together; both arrays of sizes cover the same bytes."""
    a, b = (np.repeat(np.arange(len(s), dtype=np.int32), s) for s in (a_sizes, b_sizes))
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[:-1], last_b[:-1] = a[1:] != a[:-1], b[1:] != b[:-1]
    shared, together = last_a | last_b, last_a & last_b
    return a[shared], b[shared], a[together], b[together]


def written(c: Codec, a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, a_off: np.ndarray, b_off: np.ndarray) -> list[str]:
    """The groups of each chunk as text; ea, eb: the last token of each group."""
    groups_a, groups_b = np.searchsorted(ea, np.arange(len(a))), np.searchsorted(eb, np.arange(len(b)))
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[ea], last_b[eb] = True, True
    parts = np.empty(len(a) + len(b), object)  # of each group A's tokens, then B's; each with the mark that follows it
    before = np.concatenate([[0], eb + 1])
    parts[np.arange(len(a)) + before[groups_a]] = np.where(last_a, c.a_names[1][a], c.a_names[0][a])
    parts[np.arange(len(b)) + (ea + 1)[groups_b]] = np.where(last_b, c.b_names[1][b], c.b_names[0][b])
    said, at = parts.tolist(), (a_off + b_off).tolist()
    return ["".join(said[i:j])[:-1] for i, j in zip(at, at[1:])]


class Aligned:
    """Chunks with their groups, in flat arrays: of chunk i the groups off[i]:off[i + 1], each with its last ids; remembered across batches."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pair, self.off = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, of B, overlaps
        self.good = np.zeros(0, bool)
        self.names: list[str] = []

    def add(self, fresh: list[str]) -> None:
        """Encodes and aligns chunks that aren't known yet."""
        if not fresh:
            return
        c = self.codec
        a, a_off, b, b_off, good = c.encode(fresh)
        sa, _, ea, eb = owners(c.a_sizes[a], c.b_sizes[b])
        ends = np.searchsorted(ea, a_off)  # where each chunk's groups start
        overlaps = np.diff(np.searchsorted(sa, a_off))
        self.names += written(c, a, b, ea, eb, a_off, b_off)
        start = len(self.index)
        self.index.update(zip(fresh, range(start, start + len(fresh))))
        self.pair = np.concatenate([self.pair, a[ea] << 32 | b[eb]])
        self.off = np.concatenate([self.off, self.off[-1] + ends[1:]])
        self.counts = np.concatenate([self.counts, np.stack([np.diff(a_off), np.diff(b_off), overlaps], 1)])
        self.good = np.concatenate([self.good, good])

    def rows(self, texts: Iterable[str | None]) -> Iterator[list[int] | None]:
        """The chunks of each text, as places in these arrays; None: no tokens."""
        cut = [self.codec.chunks(t) if t else [] for t in texts]
        if len(self.index) > KEPT:
            self.clear()
        self.add([s for s in dict.fromkeys(s for x in cut for s in x) if s not in self.index])
        for x in cut:
            at = np.fromiter(map(self.index.__getitem__, x), np.int64, len(x))
            yield at if len(at) and self.good[at].all() else None


def _portions(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Rows of AT_ONCE characters together; a longer one is alone."""
    size = np.asarray(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    for i, j in text.runs(off, AT_ONCE):
        yield ids.slice(i, j - i), texts.slice(i, j - i).to_pylist()


#: What ``align`` can return of each document, besides the id.
OUTPUTS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_overlaps": "long",
    "groups": "string",  # as ids: a1,a2|b1;a3|b2,b3
    "groups_sha256": "string",  # of these; '' without tokens
    "pairs": "array<long>", "times": "array<int>",  # distinct links, A's id times 2**32 plus B's, and how often each stands in the text
    "cuts": "array<long>",  # byte offsets in space+text at which both end, the first token's start not counted
}


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, outputs: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_overlaps", "groups", "cuts")) -> DataFrame:
    """Each row's id and the ``outputs`` of its text; one pass, no shuffle.  The files are read by the driver and sent along."""
    files = _read(a_file), _read(b_file)
    kind = dict(docs.dtypes)[id_col]

    def one(known: Aligned, at: np.ndarray | None) -> dict:
        if at is None:
            return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_overlaps": 0, "groups": "", "groups_sha256": "", "pairs": [], "times": [], "cuts": []}
        out = {}
        n_a, n_b, n_overlaps = known.counts[at].sum(0).tolist()
        where = _slices(known.off, at)
        out |= {"n_a": n_a, "n_b": n_b, "n_groups": len(where), "n_overlaps": n_overlaps}
        if "groups" in outputs or "groups_sha256" in outputs:
            said = ";".join([known.names[i] for i in at.tolist()])
            out |= {"groups": said, "groups_sha256": hashlib.sha256(said.encode()).hexdigest()}
        if "pairs" in outputs or "times" in outputs:
            out["pairs"], out["times"] = np.unique(known.pair[where], return_counts=True)
        if "cuts" in outputs:
            parts = [g.split("|")[0] for g in ";".join([known.names[i] for i in at.tolist()]).split(";")]
            sizes = known.codec.a_sizes
            out["cuts"] = np.cumsum([sum(int(sizes[int(i)]) for i in p.split(",")) for p in parts])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Aligned(Codec(*files))
            for ids, texts in _portions(batch.column(0), batch.column(1)):
                got = [one(known, at) for at in known.rows(texts)]
                columns = []
                for name in outputs:
                    values = [g[name] for g in got]
                    if OUTPUTS[name].startswith("array"):
                        off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                        flat = np.concatenate([np.asarray(v, np.int64) for v in values]) if values else np.zeros(0, np.int64)
                        columns.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64() if "long" in OUTPUTS[name] else pa.int32())))
                    else:
                        columns.append(pa.array(values, pa.int64() if OUTPUTS[name] == "long" else pa.string()))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *outputs])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{o} {OUTPUTS[o]}" for o in outputs)]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How often two ids are linked, over all documents: pair, n.  At most ``most_pairs`` rows, of which a task sends each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, waiting = [], 0

        def merged():
            keys, at = np.unique(np.concatenate([pair, *(h[0] for h in held)]), return_inverse=True)
            out = np.zeros(len(keys), np.int64)
            np.add.at(out, at, np.concatenate([n, *(h[1] for h in held)]))
            return keys, out

        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            waiting += len(held[-1][0])
            if waiting > max(len(pair), 1 << 20):
                pair, n = merged()
                held, waiting = [], 0
        pair, n = merged()
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def agreement(aligned: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_links, n_best (links that are the commonest of their B id, ties included) and count_sum (over links)."""
    got = counts.toArrow()  # at most most_pairs rows
    pair, n = (got.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    _, b = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
    most = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(most, b, n)
    best = n == most[b] if len(b) else np.zeros(0, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column(len(keep)), batch.column(len(keep) + 1).flatten().to_numpy().astype(np.int64)
            off = lists.offsets.to_numpy().astype(np.int64)
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off - off[0]])  # noqa: B023, E731
            columns = [total(times), total(times * best[at]), total(times * n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, "n_links", "n_best", "count_sum"])

    kinds = dict(aligned.dtypes)
    return aligned.select(*keep, "pairs", "times").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n_links long, n_best long, count_sum long"]))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    aligned = store.put(align(docs, outputs=("n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "pairs", "times")), "aligned")
    found = agreement(aligned, pair_counts(aligned), ["id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256"])
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {}
