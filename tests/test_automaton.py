import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.functions import automaton
from riskloom.operators import lexicon


def plain(texts, lists):
    return [None if t is None else [sum(w in t for w in words) for words in lists.values()] for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_counts_against_plain_search(seed, monkeypatch):
    r = random.Random(seed)
    letters = ["a", "b", "ab", "é", " ", "中", "🙂"][: 3 + seed]
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(1, n)))
    lists = {"x": [word(6) for _ in range(60)], "y": [word(3) for _ in range(10)] * 2, "none": [], "empty": ["", "a"], "long": ["ab" * 300]}
    texts = [word(200) for _ in range(200)] + [None, "", "a", "ab" * 5000, word(3000)]
    a = automaton.Automaton(lists)
    for piece, lanes in ((1 << 21, 4096), (700, 5)):
        monkeypatch.setattr(automaton, "PIECE", piece)
        monkeypatch.setattr(automaton, "LANES", lanes)
        got = a.count(pa.array(texts))
        assert [list(g) for t, g in zip(texts, got) if t is not None] == [p for p in plain(texts, lists) if p is not None]


def test_a_words_cost_does_not_grow_with_their_number():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(5, 12)))
    words = [word() for _ in range(20000)]
    texts = pa.array([" ".join(r.choice(words[:200]) if r.random() < 0.01 else word() for _ in range(400)) for _ in range(400)])
    took = {}
    for n in (200, 20000):
        a = automaton.Automaton({"w": words[:n]})
        times = []
        for _ in range(5):
            began = time.process_time()
            a.count(texts)
            times.append(time.process_time() - began)
        took[n] = min(times)
    assert took[20000] < 2 * took[200] + 0.02


def test_lexicons_as_tables(spark):
    words = spark.createDataFrame([("1", "Alpha"), ("1", "beta"), ("2", "gamma"), (None, "x"), ("2", None)], "list string, word string")
    a = automaton.of_table(words, "list", "word")
    rows = spark.createDataFrame([(1, "ALPHA betamax"), (2, None), (3, "")], "k int, t string")
    got = rows.select("k", *[c.alias(n) for n, c in lexicon.shares(F.col("t"), {"1": 2, "2": 1}, a).items()]).collect()
    assert [tuple(g) for g in sorted(got)] == [(1, 1.0, 0.0), (2, None, None), (3, 0.0, 0.0)]


def test_too_many_words_are_refused(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MOST_NODES", 5)
    with pytest.raises(ValueError):
        automaton.Automaton({"w": ["abcdefgh"]})
    with pytest.raises(ValueError):
        automaton.of_table(spark.createDataFrame([("a", "abcdefgh")], "n string, w string"), "n", "w")


def test_no_words():
    a = automaton.Automaton({"w": []})
    assert a.count(pa.array(["a", None])).tolist() == [[0], [0]] and np.array_equal(a.found(pa.array([], pa.string()))[0], [])
