import re

import numpy as np
import pytest

from critpath.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def test_apportion_is_sainte_lague():
    assert mixing.apportion(np.array([53, 24, 23.0]), np.array([99] * 3), 7).tolist() == [3, 2, 2]
    assert mixing.apportion(np.array([10.0, 10.0]), np.array([5, 5]), 5).tolist() == [3, 2]
    assert mixing.apportion(np.array([100.0, 1.0]), np.array([3, 9]), 8).tolist() == [3, 5]
    assert mixing.apportion(np.array([0.0]), np.array([0]), 3).tolist() == [0]


def test_apportion_against_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, n = rng.integers(1, 1000, rng.integers(1, 9)).astype(float), int(rng.integers(0, 60))
        got = np.zeros(len(v), int)
        for _ in range(n):
            got[np.argmax(v / (2 * got + 1))] += 1
        assert mixing.apportion(v, np.full(len(v), 10**6), n).tolist() == got.tolist()


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 10, 100], [5, 2, 1], 3) == [30.0, 30.0, 60.0]
    assert mixing.targets([0, 8], [5, 2], 3) == [0.0, 8.0]


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), ["a", "b", "é", None][int(i % 7 % 4)], "x", 1) for i in range(400)]
    rows += [(900, None, "a", "x", 1), (901, "", "z", "x", 1), (902, "one\ttwo\x0bthree four", "tiny", None, None), (902, "one\ttwo\x0bthree four", "tiny", None, None), (None, "a b c", "b", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, shard_words=5000).collect()
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    names = sorted(n for n in by if n is not None) + [None]
    want = mixing.targets([sum(r.size for r in by[n]) for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)
    assert sum(want) == pytest.approx(total)
    for n, t in zip(names, want):
        assert {r.target for r in by[n]} == {t} and {r.source_size for r in by[n]} == {sum(r.size for r in by[n])}
        assert abs(sum(r.taken for r in by[n]) - t) <= 16 + 0.02 * t
    again = mixing.mix(docs.repartition(7), shard_words=5000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()
    assert [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got] == [(1, 0, 0, 0.0, 0)]
