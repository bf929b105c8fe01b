import hashlib
import re

import numpy as np
import pytest

from critpath.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, n_words int"
ITEMS = "item_id long, text string, doc_id int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        n = min(10, len(own))
        for k in range(len(own) - n + 1):
            for p in range(len(w) - n + 1):
                if n and w[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def sample(rng):
    vocabulary = ["a", "b", "c", "d", "É", "ff", "g7"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(10, 40)))) for i in range(12)] + [(50, "short b item"), (51, "x"), (52, ""), (53, None), (54, "a b c d a b c d a"), (None, "nameless thing here"), (3, "q r s t u v w x y z q r")]
    docs = []
    for i in range(80):
        t = text(int(rng.integers(0, 60)))
        if i % 3 == 0:
            own = words(items[i % 12][1])
            a = int(rng.integers(0, len(own)))
            t += ", " + "-".join(own[a : a + int(rng.integers(5, 20))]).upper() + ". " + text(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "SHORT b Item"), (103, "x"), (104, "nameless thing here"), (5, "x x"), (5, "x x"), (None, "y z q x"), (105, ("z " * 5000) + items[0][1] + " z" * 5000)]
    return docs, items


@pytest.mark.parametrize("part_words", [2_000_000, 60])
def test_against_brute_force(spark, part_words):
    docs, items = sample(np.random.default_rng(8))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(0, items[0][1], 2)], ITEMS)
    got = decontaminate.matches(frame, bench, part_words=part_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=key) == sorted([(d, *brute(t, items)) for d, t in docs], key=key)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)


def test_repeated_words_are_not_slow():
    import time

    index = decontaminate.Index([str(i) for i in range(50)], [b"z " * 300] * 50, 10, 5)
    h = index.words[:1].repeat(2000)
    began = time.perf_counter()
    hit, found = index.match(h, np.array([0, 2000]))
    assert hit.all() and len(found[0]) == 50 and time.perf_counter() - began < 1


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "short B item", "x", 1), (2, None, "x", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "short b item", 1), (11, "b", 1)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in decontaminate.op8_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"11,7").hexdigest() and (got[1].n_hit, got[1].n_items, got[1].contaminated) == (3, 2, True)
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", 1)], ITEMS)
    assert decontaminate.matches(none, bench).collect() == []
    got = decontaminate.matches(spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA), spark.createDataFrame([], ITEMS)).collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == [(2, 0, [])]
