import re
import zlib
from collections import Counter

import numpy as np
import pytest

from critpath.llm import common, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, toxic int, score int"
LABELS = "doc_id long, quality int, toxic int, text int"


def test_block_max_finds_the_exact_nearest():
    rng = np.random.default_rng(3)
    for n, n_terms, k in ((500, 30, 7), (700, 300, 15), (5, 30, 7)):
        terms = np.sort(rng.integers(1, 1 << 63, n_terms, dtype=np.uint64)) * np.uint64(2)
        chance = rng.uniform(0, 1, n_terms) ** 6 + 1e-3
        bag = lambda size: Counter({int(terms[t]): int(rng.integers(1, 5)) for t in rng.choice(n_terms, size, replace=False, p=chance / chance.sum())})
        bags = [bag(int(rng.integers(0, 9))) for _ in range(n)]
        index = toxicity.BlockMax(terms, rng.uniform(0.1, 4, n_terms), np.arange(n), rng.integers(0, 2, n), np.ones(n), bags, k, 0.1)
        dense = np.zeros((n, n_terms))
        for i, b in enumerate(bags):
            at, w = index.vector(b)
            dense[i, at] = w
        asked = [bag(5) | {12345: 3} for _ in range(60)] + [{}, {99: 1}, bags[0]]
        vectors = [index.vector(q) for q in asked]
        rows = np.repeat(np.arange(len(asked)), [len(a) for a, _ in vectors])
        at, w = (np.concatenate(c) for c in zip(*vectors))
        text, example, cosine = index.nearest(rows, at.astype(int), w, len(asked))
        scores, evidence = index.score(rows, at.astype(int), w, len(asked))
        for i, (a, x) in enumerate(vectors):
            s = np.round(dense[:, a] @ x, 12)
            order = np.lexsort((np.arange(n), -s))[:k]
            order = order[s[order] > 0]
            assert example[text == i].tolist() == order.tolist() == evidence[i].tolist() and cosine[text == i] == pytest.approx(s[order])
            top = s[order[0]] if len(order) else 1.0
            assert scores[i] == pytest.approx(((s[order] ** 2 * index.labels[order]).sum() + 0.01 * top**2) / ((s[order] ** 2).sum() + 0.1 * top**2))
        assert scores[60] == scores[61] == pytest.approx(0.1)


def plain_bags(texts):
    words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower()) for t in texts]
    return [Counter([*ws, *((n, w[:n]) for w in ws for n in toxicity.PREFIXES if len(w) > n)]) for ws in words]


def test_whole_operator_against_brute_force(spark):
    """Every score from cosines with all examples, terms compared as bytes."""
    docs = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    rows = {r.doc_id: (r.score, r.evidence) for r in toxicity.op6_toxicity(spark, SF).select("doc_id", "score", "evidence").collect()}
    labels = common.table(spark, SF, "labels")
    index = toxicity.fit(common.table(spark, SF, "documents"), labels, ~toxicity.held_out())
    ids, y = index.ids.tolist(), index.labels
    bags = dict(zip(docs, plain_bags(docs.values())))
    held = {}
    for e, i in enumerate(ids):
        for t in bags[i]:
            held.setdefault(t, []).append(e)
    held = {t: e for t, e in held.items() if len(e) > 1}
    df = Counter(t for b in bags.values() for t in b if t in held)
    n1 = int(y.sum())
    counts = np.array([[sum(y[e] == c for e in es) for es in held.values()] for c in (0, 1)])
    weight = dict(zip(held, (np.log((1 + len(docs)) / (1 + np.array([df[t] for t in held]))) + 1) * toxicity.relevance(counts, len(ids) - n1, n1)))
    unit = lambda b: (lambda v: {t: x / max(1e-300, sum(z * z for z in v.values()) ** 0.5) for t, x in v.items()})({t: (1 + np.log(n)) * weight[t] for t, n in b.items() if t in weight})
    vectors = [unit(bags[i]) for i in ids]
    both = 0
    for d in list(docs)[::9]:
        v = unit(bags[d])
        s = np.array([round(sum(x * o[t] for t, x in v.items() if t in o), 12) for o in vectors])
        order = np.lexsort((np.arange(len(s)), -s))[:15]
        order = order[s[order] > 0]
        vote = s[order] ** 2 * index.weights[order]
        base = 0.1 * index.weights.mean() * (s[order[0]] ** 2 if len(order) else 1)
        want = ((vote * y[order]).sum() + base * index.prior) / (vote.sum() + base)
        assert rows[d][0] == pytest.approx(want, abs=1e-6)
        both += len(set(y[np.flatnonzero(s > 0)])) == 2
    assert both > 100  # nearly all documents have neighbours of both labels


def test_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in common.table(spark, SF, "labels").collect()}
    rows = toxicity.op6_toxicity(spark, SF).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.75
    assert np.mean([p for _, p, y in held if not y]) < 0.05


def test_odd_rows(spark):
    rows = [(i, f"w{i % 7} plain words w{i % 11}" + (" nasty vile" if i % 5 == 0 else ""), 1, 1) for i in range(120)]
    labels = [(i, 1, int(i % 5 == 0), 1) for i in range(100)] + [(3, 1, 0, 1), (200, None, None, None), (None, 1, 1, 1), (999, 1, 1, 1)]
    docs = spark.createDataFrame(rows + [(200, None, 1, 1), (201, "", 1, 1), (202, "nasty " * 40000, None, None), (None, "vile", 1, 1), (0, *rows[0][1:])], DOCS)
    index = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), ~toxicity.held_out())
    got = toxicity.score(docs, index).collect()
    assert len(got) == 125
    by = {r.doc_id: r for r in got}
    assert by[105].score > 0.5 and by[115].score > 0.5 and by[202].score > 0.5 and by[None].score > 0.5 and by[105].evidence
    assert by[101].score < 0.3 and by[200].score == by[201].score < 0.3 and not by[200].evidence
    empty = toxicity.fit(docs, spark.createDataFrame([], LABELS), ~toxicity.held_out())
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), index).collect() == []
