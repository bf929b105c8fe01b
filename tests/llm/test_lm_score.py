import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from critpath.llm import lm_score

SCHEMA = "doc_id long, text string, key string, n int, block int"


def stream(text):
    t = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    return [b + 1 for b in t.encode()] + [0]


class Plain:
    """PPM with method D and exclusion, one symbol at a time."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            s = [0] * lm_score.ORDER + stream(t)
            for i in range(lm_score.ORDER, len(s)):
                for k in range(lm_score.ORDER + 1):
                    self.seen[tuple(s[i - k : i])][s[i]] += 1

    def p(self, context, sym):
        out, excluded = 1.0, set()
        for k in range(lm_score.ORDER, -1, -1):
            own = self.seen.get(tuple(context[len(context) - k :]))
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            total = 2 * sum(left.values())
            if sym in left:
                return out * (2 * left[sym] - 1) / total
            if left:
                out *= len(left) / total
            excluded |= set(own)
        return out / (lm_score.SYMBOLS - len(excluded))

    def score(self, text):
        s = [0] * lm_score.ORDER + stream(text)
        return sum(math.log10(self.p(s[i - lm_score.ORDER : i], s[i])) for i in range(lm_score.ORDER, len(s)))


def test_probabilities_sum_to_one():
    m = Plain(["abracadabra", "abrac", "", "xyz abra"])
    for c in ([0, 0, 0, 0], [98, 99, 115, 98], [1, 2, 3, 4], [0, 0, 0, 98]):
        assert sum(m.p(c, s) for s in range(lm_score.SYMBOLS)) == pytest.approx(1)


def test_against_plain_model(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["the", "an", "Été", "of\ttea", "x", "heron", "ß", "z" * 30]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))), "k", 1, 7) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "k", 1, 1), (102, " \n ", "k", 1, 1), (103, "unseen QUARTZ 漢字", "k", 1, 1), (5, "again the an", "k", 1, 1), (5, "again the an", "k", 1, 1), (None, "no id", "k", 1, 1), (104, "the an " * 20000, "k", 1, 1)]
    got, joined = (lm_score.score(spark.createDataFrame(rows, SCHEMA), lm_score.held_out(), block_bytes=3000, broadcast_grams=limit).collect() for limit in (5_000_000, 0))
    assert sorted(map(str, got)) == sorted(map(str, joined))  # the same to the last bit, by either way
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]
    counts = Counter(w for d, t, *_ in rows if not out(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = Plain([t for d, t, *_ in rows if not out(d)])
    memo = {}
    want = []
    for d, t, *_ in rows:
        own = words(t)
        if t not in memo:
            memo[t] = model.score(t)
        want.append((d, out(d), len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), memo[t]))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_no_rows_and_no_training(spark):
    assert lm_score.score(spark.createDataFrame([], SCHEMA), lm_score.held_out()).collect() == []
    got = lm_score.score(spark.createDataFrame([(1, "a", None, None, None)], SCHEMA), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(2, 0, 0, 0.0)]
    assert got[0].score == pytest.approx(2 * -math.log10(257))
