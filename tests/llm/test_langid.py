import zlib

import numpy as np
import pytest

from critpath.llm import common, langid

SCHEMA = "doc_id long, text string, lang string, source int, score int"
SF = "/root/testdata/sf0.01"


def test_summed_rows_equal_the_mean_embedding():
    rng = np.random.default_rng(0)
    bits = 10
    model = langid.Model(["a", "b"], rng.normal(0, 1, (2, 1 << bits)).astype(np.float32), np.array([0.1, -0.2]), bits, 1.5, 0.5)
    texts = ["The cat", "", "É1x", "a b", "zz" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = model.scores(data, offsets)
    for i, t in enumerate(texts):
        own = b" " + bytes(langid._FOLD[np.frombuffer(t.encode(), np.uint8)]) + b" "
        rows = []
        for k, m in ((3, 2654435761), (4, 2246822519)):
            for p in range(len(own) - k + 1):
                if own[p + 1] != 0x20:
                    rows.append(((int.from_bytes(own[p : p + k], "big") * m) & 0xFFFFFFFF) >> (32 - bits))
        z = (np.mean([model.table[:, r] for r in rows], axis=0) if rows else 0) + model.bias
        e = np.exp(z / 1.5)
        assert got[i] == pytest.approx(e / e.sum(), rel=1e-4)


def test_held_out_accuracy(spark):
    docs = common.table(spark, SF, "documents")
    rows = langid.op7_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02 and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, t, lang, 1, 1) for i, (t, lang) in enumerate([("the and of it", "en"), ("der und die das", "de")] * 20)]
    docs = spark.createDataFrame(rows + [(100, None, "en", 1, 1), (101, "", None, 1, 1), (102, "123 !?", "de", 1, 1), (103, "漢", None, None, None), (104, "the of " * 30000, None, 1, 1), (0, *rows[0][1:]), (None, "und die", None, 1, 1)], SCHEMA)
    got = langid.predict(docs, langid.fit(docs, ~langid.held_out())).collect()
    assert len(got) == 47
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[103].lang_pred in ("en", "de") and by[104].lang_pred == "en" and by[None].lang_pred == "de"
    none = langid.predict(docs.limit(1), langid.fit(docs.limit(0), ~langid.held_out())).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), None).collect() == []
