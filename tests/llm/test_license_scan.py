import re

import numpy as np

from critpath.llm import license_scan as L

SCHEMA = "doc_id long, text string, n_words int, labels string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, threshold=0.9):
    w, places, base = words(text), [], set()
    for phrase, label in L.PHRASES:
        own = phrase.split()
        for p in range(len(w) - len(own) + 1):
            if w[p : p + len(own)] == own:
                places.append(p)
                base.add(label)
    blocks = set()
    for n, line in enumerate((text or "").split("\n")):
        for label, t in L.TEMPLATES:
            own = set(words(t))
            share = len(own & set(words(line))) / len(own)
            if share >= threshold - 1e-12:
                blocks.add((n, label, round(share, 9)))
    labels = base | {b[1] for b in blocks}
    score = 1.0 if base else max((b[2] for b in blocks), default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9), blocks


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = sorted({w for _, t in L.TEMPLATES for w in words(t)}) + ["foo", "bär", "x1"]
    texts = ["Apache License", "the GNU\nGeneral Public-License; mit license", "CC BY", "cc-by 4.0", "apache licensed", "", None, "\n\n", "no license here", "x " * 50000 + "Released under the MIT License.\n" + "y " * 50000]
    for k in range(120):
        lines = []
        for _ in range(int(rng.integers(1, 5))):
            own = words(L.TEMPLATES[int(rng.integers(len(L.TEMPLATES)))][1])
            keep = [w for w in own if rng.random() > 0.07]
            lines.append(" ".join(keep if rng.random() < 0.5 else list(rng.permutation(keep)) + list(rng.choice(pool, 3))))
            if rng.random() < 0.5:
                lines.append(" ".join(rng.choice(pool, int(rng.integers(0, 30)))))
        texts.append("\n".join(lines))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, "Apache License", 1, "x"), (None, "mit license", None, None)]
    got = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    for r, (d, t, _, _) in zip(got, rows, strict=True):
        own = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), {(b.line, b.label, round(b.containment, 9)) for b in r.blocks})
        assert r.doc_id == d and own == brute(t), (own, brute(t))


def test_wrapped_notices_are_found(spark, tmp_path):
    import textwrap

    rows, want = [(0, "permission to use\nnothing of it\nthis is free", 1, "x"), (1, None, 1, "x")], {0: "", 1: ""}
    for k, (label, t) in enumerate(L.TEMPLATES):
        for w in (24, 40, 72):
            i = len(rows)
            body = "\n".join(" * " + x for x in textwrap.wrap(f"Some words. {t}. More words", w))
            rows.append((i, f"Intro line\n{body}\nend", 1, "x"))
            want[i] = label
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in L.op4_licenses(spark, str(tmp_path)).collect()}
    assert len(by) == len(rows) and by[0].labels == by[1].labels == ""
    for i, label in want.items():
        if label:
            assert label in by[i].labels.split(",") and by[i].score == 1.0


def test_no_rows(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []
