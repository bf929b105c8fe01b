import corpus_pipeline as P
from critpath.llm import common, registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language", "non_toxic", "near_dedup", "decontaminated", "mix_sources"]
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_each_stage_takes_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    copy = docs.where("doc_id = 3").withColumn("doc_id", docs["doc_id"] + 900_000)
    leak = common.table(spark, sf, "benchmark").where("item_id = 0").selectExpr("cast(900100 as long) doc_id", "concat('Intro words. ', text) text", "'en' lang", "'src1' source", "cast(9 as long) n_chars")
    blank = spark.createDataFrame([(900200, "123 456", "en", "src1", 7), (900201, None, None, None, None)], COLUMNS)
    docs = docs.unionByName(copy).unionByName(leak).unionByName(blank)
    at = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, at, sf)
        if k < 4:
            assert out.columns == P.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r.doc_id for r in at.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        gone = before - after
        assert gone <= before and after <= before
        if name == "language":
            assert gone >= {900200, 900201} and len(gone) < 10
        if name == "near_dedup":
            assert 900003 in gone and 3 in after
        if name == "decontaminated":
            assert 900100 in gone
        at = out
    assert at.where("taken < 1 or taken > 3 * size").count() == 0


def test_near_dedup_keeps_one_row_a_group_whatever_the_ids(spark):
    rng = __import__("random").Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (None, c), (3, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], COLUMNS)
    got = P.near_dedup(spark, docs, "").select("doc_id", "text").collect()
    assert len(got) == 4 and {tuple(r) for r in got} == {(None, a), (3, b), (7, c), (7, d)}


def labelled(spark, tmp_path):
    """A folder of small tables, and documents with odd rows and clashing columns."""
    rng = __import__("random").Random(3)
    plain = lambda n: " ".join(rng.choice(("the", "river", "of", "stone", "and", "old", "trees", "by", "night", "we", "walk", "home")) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, plain(30) + (" vile nasty scum" if i % 4 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(120)]
    rows += [(120, "vile nasty scum " + plain(30), "en", None, None), (121, plain(30), None, "a", 1), (121, plain(30), "en", "a", 1), (None, plain(30), "en", "a", 1), (5, *rows[5][1:])]
    rows += [(130, None, "en", "a", 0), (131, "", "en", "a", 0), (132, "  7 ", None, None, None), (133, "exam words " + " ".join(f"q{k}" for k in range(12)), "en", "b", 1)]
    labels = [(i, 1, int(i % 4 == 0), "x") for i in range(100)] + [(None, None, 1, "x"), (3, 1, None, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/t/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(12))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    extra = ", score string, taken string, key string, component_id string, rejected string, n_hit string"
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], COLUMNS + extra), rows


def test_stages_on_odd_rows(spark, tmp_path):
    docs, rows = labelled(spark, tmp_path)
    text = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    everything = sorted((str(r[0]), str(r[1])) for r in rows)
    got = text(P.non_toxic(spark, docs, f"{tmp_path}/t"))
    assert got == [(i, t) for i, t in everything if "vile" not in t]
    assert text(P.non_toxic(spark, docs, f"{tmp_path}/none")) == everything
    got = text(P.decontaminated(spark, docs, f"{tmp_path}/t"))
    assert got == [(i, t) for i, t in everything if i != "133"] and text(P.decontaminated(spark, docs, f"{tmp_path}/none")) == everything
    got = P.language(spark, docs, "").collect()
    assert {r.doc_id for r in got}.isdisjoint({130, 131, 132}) and {r.lang for r in got} == {"en"} and sum(r.doc_id == 5 for r in got) == 2
    for seed in (1, 2):
        got = text(P.near_dedup(spark, docs.repartition(seed + 2), ""))
        assert len(got) == len({t if t.split() and t != "None" else "" for _, t in everything})
        assert [i for i, t in got if t in ("None", "")] == ["130"]
    got = P.mix_sources(spark, docs, "").collect()
    assert {r.source for r in got} <= {"a", "b", None} and all(0 < r.taken <= 3 * r.size for r in got)


def test_stages_on_no_rows(spark, tmp_path):
    docs, _ = labelled(spark, tmp_path)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), f"{tmp_path}/t").count() == 0


def test_near_dedup_against_brute_force(spark):
    from critpath.llm.simhash import fingerprint

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    fps = [fingerprint((r.text or "").encode()) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == [rows[i].doc_id for i in range(len(rows)) if label[i] == i]
