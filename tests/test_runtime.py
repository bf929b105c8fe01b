import weakref

import corpus_pipeline
from critpath import runtime


def test_give_back_frees_what_refers_to_itself(spark):
    class Thing:
        pass

    x = Thing()
    x.self, gone = x, weakref.ref(x)
    del x
    runtime.give_back(spark)
    assert gone() is None


def test_near_dedup_gives_back_before_and_after_its_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back", calls.append)
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1] and calls == [spark, spark]


def test_every_stage_gives_back_before_it_starts(spark, monkeypatch):
    class Began(Exception):
        pass

    def began(_):
        raise Began

    monkeypatch.setattr(corpus_pipeline, "give_back", began)
    for name, stage in corpus_pipeline.STAGES:
        try:
            stage(spark, None, "")  # no documents to work on: anything before is an error of another kind
        except Began:
            continue
        raise AssertionError(name)


def test_rounds_keep_no_size_that_no_table_has(spark):
    state = spark.range(3).selectExpr("id", "if(id = 1, null, id) as x")
    for _ in range(8):  # a join's estimate is the product of its sides'
        state = runtime.checkpointed(state.join(state.select("id"), "id"))
    assert int(str(state._jdf.queryExecution().analyzed().stats().sizeInBytes())) < 1 << 63
    assert sorted(map(tuple, state.collect())) == [(0, 0), (1, None), (2, 2)]
    assert [(f.name, f.dataType.typeName(), f.nullable) for f in state.schema] == [("id", "long", False), ("x", "long", True)]
