import random

import corpus_pipeline
from gridloom.llm import common


def stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark._jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


def shuffled(spark, run):
    """Bytes that the stages of a run write to shuffles."""
    last = max(s.stageId() for s in stages(spark))
    run()
    return sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > last)


def test_near_dedup_shuffles_no_texts_without_partners(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(400))
    rows = [(i, text()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)] + [(2000 + i, rows[i][1] + " end") for i in range(10)]
    size = sum(len(t) for _, t in rows)
    docs = common.stage(spark.createDataFrame(rows, "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = []
        moved = shuffled(spark, lambda: kept.extend(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(kept) == list(range(400))
    assert 0 < moved < 0.8 * size, (moved, size)


def test_sieve_is_exact_at_any_size(spark, monkeypatch):
    df = spark.range(3000).selectExpr("if(id % 100 = 7, null, cast(id as int)) as k", "id as place", "'x' as `Sieve`")
    everything = sorted(r.place for r in df.collect())
    for words in (1 << 20, 64):  # 64 words are full of bits: nearly all rows pass
        monkeypatch.setattr(common, "SIEVE_WORDS", words)
        for keys in (spark.range(0), spark.range(0, 2000, 2).unionByName(spark.sql("select cast(null as bigint) id")), spark.range(3000)):
            keys = common.stage(keys.withColumnRenamed("id", "k"))
            gone = {r.k for r in keys.collect() if r.k is not None}
            left = common.without_keys(df, keys, "k")
            assert left.columns == df.columns
            assert sorted(r.place for r in left.collect()) == [p for p in everything if p % 100 == 7 or p not in gone]
            sieve = common.Sieve(keys, "k")
            passed, held = ([r.place for r in part.collect()] for part in (sieve.passed(df), sieve.held(df)))
            assert sorted(passed + held) == everything
            assert {p for p in gone if p % 100 != 7} <= set(passed)
            if words > 64 and len(gone) == 1000:
                assert len(passed) < 1300
