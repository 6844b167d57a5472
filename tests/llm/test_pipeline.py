import json
import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, neardup, pii


def write(spark, root):
    rng = random.Random(3)
    en = "the and of to in is that it was for with on as are this be at by from or".split()
    de = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "er", "en", "st"]) + rng.choice(["", "", "a", "o", "i"]) for _ in range(n))
    item = prose(en, 40)
    docs = [(i, prose(en if i % 3 else de, 60), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    docs += [(100, docs[1][1], "en", "s0"), (101, docs[2][1] + " added", "en", "s0"), (102, None, None, None), (103, "123 ...", "en", "s1"), (104, "", "de", "s1")]
    docs += [(105, docs[4][1] + " write to a.b@c.org or +1 (743) 555-3824 now", "en", "s1"), (106, prose(en, 100) + " " + item[: len(item) // 2] + " " + prose(en, 80), "en", "s2"), (107, item, "en", "s2")]
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    frame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    frame([(1, item), (2, None)], "item_id long, text string", "benchmark")
    frame([(i, i % 2, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int", "labels")
    return {d[0]: d[1] for d in docs}, item


def test_every_stage_takes_effect(spark, tmp_path):
    texts, item = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "source_mixing":
            assert docs.columns == columns
    assert set(seen["language_id"]) == set(texts) - {102, 103, 104}
    assert set(seen["near_dedup"]) == set(seen["language_id"]) - {100, 101, 105}
    left = seen["decontamination"]
    assert set(left) == set(seen["near_dedup"]) - {107}
    want = " ".join(item.split()[:10])
    assert want in texts[106] and want not in left[106]["text"] and left[106]["n_chars"] == len(left[106]["text"])
    assert all(left[i]["text"] == texts[i] for i in left if i < 100)
    last = seen["source_mixing"]
    assert all(r["copies"] >= 1 for r in last.values())


def test_redaction_in_the_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a.b@c.org", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.personal_data(spark, df, str(tmp_path)).collect()[0]
    assert row["text"] == "mail [EMAIL]" and row["n_chars"] == 12


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_empty_repeated_and_odd_rows(spark, tmp_path):
    """Empty tables, repeated rows, null ids and texts, and extra columns named like the stages' own."""
    _, item = write(spark, tmp_path)
    rows = [(1, "the cat and the dog sat in the sun", "en", "s", 34)] * 2 + [(None, "der hund und die katze", "de", "s", 22)] * 2 + [(3, None, "en", "s", 0)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' lang_pred", "'x' Kept", "1 pii_spans", "2 hit_runs", "3 n_words")
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, odd.limit(0), str(tmp_path)).count() == 0
        got = function(spark, odd, str(tmp_path))
        ids = sorted((r["doc_id"] or 0) for r in got.collect())
        if name == "source_mixing":
            assert set(ids) <= {0, 1, 3}
            continue
        assert got.columns == odd.columns
        assert ids == {"language_id": [0, 0, 1, 1], "near_dedup": [0, 0, 1, 3]}.get(name, [0, 0, 1, 1, 3])
