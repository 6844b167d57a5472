import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import suffixdedup as sd


def brute(rows, span):
    """Removed byte positions by row number, judged on places (id, start)."""
    first = {}
    for doc, raw in sorted((d, r) for d, r in rows if d is not None):
        for i in range(len(raw) - span + 1):
            s = raw[i : i + span]
            first[s] = min(first.get(s, (doc, i)), (doc, i))
    out = []
    for doc, raw in rows:
        gone = set()
        if doc is not None:
            for i in range(len(raw) - span + 1):
                if first[raw[i : i + span]] < (doc, i):
                    gone.update(range(i, i + span))
        out.append(gone)
    return out


def expected(rows, span):
    out = []
    for (doc, raw), gone in zip(rows, brute(rows, span)):
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(raw)))
        out.append((doc, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, span, gram):
    got = sd.remove_repeats(df, span=span, gram=gram).collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(b - a for a, b in r["removed_runs"]), len(r["removed_runs"]), hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in got), key=repr)


def test_sort_and_extensions():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(n)]
        length = np.array([len(t) for t in texts])
        rows = np.array([list(t.ljust(12, b"\0")) for t in texts], np.uint8)
        s = sd.HashSuffixes(rows, length)
        order = s.sort()
        assert [texts[i] for i in order] == sorted(texts)
        ext = s.neighbours(order)
        for k in range(1, n):
            a, b = texts[order[k - 1]], texts[order[k]]
            m = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert ext[k] == m


def texts(rng, n):
    passage = "".join(rng.choice("abcdé ") for _ in range(60))
    out = []
    for i in range(n):
        parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.6:
            a = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), passage[a : a + rng.randint(5, 40)])
        out.append("".join(parts))
    return out + ["a" * 70, "ab" * 40, "", passage, passage]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    for span, gram, hot in ((10, 4, 512), (12, 1, 1), (20, 19, 3), (10, 4, 2)):
        monkeypatch.setattr(sd, "HOT", hot)
        rows = list(enumerate(texts(rng, 25))) + [(100, None)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = expected([(d, (t or "").encode()) for d, t in rows], span)
        assert result(df, span, gram) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    rng = random.Random(3)
    base = "".join(rng.choice("abc") for _ in range(200))
    rows = [(1, base + "x" + base), (2, base[50:150] * 3), (3, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r: 0 for r in range(4)}
    group = sd.repeats(df.select(F.col("doc_id").alias("id"), "text"), 10, 4).collect()
    assert group and result(df, 10, 4) == expected([(d, t.encode()) for d, t in rows], 10)


def test_edges(spark):
    rows = [(1, "z" * 30), (1, "z" * 30), (None, "z" * 30), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_BYTES", F.lit(1))
    got = sorted(((r["doc_id"], sum(b - a for a, b in r["removed_runs"])) for r in sd.remove_repeats(df, span=10, gram=4).collect()), key=repr)
    assert got == [(1, 29), (1, 29), (2, 0), (3, 0), (None, 0)]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_hot_passage_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(4)
        line = "".join(rng.choice("abcdefgh") for _ in range(50))
        rows = [(i, "".join(rng.choice("xyzuvw") for _ in range(rng.randint(0, 9))) + line + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))) for i in range(120)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert result(df, 20, 6) == expected([(d, t.encode()) for d, t in rows], 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
