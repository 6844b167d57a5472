import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import common, neardup


def sets_of(text, k):
    w = text.encode().lower().split() if text else []
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, k, percent):
    sets = {d: sets_of(t, k) for d, t in rows}
    comp = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted((d, len(sets[d]), comp[d], comp[d] == d) for d in sets)


def corpus(rng, groups=8, vocab=400):
    word = lambda: f"w{rng.randint(0, vocab)}"
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 5, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((rng.randint(0, 10**9), " ".join(w)))
    return rows


def result(df, **how):
    return sorted(tuple(r) for r in neardup.near_duplicates(df, **how).collect())


def test_signature_estimates_the_share():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    sig = neardup.superminhash([a[:800], a[200:], a[:1], a[:0]], 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1
    assert (sig[2] != neardup._FULL).all() and (sig[3] == neardup._FULL).all()
    # a slot's value is its level and a fraction; one element meets every level once
    assert sorted((sig[2] >> np.uint64(32)).tolist()) == list(range(256))
    assert (neardup.superminhash([a[:800]], 256)[0] == sig[0]).all()


def test_matches_brute_force(spark):
    rng = random.Random(7)
    rows = corpus(rng, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, shingle=3, percent=85) == brute(rows, 3, 85)


def test_hot_group_keeps_every_link(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, shingle=3, percent=85) == brute(rows, 3, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (5, "one two"), (6, "x " * 100000), (7, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("COMPONENT_ID", F.lit("?"))
    got = result(df)
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True), (7, 0, 7, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    lone = neardup.near_duplicates(spark.createDataFrame([(None, "one"), (3, "one")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in lone} == {(None, None, True), (3, 3, True)}


def test_components_of_long_chains(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10**6), 300)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], x) for x in ids[201:]]
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == min(ids[:200]) for x in ids[:200]) and all(got[x] == min(ids[200:]) for x in ids[200:])
