import math
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import ngramlm


def toks(text):
    return [*(text or "").encode().lower().split(), None]


def sample(n=60):
    import random

    rng = random.Random(4)
    chain = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["the"], "ran": ["the", "far"], "far": ["the"]}
    rows = []
    for i in range(n):
        w, out = "the", []
        for _ in range(rng.randint(3, 20)):
            out.append(w)
            w = rng.choice(chain[w]) if rng.random() > 0.1 else f"new{rng.randint(0, 30)}"
            if w not in chain:
                out.append(w)
                w = "the"
        rows.append((i, " ".join(out), i % 10 == 0))
    return rows + [(1000, None, False), (1001, "", True), (1002, "ÉTÉ The", True), (1003, "the " * 50000, False), (1003, "the " * 50000, False)]


def test_against_plain_counts(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("SCORE", F.lit("x"))
    monkeypatch.setattr(ngramlm, "GROUP_BYTES", 1 << 14)
    got = sorted(tuple(r) for r in ngramlm.score(df).collect())
    uni = Counter(w for _, text, held in rows if not held for w in toks(text))
    total, types = sum(uni.values()), len(uni)
    want = {}
    for doc, text, held in rows:
        t = toks(text)
        want[doc] = (held, len(t), sum(w in uni for w in t), total, sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t))
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    for doc, held, n, known, train, base, score in got:
        assert (held, n, known, train) == want[doc][:4] and math.isclose(base, want[doc][4], rel_tol=1e-9)
        assert score < 0
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def plain_model(rows, mixture):
    """Probability of each token of each row from Counters and the mixture's weights; gone: leave-one-out."""
    uni, bi, tri = Counter(), Counter(), Counter()
    for _, text, held in rows:
        if not held:
            t = toks(text)
            uni.update(t)
            bi.update(zip([None, *t], t))
            tri.update(zip([None, *t], t, t[1:]))
    total, types = sum(uni.values()), len(uni)
    bucket = lambda c: min(95, math.floor(2 * math.log2(c)))

    def up(weights, low, c, context, gone):
        if context <= gone:
            return low
        w = weights[bucket(context)]
        return w * (c - gone) / (context - gone) + (1 - w) * low

    def probabilities(text, gone=0):
        t, out = toks(text), []
        for i, w in enumerate(t):
            before = t[i - 1] if i else None
            p = mixture.one * (uni[w] - gone) / (total - gone) + (1 - mixture.one) / (types + 1)
            p = up(mixture.two, p, bi[before, w], uni[before], gone)
            if i:
                first = t[i - 2] if i > 1 else None
                p = up(mixture.three, p, tri[first, before, w], bi[first, before], gone)
            out.append(p)
        return out

    return probabilities


def test_scores_against_a_plain_model(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    monkeypatch.setattr(ngramlm, "GROUP_BYTES", 1 << 14)
    counted, unigrams = ngramlm.count_tokens(df)
    mixture = ngramlm.learn(unigrams.df, counted.df)
    model = plain_model(rows, mixture)
    got = sorted((r["id"], r["score"]) for r in ngramlm.judge(counted.df, mixture).collect())
    want = sorted((doc, sum(map(math.log10, model(text)))) for doc, text, _ in rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in zip(got, want))


def test_weights_are_the_best_for_deleted_tokens(spark):
    rows = sample(200)[:200]
    counted, unigrams = ngramlm.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    mixture = ngramlm.learn(unigrams.df, counted.df)
    deleted = lambda m: sum(math.log(p) for _, text, held in rows if not held for p in plain_model(rows, m)(text, 1))
    best = deleted(mixture)
    for name in ("two", "three"):
        weights = getattr(mixture, name)
        for b in np.flatnonzero(weights > 1e-3):
            for shift in (0.8, 1.2):
                other = weights.copy()
                other[b] = min(0.999, other[b] * shift)
                assert deleted(replace(mixture, **{name: other})) <= best + 1e-3 * abs(best)


def test_ids_of_any_type(spark):
    rows = [("a", "x y", False), (None, "x z", False), (None, "x y", True)]
    df = spark.createDataFrame(rows, "doc_id string, text string, held_out boolean")
    got = {(r["doc_id"], r["n_known"]) for r in ngramlm.score(df).collect()}
    assert got == {("a", 3), (None, 3)}
    exact = df.selectExpr("cast(length(text) as decimal(10, 2)) doc_id", "text", "held_out")
    assert ngramlm.score(exact).count() == 3


def test_probabilities_sum_to_one():
    # with counts of a tiny corpus, the mixture over the vocabulary and one unknown word is 1
    rng = np.random.default_rng(0)
    c1 = rng.integers(1, 9, 6)
    c2 = rng.multinomial(c1[0], np.ones(6) / 6)
    w, uni, total = 0.7, 0.9, c1.sum()
    p = w * c2 / c1[0] + (1 - w) * (uni * c1 / total + (1 - uni) / 7)
    assert math.isclose(p.sum() + (1 - w) * (1 - uni) / 7, 1)


def test_weight_is_a_maximum():
    ratio, count = np.array([0.0, 0.5, 3.0, 20.0]), np.array([4.0, 2, 5, 1])
    best = ngramlm.mix_weight(ratio, count, rounds=500)
    like = lambda w: (count * np.log(w * ratio + 1 - w)).sum()
    assert all(like(best) >= like(w) - 1e-9 for w in np.linspace(0.01, 0.99, 99))


def test_packing():
    c = np.array([0, 1, 254, 255, 70000, 3])
    assert (ngramlm.unpack_counts(ngramlm.pack_counts(c), 6) == c).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert ngramlm.score(empty).count() == 0
    only_held = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert ngramlm.score(only_held).collect()[0]["n_known"] == 0
