import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import mixing


def corpus():
    rows = [(i, f"news report market {i} " * 5, "a") if i % 4 else (i, f"recipe sugar flour {i} " * 5, "b") for i in range(200)]
    return [(i, t) for i, t, _ in rows], [(i, d) for i, _, d in rows if i % 2 == 0 or i % 5 == 0]


def test_rates_meet_the_targets(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "sugar " * 50000), (902, "sugar " * 50000)], "doc_id long, text string").withColumn("RATE", F.lit("x"))
    lab = spark.createDataFrame([*labels, (5000, "b"), (4, None), (8, "b"), (8, "b")], "doc_id long, domain string")
    out = mixing.mix(df.filter("doc_id < 902"), lab, {"a": 0.4, "b": 0.6}).collect()
    n = np.array([r["n_tokens"] for r in out], float)
    p = np.array([r["posteriors"] for r in out])
    r = np.array([r["rate"] for r in out])
    share = (n * r) @ p / (n * r).sum()
    assert abs(share - [0.4, 0.6]).max() < 0.02 and r.min() >= 0 and r.max() <= 4
    assert all(abs(x["copies"] - x["rate"]) < 1 for x in out)
    assert len(mixing.mix(df, lab, {"a": 1.0}).collect()) == len(docs) + 4


def test_descent_equals_a_direct_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4] * 3, 80)
    n = rng.integers(1, 100, 80)
    scored = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    total = float(n.sum())
    targets = np.array([0.2, 0.3, 0.5]) * total
    pulls, base = mixing.fit_rates(scored, targets, most=4.0, steps=60, tolerance=1e-6)
    r = mixing.rates_after(p, pulls, base, 1e-3, 4.0)[0]
    a = n[:, None] * p
    x = np.full(80, base)
    for _ in range(20000):  # plain projected gradient
        x = np.clip(x - 0.99 * (p @ ((x @ a - targets) / a.sum(0)) + 1e-3 * (x - base)), 0, 4)
    assert np.abs(r @ a - targets).max() < 0.01 * total and np.abs(r - x).max() < 0.05


def test_defaults_solve_rare_domains(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([6.0, 3.0, 0.5, 0.3], 120)
    n = rng.integers(1, 100, 120)
    scored = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    targets = np.array([0.75, 0.22, 0.02, 0.01]) * n.sum()
    r = mixing.rates_after(p, *mixing.fit_rates(scored, targets), 1e-3, 4.0)[0]
    a = n[:, None] * p
    x = np.ones(120)
    for _ in range(60000):  # plain projected gradient
        x = np.clip(x - 0.99 * (p @ ((x @ a - targets) / a.sum(0)) + 1e-3 * (x - 1)), 0, 4)
    assert (np.abs(r @ a - x @ a) < 0.005 * targets).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(docs, lab, {"a": 1.0}).count() == 0
    some = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert mixing.mix(some, lab, {"a": 1.0}).collect()[0]["rate"] == 1.0
