import random

from pyspark.sql import functions as F

from gridloom.llm import decontaminate as dc


def brute(words, items, window):
    hit, names = set(), set()
    for name, item in items:
        k = min(len(item), window)
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                names.add(name)
    return hit, names


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for trial in range(300):
        vocab = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3]))]
        items = [(str(i), [rng.choice(vocab) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        docs = [[rng.choice([*vocab, b"zz"] if rng.random() < 0.5 else vocab) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        for words, (runs, names) in zip(docs, dc.Automaton(items, 4).pack().match(docs)):
            assert (set(i for a, b in runs for i in range(a, b)), names) == brute(words, items, 4)
            assert all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_stretches_do_not_matter(monkeypatch):
    rng = random.Random(9)
    items = [(str(i), [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 14))]) for i in range(4)]
    docs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (0, 1, 50, 200)]
    found = []
    for n in (1, 7, 1000):
        monkeypatch.setattr(dc, "STRETCH", n)
        found.append(dc.Automaton(items, 6).pack().match(docs))
    assert found[0] == found[1] == found[2]


def test_packed_size_is_bounded():
    rng = random.Random(8)
    words = [b"w%d" % rng.randint(0, 50) for _ in range(20000)]
    p = dc.Automaton([("a", words)]).pack()
    assert len(p.link) <= 2 * len(words) and len(p.keys) <= 3 * len(words)
    assert sum(x.nbytes for x in (p.keys, p.to, p.link, p.length, p.window_state, p.short_state)) <= 68 * len(words)


def test_shards_give_the_same_hits(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    bench = spark.createDataFrame([(i, text(rng.randint(0, 8))) for i in range(12)] + [(99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text(40)) for i in range(20)], "doc_id long, text string")
    one, many = (sorted(dc.find_hits(docs, bench, window=5, shard_bytes=n).collect()) for n in (10**6, 40))
    assert one == many


def test_edges_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item.upper() + "!"), (1, item), (2, ""), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "Before, " + item + " after" + " clean" * 30), (4, item), (5, "w0 w1 fine"), (5, "w0 w1 fine"), (6, "x " * 200000)],
        "doc_id long, text string",
    ).withColumn("N_WORDS", F.lit(-1))
    hits = dc.find_hits(docs, bench)
    got = {r["doc_id"]: r for r in hits.collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and got[6]["n_words"] == 200000
    assert got[3]["hit_items"] == ["1"] and [list(x) for x in got[3]["hit_runs"]] == [[1, 13]]
    left = {r["doc_id"]: r["text"] for r in dc.remove_hits(hits).collect()}
    assert 4 not in left and left[3] == "Before,  after" + " clean" * 30 and left[5] == "w0 w1 fine" and left[1] is None
    none = dc.find_hits(docs, bench.limit(0))
    assert none.filter(F.size("hit_runs") > 0).count() == 0 and none.count() == 7
    assert dc.find_hits(docs.limit(0), bench).count() == 0


def test_short_items_are_cut(spark):
    """A whole item of three words or more goes; one of two words stays."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "two words"), (3, "one nine word item sits here now my dear")], "item_id long, text string")
    rest = " clean" * 30
    docs = spark.createDataFrame([(1, "a alpha, beta gamma b" + rest), (2, "two words" + rest), (3, "x one nine word item sits here now my dear y" + rest)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in dc.remove_hits(dc.find_hits(docs, bench)).collect()}
    assert left == {1: "a  b" + rest, 2: "two words" + rest, 3: "x  y" + rest}
