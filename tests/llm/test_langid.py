import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid

EN = ["the cat sat on the mat and then the dog ran with it", "this is the house that was there with them"]
DE = ["der hund und die katze sind nicht in dem haus", "ich habe das buch auf den tisch gelegt und gehe"]
FR = ["le chat est sur la table et le chien avec nous", "je ne sais pas pourquoi elle est dans la maison"]
ES = ["el perro y la casa son para los niños de aquí", "no sé por qué está en el coche con una mujer"]


def rows():
    out = []
    for lang, texts in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)):
        for k in range(20):
            words = texts[k % 2].split()
            out.append((len(out), " ".join(words[k % 5 :] + words[: k % 5]), lang))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 4 <> 2"))
    got = langid.identify(df.filter("doc_id % 4 = 2"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) == len(got) == 20
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_edge_cases(spark):
    df = spark.createDataFrame(rows() + [(900, "null label", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! 45"), (4, "the " * 300000), (4, "the " * 300000), (5, "é")], "doc_id long, text string").withColumn("LANG_SCORE", F.lit("x"))
    got = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["lang_score"] for r in got[:3]] == [0, 0, 0]
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "en"
    assert got[5]["lang_pred"] != "und"


def test_training_reads_whole_texts(spark):
    """The first megabytes of all texts are the same; what tells the languages comes after."""
    short = spark.createDataFrame([r for r in rows() if r[2] in ("en", "de") and r[0] % 5 == 0], "doc_id long, text string, lang string")
    long = short.withColumn("text", F.expr("concat(repeat('zq ', 400000), repeat(concat(text, ' '), 20000))"))
    got = langid.identify(short, langid.fit(long)).collect()
    assert len(got) == 8 and all(r["lang"] == r["lang_pred"] for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    some = spark.createDataFrame([(1, "hello", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(some, model).collect()] == ["und"]
    assert [r["lang_pred"] for r in langid.identify(some, langid.fit(some)).collect()] == ["en"]
