"""Language identification by hierarchical discrimination.

A first linear SVM layer picks the language family; within the family, one-versus-one
linear SVMs vote between the closely related languages. Features are hashed byte bigrams
and trigrams of the lower-cased text, weighted by their share of the text, so a document's
margin is the mean of per-position weights and whole texts of any length are scored in one pass.

Cases: null text, empty text and text without a letter give ``und`` with score 0. Training
ignores rows with a null label or null text; with no usable row every answer is ``und``. A
single learned language is answered with score 1. Ties between languages go to the
alphabetically first. Rows with a null id are scored but teach nothing. Repeated rows are scored alike. Columns named like the outputs give way.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm import common

#: Families of ISO 639-1 codes; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr gu pa ne",
}
DIM = 4096
SCALE = 60.0
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family_of(lang: str) -> str:
    base = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), lang)


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace")))


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigram and trigram codes of the joined texts, and where each text begins."""
    framed = [b" " + t.translate(_TABLE) + b"  " for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in framed])))
    u = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32)
    two = u[:-1] * np.uint32(2654435761) ^ u[1:] * np.uint32(40503)
    tri = two[:-1] * np.uint32(2246822519) + u[2:] * np.uint32(3266489917)
    two = (two * np.uint32(668265263)) >> np.uint32(20)
    tri = (tri * np.uint32(374761393)) >> np.uint32(20)
    return two, tri, starts


def features(texts: list[bytes]) -> np.ndarray:
    two, tri, starts = codes_of(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for i in range(len(texts)):
        a, b = starts[i], starts[i + 1] - 2
        row = np.bincount(two[a:b], minlength=DIM) + np.bincount(tri[a:b], minlength=DIM)
        out[i] = row * (SCALE / max(1, 2 * (b - a)))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Hinge loss by averaged subgradient steps over minibatches; y is +1 or -1; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    w, avg, bias, avg_b, n, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, len(y), 0
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            t += 1
            step = 1.0 / (lam * (t + 1 / lam / 8))
            xb, yb = x[rows], y[rows]
            hit = (yb * (xb @ w + bias) < 1) * yb * weight[rows]
            w *= 1 - step * lam
            w += (step / len(rows)) * (hit @ xb)
            bias += 0.05 * step * hit.mean()
            avg += (w - avg) / t
            avg_b += (bias - avg_b) / t
    return np.append(avg, avg_b).astype(np.float32)


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    family_svm: dict[str, np.ndarray] = field(default_factory=dict)
    pair_svm: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def margins(self, w: np.ndarray, codes, n: np.ndarray) -> np.ndarray:
        two, tri, starts = codes
        weight = w[:-1]
        sums = np.concatenate(([0.0], np.cumsum(weight[two[: len(tri)]] + weight[tri], dtype=np.float64)))
        ends = np.minimum(starts[1:] - 2, len(sums) - 1)
        return (sums[ends] - sums[starts[:-1]]) * (SCALE / np.maximum(1, 2 * n)) + w[-1]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families or not texts:
            return names, score
        codes = codes_of(texts)
        n = np.diff(codes[2]) - 2
        fams = sorted(self.families)
        votes = np.stack([self.margins(self.family_svm[f], codes, n) if f in self.family_svm else np.zeros(len(texts)) for f in fams])
        best = votes.argmax(0)
        soft = np.exp(2 * (votes - votes.max(0)))
        sure = 1 / soft.sum(0)
        inner = {}
        for fam, langs in self.families.items():
            tally = np.zeros((len(langs), len(texts)))
            for (a, b), w in self.pair_svm.items():
                if a in langs:
                    m = self.margins(w, codes, n)
                    up = 1 / (1 + np.exp(-np.clip(2 * m, -50, 50)))
                    tally[langs.index(a)] += (m >= 0) + 1e-3 * up
                    tally[langs.index(b)] += (m < 0) + 1e-3 * (1 - up)
                    inner.setdefault(fam, {})[a, b] = up
            top = tally.argmax(0)
            for i in np.flatnonzero(best == fams.index(fam)):
                if not has_letter(texts[i]):
                    continue
                lang = langs[top[i]]
                p = sure[i]
                for (a, b), up in inner.get(fam, {}).items():
                    p *= up[i] if a == lang else 1 - up[i] if b == lang else 1
                names[i], score[i] = lang, min(1.0, max(0.0, p))
        return names, score


PACKED = T.StructType([T.StructField("_vector", T.BinaryType())])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> LanguageModel:
    """Train on at most per_language rows of each language, taken in hash order of the id.

    Only the chosen ids travel before the texts are read, and of a language with more rows only those whose
    hash lies in the share that holds about four times per_language of them, so what is ranked does not grow
    with the table. Of rows that share an id and a language one is used. Executors read whole texts; the driver gets the counts of the languages and feature
    vectors of fixed size, at most per_language of each language.
    """
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.shiftrightunsigned(F.xxhash64(id_col), 1).alias("_hash"))
    rows = ids.groupBy("_lang").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * per_language).collect()
    for r in sorted(rows, key=lambda r: r["_lang"]):
        ids = ids.filter((F.col("_lang") != r["_lang"]) | (F.col("_hash") < 4 * per_language * (1 << 63) // r["n"]))
    rank = F.dense_rank().over(Window.partitionBy("_lang").orderBy("_hash", "_id"))
    chosen = ids.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("_id").distinct()
    rows = (
        labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
        .filter("_text is not null and _lang is not null")
        .join(F.broadcast(chosen), "_id", "left_semi")
    )

    def compute(part: pa.RecordBatch) -> list:
        packed = [zlib.compress(features([t]).tobytes(), 1) if has_letter(t) else None for t in common.raw_texts(part, "_text")]
        return [pa.array(packed, pa.binary())]

    vectors = common.append_columns(rows, "_text", PACKED, compute).filter("_vector is not null")
    kept = vectors.groupBy("_id", "_lang").agg(F.max("_vector").alias("_vector")).collect()
    return train(sorted((r["_lang"], zlib.decompress(r["_vector"])) for r in kept))


def train(rows: list[tuple[str, bytes]]) -> LanguageModel:
    """Fit on (language, feature vector as bytes)."""
    model = LanguageModel()
    for lang in sorted({r[0] for r in rows}):
        model.families.setdefault(family_of(lang), []).append(lang)
    if not rows:
        return model
    x, langs = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, DIM), np.array([r[0] for r in rows], object)
    fams = np.array([family_of(v) for v in langs], object)
    if len(model.families) > 1:
        for fam in model.families:
            model.family_svm[fam] = linear_svm(x, np.where(fams == fam, 1.0, -1.0))
    for members in model.families.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows_ab = np.flatnonzero((langs == a) | (langs == b))
                model.pair_svm[a, b] = linear_svm(x[rows_ab], np.where(langs[rows_ab] == a, 1.0, -1.0))
    return model


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred and lang_score to every row; the text is read whole."""

    def compute(part: pa.RecordBatch) -> list:
        names, score = model.predict(common.raw_texts(part, text_col))
        return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    return common.append_columns(docs, text_col, FIELDS, compute)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.fold_of("doc_id", 4) == 2
    model = fit(docs.filter(~F.coalesce(held, F.lit(True))))
    scored = identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
