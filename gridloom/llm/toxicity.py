"""Toxicity scoring with a bidirectional gated recurrent network and attention pooling.

Each word enters as a word vector (of words that at least SUPPORT sampled documents hold; a
zero vector for others) joined with a character vector (the mean of its hashed character
trigrams). Forward and backward gated recurrent units read a
window of words, attention pools their states, and a logistic unit scores the window. A
document is read in overlapping windows over its whole text and scores as its worst window;
each window overlaps half of the next one (a window at every word would take twenty times the work).

Training is plain numpy: hand-written back-propagation through time and Adam, on a bounded
sample of labelled documents. A toxic document's positive example is its most suspicious
window by smoothed log odds of its words; clean documents give their most suspicious window
and a random one. The log odds also start the first coordinate of the word vectors.

Cases: null and empty texts (and texts without a word) score as an empty window, the clean
side of the prior; rows without a label are only scored; labels without a document or null
labels are ignored; of repeated labels the greatest is used; without two classes in the
sample every score is the prior; repeated rows score alike; columns named like the outputs
give way; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))
SUPPORT, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 4, 4096, 8, 6, 8, 6
WINDOW, STRIDE = 40, 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_KEEP).split()


def trigram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's character trigrams, framed by marks, and where each word's begin."""
    framed = b"".join(b"<" + w + b">" for w in words)
    sizes = np.array([len(w) for w in words], np.int64)  # a framed word of n bytes has n trigrams
    u = np.frombuffer(framed, np.uint8).astype(np.uint32)
    starts = np.cumsum(sizes + 2) - sizes - 2
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    code = (u[at] * np.uint32(2654435761)) ^ (u[at + 1] * np.uint32(2246822519)) ^ (u[at + 2] * np.uint32(3266489917))
    code = (code * np.uint32(668265263)) >> np.uint32(20)
    return code.astype(np.int64) % TRIGRAMS, np.cumsum(sizes) - sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Toxicity:
    p: dict[str, np.ndarray]
    vocab: dict[bytes, int]
    prior: float = 0.5
    trained: bool = False

    @classmethod
    def fresh(cls, words: list[bytes] = (), seed: int = 11) -> "Toxicity":
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=0.3: (rng.normal(size=s) * scale).astype(np.float32)
        x = WORD_DIM + CHAR_DIM
        p = {"word": draw(len(words) + 1, WORD_DIM, scale=0.05), "char": draw(TRIGRAMS, CHAR_DIM, scale=0.2)}
        for d in "fb":
            p |= {f"x{d}": draw(x, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"att": draw(2 * HIDDEN, ATTEND), "att_v": draw(ATTEND), "out": draw(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        p["word"][0] = 0
        return cls(p, {w: i + 1 for i, w in enumerate(words)})

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Rows of the word vectors; 0 for unknown words."""
        return np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        tri, at = trigram_slots(words)
        sizes = np.diff(np.concatenate((at, [len(tri)])))
        chars = np.add.reduceat(self.p["char"][tri], at, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][self.slots(words)], chars), axis=1)

    def _run(self, gates: np.ndarray, real: np.ndarray, d: str, keep: bool):
        """States of one direction; gates: input projections (steps, windows, 3H), real: word or padding."""
        steps, n, _ = gates.shape
        u, h = self.p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        cache = []
        for t in range(steps):
            g = gates[t]
            zr = sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            m = real[t][:, None]
            new = np.where(m, h + z * (c - h), h)
            if keep:
                cache.append((h, z, r, c, m))
            out[t] = h = new
        return out, cache

    def logits(self, table: np.ndarray, idx: np.ndarray, real: np.ndarray, keep: bool = False):
        """Scores of windows; table: projections of distinct words by direction, idx and real: (steps, windows)."""
        fwd, cf = self._run(table[0][idx], real, "f", keep)
        bwd, cb = self._run(table[1][idx[::-1]], real[::-1], "b", keep)
        s = np.concatenate((fwd, bwd[::-1]), axis=2)
        a = np.tanh(s @ self.p["att"])
        e = np.where(real, a @ self.p["att_v"], -1e9)
        w = np.exp(e - e.max(0))
        w = np.where(real, w, 0)
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * s).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_b"]
        return (logit, (s, a, w, pooled, cf, cb)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]])

    def score(self, texts: list[bytes], batch: int = 2048) -> np.ndarray:
        """Worst window of each text."""
        if not self.trained:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        words, sizes = [], []
        for raw in texts:
            w = words_of(raw)
            words += w
            sizes.append(len(w))
        out[np.array(sizes) == 0] = min(sigmoid(self.p["out_b"].astype(np.float64))[0], self.prior)
        if not words:
            return out
        known: dict[bytes, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        table = self.project(self.vectors(list(known)))
        base, doc, start, length = 0, [], [], []
        for i, n in enumerate(sizes):
            if n:
                for s in window_starts(n):
                    doc.append(i)
                    start.append(base + s)
                    length.append(min(WINDOW, n))
            base += n
        doc, start, length = np.array(doc), np.array(start), np.array(length)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            steps = np.arange(length[rows].max())[:, None]
            real = steps < length[rows]
            idx = flat[np.minimum(start[rows] + steps, len(flat) - 1)]
            np.maximum.at(out, doc[rows], sigmoid(self.logits(table, idx, real).astype(np.float64)))
        return out

    def gradients(self, words: list[bytes], idx: np.ndarray, real: np.ndarray, y: np.ndarray):
        """Mean logistic loss of windows and its gradients."""
        p, n = self.p, len(y)
        x = self.vectors(words)
        logit, (s, a, w, pooled, cf, cb) = self.logits(self.project(x), idx, real, keep=True)
        prob = sigmoid(logit)
        loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        dl = ((prob - y) / n).astype(np.float32)
        g["out"], g["out_b"] = dl @ pooled, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["out"]
        ds = w[:, :, None] * dpool
        dw = (s * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["att_v"] * (1 - a**2)
        g["att_v"] = np.einsum("tn,tna->a", de, a)
        g["att"] = np.einsum("tnh,tna->ha", s, da)
        ds = ds + da @ p["att"].T
        dx = np.zeros_like(x)
        for d, cache, dh_out, at in (("f", cf, ds[:, :, :HIDDEN], idx), ("b", cb, ds[::-1, :, HIDDEN:], idx[::-1])):
            u, carry = p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
            dgates = np.zeros((len(at), n, 3 * HIDDEN), np.float32)
            for t in range(len(at) - 1, -1, -1):
                h, z, r, c, m = cache[t]
                dh = dh_out[t] + carry
                live = np.where(m, dh, 0)
                dc = live * z * (1 - c**2)
                dz = live * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                g[f"h{d}"][:, : 2 * HIDDEN] += h.T @ dzr
                g[f"h{d}"][:, 2 * HIDDEN :] += (r * h).T @ dc
                carry = np.where(m, dh * (1 - z), dh) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
                dgates[t] = np.concatenate((dzr, dc), axis=1)
            flat = dgates.reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(per_word, at.reshape(-1), flat)
            g[f"x{d}"], g[f"b{d}"] = x.T @ per_word, flat.sum(0)
            dx += per_word @ p[f"x{d}"].T
        slots = self.slots(words)
        g["word"] = (slots, dx[:, :WORD_DIM] * (slots > 0)[:, None])
        tri, at = trigram_slots(words)
        sizes = np.diff(np.concatenate((at, [len(tri)])))
        g["char"] = (tri, np.repeat(dx[:, WORD_DIM:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        return loss, g


def train(texts: list[bytes], toxic: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Toxicity:
    docs = [words_of(t) for t in texts]
    held: dict[bytes, list[int]] = {}
    for words, label in zip(docs, toxic):
        for w in set(words):
            held.setdefault(w, [0, 0])[label] += 1
    held = {w: c for w, c in sorted(held.items()) if sum(c) >= SUPPORT}
    model = Toxicity.fresh(list(held), seed)
    y = np.array(toxic, float)
    model.prior = float(min(max(y.mean(), 0.01), 0.49)) if len(y) else 0.49
    if len(set(toxic)) < 2:
        return model
    n = {c: sum(v == c for v in toxic) for c in (0, 1)}
    odds = np.array([0.0] + [(np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))) * sum(c) / (sum(c) + SUPPORT) for c in held.values()])
    model.p["word"][:, 0] = np.clip(odds, -3, 3)
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    for words, label in zip(docs, toxic):
        if not words:
            continue
        heat = np.maximum(odds[model.slots(words)], 0) ** 2
        sums = np.concatenate(([0.0], np.cumsum(heat)))
        starts = np.array(window_starts(len(words)))
        best = starts[np.argmax(sums[np.minimum(starts + WINDOW, len(words))] - sums[starts])]
        picks = [best] if label else [best, rng.choice(starts)]
        for s in picks:
            windows.append(words[s : s + WINDOW])
            labels.append(label)
    labels = np.array(labels, np.float32)
    weight = np.where(labels > 0)[0]
    extra = rng.choice(weight, max(0, len(labels) - 2 * len(weight)), replace=True) if len(weight) else np.zeros(0, int)
    pool = np.concatenate((np.arange(len(labels)), extra[: len(extra) // 2]))
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(pool)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            chosen = [windows[i] for i in rows]
            known: dict[bytes, int] = {}
            length = np.array([len(w) for w in chosen])
            idx = np.zeros((length.max(), len(rows)), np.int64)
            for j, w in enumerate(chosen):
                idx[: len(w), j] = [known.setdefault(x, len(known)) for x in w]
            real = np.arange(length.max())[:, None] < length
            _, g = model.gradients(list(known), idx, real, labels[rows])
            step += 1
            lr = rate * (1 - epoch / epochs * 0.8) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in g.items():
                if isinstance(grad, tuple):  # sparse rows, plain adaptive steps
                    where, inverse = np.unique(grad[0], return_inverse=True)
                    total = np.zeros((len(where), grad[1].shape[1]), np.float32)
                    np.add.at(total, inverse, grad[1])
                    m2[k][where] += total**2
                    model.p[k][where] -= 0.5 * rate * total / (np.sqrt(m2[k][where]) + 1e-6)
                    continue
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                model.p[k] -= (lr * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    model.trained = True
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000) -> Toxicity:
    """Train on at most per_class documents of each class, taken in hash order of the id; ids travel before texts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    known = known.join(docs.select(id_col).distinct(), id_col, "left_semi")
    part = lambda c: known.filter(F.col("_toxic") == c).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_raw"))
        .join(F.broadcast(part(0).unionByName(part(1)).withColumnRenamed(id_col, "_id")), "_id").collect()
    )
    rows = sorted((str(r["_id"]), int(r["_toxic"]), bytes(r["_raw"] or b"")) for r in rows)
    return train([r[2] for r in rows], [r[1] for r in rows])


FIELDS = T.StructType([T.StructField("toxic_score", T.DoubleType())])


def add_scores(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.append_columns(docs, text_col, FIELDS, lambda part: [pa.array(shared.value.score(common.raw_texts(part, text_col)))])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(common.fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    model = fit(docs.filter("not held_out"), common.table(spark, sf_dir, "labels"))
    scored = add_scores(docs, model)
    return scored.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
