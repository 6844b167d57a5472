"""Mixing sources to target weights with soft domain membership.

A multinomial logistic classifier over hashed words is trained on a bounded sample of a table
of labelled documents and predicts every document's domain posteriors. Nonnegative rates
(expected copies of each document) are then fitted by bounded least squares, so that the expected tokens of each domain, the sum of rate x tokens x posterior, match targets:

    min  1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / A_k + ridge/2 sum_d n_d (r_d - r0)^2,   0 <= r_d <= most

A_k are the available tokens. The dual has one price per domain, and a document's rate
depends only on its posteriors and the prices, so rates are never stored between steps: each
Newton step with line search is one pass over the small table of posteriors that adds up the
tokens of each domain and the curvature of each pair of domains. Steps go on until every
domain is solved to a share of its own target or the dual no longer rises; a target that the
limits of the rates and the ridge keep out of reach is logged.

Cases: null and empty texts have 0 tokens and the class prior, and get the base rate moved
by their posteriors like any other; unlabelled documents are only scored; labels without a
document or with a null domain are ignored; of repeated labels the least is used; no usable
label means a uniform posterior; repeated rows are fitted and returned each; an empty table
gives no rows. Columns named like the outputs give way.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

DIM = 8192


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        words = raw.lower().split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return (flat % np.uint64(DIM)).astype(np.int64), sizes


class DomainModel:
    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Softmax of word weights scaled by the root of the word count."""
        z = np.tile(self.bias, (len(sizes), 1))
        ends = np.cumsum(sizes)
        for k in range(len(self.domains)):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[slots, k])))
            z[:, k] += (sums[ends] - sums[ends - sizes]) / np.sqrt(np.maximum(1, sizes))
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 120, decay: float = 1e-4) -> DomainModel:
    domains = sorted(set(labels)) or ["all"]
    y = np.eye(len(domains))[[domains.index(v) for v in labels]] if labels else np.zeros((0, 1))
    bias = np.log((y.sum(0) + 1) / (len(y) + len(domains)))
    model = DomainModel(domains, np.zeros((DIM, len(domains))), bias.copy())
    if len(domains) < 2:
        return model
    slots, sizes = word_slots(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    value = 1 / np.sqrt(np.maximum(1, sizes))[doc]
    grad2_w, grad2_b = np.full_like(model.weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        gap = (model.posteriors(slots, sizes) - y) / len(texts)
        gw = np.stack([np.bincount(slots, weights=value * gap[doc, k], minlength=DIM) for k in range(len(domains))], 1) + decay * model.weights
        gb = gap.sum(0)
        grad2_w, grad2_b = 0.9 * grad2_w + 0.1 * gw**2, 0.9 * grad2_b + 0.1 * gb**2
        model.weights -= 0.02 * gw / np.sqrt(grad2_w)
        model.bias -= 0.02 * gb / np.sqrt(grad2_b)
    return model


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample_rows: int = 3000) -> DomainModel:
    """Train on sample_rows labelled documents, taken in hash order of the id; ids travel before texts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(id_col).agg(F.min(F.col(domain_col).cast("string")).alias("_domain"))
    chosen = known.join(docs.select(id_col).distinct(), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_raw")).join(F.broadcast(chosen), id_col).select("_domain", "_raw").collect()
    rows = sorted((r["_domain"], bytes(r["_raw"] or b"")) for r in rows)
    return train([r[1] for r in rows], [r[0] for r in rows])


FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])


def add_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list:
        slots, sizes = word_slots(common.raw_texts(part, text_col))
        p = shared.value.posteriors(slots, sizes)
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))]

    return common.append_columns(docs, text_col, FIELDS, compute)


def rates_after(p: np.ndarray, pulls: list[np.ndarray], base: float, ridge: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) after the accelerated projected steps with the given residual vectors."""
    r = y = np.full(len(p), base)
    momentum = 1.0
    for pull in pulls:
        new = np.clip(y - (p @ pull + ridge * (y - base)) / (1 + ridge), 0.0, most)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - r)
        r, momentum = new, after
    return r, y


def fit_rates(scored: DataFrame, targets: np.ndarray, most: float = 4.0, ridge: float = 1e-3, steps: int | None = None, tolerance: float = 1e-3):
    """Residual vectors that give the rates; scored holds n_tokens and posteriors. Returns (pulls, base rate).

    Each domain is solved to tolerance of its own target; steps, if given, is the most Newton steps.
    """
    k = len(targets)

    def sums(prices: np.ndarray, base: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Least cost of the rates at these prices, the tokens they give each domain, and the weight of the rates within limits."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy().astype(float)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    cost = p @ prices
                    wish = base - cost / ridge
                    r = np.clip(wish, 0.0, most)
                    free = p * np.where((wish > 0) & (wish < most), n, 0.0)[:, None]
                    v = np.concatenate(([(n * (r * cost + ridge / 2 * (r - base) ** 2)).sum()], (n * r) @ p, (free.T @ p).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["k", "v"])

        out = np.zeros(1 + k + k * k)
        for row in scored.select("n_tokens", "posteriors").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[row["k"]] = row["v"]
        return out[0], out[1 : 1 + k], out[1 + k :].reshape(k, k)

    have = sums(np.zeros(k), 1.0)[1]
    if not have.sum():
        return [], 1.0
    base = float(targets.sum() / have.sum())
    scale = np.maximum(have, 1e-9 * have.sum())
    close = tolerance * np.maximum(targets, 1e-6 * targets.sum())

    def dual(prices: np.ndarray):
        cost, got, free = sums(prices, base)
        return cost - prices @ targets - (scale * prices**2).sum() / 2, got, got - targets - scale * prices, free

    prices = np.zeros(k)
    value, got, slope, free = dual(prices)
    done = 0
    while (np.abs(slope) > close).any() and (steps is None or done < steps):
        step = np.linalg.solve(np.diag(scale) + free / ridge, slope)
        part, floor = 1.0, 1e-12 * abs(value)
        while part > 1e-9:
            after = dual(prices + part * step)
            if after[0] >= value + 1e-4 * part * (slope @ step) - floor:
                break
            part /= 2
        if part <= 1e-9 or (after[0] <= value + floor and np.abs(after[2]).max() >= np.abs(slope).max()):
            break
        prices = prices + part * step
        value, got, slope, free = after
        done += 1
    missed = np.flatnonzero(np.abs(got - targets) > 10 * close)
    if len(missed):
        logging.getLogger(__name__).warning("mixing targets missed by more than %g of their size, as domain: (tokens, target): %s", 10 * tolerance, {int(i): (float(got[i]), float(targets[i])) for i in missed})
    # one step of rates_after from the base with this vector is the clipped rate at the prices
    return [prices * (1 + ridge) / ridge], base


RATE_FIELDS = T.StructType([T.StructField("rate", T.DoubleType())])


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", budget: float = 1.0, most: float = 4.0) -> DataFrame:
    """Add n_tokens, posteriors, rate and copies; shares: target share of tokens by domain, budget: times all tokens.

    Domains without a share get none; copies rounds the rate up or down by a hash of the id,
    so that its expectation is the rate.
    """
    model = fit_domains(docs, labels, id_col, text_col, domain_col)
    scored = common.stage(add_posteriors(docs, model, text_col), "mixing")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = np.array([shares.get(d, 0.0) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    pulls, base = fit_rates(scored, wanted * total * budget, most)
    if len(model.domains) < 2:
        pulls, base = [], budget

    def compute(part: pa.RecordBatch) -> list:
        p = part.column(part.schema.get_field_index("posteriors")).flatten().to_numpy().reshape(part.num_rows, -1)
        return [pa.array(rates_after(p, pulls, base, 1e-3, most)[0])]

    out = common.append_columns(scored, text_col, RATE_FIELDS, compute)
    chance = F.pmod(F.xxhash64(F.lit("copies"), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return common.without(out, ["copies"]).withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


#: Target shares of tokens by quality and toxicity label.
SHARES = {"high_clean": 0.75, "low_clean": 0.22, "high_toxic": 0.02, "low_toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return labels.select("doc_id", F.concat(quality, F.lit("_"), toxic).alias("domain"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mix(docs, label_domains(common.table(spark, sf_dir, "labels")), SHARES)
    return out.select("doc_id", "n_tokens", "posteriors", "rate", "copies")
