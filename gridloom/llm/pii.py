"""Personal data with a skip-chain conditional random field.

Regular expressions with checks (octet range, Luhn, digit counts) give the base spans, which
always stay. A CRF then labels the document's candidate tokens (those holding a digit or an
at sign) as other, email, ip, card or phone. Close neighbours share chain potentials; equal
tokens and similar ones (the same last or first seven digits, or the same address but for its domain's
ending) share two kinds of skip potentials, anywhere in the document. Tokens in base
spans are observed; loopy message passing carries their labels to the distant mentions that
the expressions cannot see, such as a phone number repeated without its plus sign. Runs of
one label become added spans if they are plausible for their kind and touch no base span.

Node weights and all pair potentials are trained together, by gradient steps on the log
likelihood of the base labels in a bounded sample of documents (its prior is default_model).
Each step runs message passing twice, once with the labels held and once free, and moves along the
difference of expected counts. A token without base label that is linked to one of a
labelled kind is hidden: it is left free in both, so that missed mentions do not teach that
copies disagree.

Links. Equal tokens are linked in the order of their occurrence (each to the previous and the
first one), similar ones to the first of their likeness, so links grow with the tokens, not
with their square.

Cases: null text counts as empty and has no spans; a null id is scored and may be sampled like any
other; repeated rows give repeated results; an empty sample leaves the default potentials;
texts are read whole. Columns named like the outputs give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as listed."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append(("email", left, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT_ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


_DIGIT_ANY = re.compile(r"[0-9]")


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Whitespace-delimited tokens that hold a digit or an at sign, outer punctuation removed."""
    out, pos = [], 0
    while m := _MARK.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        pos = end
        while end > start and text[end - 1] in ".,;:!?\"'*#$%&|>":
            end -= 1
        while start < end and text[start] in "\"'*#$%&|<=,;:":
            start += 1
        if end > start:
            out.append((start, end))
    return out


N_FEATURES = 18


def token_features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(tokens), N_FEATURES))
    for i, (s, e) in enumerate(tokens):
        t = text[s:e]
        digits = _DIGITS.sub("", t)
        n, dots, letters = len(digits), t.count("."), sum(c.isalpha() for c in t)
        x[i] = (
            1, "@" in t, t.startswith("+"), "(" in t, "-" in t, dots == 3, dots > 0, letters > 0, letters > 6,
            n == 0, 1 <= n <= 2, n == 3, 4 <= n <= 7, 8 <= n <= 13, 14 <= n <= 19, n > 19,
            14 <= n <= 19 and letters == 0 and luhn(digits), e < len(text) and s > 0 and text[s - 1] == '"',
        )
    return x


def token_key(token: str) -> str:
    digits = _DIGITS.sub("", token)
    return token.lower() if "@" in token or not digits or any(c.isalpha() for c in token) else digits if "." not in token else token


LABELS, CHAIN, EQUAL, SIMILAR = 5, 0, 1, 2


@dataclass
class Crf:
    """Log potentials: node weights (features x labels) and label pairs of chain, equal and similar links."""

    weights: np.ndarray
    pairs: np.ndarray
    rounds: int = 12


def default_model() -> Crf:
    w = np.zeros((N_FEATURES, LABELS))
    w[0, 0] = 3.0
    w[1, 1] = 2.5
    return Crf(w, np.stack([0.5, 4.0, 2.0])[:, None, None] * np.eye(LABELS))


def labels_of(tokens, spans) -> np.ndarray:
    """Label number of the first base span that a token overlaps, or 0."""
    y, at = np.zeros(len(tokens), int), 0
    for i, (s, e) in enumerate(tokens):
        while at < len(spans) and spans[at][2] <= s:
            at += 1
        j = at
        while j < len(spans) and spans[j][1] < e and not y[i]:
            if spans[j][2] > s:
                y[i] = KINDS.index(spans[j][0]) + 1
            j += 1
    return y


def likenesses(key: str) -> list[str]:
    """What similar tokens share."""
    if "@" in key:
        return [key.rpartition(".")[0] or key]
    return ["<" + key[:7], ">" + key[-7:]] if len(key) >= 7 else []


def links_of(text: str, tokens) -> tuple[np.ndarray, np.ndarray]:
    """(links, kinds): chain links of close neighbours, skip links of equal and of similar tokens."""
    links = [(i, i + 1, CHAIN) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 3]
    first, last, like = {}, {}, {}
    for i, (s, e) in enumerate(tokens):
        key = token_key(text[s:e])
        if len(key) < 3:
            continue
        if key in last:
            links.append((last[key], i, EQUAL))
            if first[key] != last[key]:
                links.append((first[key], i, EQUAL))
        else:
            first[key] = i
            for other in sorted({like.setdefault(x, i) for x in likenesses(key)} - {i}):
                links.append((other, i, SIMILAR))
        last[key] = i
    table = np.array(links, np.int64).reshape(-1, 3)
    return table[:, :2], table[:, 2]


def _softmax(x: np.ndarray) -> np.ndarray:
    soft = np.exp(x - x.max(-1, keepdims=True))
    return soft / soft.sum(-1, keepdims=True)


def propagate(model: Crf, node: np.ndarray, links: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of tokens (n x 5) and of links (m x 5 x 5) by damped loopy sum-product; exact on trees."""
    m = len(links)
    if not m:
        return _softmax(node), np.zeros((0, LABELS, LABELS))
    pot = model.pairs[kinds]
    src, dst = np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0]))
    factor = np.exp(np.concatenate((model.pairs, model.pairs.transpose(0, 2, 1))))[np.concatenate((kinds, kinds + len(model.pairs)))]
    back = np.concatenate((np.arange(m) + m, np.arange(m)))
    order = np.argsort(dst, kind="stable")
    met, first = np.unique(dst[order], return_index=True)

    def beliefs(msg):
        out = node.copy()
        out[met] += np.add.reduceat(msg[order], first)
        return out

    msg = np.zeros((2 * m, LABELS))
    for step in range(model.rounds):
        rest = beliefs(msg)[src] - msg[back]
        new = np.log(np.matmul(np.exp(rest - rest.max(1, keepdims=True))[:, None, :], factor)[:, 0])
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-6:
            break
        msg = new if step < 2 else 0.5 * (msg + new)
    belief = beliefs(msg)
    edge = (belief[links[:, 0]] - msg[back[:m]])[:, :, None] + pot + (belief[links[:, 1]] - msg[:m])[:, None, :]
    return _softmax(belief), _softmax(edge.reshape(m, -1)).reshape(m, LABELS, LABELS)


def held_to(node: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Node potentials with the labels y observed; -1 is hidden."""
    out, seen = node.copy(), np.flatnonzero(y >= 0)
    out[seen] = -30.0
    out[seen, y[seen]] = 0.0
    return out


def plausible(kind: str, token: str) -> bool:
    digits = len(_DIGITS.sub("", token))
    letters = any(c.isalpha() for c in token)
    return {
        "email": "@" in token and not token.startswith("@") and not token.endswith("@"),
        "ip": token.count(".") == 3 and not letters and digits >= 4,
        "card": 14 <= digits <= 19 and not letters,
        "phone": 7 <= digits <= 15 and not letters,
    }[kind]


def find(text: str, model: Crf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text."""
    spans = base_spans(text)
    tokens = tokens_of(text)
    if not tokens:
        return spans, []
    y = labels_of(tokens, spans)
    if y.all():
        return spans, []
    node = held_to(token_features(text, tokens) @ model.weights, np.where(y > 0, y, -1))
    best = propagate(model, node, *links_of(text, tokens))[0].argmax(1)
    added, i = [], 0
    while i < len(tokens):
        if best[i] and not y[i]:
            j = i
            while j + 1 < len(tokens) and best[j + 1] == best[i] and not y[j + 1] and tokens[j + 1][0] - tokens[j][1] <= 2:
                j += 1
            kind = KINDS[best[i] - 1]
            if plausible(kind, text[tokens[i][0] : tokens[j][1]]):
                added.append((kind, tokens[i][0], tokens[j][1]))
            i = j
        i += 1
    return spans, added


def graph_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature bits, labels, links, kinds) of a text; -1 labels hidden tokens."""
    tokens = tokens_of(text)
    y = labels_of(tokens, base_spans(text))
    links, kinds = links_of(text, tokens)
    bits = token_features(text, tokens).astype(np.int64) @ (1 << np.arange(N_FEATURES))
    skip = links[kinds != CHAIN]
    for a, b in ((0, 1), (1, 0)):
        near = skip[:, a][(y[skip[:, a]] <= 0) & (y[skip[:, b]] > 0)]
        y[near] = -1
    return bits, y, links, kinds


def joined(graphs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One graph of many, unconnected."""
    sizes = np.cumsum([0, *(len(g[0]) for g in graphs)])
    return (
        np.concatenate([g[0] for g in graphs]), np.concatenate([g[1] for g in graphs]),
        np.concatenate([g[2] + at for g, at in zip(graphs, sizes)]), np.concatenate([g[3] for g in graphs]),
    )


def gradient(model: Crf, graph) -> np.ndarray:
    """Observed minus expected counts of features and label pairs, then the number of tokens."""
    bits, y, links, kinds = graph
    x = (bits[:, None] >> np.arange(N_FEATURES) & 1).astype(float)
    node = x @ model.weights
    free, free_pairs = propagate(model, node, links, kinds)
    held, held_pairs = propagate(model, held_to(node, y), links, kinds)
    pairs = np.zeros_like(model.pairs)
    np.add.at(pairs, kinds, held_pairs - free_pairs)
    return np.concatenate(((x.T @ (held - free)).ravel(), pairs.ravel(), [len(bits)]))


def climb(gradients, steps: int = 24, rate: float = 0.25, ridge: float = 1e-3) -> Crf:
    """Adam on the mean log likelihood less a ridge around default_model; gradients(model) sums gradient over the sample."""
    prior = default_model()
    at = np.concatenate((prior.weights.ravel(), prior.pairs.ravel()))
    origin, first, second = at.copy(), np.zeros(len(at)), np.zeros(len(at))
    made = lambda v, rounds: Crf(v[: prior.weights.size].reshape(prior.weights.shape).copy(), v[prior.weights.size :].reshape(prior.pairs.shape).copy(), rounds)
    for step in range(1, steps + 1):
        total = gradients(made(at, 5))
        if not total[-1]:
            return prior
        slope = total[:-1] / total[-1] - ridge * (at - origin)
        skip = slope[prior.weights.size :].reshape(prior.pairs.shape)
        skip[EQUAL:] = 0.5 * (skip[EQUAL:] + skip[EQUAL:].transpose(0, 2, 1))  # skip links have no direction
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return made(at, prior.rounds)


def train(texts: list[str]) -> Crf:
    """Fit on the base labels of the given texts."""
    graph = joined([graph_of(t) for t in texts]) if texts else None
    return climb(lambda model: gradient(model, graph)) if texts else default_model()


GRAPHS = "bits array<long>, labels array<long>, ends array<long>, kinds array<long>"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> Crf:
    """Train on sample_docs documents with digits or at signs, taken in hash order of the id.

    Ids travel before texts; executors read the sampled texts whole, keep their graphs in the shared
    folder and send sums of counts, which have a fixed size, at each step.
    """
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike("[0-9@]"))
    chosen = marked.select(F.col("_id").alias("_chosen")).orderBy(F.xxhash64("_chosen"), "_chosen").limit(sample_docs).distinct()
    sample = marked.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("_chosen")), "left_semi")

    def compute(part: pa.RecordBatch):
        graphs = [graph_of(t) for t in part.column(part.schema.get_field_index("_text")).to_pylist()]
        lists = lambda rows: pa.array([np.asarray(r).ravel() for r in rows], pa.list_(pa.int64()))
        yield {name: lists([g[i] for g in graphs]) for i, name in enumerate(("bits", "labels", "ends", "kinds"))}

    graphs = common.Stage(common.emit_rows(sample, "_text", GRAPHS, compute).repartition(8), "pii-graphs")

    def summed(model: Crf) -> np.ndarray:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    cols = [[np.asarray(r, np.int64) for r in c.to_pylist()] for c in batch.columns]
                    graph = joined([(bits, y, ends.reshape(-1, 2), kinds) for bits, y, ends, kinds in zip(*cols)])
                    yield pa.RecordBatch.from_arrays([pa.array([gradient(model, graph)], pa.list_(pa.float64()))], names=["sums"])

        rows = graphs.df.mapInArrow(run, "sums array<double>").collect()
        return np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(1)

    model = climb(summed)
    graphs.drop()
    return model


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])
FIELDS = T.StructType([
    T.StructField("pii_spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType()),
    ]))),
])


def find_spans(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """Add pii_spans: base and added spans by start and kind, code points, end exclusive."""

    def compute(part: pa.RecordBatch) -> list:
        out = []
        for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
            base, more = find(text, model) if text else ([], [])
            every = sorted([(*s, False) for s in base] + [(*s, True) for s in more], key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([{"kind": k, "start": a, "end": b, "added": n} for k, a, b, n in every])
        return [pa.array(out, pa.list_(SPAN))]

    return common.append_columns(docs, text_col, FIELDS, compute)


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span of pii_spans by its kind in brackets; overlapping spans are replaced as one."""

    @F.pandas_udf("string")
    def cover(text, spans):
        import pandas as pd

        out = []
        for t, row in zip(text, spans):
            if t is None or not len(row):
                out.append(t)
                continue
            parts, at = [], 0
            for s in row:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = s["end"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return found.withColumn(text_col, F.when(F.size("pii_spans") > 0, cover(text_col, "pii_spans")).otherwise(F.col(text_col)))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    base = F.filter("pii_spans", lambda s: ~s["added"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: (s["kind"] == kind) & ~s["added"])).cast("long").alias(f"n_{kind}")
    spans = F.col("pii_spans")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"), F.size(F.filter(spans, lambda s: s["added"])).cast("long").alias("n_added"),
    )
