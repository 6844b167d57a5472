"""Language-model scoring by deleted interpolation.

A trigram model over words. The maximum-likelihood trigram, bigram and unigram and a uniform
share for unseen words are mixed from the lowest order up:

    p1 = w1 * c(t) / N + (1 - w1) / (V + 1)
    p2 = w2[b] * c(s t) / c(s) + (1 - w2[b]) * p1         b: bucket of the context's count c(s)
    p3 = w3[b] * c(r s t) / c(r s) + (1 - w3[b]) * p2     b: bucket of the context's count c(r s)

The empty context of the unigram has one frequency, N, and so one weight. All weights are
learned by expectation-maximisation on held-out counts: every training token in turn is
deleted from the counts that predict it (leave one out), so no data is set aside. A
document's first word follows an end token, and has no trigram.

Counts are exact and distributed. Documents are dealt into groups of bounded size and written
once, bucketed by group, so that texts are shuffled a single time. A group asks once for each
distinct n-gram in it: sorted 64-bit keys travel to the owners of key ranges, packed in binary
rows, with the group's own training counts. Owners add the counts up and answer in the same
order. A key thus crosses the network once per group and not once per occurrence, frequent
words are summed before the shuffle, key ranges are even whatever the words, and no table of
counts is ever held whole. A group sends rows only to owners that it has keys for, so there are
never more rows than distinct keys, and at usual sizes each row holds thousands of them.
Trigrams travel in a pass of their own, after the files of the first are gone. The groups keep
three counts a token; learning and scoring then only scan. Only mixture statistics (at most
buckets x bins numbers) reach the driver.

Cases: null text is empty and holds only the end token; a null id counts as training text;
repeated rows count and are returned each; very long texts are read whole; an empty table
gives no rows; without training tokens every probability is the uniform one. Ids may be of any
type. Keys are 64-bit hashes: of n distinct n-grams, about n / 2^64 of the others share a given one's key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
GROUP_BYTES, OWNER_BYTES = 6 << 20, 8 << 20
BINS, STEP, BUCKETS = 400, 0.25, 96


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by the end token, and the token count of each text."""
    parts, sizes = [], np.empty(len(texts), np.int64)
    end = np.array([END])
    for i, raw in enumerate(texts):
        words = raw.lower().split()
        sizes[i] = len(words) + 1
        parts += [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), end]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each token, and whether there is one."""
    there = np.ones(len(tokens), bool)
    if order == 1 or not len(tokens):
        return tokens, there
    before = np.concatenate(([END], tokens[:-1]))
    keys = common.mix64(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
    if order == 3:
        there[np.cumsum(sizes) - sizes] = False
        keys = common.mix64(np.concatenate(([END], keys[:-1])) * np.uint64(0xD6E8FEB86659FD93) + tokens)
    return keys, there


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as one byte each; larger ones follow in eight bytes."""
    small = np.minimum(c, 255).astype(np.uint8)
    return small.tobytes() + c[c >= 255].astype(np.int64).tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, -1, n)
    return out


def _limits(owners: int) -> np.ndarray:
    """First key of each owner's range, in the order of owners."""
    return np.array([(i << 64) // owners for i in range(owners)], np.uint64)


def _raw(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return [b"" if x is None else x for x in table["raw"].to_pylist()], ~np.array(table["held"].to_pylist(), bool)


def _requests(docs: DataFrame, owners: int, orders: tuple[int, ...]) -> DataFrame:
    schema = pa.schema([("owner", pa.int64()), ("g", pa.int64()), ("kind", pa.int8()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(table: pa.Table) -> pa.Table:
        texts, train = _raw(table)
        tokens, sizes = encode(texts)
        weight = np.repeat(train, sizes)
        g = table["g"][0].as_py()
        rows = []
        for order in orders:
            every, there = grams(tokens, sizes, order)
            keys, index = np.unique(every[there], return_inverse=True)
            counts = np.bincount(index, weights=weight[there], minlength=len(keys)).astype(np.int64)
            cut = np.concatenate((np.searchsorted(keys, _limits(owners)), [len(keys)]))
            for o in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                a, b = cut[o], cut[o + 1]
                rows.append((o, g, order, b - a, keys[a:b].tobytes(), pack_counts(counts[a:b])))
        return pa.table(list(map(list, zip(*rows))) if rows else [[]] * 6, schema=schema)

    return docs.groupBy("g").applyInArrow(ask, "owner long, g long, kind byte, n int, keys binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """Answers (g >= 0) in the order of the request, and one row of unigram statistics per owner (g = -1)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("g", pa.int64()), ("owner", pa.int64()), ("kind", pa.int8()), ("n", pa.int32()), ("counts", pa.binary()), ("types", longs), ("values", longs)])

    def answer(table: pa.Table) -> pa.Table:
        owner = table["owner"][0].as_py()
        g, kind, n = (table[c].to_numpy() for c in ("g", "kind", "n"))
        out = []
        for what in np.unique(kind):
            rows = np.flatnonzero(kind == what)
            keys = np.concatenate([np.frombuffer(table["keys"][int(i)].as_py(), np.uint64) for i in rows])
            counts = np.concatenate([unpack_counts(table["counts"][int(i)].as_py(), n[i]) for i in rows])
            _, index = np.unique(keys, return_inverse=True)
            total = np.bincount(index, weights=counts).astype(np.int64)
            mine, at = total[index], 0
            for i in rows:
                out.append((g[i], owner, what, n[i], pack_counts(mine[at : at + n[i]]), None, None))
                at += n[i]
            if what == 1:
                values, types = np.unique(total[total > 0], return_counts=True)
                out.append((-1, owner, 0, len(values), None, types.tolist(), values.tolist()))
        return pa.table(list(map(list, zip(*out))), schema=schema)

    return asked.groupBy("owner").applyInArrow(answer, "g long, owner long, kind byte, n int, counts binary, types array<long>, values array<long>")


def _per_token(docs: DataFrame, answers: DataFrame, id_type: T.DataType) -> DataFrame:
    """(id, held, n, c1, c2, c3): of each document, the packed counts of the n-grams that end at its tokens."""

    def deal(key, table: pa.Table, got: pa.Table) -> pa.Table:
        texts, _ = _raw(table)
        tokens, sizes = encode(texts)
        kind, owner, n = (got[c].to_numpy() for c in ("kind", "owner", "n"))
        cuts, cols = np.cumsum(sizes)[:-1], []
        for order in (1, 2, 3):
            every, there = grams(tokens, sizes, order)
            keys, index = np.unique(every[there], return_inverse=True)
            rows = np.flatnonzero(kind == order)
            rows = rows[np.argsort(owner[rows])]
            counts = np.zeros(len(tokens), np.int64)
            if len(rows):
                counts[there] = np.concatenate([unpack_counts(got["counts"][int(i)].as_py(), n[i]) for i in rows])[index]
            cols.append(pa.array([pack_counts(c) for c in np.split(counts, cuts)] if len(sizes) else [], pa.binary()))
        return pa.table([table["id"], table["held"], pa.array(sizes), *cols], names=["id", "held", "n", "c1", "c2", "c3"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("held", T.BooleanType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("c1", "c2", "c3"))])
    return docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(deal, schema)


# -- the mixture ---------------------------------------------------------------------------


def mix_weight(ratio: np.ndarray, count: np.ndarray, start: float = 0.5, rounds: int = 300) -> float:
    """EM for p = w * ratio + (1 - w) on a weighted sample of ratios."""
    total, w = count.sum(), start
    if not total:
        return 0.0
    for _ in range(rounds):
        w = float((count * (w * ratio / (w * ratio + 1 - w))).sum() / total)
        w = min(max(w, 1e-6), 1 - 1e-6)
    return w


def bucket_of(c: np.ndarray) -> np.ndarray:
    """Buckets of a context's count, two for each power of two."""
    return np.minimum(np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.int64), BUCKETS - 1)


@dataclass
class Mixture:
    """Training tokens, their distinct words, and the weight of each order; of bigrams and trigrams by bucket."""

    total: int = 0
    distinct: int = 0
    one: float = 0.0
    two: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    three: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))

    def unigram(self, c1: np.ndarray, gone: int = 0) -> np.ndarray:
        return self.one * (c1 - gone) / max(1, self.total - gone) + (1 - self.one) / (self.distinct + 1)

    def raised(self, weights: np.ndarray, low: np.ndarray, c: np.ndarray, context: np.ndarray, gone: int = 0) -> np.ndarray:
        """The next order's probabilities; gone: occurrences deleted from the counts."""
        w = np.where(context > gone, weights[bucket_of(context)], 0.0)
        return w * np.where(context > gone, c - gone, 0) / np.maximum(1, context - gone) + (1 - w) * low

    def probabilities(self, c1, c2, c3, before1, before2) -> np.ndarray:
        return self.raised(self.three, self.raised(self.two, self.unigram(c1), c2, before1), c3, before2)


def _unpacked(part: pa.RecordBatch):
    """(token counts of the documents, c1, c2, c3, count of each token's bigram context, of its trigram context)."""
    sizes = part.column(part.schema.get_field_index("n")).to_numpy()
    cols = []
    for name in ("c1", "c2", "c3"):
        rows = part.column(part.schema.get_field_index(name)).to_pylist()
        cols.append(np.concatenate([unpack_counts(raw, n) for raw, n in zip(rows, sizes)]))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    before1, before2 = (np.concatenate(([0], c[:-1])) for c in cols[:2])
    before1[starts] = cols[0][ends - 1]  # a text ends in the end token, which its first word follows
    before2[starts] = 0
    return (sizes, *cols, before1, before2)


def _learn_order(counted: DataFrame, mixture: Mixture, order: int) -> np.ndarray:
    """Weights by bucket: each training token is predicted from the counts without it."""

    def compute(part: pa.RecordBatch):
        sizes, c1, c2, c3, before1, before2 = _unpacked(part)
        mine = np.repeat(~np.array(part.column(part.schema.get_field_index("held")).to_pylist(), bool), sizes)
        c1, c2, c3, before1, before2 = (x[mine] for x in (c1, c2, c3, before1, before2))
        low, c, context = mixture.unigram(c1, 1), c2, before1
        if order == 3:
            low, c, context = mixture.raised(mixture.two, low, c2, before1, 1), c3, before2
            there = context > 0
            low, c, context = low[there], c[there], context[there]
        high = np.where(context > 1, c - 1, 0) / np.maximum(1, context - 1)
        with np.errstate(divide="ignore"):
            bin_ = np.where(high > 0, np.clip(np.rint(np.log2(high / low) / STEP) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)
        code, index, n = np.unique(bucket_of(context) * BINS + bin_, return_inverse=True, return_counts=True)
        yield {"code": code, "n": n.astype(np.int64), "ratios": np.bincount(index, weights=high / low, minlength=len(code))}

    with common.tidy(counted.sparkSession):
        seen = common.emit_rows(counted, "c1", "code long, n long, ratios double", compute).groupBy("code").agg(F.sum("n").alias("n"), F.sum("ratios").alias("ratios")).collect()
    table, mean = np.zeros((BUCKETS, BINS)), np.zeros((BUCKETS, BINS))
    for r in seen:
        table[divmod(r["code"], BINS)], mean[divmod(r["code"], BINS)] = r["n"], r["ratios"] / r["n"]
    return np.array([mix_weight(*pair) for pair in zip(mean, table)])


def learn(unigrams: DataFrame, counted: DataFrame) -> Mixture:
    """Fit on rows of unigram statistics (types, values) and the counts of every token."""
    # counts above 1024 are met in eighths of a power of two, so that the statistics stay small
    stats = unigrams.select(F.explode(F.arrays_zip("values", "types")).alias("s")).select(F.col("s.values").alias("c"), F.col("s.types").alias("t"))
    binned = F.when(F.col("c") <= 1024, F.col("c")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("c") * 8) / 8)))
    rows = stats.groupBy(binned.alias("b")).agg(F.sum("t").alias("types"), F.sum(F.col("c") * F.col("t")).alias("tokens")).collect()
    out = Mixture(sum(r["tokens"] for r in rows), sum(r["types"] for r in rows))
    if out.total:
        mean = np.array([r["tokens"] / r["types"] for r in rows])
        out.one = mix_weight((mean - 1) / max(1, out.total - 1) * (out.distinct + 1), np.array([float(r["tokens"]) for r in rows]))
        out.two = _learn_order(counted, out, 2)
        out.three = _learn_order(counted, out, 3)
    return out


SCORES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])


def judge(counted: DataFrame, mixture: Mixture) -> DataFrame:
    """Scores of every row of counts."""

    def compute(part: pa.RecordBatch) -> list:
        sizes, c1, *rest = _unpacked(part)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((c1 + 0.1) / (mixture.total + 0.1 * (mixture.distinct + 1)))
        add = lambda x: np.add.reduceat(x, starts)
        return [
            pa.array(sizes), pa.array(add((c1 > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(sizes), mixture.total, np.int64)),
            pa.array(add(base)), pa.array(add(np.log10(mixture.probabilities(c1, *rest)))),
        ]

    return common.append_columns(counted, "c1", SCORES, compute)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> tuple[common.Stage, common.Stage]:
    """(counts of every token of each row, unigram statistics); rows with held_col true teach nothing."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)))).first()[0] or 0
    groups, owners = max(1, math.ceil(size / GROUP_BYTES)), max(1, math.ceil(size / OWNER_BYTES))
    raw = F.col(text_col).cast("binary")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held"), raw.alias("raw"), F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).alias("g"))
    dealt = common.Bucketed(src, "g", groups, "lm-docs")
    answers = [common.Stage(_answers(_requests(dealt.df, owners, orders)), "lm-answers") for orders in ((1, 2), (3,))]
    replies = answers[0].df.unionByName(answers[1].df).filter("g >= 0").select("g", "owner", "kind", "n", "counts")
    counted = common.Stage(_per_token(dealt.df, replies, docs.schema[id_col].dataType), "lm-counts")
    dealt.drop()
    unigrams = common.Stage(answers[0].df.filter("g = -1").select("types", "values"), "lm-unigrams")
    for a in answers:
        a.drop()
    return counted, unigrams


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows with held_col true teach nothing."""
    counted, unigrams = count_tokens(docs, id_col, text_col, held_col)
    mixture = learn(unigrams.df, counted.df)
    unigrams.drop()
    return judge(counted.df, mixture).select(F.col("id").alias(id_col), F.col("held").alias("held_out"), *SCORES.fieldNames())


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", (common.fold_of("doc_id", 10) == 0).alias("held_out"))
    return score(docs)
