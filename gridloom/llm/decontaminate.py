"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised benchmark items build one automaton whose transitions are word numbers; a
document's words are streamed through it, and the longest match ending at each word is
tracked. A word is hit when it lies in an occurrence of ``window`` consecutive item words,
or of a whole item that is shorter than that.

Items are cut into pieces that overlap by a window less a word, and dealt by hash into shards of about
``shard_bytes`` of text. Each shard's automaton is built in a task and packed into arrays: at
most two states and three transitions a word, 68 bytes a word in all, besides its distinct
words. A packed shard is broadcast (its size is counted first), and documents are matched against it in
numpy, many stretches side by side; a stretch starts a window less a word early, which is
all that hits depend on. Benchmarks beyond one shard make several passes; each is written
before the next and merges its hit runs by document.

Cases: null and empty texts have no words and no hits; items without words are ignored;
repeated items count by distinct item_id; an empty benchmark leaves everything clean;
very long texts are streamed whole. Columns named like the outputs give way.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, words in items:
            if words:
                seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((name, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self._mark(coded)

    def _clone(self, p: int, q: int, c: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, q, c)
        return cur

    def _mark(self, coded) -> None:
        """Items by the state of each whole window, and the states of whole short items."""
        w = self.window
        self.items_at: dict[int, set[str]] = {}
        self.shorts_at: dict[int, dict[int, set[str]]] = {}
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.next)
        for v in order[1:]:
            up = self.link[v]
            self.window_state[v] = self.window_state[up] if self.length[up] >= w else v if self.length[v] >= w else -1
        for name, seq in coded:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i >= w - 1:
                    self.items_at.setdefault(self.window_state[v], set()).add(name)
            if len(seq) < w:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                self.shorts_at.setdefault(v, {}).setdefault(len(seq), set()).add(name)
        # nearest state on the link path, itself included, that ends a short item
        self.short_state = [-1] * len(self.next)
        for v in order[1:]:
            self.short_state[v] = v if v in self.shorts_at else self.short_state[self.link[v]]

    def pack(self) -> "Packed":
        states = np.repeat(np.arange(len(self.next)), [len(t) for t in self.next])
        symbols = np.fromiter(itertools.chain.from_iterable(self.next), np.int64, len(states))
        to = np.fromiter(itertools.chain.from_iterable(t.values() for t in self.next), np.int32, len(states))
        keys = states * max(1, len(self.vocab)) + symbols
        order = np.argsort(keys)
        names = sorted(set().union(*self.items_at.values(), *(n for s in self.shorts_at.values() for n in s.values())))
        number = {n: i for i, n in enumerate(names)}
        listed = [(v, number[n]) for v, found in self.items_at.items() for n in found]
        shorts = {v: [(m, [number[n] for n in found]) for m, found in s.items()] for v, s in self.shorts_at.items()}
        as_int = lambda x: np.array(x, np.int32)
        return Packed(self.window, list(self.vocab), names, keys[order], to[order], as_int(self.link), as_int(self.length), as_int(self.window_state), as_int(self.short_state), np.array(sorted(listed), np.int64).reshape(-1, 2), shorts)


#: Words of a stretch that is matched beside others.
STRETCH = 256


class Packed:
    """A generalised suffix automaton in arrays, matched against many documents at once."""

    def __init__(self, window, words, names, keys, to, link, length, window_state, short_state, listed, shorts):
        self.window, self.words, self.names, self.keys, self.to = window, words, names, keys, to
        self.link, self.length, self.window_state, self.short_state, self.listed, self.shorts = link, length, window_state, short_state, listed, shorts
        self.vocab: dict[bytes, int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "vocab": None}

    def _walk(self, ids: np.ndarray, begin: np.ndarray, own: np.ndarray, end: np.ndarray):
        """(position, state, length) after each word of the stretches [own, end), read from begin, that may end a hit."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, own, size = begin[order], own[order], size[order]
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        wide = max(1, len(self.words))
        out = []
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, side="left"))
            c, v, l = ids[begin[:k] + t], state[:k], length[:k]
            v[c < 0] = 0
            l[c < 0] = 0
            left = np.flatnonzero(c >= 0)
            while left.size:
                key = v[left] * wide + c[left]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                done = left[there]
                v[done] = self.to[at[there]]
                l[done] += 1
                left = left[~there]
                root = v[left] == 0
                l[left[root]] = 0
                left = left[~root]
                v[left] = self.link[v[left]]
                l[left] = self.length[v[left]]
            hit = np.flatnonzero(((l >= self.window) | (self.short_state[v] > 0)) & (begin[:k] + t >= own[:k]))
            if hit.size:
                out.append((begin[hit] + t, v[hit].copy(), l[hit].copy()))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def match(self, docs: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
        """Of each document, the hit word runs [start, end) in order, and the items whose windows occur."""
        if self.vocab is None:
            self.vocab = {w: i for i, w in enumerate(self.words)}
        sizes = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1  # a gap after each document keeps them apart
        ids = np.full(int((sizes + 1).sum()), -1, np.int64)
        inside = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids[inside] = np.fromiter(map(self.vocab.get, itertools.chain.from_iterable(docs), itertools.repeat(-1)), np.int64, int(sizes.sum()))
        count = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(docs)), count)
        own = first[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
        pos, state, length = self._walk(ids, np.maximum(first[doc], own - self.window + 1), own, np.minimum(first[doc] + sizes[doc], own + STRETCH))
        change, found = np.zeros(len(ids) + 1, np.int64), [set() for _ in docs]
        whole = length >= self.window
        change[pos[whole] - self.window + 1] += 1
        change[pos[whole] + 1] -= 1
        where = np.searchsorted(first, pos, side="right") - 1
        for d, s in np.unique(np.stack((where[whole], self.window_state[state[whole]])), axis=1).T.tolist():
            a, b = np.searchsorted(self.listed[:, 0], [s, s + 1])
            found[d].update(self.names[i] for i in self.listed[a:b, 1])
        if self.shorts:
            for p, s, l, d in zip(pos.tolist(), self.short_state[state].tolist(), length.tolist(), where.tolist()):
                while s > 0:
                    for m, names in self.shorts[s]:
                        if m <= l:
                            found[d].update(self.names[i] for i in names)
                            change[p + 1 - m] += 1
                            change[p + 1] -= 1
                    up = self.link[s]
                    s = self.short_state[up] if up > 0 else -1
        edge = np.diff(np.concatenate(([0], (np.cumsum(change) > 0).astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        runs: list[list[list[int]]] = [[] for _ in docs]
        for d, a, b in zip((np.searchsorted(first, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
            runs[d].append([a - int(first[d]), b - int(first[d])])
        return list(zip(runs, found))


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_bytes: int) -> tuple[common.Stage, int]:
    """(shard, packed automaton) of the items, one row a shard, and the number of shards."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("raw")).filter("name is not null and raw is not null")
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    piece = max(window, shard_bytes // 64)  # words; a small part of a shard

    def cut(batch: pa.RecordBatch):
        out = {"name": [], "at": [], "raw": []}
        for name, raw in zip(batch.column(0).to_pylist(), common.raw_texts(batch, "raw")):
            words = words_of(raw)
            for a in range(0, len(words), piece):
                part = words[a : a + piece + window - 1]
                if not a or len(part) >= window:
                    for key, value in zip(out, (name, a, b" ".join(part))):
                        out[key].append(value)
        yield {"name": pa.array(out["name"], pa.string()), "at": pa.array(out["at"], pa.int64()), "raw": pa.array(out["raw"], pa.binary())}

    def build(table: pa.Table) -> pa.Table:
        items = sorted(zip(table["name"].to_pylist(), table["raw"].to_pylist()))
        packed = Automaton([(name, raw.split()) for name, raw in items], window).pack()
        return pa.table({"shard": table["shard"][:1].cast(pa.int64()), "packed": pa.array([pickle.dumps(packed, protocol=5)], pa.binary())})

    pieces = common.emit_rows(rows, "raw", "name string, at long, raw binary", cut).withColumn("shard", F.pmod(F.xxhash64("name", "at"), F.lit(shards)))
    return common.Stage(pieces.groupBy("shard").applyInArrow(build, "shard long, packed binary"), "automata"), shards


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


def _merge_runs(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _pass(docs: DataFrame, shared, text_col: str, more: bool) -> DataFrame:
    """Hits of one automaton; with more, joined with those of the columns _runs and _items, which go."""

    def compute(part: pa.RecordBatch) -> list:
        words = [words_of(raw) for raw in common.raw_texts(part, text_col)]
        runs, items = map(list, zip(*shared.value.match(words)))
        if more:
            before = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_runs", "_items")]
            runs = [_merge_runs(r + [list(x) for x in old]) for r, old in zip(runs, before[0])]
            items = [found.union(old) for found, old in zip(items, before[1])]
        return [pa.array([len(w) for w in words], pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    out = common.append_columns(docs, text_col, FIELDS, compute)
    return out.drop("_runs", "_items") if more else out


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = 4 << 20) -> DataFrame:
    """Add n_words, hit_runs (word ranges, end exclusive) and hit_items (sorted as strings)."""
    spark = docs.sparkSession
    built, shards = _shards(benchmark, item_col, item_text, window, shard_bytes)
    out, held = docs, None
    for shard in range(shards):
        row = built.df.filter(F.col("shard") == shard).select("packed").first()
        shared = spark.sparkContext.broadcast(pickle.loads(row["packed"]) if row else Automaton([], window).pack())
        before = out.withColumnsRenamed({"hit_runs": "_runs", "hit_items": "_items"}).drop("n_words") if shard else out
        found = _pass(before, shared, text_col, bool(shard))
        if shards == 1:
            out = found
            break
        after = common.Stage(found, "hits")
        shared.unpersist()
        if held is not None:
            held.drop()
        out, held = after.df, after
    built.drop()
    return out


def _spans(raw: bytes, runs) -> list[tuple[int, int]]:
    """Byte ranges of word runs; a run reaches from its first word's start to its last word's end."""
    flat = np.frombuffer(raw.translate(_KEEP), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(first[a]), int(last[b - 1])) for a, b in runs]


def remove_hits(hits: DataFrame, text_col: str = "text", min_span: int = 3, max_coverage: float = 0.5) -> DataFrame:
    """Cut hit runs of at least min_span words out of the texts; rows hit beyond max_coverage of their words go.

    Runs shorter than min_span (whole items of one or two words) stay in the text unless
    coverage drops the row.
    """

    kept = hits.withColumn("_hit", F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])).filter(F.col("_hit") <= max_coverage * F.col("n_words")).drop("_hit")

    @F.pandas_udf("string")
    def cut(text, runs):
        import pandas as pd

        out = []
        for t, r in zip(text, runs):
            wanted = [x for x in r if x[1] - x[0] >= min_span] if t is not None else []
            if not wanted:
                out.append(t)
                continue
            raw, at, parts = t.encode(), 0, []
            for a, b in _spans(raw, wanted):
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return kept.withColumn(text_col, F.when(F.size("hit_runs") > 0, cut(text_col, "hit_runs")).otherwise(F.col(text_col)))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
m as (select doc_id, i, dw.k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from m)) group by 1),
t as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) s from (select distinct doc_id, cast(item_id as varchar) x from m) group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
