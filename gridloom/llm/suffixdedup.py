"""Removal of repeated byte strings by a hash-compared sparse suffix sort.

A byte goes if a string of ``span`` bytes that covers it also starts earlier, in a document
with a smaller id or earlier in the same one. Strings are judged on the input.

Anchors. Not every suffix is sorted: a suffix starts at an anchor, a position whose
``gram``-byte hash is the least within some string of ``span`` bytes. Equal strings hold
equal anchors, so every repeat is met at an anchor, and only about 2 / (span - gram + 2) of
the positions are kept. An anchor is sent on as the polynomial hash of its gram and a 128-bit
BLAKE2b digest of its whole context (all strings of ``span`` bytes around it), never as text.

Equal contexts, by hash and confirmed by digest, are settled first: all but the first lose the whole context.
This happens within each batch of documents, so that passages that very many documents
share are merged before the shuffle, and then for all documents, streaming over rows sorted
by hash. Only contexts that differ although their grams agree are fetched as bytes. A string
that leaves the anchor o bytes in holds the core of its half: the gram with what lies right of it up to half the reach
(small o), or with as much left of it (large o). Contexts of a gram that more than ``HOT`` of them
share are therefore dealt by the hashes of their two cores and meet only those that share one; others meet by gram.

Suffix sort. There, the suffixes right of the anchor and the reversed prefixes left of it
are each sorted by a merge sort whose comparisons find the common extension by binary search
over prefix polynomial hashes, a logarithmic number of steps per comparison. The common
extensions of sorted neighbours are verified against the bytes, which corrects any collision.
They give each anchor's class at every depth, and a string is repeated if its two classes
(left depth o, right depth span - o) were met in an earlier place.

Cases: null text is empty; texts shorter than span keep all; matches never cross documents;
a row with a null id keeps all and is nobody's earlier place; repeated rows with one id are
the same place and are returned each; very long texts are hashed in overlapping pieces;
an empty table gives no rows. Columns named like the outputs give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

PIECE = 1 << 20
HOT = 512
_BASE = 0x9E3779B97F4A7C15
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hasher:
    """Prefix polynomial hashes modulo 2^64 over random byte values; odd bases are invertible."""

    def __init__(self):
        self.base = _BASE
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = np.random.default_rng(1000).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out


_hashers: list[_Hasher] = []


def hasher() -> _Hasher:
    if not _hashers:
        _hashers.append(_Hasher())
    return _hashers[0]


def _slide(x: np.ndarray, width: int, best, fill) -> np.ndarray:
    """best over x[i : i + width] for every i, by doubling; positions past the end count as fill."""
    got, have = x, 1
    while have < width:
        step = min(have, width - have)
        got = best(got, np.concatenate((got[step:], np.full(min(step, len(got)), fill, got.dtype))))
        have += step
    return got


def anchors_of(data: np.ndarray, ends: np.ndarray, span: int, gram: int):
    """(positions, gram hash, left reach, right reach) over joined documents; ends: each one's end."""
    one = hasher()
    n = len(data)
    p1 = one.prefix(data)
    starts = np.concatenate(([0], ends[:-1]))
    end_at = np.repeat(ends, ends - starts)
    pos = np.arange(n)
    h = np.full(n, _MAX, np.uint64)
    inside = n - gram + 1
    if inside <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h[:inside] = common.mix64((p1[gram:] - p1[:inside]) * one.down[:inside]) | np.uint64(1)
    width = span - gram + 1
    least = _slide(h, width, np.minimum, _MAX)
    least[pos + span > end_at] = 0
    most = _slide(least[::-1], width, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero(most == h)
    left = np.minimum(span - gram, at - np.repeat(starts, ends - starts)[at])
    right = np.minimum(span, end_at[at] - at)
    return at, h[at], left, right


def digests(blob: bytes, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the contexts, as two columns; the first is never 0."""
    raw = b"".join([blake2b(blob[a:b], digest_size=16).digest() for a, b in zip((at - left).tolist(), (at + right).tolist())])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return common.mix64(both[:, 0] + (left * 256 + right).astype(np.uint64)) | np.uint64(1), both[:, 1]


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    return doc[first], start[first], reach[last] - shift[first]


ROW = "key long, ctx long, more long, doc long, place long"


def _pack(pos, left, right) -> np.ndarray:
    return (pos.astype(np.int64) << 16) | (left.astype(np.int64) << 8) | right.astype(np.int64)


def _anchor_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Anchors with ctx <> 0; settled intervals with ctx = 0 and place = start << 32 | end."""
    margin = 2 * span

    def pieces(ids: np.ndarray, texts: list[bytes]):
        """Groups of (doc, offset, kept from, kept to, bytes) of about PIECE bytes."""
        group, size = [], 0
        for doc, raw in zip(ids, texts):
            if len(raw) < span:
                continue
            for a in range(0, len(raw), PIECE):
                b = min(len(raw), a + PIECE)
                lo, hi = max(0, a - margin), min(len(raw), b + margin)
                group.append((doc, lo, a, b, raw[lo:hi]))
                size += hi - lo
                if size >= PIECE:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def settle(group):
        blob = b"".join(x[4] for x in group)
        sizes = np.array([len(x[4]) for x in group])
        ends = np.cumsum(sizes)
        at, key, left, right = anchors_of(np.frombuffer(blob, np.uint8), ends, span, gram)
        which = np.searchsorted(ends, at, side="right")
        cols = np.array([(x[0], x[1], x[2], x[3]) for x in group], np.int64)
        pos = at - (ends - sizes)[which] + cols[which, 1]
        keep = (pos >= cols[which, 2]) & (pos < cols[which, 3])
        at, key, left, right = at[keep], key[keep], left[keep], right[keep]
        return (cols[which, 0][keep], pos[keep], key, *digests(blob, at, left, right), left, right)

    def compute(part: pa.RecordBatch):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        found = [settle(g) for g in pieces(ids, common.raw_texts(part, "text"))]
        if not found:
            return
        doc, pos, key, ctx, more, left, right = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, doc, more, ctx, key))
        doc, pos, key, ctx, more, left, right = (x[order] for x in (doc, pos, key, ctx, more, left, right))
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])))
        rep = np.flatnonzero(first)[np.cumsum(first) - 1]
        gone = ~first & ((doc != doc[rep]) | (pos != pos[rep]))
        d, s, e = _merge(doc[gone], (pos - left)[gone], (pos + right)[gone])
        none = np.zeros(len(d), np.int64)
        yield {
            "key": np.concatenate((key[first], common.mix64(d.astype(np.uint64)))).view(np.int64),
            "ctx": np.concatenate((ctx[first].view(np.int64), none)), "more": np.concatenate((more[first].view(np.int64), none)),
            "doc": np.concatenate((doc[first], d)), "place": np.concatenate((_pack(pos, left, right)[first], s << 32 | e)),
        }

    return common.emit_rows(docs.filter("id is not null and text is not null").select("id", "text"), "text", ROW, compute)


def _settle_contexts(rows: DataFrame) -> DataFrame:
    """Rows sorted by (key, ctx, more, doc, place) to intervals (kind 0: doc, a = start, b = end) and
    contexts to be fetched (kind 1: key, doc, a = place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, context, doc and position of the current first place, contexts so far, pending row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ctx, more, doc, place = (batch.column(i).to_numpy() for i in range(5))
            passed = ctx == 0
            out = [(np.zeros(passed.sum(), np.int64), doc[passed], place[passed] >> 32, place[passed] & 0xFFFFFFFF, 0)]
            key, ctx, more, doc, place = (x[~passed] for x in (key, ctx, more, doc, place))
            if len(key):
                go_on = last is not None and key[0] == last[0]
                new_key = np.concatenate(([not go_on], key[1:] != key[:-1]))
                new_ctx = new_key | np.concatenate(([not (go_on and (ctx[0], more[0]) == last[1])], (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])))
                reps = np.flatnonzero(new_ctx)
                owner = np.cumsum(new_ctx) - 1
                pos = place >> 16
                rep_doc, rep_pos = np.full(len(key), last[2] if last else 0), np.full(len(key), last[3] if last else 0)
                own = owner >= 0
                rep_doc[own], rep_pos[own] = doc[reps[owner[own]]], pos[reps[owner[own]]]
                gone = ~new_ctx & ((doc != rep_doc) | (pos != rep_pos))
                left, right = (place >> 8) & 255, place & 255
                out.append((np.zeros(gone.sum(), np.int64), doc[gone], (pos - left)[gone], (pos + right)[gone], 0))
                seg = np.cumsum(new_key) - int(new_key[0])
                count = np.bincount(seg[reps], minlength=seg[-1] + 1)
                pending = None
                if go_on:
                    count[0] += last[4]
                    pending = last[5]
                    if pending is not None and count[0] > 1:
                        out.append(([pending[0]], [pending[1]], [pending[2]], [0], 1))
                        pending = None
                need = reps[count[seg[reps]] > 1]
                out.append((key[need], doc[need], place[need], np.zeros(len(need), np.int64), 1))
                if count[-1] == 1 and len(reps) and seg[reps[-1]] == seg[-1]:
                    pending = (key[reps[-1]], doc[reps[-1]], place[reps[-1]])
                elif seg[-1] > 0:
                    pending = None
                last = (key[-1], (ctx[-1], more[-1]), rep_doc[-1], rep_pos[-1], count[-1], pending)
            cols = [np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in range(4)]
            kind = np.concatenate([np.full(len(o[0]), o[4], np.int8) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], names=["kind", "key", "doc", "a", "b"])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "ctx", "more", "doc", "place").mapInArrow(run, "kind byte, key long, doc long, a long, b long")


# -- the suffix sort -----------------------------------------------------------------------


class HashSuffixes:
    """Strings of bounded length with prefix hashes; compared by binary search for their common extension."""

    def __init__(self, strings: np.ndarray, length: np.ndarray, group: np.ndarray | None = None):
        """strings: one row of bytes each; length: bytes in use; group: numbers of what is sorted apart, smaller ones first."""
        self.bytes, self.length = strings, length
        self.group = np.zeros(len(length), np.int64) if group is None else group
        n, width = strings.shape
        h = hasher()
        h.powers(width)
        beyond = np.arange(width) >= length[:, None]
        terms = np.where(beyond, np.uint64(0), h.values[strings] * h.up[:width])
        self.prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(terms, axis=1, out=self.prefix[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix by hashes, in a logarithmic number of steps."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j; shorter ones first, smaller groups before all."""
        out = self.group[i] < self.group[j]
        alike = np.flatnonzero(self.group[i] == self.group[j])
        i, j = i[alike], j[alike]
        at = self.common(i, j)
        a_end, b_end = at >= self.length[i], at >= self.length[j]
        width = self.bytes.shape[1] - 1
        a, b = self.bytes[i, np.minimum(at, width)], self.bytes[j, np.minimum(at, width)]
        out[alike] = np.where(a_end, ~b_end, ~b_end & (a < b))
        return out

    def sort(self) -> np.ndarray:
        """Stable bottom-up merge sort; the merges of one width are made side by side."""
        n = len(self.length)
        order, width = np.argsort(self.group, kind="stable"), 1
        while width < n:
            index = np.arange(n)
            base = index // (2 * width) * (2 * width)
            mid, stop = np.minimum(base + width, n), np.minimum(base + 2 * width, n)
            mine = index < mid
            lo, hi = np.where(mine, mid, base), np.where(mine, stop, mid)
            start = lo.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                probe = (lo[open_] + hi[open_]) >> 1
                me, it = order[open_], order[probe]
                # a left element goes before equal right ones, a right element after equal left ones
                before = np.where(mine[open_], self.less(it, me), ~self.less(me, it))
                lo[open_] = np.where(before, probe + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], probe)
            place = np.where(mine, index, base + index - mid) + (lo - start)
            merged = np.empty(n, order.dtype)
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each sorted string with the one before it in its group, verified on the bytes."""
        out = np.zeros(len(order), np.int64)
        if len(order) > 1:
            i, j = order[:-1], order[1:]
            alike = np.flatnonzero(self.group[i] == self.group[j])
            i, j = i[alike], j[alike]
            got = self.common(i, j)
            differ = (self.bytes[i] != self.bytes[j]) & (np.arange(self.bytes.shape[1]) < got[:, None])
            out[1 + alike] = np.where(differ.any(1), differ.argmax(1), got)
        return out

    def classes(self):
        """order and neighbour extensions; class_at(depth) numbers equal prefixes of that depth."""
        order = self.sort()
        ext = self.neighbours(order)
        fresh = np.concatenate(([True], self.group[order][1:] != self.group[order][:-1]))[: len(order)]

        def class_at(depth: int) -> np.ndarray:
            out = np.empty(len(order), np.int64)
            out[order] = np.cumsum((ext < depth) | fresh)
            return out

        return class_at


def halves(span: int, gram: int) -> list[tuple[int, int]]:
    """Least and greatest offset o of the two halves."""
    reach = span - gram
    return [(0, reach // 2), (reach // 2 + 1, reach)] if reach else [(0, 0)]


def core_hash(raw: bytes, left: int, low: int, high: int, span: int) -> int | None:
    """Hash of the bytes that all strings with offsets from low to high share; None if the context has none of them."""
    if left < low or len(raw) - left < span - high:
        return None
    return int.from_bytes(blake2b(raw[left - low : left + span - high], digest_size=8, salt=b"%d" % low).digest(), "little", signed=True)


def repeated(contexts: list[bytes], left: np.ndarray, span: int, gram: int, half: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in order of their place: least and greatest left offset of a repeated string, -1 if none.

    left: bytes of each context before its anchor; half: the half whose offsets count for it, -1 or None for all;
    group: contexts of different groups share no string.
    """
    n, reach = len(contexts), span - gram
    size = np.array([len(c) for c in contexts])
    starts = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(contexts) + b"\0" * (2 * span), np.uint8)
    right = size - left
    anchor = starts + left
    forward = HashSuffixes(flat[np.minimum(anchor[:, None] + np.arange(span), len(flat) - 1)], right, group)
    backward = HashSuffixes(flat[np.maximum(anchor[:, None] - 1 - np.arange(max(1, reach)), 0)], left, group)
    class_right, class_left = forward.classes(), backward.classes()
    low, high = np.full(n, -1), np.full(n, -1)
    for o in range(reach + 1):
        mine = True if half is None else (half < 0) | (half == [a <= o <= b for a, b in halves(span, gram)].index(True))
        fit = np.flatnonzero((left >= o) & (right >= span - o) & mine)
        if len(fit) < 2:
            continue
        both = class_left(o)[fit] * (n + 1) + class_right(span - o)[fit]
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(fit), bool)
        again[order[1:]] = both[order[1:]] == both[order[:-1]]
        hit = fit[again]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def _solve(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """(core, half, doc, pos, left, ctx bytes) to intervals (doc, a, b); a core's contexts are kept together, about 20,000 at once."""

    def run(batches):
        held = []

        def out():
            core, half, doc, pos, left, ctx = zip(*held)
            core, half, doc, pos, left = map(np.array, (core, half, doc, pos, left))
            order = np.lexsort((pos, doc, half, core))
            alike = [c[order] for c in (core, half, doc, pos)]  # rows that share an id are one place
            order = order[np.concatenate(([True], np.any([c[1:] != c[:-1] for c in alike], axis=0)))]
            _, which, size = np.unique(core[order], return_inverse=True, return_counts=True)
            which_of = np.zeros(len(core), np.int64)
            which_of[order] = which
            order = order[size[which] > 1]  # a context alone with its core holds no repeat
            order = order[np.lexsort((pos[order], doc[order]))]
            if not len(order):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc", "a", "b"])
            doc, pos, left, half, which = doc[order], pos[order], left[order], half[order], which_of[order]
            low, high = repeated([ctx[i] for i in order], left, span, gram, half, which)
            hit = low >= 0
            d, s, e = _merge(doc[hit], (pos - high)[hit], (pos - low + span)[hit])
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["doc", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= 20000 and row[0] != held[-1][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(run, "doc long, a long, b long")


def _fetch(wanted: DataFrame, docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Context bytes of wanted places (key, doc, place): once by key, or for a hot key once for each half whose strings they may hold."""
    hot = common.Stage(wanted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col("key").alias("hot")), "hot")
    lists = wanted.join(hot.df, F.col("key") == F.col("hot"), "left").groupBy("doc").agg(F.collect_list(F.struct("key", "place", F.col("hot").isNotNull().alias("split"))).alias("places"))
    both = docs.join(lists, docs.id == lists.doc).select("id", "text", "places")
    parts = halves(span, gram)

    def compute(part: pa.RecordBatch):
        cols = [[], [], [], [], [], []]
        found = part.column(2)
        keys, places, split = (found.flatten().field(i).to_pylist() for i in range(3))
        counts = np.diff(found.offsets.to_numpy()).tolist()
        at = 0
        for doc, raw, count in zip(part.column(0).to_pylist(), common.raw_texts(part, "text"), counts):
            for key, place, hot in zip(keys[at : at + count], places[at : at + count], split[at : at + count]):
                pos, left, right = place >> 16, (place >> 8) & 255, place & 255
                ctx = raw[pos - left : pos + right]
                for core, half in [(core_hash(ctx, left, *ends, span), half) for half, ends in enumerate(parts)] if hot else [(key, -1)]:
                    if core is not None:
                        for col, value in zip(cols, (core, half, doc, pos, left, ctx)):
                            col.append(value)
            at += count
        yield dict(zip(("core", "half", "doc", "pos", "left", "ctx"), [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))]))

    return common.emit_rows(both, "text", "core long, half int, doc long, pos long, left int, ctx binary", compute)


def repeats(docs: DataFrame, span: int = 100, gram: int = 32) -> DataFrame:
    """Removable byte intervals (doc, a, b) of (id, text); they may overlap."""
    if not 1 <= gram < span <= 255:
        raise ValueError("1 <= gram < span <= 255")
    spark = docs.sparkSession
    settled = common.Stage(_settle_contexts(_anchor_rows(docs, span, gram)), "settled")
    wanted = settled.df.filter("kind = 1").select("key", "doc", F.col("a").alias("place"))
    solved = common.Stage(_solve(_fetch(wanted, docs, span, gram), span, gram), "solved")
    return settled.df.filter("kind = 0").select("doc", "a", "b").unionByName(solved.df)


FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("removed_runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_bytes", T.BinaryType()),
])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100, gram: int = 32) -> DataFrame:
    """Add n_bytes, removed_runs (maximal, byte offsets) and kept_bytes to every row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = repeats(src, span, gram).groupBy("doc").agg(F.collect_list(F.array("a", "b")).alias("_runs"))
    both = docs.join(found, docs[id_col] == found.doc, "left").drop("doc")

    def compute(part: pa.RecordBatch) -> list:
        sizes, runs, kept = [], [], []
        lists = part.column(part.schema.get_field_index("_runs")).to_pylist()
        for raw, spans in zip(common.raw_texts(part, text_col), lists):
            sizes.append(len(raw))
            mine = []
            for a, b in sorted((x[0], min(x[1], len(raw))) for x in spans or ()):
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], b)
                elif a < b:
                    mine.append([a, b])
            at, left = 0, []
            for a, b in mine:
                left.append(raw[at:a])
                at = b
            runs.append(mine)
            kept.append(b"".join([*left, raw[at:]]) if mine else raw)
        return [pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]

    return common.append_columns(both, text_col, FIELDS, compute).drop("_runs")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_runs").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
