"""Near-duplicate documents: SuperMinHash signatures, banding, verification and union-find.

Signatures: every shingle draws, level by level, a slot from its own random permutation and
the value level + fraction; a slot keeps its least value. All shingles of a document take
level j before any takes level j + 1, so a document stops as soon as its slots are full -
values of later levels cannot win. Ranks within an element are thus correlated as SuperMinHash
demands, and long documents finish after one level.

Documents with one word sequence (a 128-bit cryptographic digest) are one class from the start;
what follows works on one head a class. Classes that share a band are compared against pivots of that
band's bucket, first one pivot, then sixteen times as many in each round, drawn from small
components first. Pairs already in one component are skipped, compared pivots leave the bucket,
and rounds end when every bucket lies in one component or all its pairs are compared.

A parity sketch decides which pairs are looked at: bit i says whether an odd number of the
set's shingles hash to i. Each bit in which two sketches differ stands for a shingle that only
one set holds, so a pair with (100 + p) * bits > (100 - p) * (a + b) cannot share p percent of
its union. The bound is exact and never drops a link. Sketches hold two to four bits a shingle, hence
copies of one text with different edits, which share bands but are no links, fall out before any
text is read, and a group of near copies yields pairs in proportion to its links. Pivots are the
least of each salted part of a bucket, so that no task ranks or holds a bucket. Every pair that
is left is confirmed on the full shingle sets of both texts.

Cases: null or empty text has no shingles and stands alone; a text with fewer words than a
shingle is one shingle; a row with a null id stands alone with a null component; repeated
rows are returned each; rows with one id and different texts act as one node; very long
texts are read whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

_GOLD = 0x9E3779B97F4A7C15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a word sequence's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    acc = np.full(n, 0x51ED270B153A4D2F + k * (k < size), np.uint64)
    for i in range(k):
        acc = common.mix64(acc * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n])
    return np.unique(acc)


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (documents x slots) of sets of hashes; an empty set keeps full slots."""
    sig = np.full((len(sets), slots), _FULL, np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 120_000):
            size += len(sets[end])
            end += 1
        if size:
            _sign(sets[at:end], sig[at:end], slots)
        at = end
    return sig


def _sign(sets: list[np.ndarray], sig: np.ndarray, slots: int) -> None:
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    kind = np.uint8 if slots <= 256 else np.uint16
    perm = None
    for level in range(slots):
        draw = common.mix64(h + np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        k = level + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(level << 32) | (draw >> np.uint64(32))
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, level]
        np.minimum.at(flat, doc * slots + slot, value)
        open_docs = (sig == _FULL).any(1)
        open_docs[[len(s) == 0 for s in sets]] = False
        alive = open_docs[doc]
        if not alive.any():
            return
        h, doc = h[alive], doc[alive]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=kind), (len(h), 1))
            perm[np.arange(len(h)), k[alive]] = 0
        else:
            perm = perm[alive]


def rows_for(threshold: float, bands: int, miss: float = 1e-4) -> int:
    """Most rows a band may have so that a pair at the threshold shares no band with at most this chance."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of hashes fall on it; a power of two of words, two to four bits a hash."""
    bits = 64 << max(2, (len(hashes) // 32).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, text_key, bands, sketch) of (id, text): set size, digest of the word sequence, band keys, parity sketch."""
    slots = bands * rows

    def compute(part: pa.RecordBatch):
        words = [raw.lower().split() for raw in common.raw_texts(part, "text")]
        sets = [shingle_hashes(w, shingle) for w in words]
        sig = superminhash(sets, slots).reshape(len(sets), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), (len(sets), bands)).copy()
        for r in range(rows):
            key = common.mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
        sketches = [parity_sketch(s) for s in sets]
        ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
        yield {
            "id": part.column(0), "n": pa.array([len(s) for s in sets], pa.int64()),
            "text_key": pa.array([blake2b(b" ".join(w), digest_size=16).digest() for w in words], pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64))),
            "sketch": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches))),
        }

    return common.emit_rows(docs.select("id", "text"), "text", "id long, n long, text_key binary, bands array<long>, sketch array<long>", compute)


def _folded(sketch: Column) -> Column:
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _can_link(percent: int) -> Column:
    """Whether (n, sketch) and (pn, psketch) may reach the threshold; sketches of other sizes than equal or double count as equal."""
    mine, other = F.col("sketch"), F.col("psketch")
    x = F.when(F.size(mine) > F.size(other), _folded(mine)).otherwise(mine)
    y = F.when(F.size(other) > F.size(mine), _folded(other)).otherwise(other)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    sizes = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    return sizes & ((100 + percent) * F.coalesce(apart, F.lit(0)) <= (100 - percent) * (F.col("n") + F.col("pn")))


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between the components of the pairs (id, pid, comp, pcomp) whose full shingle sets reach the
    threshold; a pivot's text repeats, so pairs are met in its order."""

    def run(batches):
        held, held_set = None, None

        def words(raw):
            w = raw.lower().split()
            k = min(shingle, len(w))
            return set(zip(*[w[i:] for i in range(k)])) if w else set()

        for batch in batches:
            for part in common.slices(batch, "text"):
                keep = []
                for i, (mine, other) in enumerate(zip(common.raw_texts(part, "text"), common.raw_texts(part, "ptext"))):
                    if other != held:
                        held, held_set = other, words(other)
                    own = words(mine)
                    both = len(own & held_set)
                    union = len(own) + len(held_set) - both
                    if union and 100 * both >= percent * union:
                        keep.append(i)
                rows = pa.array(keep, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows)], names=["a", "b"])

    left = pairs.join(texts, "id")
    both = left.join(texts.select(F.col("id").alias("pid"), F.col("text").alias("ptext")), "pid")
    return both.select("comp", "pcomp", "text", "ptext").mapInArrow(run, "a long, b long").distinct()


def _merged(labels: common.Stage | None, fresh: DataFrame) -> common.Stage:
    """Labels (node, comp) after the components in fresh, labelled alike, have come together."""
    if labels is None:
        return common.Stage(fresh, "labels")
    up = fresh.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    moved = labels.df.join(up, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
    out = common.Stage(moved.unionByName(fresh.join(labels.df.select("node"), "node", "left_anti")), "labels")
    labels.drop()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 24) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row; components of all links of at least percent."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = common.Stage(signatures(src, shingle, bands, rows_for(percent / 100, bands)), "signatures")
    rows = common.Stage(signed.df.select("id", "n", "text_key"), "members")
    full = signed.df.filter("n > 0 and id is not null")
    heads = common.Stage(full.groupBy("text_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "heads")
    signed.drop()
    labels = _links(src, heads.df, shingle, percent)

    of_class = heads.df.select("text_key", F.col("id").alias("rep"))
    if labels is not None:
        of_class = of_class.join(labels.df, F.col("rep") == F.col("node"), "left").select("text_key", F.coalesce("comp", "rep").alias("rep"))
    classes = common.Stage(of_class, "classes")
    heads.drop()
    counted = F.col("id").isNotNull() & (F.col("n") > 0)
    member = rows.df.filter(counted).join(classes.df, "text_key").select("id", "n", "rep")
    out = member.unionByName(rows.df.filter(~counted).select("id", "n", F.col("id").alias("rep")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"), F.coalesce(F.col("id") == F.col("rep"), F.lit(True)).alias("kept"))


def _links(src: DataFrame, heads: DataFrame, shingle: int, percent: int) -> common.Stage | None:
    """Components (node, comp) of all links between the classes' heads; None if there is no bucket."""
    cells = heads.select("id", F.explode("bands").alias("key"))
    first = common.Stage(cells.groupBy("key").agg(F.min("id").alias("pid"), F.max("id").alias("last")).filter("pid <> last").select("key", "pid"), "first")
    buckets = common.Stage(common.Sieve(first.df, "key").passed(cells).join(first.df, "key"), "buckets")
    first.drop()
    if buckets.df.isEmpty():
        buckets.drop()
        return None
    # texts outside all buckets are not shuffled; merge joins at every size, so that what is shuffled grows evenly with the input
    wanted = common.Stage(buckets.df.select("id").distinct(), "wanted")
    met = common.Sieve(wanted.df, "id").passed(src).join(wanted.df.hint("merge"), "id", "left_semi")
    texts = common.Stage(met.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"), "texts")
    wanted.drop()
    sketched = heads.select("id", "n", "sketch")
    pivot = sketched.select(F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("sketch").alias("psketch"))

    pairs = buckets.df.filter("id <> pid").select("id", "pid").distinct().join(sketched, "id").join(pivot, "pid").filter(_can_link(percent))
    pairs = common.Stage(pairs.select("id", "pid", F.col("id").alias("comp"), F.col("pid").alias("pcomp")).distinct(), "pairs")
    rest = common.Stage(buckets.df.filter("id <> pid").select("key", "id"), "buckets")
    buckets.drop()
    labels, pivots = None, 1
    while True:
        edges = common.Stage(_confirm(pairs.df, texts.df, shingle, percent), "links")
        pairs.drop()
        labels = _merged(labels, common.components(edges.df))
        edges.drop()
        sizes = common.Stage(labels.df.groupBy("comp").agg(F.count("*").alias("size")), "sizes")
        placed = rest.df.join(labels.df, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        sized = common.Stage(placed.join(sizes.df, "comp", "left").select("key", "id", "comp", F.coalesce("size", F.lit(1)).alias("size")), "buckets")
        rest.drop()
        sizes.drop()
        mixed = common.Stage(sized.df.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "mixed")
        live = common.Stage(sized.df.join(mixed.df, "key"), "buckets")
        sized.drop()
        mixed.drop()
        if live.df.isEmpty():
            live.drop()
            texts.drop()
            return labels
        # small components come first: what is left to compare lies between them and the large ones
        pivots *= 16
        least = F.min(F.struct("size", F.xxhash64("id").alias("h"), "id", "comp"))
        chosen = common.Stage(live.df.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("part")).agg(least.alias("p")).select("key", F.col("p.id").alias("pid"), F.col("p.comp").alias("pcomp")), "pivots")
        near = live.df.join(sketched, "id").join(chosen.df.join(pivot, "pid"), "key").filter((F.col("comp") != F.col("pcomp")) & _can_link(percent))
        pairs = common.Stage(near.select("id", "pid", "comp", "pcomp").distinct(), "pairs")
        rest = common.Stage(live.df.join(chosen.df.select("key", F.col("pid").alias("id")), ["key", "id"], "left_anti").select("key", "id"), "buckets")
        live.drop()
        chosen.drop()


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP1_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from w where len(w) > 0)),
n as (select w.doc_id, count(g) n from w left join s using (doc_id) group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r(a, c) as (select doc_id, doc_id from w union select e.b, r.c from r join e on r.a = e.a where r.c < e.b)
select n.doc_id, n.n n_shingles, c component_id, n.doc_id = c kept from n join (select a, min(c) c from r group by 1) r on r.a = n.doc_id
"""
