"""Exact Jaccard self-join of word shingle sets by universe partition, and its connected components.

Sets are banded by size. In a band, shingles are hashed to m segments; two sets that link differ in at most
(a + b)(1 - t) / (1 + t) shingles, H for a band's largest. Every band has an allocation of that error budget to its segments:

* one-deletion neighbourhoods, for k segments that the band's plan names: each is indexed whole and with each one shingle left out. If
  none of them matches in two sets, the sets differ by 2 or more in each, so by H - 2k at most in all the others;
* whole segments: of the others, each set indexes only its H' + 1 - 2k first in a global order (H' for its own size): segments with
  rare and many shingles first. Of two sets' equal segments the first in the order is among both sets' choices;
* the rest are skipped.

m and the segments with neighbourhoods are chosen for each band by their cost on a bounded sample: entries, and pairs that collide, scaled to
the table's size. The segments whose neighbourhoods cost least are tried first. This moves cost, not results.

Sets that are the same (by 128 bits) form one class and enter once. Within an index entry's classes, first each is paired with one centre that varies with the
entry; those pairs are verified on the sets and joined up. Then all pairs of an entry that are still in different components
are tried, unless shingle histograms (a lower bound of the difference) rule them out, and verified. Large entries are compared in blocks:
components of more than a block's classes have blocks of their own, which are never compared among each other. So every pair that links is verified
or already joined, and no group of copies is expanded into its pairs.

Defined results: null or wordless text has an empty set, which links with nothing; texts under five words are one shingle; shingles are
compared as 64-bit hashes; texts of any length are cut in slices; rows that share a doc_id are one node (linked if either row is); null ids are no nodes and come
back with a null component; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packed
from .common import batches, drop, partitions, sized, table, tidy, trim, written
from .components import connected_components
from .packed import mixed

WORDS = 5
#: Links have 100 * intersection >= SHARE * union.
SHARE = 80
#: Texts that estimate costs and rare shingles, and shingles of them that count as frequent; both only steer cost.
SAMPLE, FREQUENT = 3000, 100_000
BINS = 256
#: Classes of an index entry that are compared as one group; larger entries are split into blocks.
BLOCK = 1024
#: Entries of a bucket that are added at a time, and classes of a signature from which on they are passed on at once.
PART, CROWD = 500_000, 20_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: What a pair that collides costs, in index entries.
PAIR = 0.25
_ENTRY = {"sig": "<u4", "more": "<u2", "c1": "<u8", "c2": "<u8"}
_SEPARATORS = b" \t\n\v\f\r"


def _word_hashes(raw: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        stop = at + SLICE
        if stop < len(raw):  # cut after a separator
            last = max(raw.rfind(c, at, stop) for c in (_SEPARATORS[i : i + 1] for i in range(6)))
            if last < at:
                nexts = [i for i in (raw.find(_SEPARATORS[k : k + 1], stop) for k in range(6)) if i >= 0]
                last = min(nexts, default=len(raw) - 1)
            stop = last + 1
        found = raw[at:stop].lower().split()
        yield np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        at = stop


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = list(_word_hashes((text or "").encode("utf-8", "surrogatepass")))
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = max(len(w) - WORDS + 1, 1)
    h = np.full(n, np.uint64(min(len(w), WORDS)))
    for k in range(min(len(w), WORDS)):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def class_of(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set (none: the empty one)."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _binary(c1: np.ndarray, c2: np.ndarray) -> pa.Array:
    """Classes as 16-byte values, which sort as (c1, c2)."""
    data = np.stack([c1, c2], 1).astype(">u8")
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * 16).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def histogram(s: np.ndarray) -> bytes:
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS).clip(0, 65535).astype("<u2").tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SHARE * (len(a) + len(b) - both) > 0


def most_apart(a, b):
    """The largest symmetric difference of linked sets of sizes a and b."""
    return ((a + b) * (100 - SHARE)) // (100 + SHARE)


@dataclass
class Plan:
    """Each band's allocation (how many segments, and those with one-deletion neighbourhoods), and the frequent shingles with their counts."""

    bands: dict[int, tuple[int, frozenset[int]]] = field(default_factory=dict)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @staticmethod
    def top(band: int) -> int:
        n = 4
        for _ in range(band):
            n = n * 3 // 2
        return n

    @staticmethod
    def band(n: int) -> int:
        band, top = 0, 4
        while n > top:
            band, top = band + 1, top * 3 // 2
        return band

    def allocation(self, band: int) -> tuple[int, frozenset[int]]:
        far = most_apart(self.top(band), self.top(band))
        return self.bands.get(band, (2 * (far + 1), frozenset()))

    def entries(self, s: np.ndarray) -> np.ndarray:
        """Index entries of a set: in its own band, where the larger set of a pair has its size, and in the next if a larger partner can be there."""
        n, out = len(s), []
        if not n:
            return s
        widest = n * 100 // SHARE
        for band in range(self.band(n), self.band(widest) + 1):
            apart = most_apart(n, min(self.top(band), widest))
            if most_apart(self.top(band), self.top(band)):  # else only equal sets can link
                out += self.in_band(s, band, apart)
        return np.unique(np.concatenate(out)) if out else s[:0]

    def in_band(self, s: np.ndarray, band: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the whole segments that are picked, and of the neighbourhoods."""
        m, deleted = self.allocation(band)
        parts = Segments(self, s, band, m)
        return parts.picked(deleted, apart), parts.near(deleted)[0]


class Segments:
    """A set dealt to m segments of a band."""

    def __init__(self, plan: Plan, s: np.ndarray, band: int, m: int):
        salt = np.uint64((band + 1) * 0xA24BAED4963EE407 % (1 << 64))
        x = mixed(s ^ salt)
        seg = ((x >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        self.m, self.x, self.seg = m, x[order], seg[order]
        self.size = np.bincount(seg, minlength=m)
        total = np.r_[np.uint64(0), np.cumsum(self.x, dtype=np.uint64)]
        ends = np.cumsum(self.size)
        self.tag = mixed(np.arange(m, dtype=np.uint64) * np.uint64(2) + salt)
        self.sums = total[ends] - total[ends - self.size]
        self.whole = mixed(self.sums + self.tag)
        self.rare = np.zeros(m, np.int64)
        if len(plan.hot):
            at = np.searchsorted(plan.hot, s[order]).clip(0, len(plan.hot) - 1)
            df = np.where(plan.hot[at] == s[order], plan.df[at], 0)
            full = np.flatnonzero(self.size)
            self.rare[full] = np.minimum.reduceat(df, (ends - self.size)[full])
        self.rare[self.size == 0] = 1 << 30

    def near(self, deleted: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the segments' one-deletion neighbourhoods, and their segments."""
        if not deleted:
            return self.x[:0], self.seg[:0]
        of = np.zeros(self.m, dtype=bool)
        of[list(deleted)] = True
        at, each = np.flatnonzero(of), of[self.seg]
        seg = self.seg[each]
        return np.r_[self.whole[at], mixed(self.sums[seg] - self.x[each] + self.tag[seg])], np.r_[at, seg]

    def picked(self, deleted: frozenset[int], apart: int) -> np.ndarray:
        """Signatures of as many of the other segments, whole, as the rest of the error budget needs."""
        rest = np.ones(self.m, dtype=bool)
        rest[list(deleted)] = False
        pick, keep = np.flatnonzero(rest), max(apart + 1 - 2 * len(deleted), 0)
        if keep < len(pick):
            pick = pick[np.lexsort((self.whole[pick], -self.size[pick], self.rare[pick]))[:keep]]
        return self.whole[pick]


def _cost(signatures: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures, by the place of their first, and what each costs."""
    _, first, n = np.unique(signatures, return_index=True, return_counts=True)
    return first, n + PAIR * scale * n * (n - 1.0)


def plan_of(sets: list[np.ndarray], rows: int = 0) -> Plan:
    """Frequent shingles, and for each band the cheapest allocation, on sample sets of a table of ``rows`` rows."""
    distinct = list({s.tobytes(): s for s in sets if len(s)}.values())
    if not distinct:
        return Plan()
    scale = max(rows / len(sets), 1.0)
    hot, df = np.unique(np.concatenate(distinct), return_counts=True)
    top = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
    top = top[df[top] > 1]
    plan = Plan({}, hot[top], df[top].astype(np.int32))
    by_band: dict[int, list[np.ndarray]] = {}
    for s in distinct:
        by_band.setdefault(plan.band(len(s)), []).append(s)
    for band, some in by_band.items():
        far, best = most_apart(plan.top(band), plan.top(band)), None
        apart = [most_apart(len(s), plan.top(band)) for s in some]
        for m in sorted({-(-(far + 1) // 2), far + 1, 2 * (far + 1), 4 * (far + 1)}) if far else ():
            parts = [Segments(plan, s, band, m) for s in some]
            # segments by what their neighbourhoods cost
            all_near, of = (np.concatenate(c) for c in zip(*(p.near(frozenset(range(m))) for p in parts), strict=True))
            first, cost = _cost(all_near, scale)
            order = np.argsort(np.bincount(of[first], cost, minlength=m), kind="stable")
            most = (far + 1) // 2 if m > -(-(far + 1) // 2) else m
            for k in sorted({0, 1, most // 2, most}):
                if far + 1 - 2 * k > m - k:  # too few segments for the budget
                    continue
                deleted = frozenset(order[:k].tolist())
                near = all_near[np.isin(of, order[:k])]
                whole = np.concatenate([p.picked(deleted, d) for p, d in zip(parts, apart, strict=True)])
                price = _cost(np.r_[near, whole], scale)[1].sum()
                if best is None or price < best[0]:
                    best = (price, (m, deleted))
        if best is not None:
            plan.bands[band] = best[1]
    return plan


def sample_plan(docs: DataFrame) -> Plan:
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    few = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # SAMPLE ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets of extreme size stand for themselves in no band of the sample
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets if len(s) <= 5000], pa.binary())], names=["s"])

    with batches(docs.sparkSession):
        seen = few.select("text").mapInArrow(tidy(run), "s binary").limit(4 * SAMPLE).collect()
    plan = plan_of([np.frombuffer(r[0], np.uint64) for r in seen], docs.count())
    del seen
    trim()
    return plan


def shingled(docs: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, n, cls, hist) and, with a bucket, of packed index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()

        def entries(held: list, classes: list) -> pa.RecordBatch | None:
            if not held:
                return None
            sig = np.concatenate(held)
            cls = np.frombuffer(b"".join(classes), ">u8").reshape(-1, 2).astype(np.uint64)
            cls = np.repeat(cls, [len(x) for x in held], axis=0)
            # 48 bits of a signature and its bucket: others that agree in both only cost
            return packed.split((mixed(sig) % np.uint64(buckets)).astype(np.int32), {"sig": sig & np.uint64(0xFFFFFFFF), "more": sig >> np.uint64(48), "c1": cls[:, 0], "c2": cls[:, 1]}, _ENTRY)

        def both(docs: list | None, index: pa.RecordBatch | None) -> pa.RecordBatch:
            n = len(docs[0]) if docs else index.num_rows
            none = lambda kind: pa.nulls(n, kind)
            own = [pa.array(x, k) for x, k in zip(docs, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if docs else [none(pa.int64())] * 2 + [none(pa.binary())] * 2
            rest = index.columns if index is not None else [none(pa.int32()), *[none(pa.binary()) for _ in _ENTRY]]
            return pa.RecordBatch.from_arrays([*own, *rest], names=["doc_id", "n", "cls", "hist", "bucket", *_ENTRY])

        for batch in batches:
            rows: list[list] = [[], [], [], []]
            held, classes, size = [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py())
                cls = class_of(s)
                for col, x in zip(rows, (i, len(s), cls, histogram(s) if len(s) else None), strict=True):
                    col.append(x)
                if cls and i is not None and cls not in done:  # a task's further copies add nothing
                    if len(done) < 100_000:
                        done.add(cls)
                    held.append(plan.entries(s))
                    classes.append(cls)
                    size += len(held[-1])
                if size > 200_000:
                    if (e := entries(held, classes)) is not None:
                        yield both(None, e)
                    held, classes, size = [], [], 0
            if rows[0]:
                yield both(rows, None)
            if (e := entries(held, classes)) is not None and e.num_rows:
                yield both(None, e)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), packed.schema(_ENTRY, "doc_id long, n long, cls binary, hist binary, bucket int"))


def blocks(entries: DataFrame, n: int) -> DataFrame:
    """Of each entry shared by several classes: kind 0 pairs with the entry's centre, kind 1 members (of three classes or more)."""

    def out(kind: int, sig: np.ndarray, a: pa.Array | None, b: pa.Array) -> pa.RecordBatch:
        none = pa.nulls(len(b), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(sig.astype(np.int64)), none if a is None else a, b], names=["kind", "sig", "a", "b"])

    def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """x and y: classes (c1, c2); equal ones make no pair."""
        less = (x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1]))
        a, b = np.where(less[:, None], x, y), np.where(less[:, None], y, x)
        both = np.concatenate([a, b], 1)[(x != y).any(1)]
        both = both[np.lexsort(both.T[::-1])]
        both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]] if len(both) else both
        return out(0, np.zeros(len(both)), _binary(both[:, 0], both[:, 1]), _binary(both[:, 2], both[:, 3]))

    def whole(sig: np.ndarray, cls: np.ndarray, least: int) -> Iterator[pa.RecordBatch | tuple]:
        """Pairs and members of sorted entries; at last the centre of each signature."""
        new = np.r_[True, sig[1:] != sig[:-1]]
        start, block = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.r_[start, len(sig)])
        # eight orders of the classes: entries that agree on the order mostly agree on the centre
        weight = mixed(cls[:, 0] + (sig >> np.uint64(45)))
        low = np.minimum.reduceat(weight, start)
        first = np.zeros(len(size), np.int64)
        at = np.flatnonzero(weight == low[block])[::-1]
        first[block[at]] = at
        yield pairs(cls[first][block], cls)
        big = size[block] >= least
        yield out(1, sig[big], None, _binary(cls[big, 0], cls[big, 1]))
        yield sig[start], cls[first]

    def run(_: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held_sig, held = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        open_sig, centre = held_sig, held  # crowded signatures, whose further classes are passed on as they come
        for e in parts:
            sig, cls = e["sig"].astype(np.uint64) | e["more"].astype(np.uint64) << np.uint64(32), np.stack([e["c1"], e["c2"]], 1)
            if len(open_sig):
                at = np.searchsorted(open_sig, sig).clip(0, len(open_sig) - 1)
                known = open_sig[at] == sig
                yield pairs(centre[at[known]], cls[known])
                yield out(1, sig[known], None, _binary(cls[known, 0], cls[known, 1]))
                sig, cls = sig[~known], cls[~known]
            sig, cls = np.r_[held_sig, sig], np.concatenate([held, cls])
            order = np.lexsort((cls[:, 1], cls[:, 0], sig))
            sig, cls = sig[order], cls[order]
            once = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]).any(1)] if len(sig) else np.zeros(0, bool)
            held_sig, held = sig[once], cls[once]
            names, count = np.unique(held_sig, return_counts=True)
            if len(go := names[count > CROWD]):
                which = np.isin(held_sig, go)
                *done, (sigs, centres) = whole(held_sig[which], held[which], 1)
                yield from done
                order = np.argsort(np.r_[open_sig, sigs])
                open_sig, centre = np.r_[open_sig, sigs][order], np.concatenate([centre, centres])[order]
                held_sig, held = held_sig[~which], held[~which]
        names, back, count = np.unique(held_sig, return_inverse=True, return_counts=True)
        many = count[back] > 1 if len(names) else np.zeros(0, bool)
        if many.any():
            *done, _ = whole(held_sig[many], held[many], 3)
            yield from done

    return packed.exchange(entries, n, _ENTRY, run, "kind int, sig long, a binary, b binary", PART)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether histograms rule a link out."""
    x, y = x.astype(np.int32), y.astype(np.int32)
    return np.abs(x - y).sum(-1) > most_apart(x.sum(-1), y.sum(-1))


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Of pairs of classes (a, b), those that link, as documents (a, b). ``classes``: (cls, doc, hist), ``texts``: (doc_id, text)."""
    spark = pairs.sparkSession
    own = classes.select("cls", "doc", "hist")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("ha", "hb"))
                yield batch.select(["a", "b", "da", "db"]).filter(pa.array(~_apart(x, y)))

    wide = pairs.join(own.select(F.col("cls").alias("a"), F.col("doc").alias("da"), F.col("hist").alias("ha")), "a").join(own.select(F.col("cls").alias("b"), F.col("doc").alias("db"), F.col("hist").alias("hb")), "b")
    close = written(spark, wide.select("a", "b", "da", "db", "ha", "hb").mapInArrow(tidy(near), "a binary, b binary, da long, db long"), f"{name}-near", batch=1000)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], names=["cls", "s"])

    docs = sized(written(spark, close.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct(), f"{name}-docs"))
    # rows that share a doc_id can have other sets: the class tells them apart
    known = written(spark, texts.join(docs, "doc_id", "left_semi").select("text").mapInArrow(tidy(sets), "cls binary, s binary").dropDuplicates(["cls"]), f"{name}-sets", "none", batch=200)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["da", "db"]).filter(pa.array(ok, pa.bool_())).rename_columns(["a", "b"])

    full = close.join(known.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    links = written(spark, full.select("da", "db", "sa", "sb").mapInArrow(tidy(check), "a long, b long"), name, batch=200)
    drop(close, known)
    return links


def remaining(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of an entry's classes that are in different components and that histograms don't rule out.

    An entry's classes are dealt into blocks of about ``BLOCK``: those of small components by component, those of a larger one into blocks of its
    own, and each pair of blocks is a group, but for pairs within one large component. So no task holds more than about two
    blocks at once, a common segment's work spreads over all tasks, and an entry of one large component costs as many groups as it has blocks."""
    spark = members.sparkSession
    known = members.join(classes.select("cls", "doc"), "cls").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    tagged = written(spark, known.select("sig", "cls", F.coalesce("label", "doc").alias("label")), "members")
    of = tagged.groupBy("sig", "label").agg(F.count("*").alias("n"))
    large = F.col("n") > BLOCK
    k = F.when(large, F.ceil(F.col("n") / BLOCK)).otherwise(0)
    shape = of.groupBy("sig").agg(F.count("*").alias("labels"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / BLOCK).alias("small"), F.sum(k).alias("own"))
    shape = written(spark, shape.where("labels > 1").select("sig", "small", (F.col("small") + F.col("own")).alias("blocks")), "several")
    before = Window.partitionBy("sig").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    apart = of.where(large).select("sig", "label", k.alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    rows = tagged.join(sized(shape), "sig").join(apart, ["sig", "label"], "left").join(classes.select("cls", "hist"), "cls")
    first = F.col("small") + F.col("before")
    own = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("label"), F.col("small"))).otherwise(first + F.pmod(F.xxhash64("cls"), F.col("k")))
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    others = F.when(F.col("k").isNull(), span(zero, F.col("blocks"))).otherwise(F.concat(span(zero, first), span(first + F.col("k"), F.col("blocks"))))
    rows = rows.select("sig", "cls", "label", "hist", own.alias("own"), F.explode(others).alias("other"))
    rows = rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "label", "hist")

    def tiles(across: bool, group: list) -> Iterator[pa.RecordBatch]:
        group = list({(g[0], g[1]): g for g in group}.values())  # a class can come twice
        own, label = (np.array([g[i] for g in group], dtype=np.int64) for i in (0, 2))
        cls = np.frombuffer(b"".join(g[1] for g in group), ">u8").reshape(-1, 2).astype(np.uint64)
        hist = np.frombuffer(b"".join(g[3] for g in group), "<u2").reshape(-1, BINS).astype(np.int32)
        size = hist.sum(1)
        left = int((own == own[0]).sum())  # rows come sorted by block
        for i in range(left):
            start = left if across else i + 1
            other = np.flatnonzero(label[start:] != label[i]) + start
            for part in np.array_split(other, max(1, len(other) // 4096)):
                ok = part[np.abs(hist[part] - hist[i]).sum(1) <= most_apart(size[part], size[i])]
                if len(ok):
                    x, y = cls[ok], np.broadcast_to(cls[i], (len(ok), 2))
                    less = ((x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1])))[:, None]
                    a, b = np.where(less, x, y), np.where(less, y, x)
                    yield pa.RecordBatch.from_arrays([_binary(a[:, 0], a[:, 1]), _binary(b[:, 0], b[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sig", "x", "y", "own", "cls", "label", "hist")), strict=True):
                if row[:3] != at:
                    if group:
                        yield from tiles(at[1] != at[2], group)
                    at, group = row[:3], []
                group.append(row[3:])
        if group:
            yield from tiles(at[1] != at[2], group)

    n = partitions(spark)
    return rows.repartition(n, "sig", "x", "y").sortWithinPartitions("sig", "x", "y", "own").mapInArrow(tidy(run), "a binary, b binary").distinct()


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = partitions(spark)
    first = written(spark, shingled(docs, sample_plan(docs), 4 * n), "shingled", "lz4", batch=1000)
    rows = first.where("bucket IS NULL").select("doc_id", "n", "cls", "hist")
    nodes = rows.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(spark, nodes.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("hist").alias("hist")), "classes")
    found = written(spark, blocks(first.where("bucket IS NOT NULL").select("bucket", *_ENTRY), n), "blocks", batch=200)
    one = verified(found.where("kind = 0").select("a", "b").distinct(), classes, docs, "links-1")
    labels = connected_components(one, "first")
    two = verified(remaining(found.where("kind = 1").select("sig", F.col("b").alias("cls")), labels, classes), classes, docs, "links-2")
    drop(found)
    # the least documents of the classes of rows that share a doc_id are joined too
    of = nodes.select("doc_id", "cls").join(classes.select("cls", "doc"), "cls")
    links = one.unionByName(two).unionByName(of.where("doc_id <> doc").groupBy("doc_id").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
        .join(of, "doc_id").select(F.col("least").alias("a"), F.col("doc").alias("b")))
    links = links.unionByName(of.where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).join(classes.select(F.col("doc").alias("a")).distinct(), "a", "left_semi"))
    final = connected_components(links, "final")
    component = classes.select("cls", "doc").join(final, F.col("doc") == F.col("node"), "left").select("cls", F.coalesce("label", "doc").alias("component_id"))
    out = rows.select("doc_id", "n", "cls").join(component, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
