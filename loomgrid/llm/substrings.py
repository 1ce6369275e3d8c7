"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers phrase ends: the places whose hash is least in some run of ``LENGTH - GRAM + 1`` places.
So every string of ``LENGTH`` bytes holds a trigger, chosen by its content alone, and equal strings hold equal triggers at equal
offsets. A string is then a dictionary suffix (what leads up to the end of a trigger) and a parse suffix (what follows it), and as such strings
reach ``REACH`` bytes to either side at most, both are kept to that length: the phrase of a trigger is its gram with what is around it.

1. Parse: each task sends (gram, phrase, document, place), by gram; an entry whose phrase the task has already sent for an
   earlier place isn't sent: its whole phrase is a repeat. So a common phrase costs one entry a task.
2. Dictionary: among the entries of a gram, all but the first of each distinct phrase are whole repeats. Where a gram has several
   distinct phrases, only their first places are compared further.
3. Suffix arrays: those phrases' bytes are fetched. Of each gram, the dictionary suffixes (read back from the trigger) and the parse suffixes
   (read on from it) are sorted by their bytes, with the lengths of common prefixes between neighbours. For each split of ``REACH`` into bytes
   before and after, a run of the first array and a run of the second, within which the common prefixes reach so far, give the strings that are
   equal byte by byte; all but the first place of each are repeats.

Grams that more than ``CROWD`` distinct phrases share go another exact way: their phrases are told apart in buckets by
phrase, and each of a phrase's strings is sent by a 128-bit hash of its own, so that one common line with any number of different
neighbours is spread over all tasks. Whole phrases are compared by 64-bit hashes within a gram's 64-bit hash, these strings by 128 bits, all others by bytes.

Defined results: null text is empty and nothing is removed from it; rows that share a doc_id are ordered by a hash of their text (as
documents of their own); null ids come first; texts of any length are cut in slices; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import distinct_ids, ordered_keys, partitions, table, tidy, written
from .packed import mixed, of_ids

LENGTH, GRAM = 100, 36
REACH = LENGTH - GRAM
#: Bytes that are parsed at once.
SLICE = 1 << 20
#: Distinct phrases of a gram that a task compares at once; grams with more are compared string by string, wherever the strings' hashes lie.
CROWD = 100_000
#: Entries of a bucket that are added at a time.
PART = 500_000
_BASE = 0x9E3779B97F4A7C15
_ENTRY = {"h": "<u8", "c": "<u8", "key": "<i8", "pos": "<i8", "right": "<u1"}
_SPAN = {"key": "<i8", "a": "<i8", "b": "<i8"}
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Hashes of any substring of a byte array."""

    def __init__(self, n: int):
        self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def sums(self, a: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], dtype=np.uint64)]

    def of(self, sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mixed((sums[j] - sums[i]) * self.down[i])


def _sliding(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + w] for each i that has a whole run."""
    n, span, out = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * span <= w:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[:n], out[w - span : w - span + n]) if span < w else out[:n]


def entries(pieces: list[tuple[int, int, bytes, int, int, int]], roller: Roller) -> dict[str, np.ndarray]:
    """Triggers of (key, first byte's place, bytes, document's length, first and last + 1 string start) pieces."""
    a = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    off = np.cumsum(sizes) - sizes
    sums = roller.sums(a)
    at = np.arange(max(len(a) - GRAM + 1, 0))
    h = roller.of(sums, at, at + GRAM)
    least = _sliding(h, REACH + 1, np.minimum)
    valid = np.zeros(len(least), dtype=bool)
    for o, (_, lo, _, _, w0, w1) in zip(off.tolist(), pieces, strict=True):
        valid[o + w0 - lo : o + w1 - lo] = True
    least = np.where(valid, least, np.uint64(0))
    # place i is a trigger if it is least in a valid run that starts at i - REACH .. i
    reach = _sliding(np.r_[np.zeros(REACH, np.uint64), least, np.zeros(max(len(h) - len(least), 0), np.uint64)], REACH + 1, np.maximum)[: len(h)]
    q = np.flatnonzero(reach == h)
    of = np.searchsorted(off, q, side="right") - 1
    key, lo, n = (np.array([p[i] for p in pieces], dtype=np.int64)[of] for i in (0, 1, 3))
    pos = q - off[of] + lo
    left, right = np.minimum(REACH, pos), np.minimum(REACH, n - pos - GRAM)
    c = mixed(roller.of(sums, q - left, q + GRAM + right) ^ (left * 128 + right).astype(np.uint64))
    return {"h": h[q], "c": c, "key": key, "pos": pos, "right": right.astype(np.uint8)}


def pieces_of(key: int, text: bytes) -> Iterator[tuple[int, int, bytes, int, int, int]]:
    """A document's bytes in slices with all that the strings which start in a slice can reach."""
    n = len(text)
    for w0 in range(0, n - LENGTH + 1, SLICE):
        w1 = min(w0 + SLICE, n - LENGTH + 1)
        lo = max(0, w0 - REACH)
        yield key, lo, text[lo : min(n, w1 + LENGTH + REACH)], n, w0, w1


def ordered(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries sorted by gram, phrase and place, each place once; which of them is the first of its phrase."""
    order = np.lexsort((e["pos"], e["key"], e["c"], e["h"]))
    e = {k: v[order] for k, v in e.items()}
    fresh = np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])] if len(order) else np.zeros(0, bool)
    again = np.r_[False, ~fresh[1:] & (e["key"][1:] == e["key"][:-1]) & (e["pos"][1:] == e["pos"][:-1])] if len(order) else fresh
    return {k: v[~again] for k, v in e.items()}, fresh[~again]


def whole_spans(e: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    pos = e["pos"][which]
    a, b = np.maximum(pos - REACH, 0), pos + GRAM + e["right"][which]
    long = b - a >= LENGTH
    return {"key": e["key"][which][long], "a": a[long], "b": b[long]}


def merged(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of each key, joined where they touch or overlap."""
    if not len(s["key"]):
        return s
    order = np.lexsort((s["a"], s["key"]))
    key, a, b = s["key"][order], s["a"][order], s["b"][order]
    new = np.r_[True, key[1:] != key[:-1]]
    # a running maximum that restarts at each key: keys are lifted above all places before them
    group = np.cumsum(new) - 1
    step = int(b.max()) + 1
    top = np.maximum.accumulate(b + group * step) if step * (int(group[-1]) + 1) < 1 << 62 else None
    if top is None:
        top = np.concatenate([np.maximum.accumulate(x) for x in np.split(b, np.flatnonzero(new)[1:])]) + 0
        gap = np.r_[True, (a[1:] > top[:-1]) | new[1:]]
    else:
        gap = np.r_[True, (a[1:] + group[1:] * step > top[:-1]) | new[1:]]
        top = top - group * step
    first = np.flatnonzero(gap)
    last = np.r_[first[1:], len(a)] - 1
    return {"key": key[first], "a": a[first], "b": top[last]}


_EXTRA = ", kind int, c binary, right binary"


def _rows(kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Rows of ``packed.schema(_SPAN) + _EXTRA``; the extra columns are those of entries that go on to ``crowd``."""
    kinds = _SPAN | ({"c": "<u8", "right": "<u1"} if kind == 2 else {})
    batch = packed.split(bucket, columns, kinds)
    if batch is None:
        return None
    none = pa.nulls(batch.num_rows, pa.binary())
    extra = [batch.column("c"), batch.column("right")] if kind == 2 else [none, none]
    cols = [*[batch.column(c) for c in ("bucket", *_SPAN)], pa.array([kind] * batch.num_rows, pa.int32()), *extra]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", *_SPAN, "kind", "c", "right"])


def _spans_out(kind: int, spans: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Spans by document bucket; ``kind`` tells whole repeats (0) from phrases to be compared (1)."""
    return _rows(kind, of_ids(spans["key"], buckets), spans)


def parse(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: rows of entries (bucket >= 0) and of repeats found in the task itself (bucket < 0), in the columns of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(2 * SLICE + 4 * LENGTH)

        def flush(pieces: list) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[np.ndarray]] = {k: [] for k in _ENTRY}
            some, size = [], 0
            for p in [*pieces, None]:
                if some and (p is None or size + len(p[2]) > 2 * SLICE):
                    for k, v in entries(some, roller).items():
                        held[k].append(v)
                    some, size = [], 0
                if p is not None:
                    some.append(p)
                    size += len(p[2])
            e, first = ordered({k: np.concatenate(v) if v else np.zeros(0, _ENTRY[k]) for k, v in held.items()})
            local = merged(whole_spans(e, ~first))
            sent = {k: v[first] for k, v in e.items()}
            yield packed.split((sent["h"] % np.uint64(buckets)).astype(np.int32), sent, _ENTRY)
            # repeats travel through the same exchange, dealt by document
            span = {"h": local["a"].astype(np.uint64), "c": local["b"].astype(np.uint64), "key": local["key"], "pos": local["a"], "right": np.zeros(len(local["key"]), np.uint8)}
            yield packed.split(-1 - of_ids(local["key"], buckets), span, _ENTRY)

        pieces, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                if raw is None or len(raw) < LENGTH:
                    continue
                for p in pieces_of(key, raw.to_pybytes()):
                    pieces.append(p)
                    size += len(p[2])
                    if size > 16 * SLICE:
                        yield from (b for b in flush(pieces) if b is not None)
                        pieces, size = [], 0
        if pieces:
            yield from (b for b in flush(pieces) if b is not None)

    return docs.select("key", "text").mapInArrow(tidy(run), packed.schema(_ENTRY))


def dictionary(parsed: DataFrame, n: int, buckets: int) -> DataFrame:
    """Step 2: spans by document bucket, kind 0 (repeats) and 1 (phrases to compare; a is the trigger's place, b its gram's hash), and
    entries of crowded grams by phrase bucket, kind 2."""

    def run(bucket: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, crowded = {k: np.zeros(0, v) for k, v in _ENTRY.items()}, np.zeros(0, np.uint64)
        for e in parts:
            if bucket < 0:
                yield _spans_out(0, {"key": e["key"], "a": e["h"].astype(np.int64), "b": e["c"].astype(np.int64)}, buckets)
                continue
            # what is held are the first places so far; one that an earlier place replaces is a repeat
            e, first = ordered({k: np.concatenate([held[k], v]) for k, v in e.items()})
            yield _spans_out(0, merged(whole_spans(e, ~first)), buckets)
            held = {k: v[first] for k, v in e.items()}
            grams, count = np.unique(held["h"], return_counts=True)
            crowded = np.union1d(crowded, grams[count > CROWD])
            if len(crowded):
                go = np.isin(held["h"], crowded)
                yield _rows(2, (mixed(held["c"][go]) % np.uint64(buckets)).astype(np.int32), {"key": held["key"][go], "a": held["pos"][go], "b": held["h"][go].view(np.int64), "c": held["c"][go], "right": held["right"][go]})
                held = {k: v[~go] for k, v in held.items()}
        same = np.r_[False, held["h"][1:] == held["h"][:-1]] if len(held["h"]) else np.zeros(0, bool)
        several = same | np.r_[same[1:], False] if len(same) else same
        yield _spans_out(1, {"key": held["key"][several], "a": held["pos"][several], "b": held["h"][several].view(np.int64)}, buckets)

    return packed.exchange(parsed, n, _ENTRY, run, packed.schema(_SPAN) + _EXTRA, PART)


def crowd(entries: DataFrame, n: int, buckets: int) -> DataFrame:
    """Of kind 2 entries, the first of each phrase (kind 1) and the spans of all others (kind 0)."""
    kinds = {"key": "<i8", "a": "<i8", "b": "<u8", "c": "<u8", "right": "<u1"}

    def run(_: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, v) for k, v in _ENTRY.items()}
        for p in parts:
            more = {"h": p["b"], "c": p["c"], "key": p["key"], "pos": p["a"], "right": p["right"]}
            e, first = ordered({k: np.concatenate([held[k], more[k]]) for k in _ENTRY})
            yield _spans_out(0, merged(whole_spans(e, ~first)), buckets)
            held = {k: v[first] for k, v in e.items()}
        yield _spans_out(1, {"key": held["key"], "a": held["pos"], "b": held["h"].view(np.int64)}, buckets)

    return packed.exchange(entries, n, kinds, run, packed.schema(_SPAN) + _EXTRA, PART)


def by_document(spans: DataFrame, n: int, merge: bool) -> DataFrame:
    """One row a document: (key, a, b), packed."""

    def run(_: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, np.int64) for k in _SPAN}
        for s in parts:
            s = {k: np.concatenate([held[k], s[k]]) for k in _SPAN}
            held = merged(s) if merge else s
        order = np.argsort(held["key"], kind="stable")
        key, a, b = (held[c][order] for c in ("key", "a", "b"))
        keys, first = np.unique(key, return_index=True)
        ends = np.r_[first[1:], len(key)]
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys), cut(a), cut(b)], names=["key", "a", "b"])

    return packed.exchange(spans.select("bucket", *_SPAN), n, _SPAN, run, "key long, a binary, b binary", PART)


_PHRASE = {"h": "<u8", "key": "<i8", "pos": "<i8", "left": "<u1", "right": "<u1", "bytes": f"|S{LENGTH + REACH}"}


_WIDE = LENGTH + REACH


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Of rows in order, how many leading bytes each shares with the one before (-1 for the first)."""
    same = sorted_[1:] == sorted_[:-1]
    return np.r_[-1, np.where(same.all(1), sorted_.shape[1], same.argmin(1))]


def suffix_repeats(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Step 3 for whole grams' phrases: the strings that an earlier place holds too."""
    m = len(e["h"])
    text = np.frombuffer(e["bytes"].tobytes(), dtype=np.uint8).reshape(m, _WIDE)
    gram = np.unique(e["h"], return_inverse=True)[1].astype(">u4").reshape(m, 1).view(np.uint8)
    arrays = []
    for part in (text[:, :REACH][:, ::-1], text[:, LENGTH:]):  # read back from the trigger, and on from it
        suffixes = np.ascontiguousarray(np.concatenate([gram, part], axis=1))
        order = np.argsort(suffixes.view(f"V{REACH + 4}").ravel(), kind="stable")
        arrays.append((order, _runs(suffixes[order]) - 4))  # negative where the gram changes
    place = np.empty(m, dtype=np.int64)  # rank by document and place
    place[np.lexsort((e["pos"], e["key"]))] = np.arange(m)
    at = np.argsort(place)

    def runs_of(which: int, depth: int) -> np.ndarray:
        order, common = arrays[which]
        run = np.empty(m, dtype=np.int64)
        run[order] = np.cumsum(common < depth)
        return run

    found: dict[str, list[np.ndarray]] = {"key": [], "a": []}
    for s in range(REACH + 1):  # strings of s bytes before the trigger
        ok = np.flatnonzero((e["left"] >= s) & (e["right"] >= REACH - s))
        if len(ok) < 2:
            continue
        v = np.sort((runs_of(0, s)[ok] * (m + 1) + runs_of(1, REACH - s)[ok]) * m + place[ok])
        string = v // m
        later = at[v[1:][string[1:] == string[:-1]] % m]
        found["key"].append(e["key"][later])
        found["a"].append(e["pos"][later] - s)
    key, a = (np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64) for c in ("key", "a"))
    return {"key": key, "a": a, "b": a + LENGTH}


def phrases(wanted: DataFrame, docs: DataFrame, out: str, ready: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], most: int) -> DataFrame:
    """``ready`` on the phrases of ``wanted`` (key, a, b), some at a time, with their bytes (zeros where the document ends)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols = {c: np.concatenate([x[i] for x in held]) for i, c in enumerate(("h", "key", "pos", "left", "right", "bytes"))}
            held.clear()
            return (b for b in ready(cols) if b is not None)

        size = 0
        for batch in batches:
            for key, text, a, b in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("a"), batch.column("b"), strict=True):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                places, hashes = np.frombuffer(a.as_py(), dtype=np.int64), np.frombuffer(b.as_py(), dtype=np.uint64)
                for i in range(0, len(places), most):
                    pos, h = places[i : i + most], hashes[i : i + most]
                    left, right = np.minimum(REACH, pos), np.minimum(REACH, len(raw) - pos - GRAM)
                    at = pos[:, None] - REACH + np.arange(_WIDE)
                    inside = (at >= (pos - left)[:, None]) & (at < (pos + GRAM + right)[:, None])
                    held.append((h, np.full(len(pos), key), pos, left.astype(np.uint8), right.astype(np.uint8), np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)))
                    size += len(pos)
                    if size > most:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return docs.select("key", "text").join(wanted, "key").mapInArrow(tidy(fetch), out)


def compare(wanted: DataFrame, docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Step 3: repeats (kind 0 spans) among the strings of phrases that share a gram."""
    kinds = {**_PHRASE, "bytes": f"|V{_WIDE}"}

    def pack(e: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield packed.split((e["h"] % np.uint64(buckets)).astype(np.int32), e | {"bytes": e["bytes"].view(f"|V{_WIDE}").ravel()}, kinds)

    def run(_: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for e in parts:  # a bucket's only part
            order = np.argsort(e["h"], kind="stable")
            h = e["h"][order]
            ends = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
            begin = 0
            while begin < len(h):  # some whole grams at a time
                stop = int(ends[min(np.searchsorted(ends, begin + 8000, side="left"), len(ends) - 1)])
                rows = order[begin:stop]
                yield _spans_out(0, merged(suffix_repeats({k: v[rows] for k, v in e.items()})), buckets)
                begin = stop

    return packed.exchange(phrases(wanted, docs, packed.schema(_PHRASE), pack, 40_000), n, kinds, run, packed.schema(_SPAN) + _EXTRA)


def compare_crowded(wanted: DataFrame, docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Step 3 for phrases of crowded grams: repeats among their strings, each dealt by its own hash."""
    rollers = [(_powers(base, _WIDE + 1), _powers(pow(base, -1, 1 << 64), _WIDE + 1)) for base in (_BASE, 0xD6E8FEB86659FD93)]
    s = np.arange(REACH + 1)

    def firsts(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], pa.RecordBatch | None]:
        e, first = ordered(e)
        later = {"key": e["key"][~first], "a": e["pos"][~first], "b": e["pos"][~first] + LENGTH}
        return {k: v[first] for k, v in e.items()}, _spans_out(0, merged(later), buckets)

    def strings(e: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ok = (s >= REACH - e["left"].astype(int)[:, None]) & (s + LENGTH <= REACH + GRAM + e["right"].astype(int)[:, None])
        hashes = []
        for up, down in rollers:
            sums = np.zeros((len(e["h"]), _WIDE + 1), dtype=np.uint64)
            np.cumsum((e["bytes"].astype(np.uint64) + np.uint64(1)) * up[:_WIDE], axis=1, dtype=np.uint64, out=sums[:, 1:])
            hashes.append(mixed((sums[:, s + LENGTH] - sums[:, s]) * down[s])[ok])
        places = {"key": np.broadcast_to(e["key"][:, None], ok.shape)[ok], "pos": (e["pos"][:, None] - REACH + s)[ok]}
        held, spans = firsts({"h": hashes[0], "c": hashes[1], **places, "right": np.zeros(len(hashes[0]), np.uint8)})
        yield packed.split((held["h"] % np.uint64(buckets)).astype(np.int32), held, _ENTRY)
        if spans is not None:  # repeats travel through the same exchange, dealt by document
            back = {"h": "a", "c": "b", "key": "key", "pos": "a", "right": "key"}
            for i in range(spans.num_rows):
                cols = {c: np.frombuffer(spans.column(f)[i].as_py(), np.int64) for c, f in back.items()}
                yield packed.split(np.full(len(cols["key"]), -1 - spans.column("bucket")[i].as_py(), np.int32), {k: v.astype(np.uint8) * 0 if k == "right" else v.view(np.uint64) if k in "hc" else v for k, v in cols.items()}, _ENTRY)

    def run(bucket: int, parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, v) for k, v in _ENTRY.items()}
        for e in parts:
            if bucket < 0:
                yield _spans_out(0, {"key": e["key"], "a": e["h"].view(np.int64), "b": e["c"].view(np.int64)}, buckets)
                continue
            held, spans = firsts({k: np.concatenate([held[k], v]) for k, v in e.items()})
            yield spans

    return packed.exchange(phrases(wanted, docs, packed.schema(_ENTRY), strings, 8000), n, _ENTRY, run, packed.schema(_SPAN) + _EXTRA, PART)


def unique_keys(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, text) with a key of its own for each row that rises with the id: the id itself, unless ids repeat or are null."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("key", F.col("doc_id")) if distinct_ids(rows, "doc_id") else ordered_keys(rows, "doc_id", "text")


def repeated_spans(rows: DataFrame, n: int) -> DataFrame:
    """(key, a, b): for each document with repeats, the packed starts and ends of its removed runs."""
    buckets, spark = 4 * n, rows.sparkSession
    spans = written(spark, dictionary(parse(rows, buckets), n, buckets), "spans")
    several = compare(by_document(spans.where("kind = 1"), n, merge=False), rows, n, buckets)
    found = spans.where("kind = 0").unionByName(several)
    if spans.where("kind = 2").limit(1).count():
        more = written(spark, crowd(spans.where("kind = 2"), n, buckets), "crowd")
        found = found.unionByName(more.where("kind = 0")).unionByName(compare_crowded(by_document(more.where("kind = 1"), n, merge=False), rows, n, buckets))
    return by_document(found, n, merge=True)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", out_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``out_text`` the kept bytes) of each row."""
    rows, n = unique_keys(docs, id, text), partitions(docs.sparkSession)
    spans = repeated_spans(rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b"), strict=True):
                raw = text.as_buffer().to_pybytes()
                starts, stops = ([], []) if a.as_py() is None else (np.frombuffer(x.as_py(), dtype=np.int64).tolist() for x in (a, b))
                kept = b"".join(raw[i:j] for i, j in zip([0, *stops], [*starts, len(raw)], strict=True))
                for col, x in zip(out, (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if out_text else None), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = rows.join(spans, "key", "left").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found if out_text else found.drop("kept")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_repeated_substrings": op2_repeated_substrings}
ORACLES: dict[str, str] = {}
