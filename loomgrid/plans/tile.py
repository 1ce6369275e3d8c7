"""One tile as streams, and back: rows as edits of spanning-tree parents or templates, or columns as postings, references or templates.

All work on a tile is array work on its sorted lists; a task holds one tile at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd

from ..functions.codecs import entropy_decode, entropy_encode, vbyte_decode, vbyte_encode
from ..operators.edits import dyadic_positions
from ..operators.order import GOLDEN, SUPPORT_SEEDS, TEMPLATE_SEEDS, mix64


@dataclass(frozen=True)
class EncodeConfig:
    """``ratio``: edits for each entry beyond which a row is written whole (None: never for that reason). ``weight``: spanning trees by
    ``metric`` or by encoding cost. Row templates are used in adaptive mode alone; ``column_templates`` without it. ``tile_entries`` and
    ``tile_columns`` bound what the task of a tile holds: blocks of more columns, and clusters of more entries, are tiled in parts."""

    cell_blocks: int = 6
    gene_blocks: int = 5
    max_cluster: int | None = None
    metric: str = "l0"
    weight: str = "metric"
    window: int = 8
    index_codec: str = "arithmetic"
    forest_cut: float = 0.0
    ratio: float | None = 1.0
    parent_refs: bool = True
    column_refs: bool = True
    adaptive: bool = False
    row_template_max: int = 16
    column_template_max: int = 32
    column_templates: int = 0
    rows: bool = True
    columns: bool = True
    prefer_columns: bool = False
    lossy_bins: int | None = None
    tile_entries: int = 400_000
    tile_columns: int = 16_384


#: The byte category of each stream, by form.
ROW_STREAMS = {"offsets": "topology", "root": "keys", "root_vals": "roots"} | dict.fromkeys(("modes", "wholes", "removes", "adds", "updates", "words", "word_gaps", "word_ids", "whole_gaps", "remove_gaps", "add_gaps", "update_gaps"), "ops") | dict.fromkeys(("word_vals", "whole_vals", "add_vals", "update_vals"), "vals")
COLUMN_STREAMS = dict.fromkeys(("modes", "wholes", "words", "removes", "adds"), "roots") | dict.fromkeys(("whole_gaps", "word_gaps", "word_ids", "refs", "remove_gaps", "add_gaps"), "ops") | {"vals": "vals"}
CATEGORIES = ("topology", "keys", "roots", "ops", "vals", "meta")
MODES = ("row_parent", "row_whole", "row_template", "col_raw", "col_ref", "col_template")
TILE = "cluster_id long, block_id long, kind string, height long, width long, streams map<string, binary>, " + ", ".join(f"{c} long" for c in (*CATEGORIES, "bytes", *MODES, "fallbacks")) + ", bound_bits double, symbols map<long, long>"


@dataclass(frozen=True)
class Lists:
    """Sorted id lists with values, one after the other; list i is ``ids[ptr[i]:ptr[i + 1]]``."""

    ptr: np.ndarray
    ids: np.ndarray
    vals: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.sizes)

    def take(self, which: np.ndarray) -> Lists:
        n = self.sizes[which]
        ptr = np.r_[0, np.cumsum(n)]
        at = np.repeat(self.ptr[which] - ptr[:-1], n) + np.arange(ptr[-1])
        return Lists(ptr, self.ids[at], self.vals[at])

    def where(self, keep: np.ndarray) -> Lists:
        n = np.bincount(self.owner[keep], minlength=len(self.ptr) - 1)
        return Lists(np.r_[0, np.cumsum(n)], self.ids[keep], self.vals[keep])

    def gaps(self) -> np.ndarray:
        """The first id of each list, then differences."""
        out = np.diff(self.ids, prepend=0)
        first = self.ptr[:-1][self.sizes > 0]
        out[first] = self.ids[first]
        return out


def lists(n: int, of: np.ndarray, ids: np.ndarray, vals: np.ndarray) -> Lists:
    order = np.lexsort((ids, of))
    return Lists(np.r_[0, np.cumsum(np.bincount(of, minlength=n))], ids[order].astype(np.int64), vals[order].astype(np.int64))


@dataclass(frozen=True)
class Edits:
    """What turns each list of a base into the list at its place: ``old`` holds the base's values of ``updates``."""

    removes: Lists
    adds: Lists
    updates: Lists
    old: np.ndarray

    def cost(self, codec: str) -> np.ndarray:
        return list_cost(self.removes, False, codec) + list_cost(self.adds, True, codec) + list_cost(self.updates, True, codec) + 4

    @property
    def count(self) -> np.ndarray:
        return self.removes.sizes + self.adds.sizes + self.updates.sizes


def edits(base: Lists, to: Lists) -> Edits:
    width = int(max(base.ids.max(initial=0), to.ids.max(initial=0))) + 1
    x, y = base.owner * width + base.ids, to.owner * width + to.ids
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    gone, new, changed = np.ones(len(x), bool), np.ones(len(y), bool), np.zeros(len(y), bool)
    gone[i], new[j] = False, False
    other = base.vals[i] != to.vals[j]
    changed[j[other]] = True
    return Edits(base.where(gone), to.where(new), to.where(changed), base.vals[i[other]])


def symbol_cost(v: np.ndarray, codec: str) -> np.ndarray:
    if codec == "stream-vbyte":
        return 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    return np.maximum(1, -(-np.frexp(v.astype(float))[1] // 6)).astype(np.int64)


def list_cost(x: Lists, values: bool, codec: str) -> np.ndarray:
    cost = symbol_cost(x.gaps(), codec) + (symbol_cost(x.vals, codec) if values else 0)
    return np.bincount(x.owner, cost, len(x.ptr) - 1).astype(np.int64)


def falls_back(count: np.ndarray, nnz: np.ndarray, ratio: float | None) -> np.ndarray:
    return np.zeros(len(count), bool) if ratio is None else np.where(nnz == 0, count > 0, count > ratio * nnz)


def child_cost(e: Edits, child: Lists, cfg: EncodeConfig) -> np.ndarray:
    return np.where(falls_back(e.count, child.sizes, cfg.ratio), list_cost(child, True, cfg.index_codec) + 2, e.cost(cfg.index_codec))


def pair_weights(x: Lists, a: np.ndarray, b: np.ndarray, cfg: EncodeConfig) -> np.ndarray:
    p, q = x.take(a), x.take(b)
    e = edits(p, q)
    if cfg.weight == "encoding":
        return np.minimum(child_cost(e, q, cfg), child_cost(edits(q, p), p, cfg))
    if cfg.metric == "l0":
        return e.removes.sizes + e.adds.sizes
    if cfg.metric == "hamming":
        return e.count
    if cfg.metric == "l2":
        total = lambda of, v: np.bincount(of.owner, v.astype(float) ** 2, len(a)).astype(np.int64)
        return total(e.removes, e.removes.vals) + total(e.adds, e.adds.vals) + total(e.updates, e.updates.vals - e.old)
    if cfg.metric == "jaccard":
        both, union = p.sizes - e.removes.sizes, p.sizes + e.adds.sizes
        far = np.float32(1) - (both.astype(np.float32) / np.maximum(union, 1).astype(np.float32)).astype(np.float32)
        return np.where(union == 0, 0, np.floor(far.astype(np.float32) * np.float32(1e6) + np.float32(0.5))).astype(np.int64)
    raise ValueError(f"no metric {cfg.metric}")


def tree_parents(x: Lists, cfg: EncodeConfig) -> np.ndarray:
    """Parents in the windowed minimum spanning forest; roots, the least of each component, are their own."""
    n = len(x.ptr) - 1
    a = np.concatenate([np.arange(n - o) for o in range(1, min(cfg.window, n - 1) + 1)] or [np.zeros(0, np.int64)])
    b = np.concatenate([np.arange(o, n) for o in range(1, min(cfg.window, n - 1) + 1)] or [np.zeros(0, np.int64)])
    w = pair_weights(x, a, b, cfg)
    order = np.lexsort((b, a, w))
    up, taken = list(range(n)), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s, t, size in zip(order.tolist(), a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True):
        s, t = find(s), find(t)
        if s != t:
            up[max(s, t)] = min(s, t)
            taken.append((i, size))
            if len(taken) == n - 1:
                break
    if cfg.forest_cut > 0 and taken:
        most = np.ceil(sorted(size for _, size in taken)[len(taken) // 2] * cfg.forest_cut)
        taken = [t for t in taken if t[1] <= most]
    near: list[list[int]] = [[] for _ in range(n)]
    for i, _ in taken:
        near[a[i]].append(int(b[i]))
        near[b[i]].append(int(a[i]))
    parent = [-1] * n
    for root in range(n):
        stack = [] if parent[root] >= 0 else [(root, root)]
        while stack:
            i, p = stack.pop()
            parent[i] = p
            stack += [(j, i) for j in near[i] if parent[j] < 0]
    return np.array(parent, dtype=np.int64)


def candidates(x: Lists, most: int, weighted: bool) -> np.ndarray:
    """Non-empty lists in the order of two projections, taken at dyadic places."""
    n = len(x.ptr) - 1
    w = np.log1p(x.vals) if weighted else np.ones(len(x.ids))
    z = [mix64(x.ids.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(s)).astype(float) / float(2**64 - 1) * 2 - 1 for s in (TEMPLATE_SEEDS if weighted else SUPPORT_SEEDS)]
    s = [np.round(np.bincount(x.owner, w * p, n), 6) for p in z]
    full = np.flatnonzero(x.sizes)
    full = full[np.lexsort((full, x.sizes[full], s[1][full], s[0][full]))]
    return full[dyadic_positions(len(full), most)] if len(full) else full


def chosen(base: np.ndarray, costs: list[np.ndarray], dictionary: np.ndarray) -> int:
    """How many templates cost least in all, fewer on ties."""
    total = np.minimum.accumulate(np.vstack([base, *costs]), axis=0).sum(1) + np.r_[0, np.cumsum(dictionary)]
    return int(np.argmin(total))


def log2_choose(most: int):
    lf = np.r_[0.0, np.cumsum(np.log2(np.arange(1, most + 1)))]

    def choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        ok = (k >= 0) & (k <= n) & (n >= 0)
        n, k = np.where(ok, n, 0), np.where(ok, k, 0)
        return lf[n] - lf[k] - lf[n - k]

    return choose


def row_form(x: Lists, width: int, cfg: EncodeConfig) -> tuple[dict, list[int], float]:
    """Streams, counts of the modes and the support bound. Row 0 is written whole; a later row as edits of an earlier parent (0), whole (1) or
    as edits of a template (2). Template edits are bounded by the template's own support."""
    n, codec = len(x.ptr) - 1, cfg.index_codec
    parent = tree_parents(x, cfg)
    at = np.arange(1, n)
    child = x.take(at)
    up = parent[1:]
    own = edits(x.take(up), child)
    refers = (up < at) & cfg.parent_refs & ~falls_back(own.count, child.sizes, cfg.ratio)
    cost = np.where(refers, own.cost(codec), list_cost(child, True, codec) + 2)
    mode, base_of, word = np.where(refers, 0, 1), up.copy(), np.zeros(n - 1, np.int64)
    words = x.take(np.zeros(0, np.int64))
    if cfg.adaptive and cfg.row_template_max and n > 1:
        pick = candidates(x, cfg.row_template_max, True)
        costs = [edits(x.take(np.full(n - 1, t)), child).cost(codec) + symbol_cost(np.array([k]), codec)[0] for k, t in enumerate(pick)]
        pick = pick[: chosen(cost, costs, list_cost(x.take(pick), True, codec) + 1)]
        words = x.take(pick)
        if len(pick):
            best = np.argmin(costs[: len(pick)], axis=0)
            better = np.min(costs[: len(pick)], axis=0) < cost
            mode, word, base_of = np.where(better, 2, mode), np.where(better, best, 0), np.where(better, pick[best], base_of)
    whole = mode == 1
    e = edits(x.take(base_of).where(~np.repeat(whole, x.sizes[base_of])), child.where(~np.repeat(whole, child.sizes)))
    full, root = child.where(np.repeat(whole, child.sizes)), x.take(np.arange(1))
    streams = {
        "offsets": np.where(up < at, at - up, 0), "root": root.gaps(), "root_vals": root.vals, "modes": mode, "wholes": np.where(whole, child.sizes, 0),
        "removes": e.removes.sizes, "adds": e.adds.sizes, "updates": e.updates.sizes, "words": words.sizes, "word_gaps": words.gaps(), "word_vals": words.vals, "word_ids": word[mode == 2],
        "whole_gaps": full.gaps(), "whole_vals": full.vals, "remove_gaps": e.removes.gaps(), "add_gaps": e.adds.gaps(), "add_vals": e.adds.vals, "update_gaps": e.updates.gaps(), "update_vals": e.updates.vals,
    }
    choose, base = log2_choose(width), x.sizes[base_of]
    by_edits = choose(base, e.removes.sizes) + choose(width - base, e.adds.sizes) + choose(base - e.removes.sizes, e.updates.sizes)
    bound = float(np.where(whole, choose(np.full(n - 1, width), child.sizes), by_edits).sum())
    return streams, np.bincount(mode, minlength=3).tolist(), bound


def column_form(x: Lists, height: int, cfg: EncodeConfig) -> tuple[dict, list[int], float]:
    """Each column's rows as they are (0), as edits of another column's (1) or of a template (2), the first of the cheapest; values in column order."""
    n, codec = len(x.ptr) - 1, cfg.index_codec
    x1 = replace(x, vals=np.ones_like(x.vals))
    at, full = np.arange(n), x.sizes > 0
    raw = np.where(full, list_cost(x1, False, codec), 0)
    parent = tree_parents(x, cfg) if cfg.column_refs else at
    has = full & (parent != at)
    delta = np.where(parent >= at, 2 * (parent - at), 2 * (at - parent) - 1)

    def change(base: Lists) -> np.ndarray:
        e = edits(base, x1)
        return list_cost(e.removes, False, codec) + list_cost(e.adds, False, codec) + 2

    ref = change(x1.take(parent)) + symbol_cost(delta, codec)
    by_ref = has & (ref < raw)
    mode, cost, base_of, word = by_ref.astype(np.int64), np.where(by_ref, ref, raw), parent.copy(), np.zeros(n, np.int64)
    pick = candidates(x1, max(cfg.column_template_max, cfg.column_templates) if cfg.adaptive else cfg.column_templates, False)
    if len(pick):
        costs = [np.where(full, change(x1.take(np.full(n, t))) + symbol_cost(np.array([k]), codec)[0], 0) for k, t in enumerate(pick)]
        if cfg.adaptive:
            pick = pick[: chosen(cost, costs, list_cost(x1.take(pick), False, codec))]
        if len(pick):
            best = np.argmin(costs[: len(pick)], axis=0)
            better = full & (np.min(costs[: len(pick)], axis=0) < cost)
            mode, word, base_of = np.where(better, 2, mode), np.where(better, best, 0), np.where(better, pick[best], base_of)
    words, plain = x1.take(pick), mode == 0
    e = edits(x1.take(base_of).where(~np.repeat(plain, x.sizes[base_of])), x1.where(~np.repeat(plain, x.sizes)))
    own = x1.where(np.repeat(plain, x.sizes))
    streams = {
        "modes": mode, "wholes": own.sizes, "whole_gaps": own.gaps(), "words": words.sizes, "word_gaps": words.gaps(), "word_ids": word[mode == 2], "refs": delta[mode == 1],
        "removes": e.removes.sizes, "adds": e.adds.sizes, "remove_gaps": e.removes.gaps(), "add_gaps": e.adds.gaps(), "vals": x.vals,
    }
    choose, base = log2_choose(height), x.sizes[base_of]
    bound = float(np.where(plain, choose(np.full(n, height), x.sizes), choose(base, e.removes.sizes) + choose(height - base, e.adds.sizes)).sum())
    return streams, np.bincount(mode, minlength=3).tolist(), bound


def packed(kind: str, form: tuple[dict, list[int], float], cfg: EncodeConfig, fallback: int = 0) -> dict:
    pack = entropy_encode if cfg.index_codec == "arithmetic" else vbyte_encode
    of = ROW_STREAMS if kind == "row" else COLUMN_STREAMS
    streams, modes, bound = form
    coded = {name: pack(v.tolist()) for name, v in streams.items() if len(v)}
    sizes = dict.fromkeys(CATEGORIES, 0) | {"meta": 4 if kind == "row" else 8}
    for name, raw in coded.items():
        sizes[of[name]] += len(raw)
    index = [v for name, v in streams.items() if of[name] == "ops" and len(v)]
    symbols = {int(s): int(c) for s, c in zip(*np.unique(np.concatenate(index), return_counts=True), strict=True)} if index else {}
    counted = dict(zip(MODES, (*modes, 0, 0, 0) if kind == "row" else (0, 0, 0, *modes), strict=True))
    return {"kind": kind, "streams": coded, **sizes, "bytes": sum(sizes.values()), **counted, "fallbacks": fallback, "bound_bits": bound, "symbols": symbols}


def smaller(kind: str, form, x: Lists, across: int, cfg: EncodeConfig) -> dict:
    """In adaptive mode the tile without it too; that is kept if it is strictly smaller."""
    best = packed(kind, form(x, across, cfg), cfg)
    if cfg.adaptive:
        plain = replace(cfg, adaptive=False)
        other = packed(kind, form(x, across, plain), plain, 1)
        best = other if other["bytes"] < best["bytes"] else best
    return best


def encode_tile(df: pd.DataFrame, cfg: EncodeConfig) -> pd.DataFrame:
    """One row: the smaller of a tile's two forms, rows on ties unless columns are preferred."""
    if not (cfg.rows or cfg.columns):
        raise ValueError("both forms of a tile are disabled")
    height, width = int(df.height.iloc[0]), int(df.width.iloc[0])
    pos, local, value = (df[c].to_numpy(np.int64) for c in ("pos", "local", "value"))
    row = smaller("row", row_form, lists(height, pos, local, value), width, cfg) if cfg.rows else None
    col = smaller("column", column_form, lists(width, local, pos, value), height, cfg) if cfg.columns else None
    by_rows = col is None or (row is not None and row["bytes"] + cfg.prefer_columns <= col["bytes"])
    out = row if by_rows else col
    return pd.DataFrame([{"cluster_id": int(df.cluster_id.iloc[0]), "block_id": int(df.block_id.iloc[0]), "height": height, "width": width, **out}])


class _Reader:
    """Takes gap lists and values from a tile's streams in order."""

    def __init__(self, streams: dict, cfg: EncodeConfig):
        unpack = entropy_decode if cfg.index_codec == "arithmetic" else vbyte_decode
        self.of, self.at = {k: unpack(bytes(v)) for k, v in streams.items()}, {}

    def all(self, name: str) -> list[int]:
        return self.of.get(name, [])

    def next(self, name: str, n: int) -> list[int]:
        at = self.at.get(name, 0)
        self.at[name] = at + n
        got = self.all(name)[at : at + n]
        if len(got) != n:
            raise ValueError(f"stream {name} is too short")
        return got

    def ids(self, name: str, n: int) -> list[int]:
        return np.cumsum(self.next(name, n)).tolist() if n else []

    def entries(self, gaps: str, vals: str, n: int) -> dict[int, int]:
        return dict(zip(self.ids(gaps, n), self.next(vals, n), strict=True))


def decode_rows(r: _Reader, height: int):
    words = [r.entries("word_gaps", "word_vals", n) for n in r.all("words")]
    rows = [r.entries("root", "root_vals", len(r.all("root")))]
    for i, (back, mode, whole, gone, new, changed) in enumerate(zip(*(r.all(s) for s in ("offsets", "modes", "wholes", "removes", "adds", "updates")), strict=True), 1):
        if mode == 1:
            row = r.entries("whole_gaps", "whole_vals", whole)
        else:
            row = dict(rows[i - back] if mode == 0 else words[r.next("word_ids", 1)[0]])
            for c in r.ids("remove_gaps", gone):
                del row[c]
            row |= r.entries("add_gaps", "add_vals", new)
            row |= r.entries("update_gaps", "update_vals", changed)
        rows.append(row)
    if len(rows) != height:
        raise ValueError(f"{len(rows)} rows decoded, {height} expected")
    return [(p, c, v) for p, row in enumerate(rows) for c, v in row.items()]


def decode_columns(r: _Reader, width: int):
    words = [set(r.ids("word_gaps", n)) for n in r.all("words")]
    modes = r.all("modes")
    if len(modes) != width:
        raise ValueError(f"{len(modes)} columns decoded, {width} expected")
    sets: list[set[int] | None] = [None] * width
    waits: dict[int, tuple[int, list[int], list[int]]] = {}
    for i, (mode, whole, gone, new) in enumerate(zip(modes, *(r.all(s) for s in ("wholes", "removes", "adds")), strict=True)):
        if mode == 0:
            sets[i] = set(r.ids("whole_gaps", whole))
            continue
        z = r.next("refs" if mode == 1 else "word_ids", 1)[0]
        lost, found = r.ids("remove_gaps", gone), r.ids("add_gaps", new)
        if mode == 2:
            sets[i] = (words[z] - set(lost)) | set(found)
        else:
            waits[i] = (i + ((z >> 1) ^ -(z & 1)), lost, found)
    for i in waits:
        chain = [i]
        while sets[chain[-1]] is None:
            chain.append(waits[chain[-1]][0])
            if len(chain) > width:
                raise ValueError("columns refer to each other in a circle")
        for j in reversed(chain[:-1]):
            p, lost, found = waits[j]
            sets[j] = (sets[p] - set(lost)) | set(found)
    vals = iter(r.all("vals"))
    return [(p, c, v) for c, s in enumerate(sets) for p, v in zip(sorted(s), vals, strict=False)]


def decode_tile(df: pd.DataFrame, cfg: EncodeConfig) -> pd.DataFrame:
    out = []
    for t in df.itertuples(index=False):
        r = _Reader(dict(t.streams), cfg)
        out += [(t.cluster_id, t.block_id, *e) for e in (decode_rows(r, t.height) if t.kind == "row" else decode_columns(r, t.width))]
    return pd.DataFrame(out, columns=["cluster_id", "block_id", "pos", "local", "value"]).astype("int64")
