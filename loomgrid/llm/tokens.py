"""Token ids of the public tokenizers, by way of a word table.

For a word-end BPE whose pre-tokenizer never crosses white space, a text's ids are its pieces' ids in a row. Texts of Latin
letters, digits and ASCII marks are cut into pieces by array operations on their bytes; pieces are looked up by a 64-bit hash
in a table of those seen before, and only new ones are merged, by a second BPE engine over the same ranks, with the word end
as a byte of its own that merges first. Any other text goes to the tokenizer itself. ``tests/llm`` holds both against each other.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

#: Slots of the word table (a power of two); at half of them it stops growing and later new words are merged anew each time.
SLOTS = 1 << 21
#: Code points that are cut at once.
BATCH = 1 << 19
_END = b"\x00"
_PLAIN = re.compile(r"[\t\n\r -&(-~À-ÖØ-öø-ÿ]*")
_BASE = 0x9E3779B97F4A7C15


def _unicode_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Tokens:
    """uint32 ids of each text, as the tokenizer gives them without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = None
        if spec["model"].get("end_of_word_suffix") == "</w>":
            self._build(spec["model"])

    def _build(self, model: dict) -> None:
        import tiktoken

        back, vocab = _unicode_bytes(), model["vocab"]
        of = {b: c for c, b in back.items()}
        ranks, ids = {bytes([i]): i for i in range(256)}, [vocab[of[i]] for i in range(256)]
        for i in range(1, 256):  # a byte and the word end merge before anything else
            ranks[bytes([i]) + _END] = len(ids)
            ids.append(vocab[of[i] + "</w>"])
        for pair in model["merges"]:
            joined = "".join(pair if isinstance(pair, list) else pair.split(" "))
            end = joined.endswith("</w>")
            ranks[bytes(back[c] for c in (joined[:-4] if end else joined)) + _END * end] = len(ids)
            ids.append(vocab[joined])
        self.ids = np.array(ids, dtype=np.uint32)
        self.ends = np.zeros(len(ids), dtype=bool)
        for k, i in ranks.items():
            self.ends[i] = k.endswith(_END) and len(k) > 1
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.kind = np.full(256, 3, dtype=np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
        self.kind[[9, 10, 13, 32]] = 0
        self.kind[[*range(97, 123), *range(128, 256)]] = 1
        self.kind[48:58] = 2
        n = 2 * BATCH + 64
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.key, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.held = np.zeros(0, np.uint32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the empty one where it belongs."""
        slot = (h >> np.uint64(43)).astype(np.int64) & (SLOTS - 1)
        open_ = np.flatnonzero((self.key[slot] != h) & (self.key[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            open_ = open_[(self.key[slot[open_]] != h[open_]) & (self.key[slot[open_]] != 0)]
        return slot

    def _insert(self, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        while len(h):
            slot = self._slots(h)
            _, first = np.unique(slot, return_index=True)
            self.key[slot[first]], self.at[slot[first]], self.size[slot[first]] = h[first], at[first], size[first]
            rest = np.ones(len(h), dtype=bool)
            rest[first] = False
            h, at, size = h[rest], at[rest], size[rest]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts).lower().encode()
        a = np.frombuffer(joined, dtype=np.uint8)
        kind = self.kind[a]
        edge = np.r_[True, (kind[1:] != kind[:-1])] | (kind == 2) if len(a) else np.zeros(0, bool)
        starts = np.flatnonzero(edge & (kind != 0))
        cuts = np.r_[np.flatnonzero(edge), len(a)]
        stops = cuts[np.searchsorted(cuts, starts, side="right")] if len(starts) else starts
        sums = np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], dtype=np.uint64)]
        h = (sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
        slot = self._slots(h)
        known = self.key[slot] == h
        at, size, pool = self.at[slot], self.size[slot].astype(np.int64), self.pool
        new = np.flatnonzero(~known)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            pieces = [joined[i:j] for i, j in zip(starts[new[first]].tolist(), stops[new[first]].tolist(), strict=True)]
            got = np.array(self.fast.encode_ordinary((_END.join(pieces) + _END).decode()), dtype=np.int64)
            ends = np.flatnonzero(self.ends[got]) + 1
            begin = np.r_[0, ends[:-1]]
            pool = np.concatenate([pool, self.ids[got]])
            at[new], size[new] = (begin + len(self.pool))[back], (ends - begin)[back]
            if self.held + len(first) <= SLOTS // 2:
                self._insert(h[new[first]], begin + len(self.pool), ends - begin)
                self.pool, self.held = pool, self.held + len(first)
        total = np.cumsum(size)
        out = pool[np.repeat(at - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        lengths = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        pieces_before = np.searchsorted(starts, np.cumsum(lengths))
        return np.split(out, np.r_[0, total][pieces_before][:-1]) if len(texts) > 1 else [out]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if len(t) <= BATCH and "<|" not in t and _PLAIN.fullmatch(t)] if self.fast else []
        out: list[np.ndarray] = [None] * len(texts)
        some, chars = [], 0
        for i in [*plain, None]:
            if i is None or chars + len(texts[i]) + len(some) > BATCH:
                for j, x in zip(some, self._plain([texts[j] for j in some]) if some else [], strict=True):
                    out[j] = x
                some, chars = [], 0
            if i is not None:
                some.append(i)
                chars += len(texts[i])
        for i, x in enumerate(out):
            if x is None:
                out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


def tokens(path: str) -> Tokens:
    """One instance a path and process, kept outside this module, whose functions travel by value."""
    held = sys.modules.setdefault("_held_tokenizers", types.ModuleType("_held_tokenizers")).__dict__
    if path not in held:
        held[path] = Tokens(path)
    return held[path]
