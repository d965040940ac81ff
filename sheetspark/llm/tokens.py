"""Token ids of whole batches by a word-BPE tokenizer, each distinct piece of text tokenized once per worker.

The tokenizer drops white space and splits letters, single digits and runs of other signs before any merge, so text can
be cut at white space and between ASCII signs of different kinds without changing an id. Cuts are made on the byte
array; a cut piece is looked up by a 64-bit hash in a table that lives as long as the Python worker, and only pieces
not met before go through the tokenizer. Apostrophes (contractions) and characters outside Latin-1 letters (which may
combine or be signs) are never cut off their neighbours. Texts with the strings of special tokens go whole.
"""

from __future__ import annotations

import os

import numpy as np

from .text import BYTE_VALUE, SEPARATOR, mix, powers, segments

#: Bounds of a worker's table; a full one is started anew.
MAX_ENTRIES = 600_000
SLOTS = 1 << 21
#: Pieces given to the tokenizer at a time (its results are large objects).
AT_ONCE = 2000
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

_LETTER, _DIGIT, _SIGN, _GLUE = 1, 2, 3, 4
KIND = np.full(256, _GLUE, np.uint8)
KIND[:128] = _SIGN
KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
KIND[48:58] = _DIGIT
KIND[39] = _GLUE
KIND[SEPARATOR] = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """``ids(offsets, data)`` gives the token ids of every text as one array with bounds."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.values = np.zeros(SLOTS, np.int32)
        self.n = self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        slot = (h >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        out = np.where(self.keys[slot] == h, self.values[slot], -1)
        rest = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (SLOTS - 1)
            key = self.keys[slot]
            hit = key == h[rest]
            out[rest[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            rest, slot = rest[more], slot[more]
        return out

    def insert(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n = len(h)
        while self.n + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        lengths = np.fromiter(map(len, ids), np.int64, n)
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = [x for y in ids for x in y]
        self.start[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + n] = lengths
        entry = np.arange(self.n, self.n + n, dtype=np.int32)
        self.n += n
        self.used += total
        slot = (h >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        rest = np.arange(n)
        while len(rest):
            free = self.keys[slot[rest]] == 0
            _, first = np.unique(np.where(free, slot[rest], -1 - rest), return_index=True)
            put = rest[first[free[first]]]
            self.keys[slot[put]] = h[put]
            self.values[slot[put]] = entry[put]
            done = np.zeros(n, bool)
            done[put] = True
            rest = rest[~done[rest]]
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)

    def pieces(self, d: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a segment; ``first``: where documents start."""
        kind = KIND[d]
        lead = d == 0xC3  # Latin-1 letters, but for the multiplication and division signs
        if lead.any():
            at = np.flatnonzero(lead[:-1])
            at = at[(d[at + 1] != 0x97) & (d[at + 1] != 0xB7)]
            kind[at] = _LETTER
            kind[at + 1] = _LETTER
        cut = np.empty(len(d), bool)
        cut[0] = True
        a, b = kind[:-1], kind[1:]
        np.not_equal(a, b, out=cut[1:])
        cut[1:] &= ((a != _GLUE) & (b != _GLUE)) | (a == 0) | (b == 0)
        cut[1:] |= (a == _DIGIT) & (b == _DIGIT)
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(d))
        solid = kind[starts] != 0
        return starts[solid], ends[solid]

    def ids(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids and the bounds of each text (n + 1)."""
        if self.n > MAX_ENTRIES:
            self.reset()
        all_entries, all_starts = [], []
        raw = None
        for lo, hi in segments(data):
            d = data[lo:hi]
            first = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
            starts, ends = self.pieces(d, first)
            if not len(starts):
                continue
            up, down = powers(len(d))
            h = mix(np.add.reduceat(BYTE_VALUE[d] * up[: len(d)], starts) * down[starts]) | np.uint64(1)
            entry = self.lookup(h)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                _, at = np.unique(h[missing], return_index=True)
                fresh = missing[at]
                raw = d.tobytes()
                for k in range(0, len(fresh), AT_ONCE):
                    some = fresh[k : k + AT_ONCE]
                    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                    self.insert(h[some], [e.ids for e in self.encode(texts, add_special_tokens=False)])
                entry[missing] = self.lookup(h[missing])
            all_entries.append(entry)
            all_starts.append(starts + lo)
        if not all_entries:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        entry, starts = np.concatenate(all_entries), np.concatenate(all_starts)
        lengths = self.length[entry].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        bounds = before[np.searchsorted(starts, offsets)]
        flat = self.flat[np.repeat(self.start[entry] - before[:-1], lengths) + np.arange(before[-1])]
        return flat, bounds

    def of(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        flat, bounds = self.ids(offsets, data)
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        raw = data.tobytes()
        for literal in SPECIAL:
            at = raw.find(literal)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                at = raw.find(literal, int(offsets[i + 1]))
        return out


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
