"""Token ids of a public word-end BPE vocabulary, many texts at a time.

The tokenizer's own rules: normalise (NFC, lower case, white space dropped), cut into pre-tokens (contractions, runs of
letters, single digits, runs of other signs), then merge inside each pre-token. Merging depends on the pre-token alone, so
it is done once per distinct pre-token by the tokenizer itself, and texts are put together from those ids with numpy.
A text with a character outside Latin (or one whose lower case is two characters), or with the content of one of the
vocabulary's added tokens, is given to the tokenizer whole. A pre-token is known by a 64-bit hash of its characters.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from .vectext import chunks, mix, powers

LATIN = 0x250
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Letters after an apostrophe that belong to it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower, kind, plain = np.zeros(LATIN, np.uint32), np.zeros(LATIN, np.uint8), np.ones(LATIN, bool)
    for c in range(LATIN):
        low = chr(c).lower()
        plain[c] = len(low) == 1
        lower[c] = ord(low[0])
        category = unicodedata.category(low[0])[0]
        kind[c] = SPACE if low[0].isspace() and not 0x1C <= c <= 0x1F else LETTER if category == "L" else DIGIT if category == "N" else OTHER
    return lower, kind, plain


LOWERED, KIND, PLAIN = _tables()


class Encoder:
    """Ids of texts under the tokenizer file at ``path``; ids of up to ``keep`` recent pre-tokens are kept."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Add ids of new pre-tokens; h is sorted."""
        ids, sizes = [], []
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = np.array(got.word_ids, np.int64)
            n = np.bincount(of, minlength=len(some)) if len(of) else np.zeros(len(some), np.int64)
            if len(n) != len(some) or not n.all():
                each = [self.whole(x) for x in some]
                ids.append(np.concatenate(each))
                sizes.append(np.array([len(x) for x in each], np.int64))
            else:
                ids.append(np.array(got.ids, np.uint32))
                sizes.append(n)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.at = np.insert(self.at, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(flat)

    def chunk(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some rows one after another, and the n+1 row offsets into them."""
        n_rows = len(offs) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
        text = raw.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        offs = before[offs]
        wide = cp >= LATIN
        small = np.where(wide, 0, cp)
        odd = wide | ~PLAIN[small]
        low, kind = LOWERED[small], KIND[small]
        slow = np.zeros(n_rows, bool)
        if odd.any():
            slow[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = True
        lowered = text.lower()
        if any(x in lowered for x in self.added):
            slow |= [any(x in text[a:b].lower() for x in self.added) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        if slow.any():
            kind[np.repeat(slow, np.diff(offs))] = SPACE
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        start = np.ones(n + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start |= first
        for p in np.flatnonzero((low == 0x27) & start[:-1]).tolist():
            if p + 1 < n and not first[p + 1] and kind[p + 1] == LETTER:
                stop = p + 1
                while stop < min(n, p + 3) and not first[stop] and kind[stop] == LETTER:
                    stop += 1
                tail = "".join(map(chr, low[p + 1 : stop].tolist()))
                k = 1 if tail[0] in CONTRACTIONS else 2 if tail in CONTRACTIONS else 0
                if k:
                    start[p + 1], start[p + 1 + k] = False, True
        inside = kind != SPACE
        begin = np.flatnonzero(start[:-1] & inside)
        end = np.flatnonzero(inside & start[1:]) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = mix((total[end] - total[begin]) * down[begin])
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > self.keep:
            self.forget()
        k = np.searchsorted(self.known, uniq)
        k[k == len(self.known)] = 0
        new = np.flatnonzero(self.known[k] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            lowered = low.astype("<u4").tobytes().decode("utf-32-le")
            self.learn(uniq[new], [lowered[a:b] for a, b in zip(begin[at[new]].tolist(), end[at[new]].tolist())])
        k = np.searchsorted(self.known, uniq)
        where, size = self.at[k][inverse], self.size[k][inverse]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(where - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ptr = np.concatenate([[0], ends])[np.searchsorted(begin, offs)]
        if slow.any():
            rows = [self.whole(text[offs[r] : offs[r + 1]]) if slow[r] else ids[ptr[r] : ptr[r + 1]] for r in range(n_rows)]
            ids, ptr = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, ptr


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def rows_of_ids(texts: pa.Array, path: str, end_id: int | None):
    """(row, ids) of each text in order; end_id, if given, follows each text's ids."""
    enc = encoder(path)
    last = np.array([] if end_id is None else [end_id], np.uint32)
    for a, b, raw, offs in chunks(texts):
        ids, ptr = enc.chunk(raw, offs)
        for r in range(b - a):
            yield a + r, np.concatenate([ids[ptr[r] : ptr[r + 1]], last])
