"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (its lower-case pieces, and single bytes so
that every word can be spelt). A word's probability is the sum over all ways to cut it into pieces, found by a forward
pass; piece probabilities are fitted by expectation-maximisation with the forward-backward counts of the same sums. A
text's score in a language is the sum of its words' log probabilities, over the whole text.

Training reads a bounded sample of labelled rows: about ``train_docs`` rows of each language, drawn at random with a fixed
seed; their whole texts are counted on the executors, and the expectation steps run there too. What reaches the driver is
one count per piece and language. Predictions cover every row.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows of null language teach nothing; if no
row teaches, every text is ``und``, and an empty table gives no rows; ties go to the language that sorts first; repeated rows
teach as often as they are drawn. Very long texts and words are summed whole, in training too. Pieces with capitals never occur, since texts are lower-cased first. Columns other
than the named ones are carried by ``keep_known`` and not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, with_fields
from .vectext import BASE, chunks, find_words, mix, powers

UNDETERMINED = "und"
#: Bytes of a word in one lattice; longer ones are summed with rescaling. Thirty-three factors of at least FLOOR stay far above the least float.
LONGEST = 32
FLOOR = 1e-8
#: The byte that stands for the vocabulary's mark of a word's beginning.
MARK = 1


class Pieces:
    """The vocabulary as byte strings: hashes sorted for lookup, ``rank`` giving the piece's number."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i)
                if piece == piece.lower():
                    found.add(piece.replace("▁", chr(MARK)).encode())
        self.all = sorted(p for p in found if p)
        self.longest = max(map(len, self.all))
        data = np.frombuffer(b"".join(self.all), np.uint8)
        ends = np.cumsum([len(p) for p in self.all])
        starts = ends - [len(p) for p in self.all]
        up, down = powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = mix((total[ends] - total[starts]) * down[starts])
        order = np.argsort(h)
        self.hashes, self.rank = h[order], order
        size = 1 << 20
        self.bits = np.zeros(size, bool)
        self.bits[(self.hashes & np.uint64(size - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.all)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or len(self)."""
        out = np.full(h.shape, len(self.all), np.int64)
        at = np.flatnonzero(self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)])
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        hit = self.hashes[k] == h[at]
        out[at[hit]] = self.rank[k[hit]]
        return out


def padded(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words as rows of bytes, with the mark before each."""
    wide = int(size.max(initial=0)) + 1
    at = start[:, None] + np.arange(-1, wide - 1)
    inside = np.arange(wide) <= size[:, None]
    out = np.where(inside, low[np.clip(at, 0, max(0, len(low) - 1))] if len(low) else 0, 0).astype(np.uint8)
    out[:, 0] = MARK
    return out


class Lattice:
    """All cuts of some words into pieces. Words come longest first; ``ids[e][k]`` are the pieces of k bytes that end at e."""

    def __init__(self, pieces: Pieces, rows: np.ndarray, size: np.ndarray):
        self.pieces, self.size = pieces, size + 1
        up, down = powers(rows.shape[1] + 1)
        total = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]], axis=1, out=total[:, 1:])
        self.ids: list[list[np.ndarray]] = [[]]
        self.live = [len(rows)]
        for e in range(1, rows.shape[1] + 1):
            n = int(np.searchsorted(-self.size, -e, "right"))  # words of at least e bytes
            self.live.append(n)
            self.ids.append([pieces.find(mix((total[:n, e] - total[:n, e - k]) * down[e - k])) for k in range(1, min(e, pieces.longest) + 1)])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, bytes so far, language]; p[piece, language] ends with a row of zeros for no piece."""
        alpha = np.zeros((self.live[0], len(self.ids), p.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, len(self.ids)):
            n = self.live[e]
            for k, ids in enumerate(self.ids[e], 1):
                hit = np.flatnonzero(ids < len(p) - 1)
                alpha[hit, e] += alpha[hit, e - k] * p[ids[hit]]
        return alpha

    def total(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[np.arange(self.live[0]), self.size]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts[word, language]."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.live[0]), self.size] = 1
        z = alpha[np.arange(self.live[0]), self.size]
        share = counts / np.maximum(z, 1e-300)
        out = np.zeros((len(self.pieces) + 1, p.shape[1]))
        for e in range(len(self.ids) - 1, 0, -1):
            for k, ids in enumerate(self.ids[e], 1):
                hit = np.flatnonzero(ids < len(p) - 1)
                q = p[ids[hit]]
                back = q * beta[hit, e]
                beta[hit, e - k] += back
                uses = alpha[hit, e - k] * back * share[hit]
                for j in range(p.shape[1]):
                    out[:, j] += np.bincount(ids[hit], uses[:, j], len(out))
        return out[:-1]


def long_blocks(size: np.ndarray):
    """Places of the words of over LONGEST bytes, longest first, in blocks of half a million bytes or one word."""
    long = np.flatnonzero(size > LONGEST)
    long, a = long[np.argsort(-size[long], kind="stable")], 0
    while a < len(long):
        own = long[a : a + max(1, min(4096, 500_000 // int(size[long[a]])))]
        yield own
        a += len(own)


def lattices(pieces: Pieces, low: np.ndarray, start: np.ndarray, size: np.ndarray, n_langs: int):
    """(places, lattice) of blocks of words, longest first; a block's arrays take some 50 MB at most."""
    order = np.argsort(-size, kind="stable")
    block = max(64, 1_500_000 // ((LONGEST + 2) * max(1, n_langs)))
    for a in range(0, len(order), block):
        own = order[a : a + block]
        yield own, Lattice(pieces, padded(low, start[own], size[own]), size[own])


def long_words(pieces: Pieces, p: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log P of words of any length, longest first, in each language: forward sums of the last few bytes, rescaled as they go."""
    rows, most = padded(low, start, size), pieces.longest
    up, down = powers(rows.shape[1] + 1)
    total = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]], axis=1, out=total[:, 1:])
    ring, logs = np.zeros((most, len(rows), p.shape[1])), np.zeros((len(rows), p.shape[1]))
    ring[0] = 1
    n = len(rows)
    for e in range(1, rows.shape[1] + 1):
        k = np.arange(1, min(e, most) + 1)
        ids = pieces.find(mix((total[:n, e, None] - total[:n, e - k]) * down[e - k]).ravel()).reshape(n, len(k))
        alpha = (p[ids] * ring[(e - k) % most, :n].transpose(1, 0, 2)).sum(axis=1)
        if e % 8 == 0:
            ring[:, :n] /= alpha
            logs[:n] += np.log(alpha)
            alpha[:] = 1
        ring[e % most, :n] = alpha
        left = int(np.searchsorted(-size, -e, "right"))  # words that go on, counted with the mark
        logs[left:n] += np.log(alpha[left:])
        n = left
    return logs


def long_expected(pieces: Pieces, p: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language by words of any length, longest first; counts[word, language].

    Forward sums are kept as logarithms. Backwards goes what share of a word's uses passes through each place: that of a place
    is dealt to the pieces that end there, by their share of the sum, so no sum of what follows is needed.
    """
    rows, most = padded(low, start, size), pieces.longest
    wide, n_langs = rows.shape[1], p.shape[1]
    up, down = powers(wide + 1)
    total = np.zeros((len(rows), wide + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[:wide], axis=1, out=total[:, 1:])

    def ending(e: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """How many words have e bytes (the mark is one); word, length and number of each piece that ends there. One byte always is a piece."""
        n, k = int(np.searchsorted(-size, 1 - e, "right")), np.arange(1, min(e, most) + 1)
        ids = pieces.find(mix((total[:n, e, None] - total[:n, e - k]) * down[e - k]).ravel()).reshape(n, len(k))
        w, at = np.nonzero(ids < len(p) - 1)
        return n, w, at + 1, ids[w, at]

    log_p, logs = np.log(p[:-1]), np.zeros((len(rows), wide + 1, n_langs))
    for e in range(1, wide + 1):
        n, w, k, ids = ending(e)
        terms, first = log_p[ids] + logs[w, e - k], np.flatnonzero(np.diff(w, prepend=-1))
        top = np.maximum.reduceat(terms, first, axis=0)
        logs[:n, e] = top + np.log(np.add.reduceat(np.exp(terms - top[w]), first, axis=0))
    through = np.zeros((most + 1, len(rows), n_langs))  # of a place and the ``most`` before it
    out = np.zeros((len(p), n_langs))
    for e in range(wide, 0, -1):
        n, w, k, ids = ending(e)
        now = through[e % (most + 1)]
        now[:n][size[:n] + 1 == e] = 1
        uses = now[w] * np.exp(log_p[ids] + logs[w, e - k] - logs[w, e])
        now[:] = 0
        through[(e - k) % (most + 1), w] += uses  # each pair of word and length comes once
        for j in range(n_langs):
            out[:, j] += np.bincount(ids, uses[:, j] * counts[w, j], len(out))
    return out[:-1]


@dataclass
class Model:
    """Languages in order, and log-free piece probabilities p[piece, language] with a last row of zeros."""

    langs: list[str]
    p: np.ndarray
    vocabulary: str


class Scorer:
    """Word scores of a model, with those of recent words kept: at most ``keep`` words."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep, self.pieces = model, keep, Pieces(model.vocabulary)
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def words(self, h: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log P of distinct words with sorted hashes h."""
        n = len(self.model.langs)
        out = np.empty((len(h), n))
        k = np.searchsorted(self.known, h)
        k[k == len(self.known)] = 0
        have = self.known[k] == h if len(self.known) else np.zeros(len(h), bool)
        out[have] = self.scores[k[have]]
        new = np.flatnonzero(~have)
        if len(new):
            s, size = start[new], end[new] - start[new]
            short = np.flatnonzero(size <= LONGEST)
            for own, lattice in lattices(self.pieces, low, s[short], size[short], n):
                out[new[short[own]]] = np.log(np.maximum(lattice.total(self.model.p), 1e-300))
            for own in long_blocks(size):
                out[new[own]] = long_words(self.pieces, self.model.p, low, s[own], size[own])
            if len(self.known) + len(new) > self.keep:
                self.known, self.scores = h, out
            else:
                at = np.searchsorted(self.known, h[new])
                self.known, self.scores = np.insert(self.known, at, h[new]), np.insert(self.scores, at, out[new], axis=0)
        return out

    def texts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log P of each text in each language."""
        w = find_words(raw, offs)
        out = np.zeros((len(offs) - 1, len(self.model.langs)))
        if len(w):
            h, first, inverse = np.unique(w.h, return_index=True, return_inverse=True)
            s = self.words(h, w.low, w.start[first], w.end[first])
            row = w.row
            for j in range(out.shape[1]):
                out[:, j] = np.bincount(row, s[inverse, j], len(out))
        return out


def train(docs: DataFrame, allowed: Column, vocabulary: str, *, text_col: str = "text", lang_col: str = "lang", train_docs: int = 600, rounds: int = 3, smooth: float = 0.05, seed: int = 17) -> Model:
    """Fit on about ``train_docs`` rows of each language among the rows that are ``allowed`` and have a language."""
    labelled = docs.filter(allowed & col(lang_col).isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy(col(lang_col).alias("lang")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0)), vocabulary)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    sample = labelled.filter(F.rand(seed) < F.element_at(share, col(lang_col))).select(col(lang_col).alias("lang"), col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            lowered = pc.utf8_lower(batch.column(1).cast(pa.large_string()))
            for a, b, raw, offs in chunks(lowered):
                w = find_words(raw, offs)
                tags = batch.column(0).slice(a, b - a).to_pylist()
                index = np.array([langs.index(t) for t in tags], np.uint64)[w.row] if len(w) else np.zeros(0, np.uint64)
                key, first, n = np.unique(w.h * np.uint64(2 * len(langs) + 1) + index, return_index=True, return_counts=True)
                words = [w.low[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace") for i in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(index[first].astype(np.int32)), pa.array(words, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-words")
    v, n_langs = len(Pieces(vocabulary)), len(langs)
    p = np.vstack([np.full((v, n_langs), 1 / v), np.zeros((1, n_langs))])
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(p)

        def expect(batches):
            pieces, total = Pieces(vocabulary), np.zeros((v, n_langs))
            for batch in batches:
                for a, b, raw, offs in chunks(batch.column("word")):
                    start, end = offs[:-1], offs[1:]
                    n = np.zeros((b - a, n_langs))
                    n[np.arange(b - a), batch.column("lang").slice(a, b - a).to_numpy()] = batch.column("n").slice(a, b - a).to_numpy()
                    size = end - start
                    short = np.flatnonzero(size <= LONGEST)
                    for own, lattice in lattices(pieces, raw, start[short], size[short], n_langs):
                        total += lattice.expected(held.value, n[short[own]])
                    for own in long_blocks(size):
                        total += long_expected(pieces, held.value, raw, start[own], size[own], n[own])
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["piece", "lang", "uses"])

        got = counts.mapInArrow(expect, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full((v, n_langs), smooth)
        uses[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("uses").to_numpy()
        p[:-1] = np.maximum(uses / uses.sum(axis=0), FLOOR)
    return Model(langs, p, vocabulary)


def _predict(scorer: Scorer | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the language's number, -1 for undetermined, and the posterior under equal priors."""
    texts = texts.cast(pa.large_string())
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if scorer is None:
        return best, score
    for a, b, raw, offs in chunks(pc.utf8_lower(texts)):
        ll = scorer.texts(raw, offs)
        top = ll.argmax(axis=1)
        post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
        ok = lettered[a:b]
        best[a:b][ok], score[a:b][ok] = top[ok], post[ok]
    return best, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = with_fields(docs.select(col(id_col)), "lang_pred string, score double")

    def run(batches):
        scorer = Scorer(held.value) if held.value.langs else None
        names = np.array([*held.value.langs, UNDETERMINED], object)
        for batch in batches:
            best, score = _predict(scorer, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=schema.names)

    return src.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input's rows and columns without those it rejects: undetermined texts, and those whose language's posterior is below ``least``."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(held.value) if held.value.langs else None
        for batch in batches:
            best, score = _predict(scorer, batch.column(at))
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
