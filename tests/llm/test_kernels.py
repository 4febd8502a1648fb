import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sealcol.llm import binpack, langid, licenses, packing, quality, substring
from sealcol.llm.ngram_join import depth_for, links_within, measured_recall
from sealcol.llm.queries import vocabulary
from sealcol.llm.tokens import Encoder
from sealcol.llm.vectext import buffers, chunks, find_words, windows

from .fixtures import words

TEXT = st.text(alphabet=st.sampled_from(list("abzAZ019 .,'\n\t-éÉßñ日\x00\x7f")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = find_words(*buffers(pa.array(texts, pa.string())))
    got = [[w.low[a:b].tobytes().decode() for a, b in zip(w.start[s:e], w.end[s:e])] for s, e in zip(w.ptr[:-1], w.ptr[1:])]
    assert got == [words(t) for t in texts]
    by_word = {}
    for h, word in zip(w.h.tolist(), [x for own in got for x in own]):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_windows_stay_inside_rows(texts, n):
    w = find_words(*buffers(pa.array(texts, pa.string())))
    at, g = windows(w, n)
    want = [tuple(own[i : i + n]) for own in map(words, texts) for i in range(len(own) - n + 1)]
    assert len(at) == len(want)
    assert len(set(zip(want, g.tolist()))) == len(set(want))


def test_chunks_cover_all_rows():
    texts = pa.array(["a" * n for n in (0, 5, 3, 100, 0, 1)])
    parts = list(chunks(texts, 8))
    assert [r for a, b, _, _ in parts for r in range(a, b)] == list(range(6))
    assert b"".join(x[2].tobytes() for x in parts) == b"a" * 109


def test_encoder_is_the_tokenizer():
    enc = Encoder(vocabulary("word_bpe_49k.json"), keep=50)
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x250)] + list(" '''sstremvld  abc12") * 20
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["it's 'tis we'll don't''s x'very", "", "日本 abc", "İstanbul", "<|endoftext|> a", "b<|STARTOFTEXT|> c <|startoftext|>"]
    raw, offs = buffers(pa.array(texts))
    ids, ptr = enc.chunk(raw, offs)
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_segmentation_sums_match_recursion():
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(pieces), 2)) / 100, np.zeros((1, 2))])
    known = {x: p[i] for i, x in enumerate(pieces.all)}

    def total(word):
        if not word:
            return np.ones(2)
        return sum((known[word[:k]] * total(word[k:]) for k in range(1, min(len(word), pieces.longest) + 1) if word[:k] in known), np.zeros(2))

    raw = np.frombuffer("thethenñandoxq".encode(), np.uint8)
    start, end = np.array([0, 3, 7]), np.array([3, 7, len(raw)])
    got = np.empty((3, 2))
    for own, lattice in langid.lattices(pieces, raw, start, end - start, 2):
        got[own] = lattice.total(p)
    want = [total(b"\1" + raw[a:b].tobytes()) for a, b in zip(start, end)]
    assert np.allclose(got, want)


def test_expected_counts_are_those_of_all_cuts():
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    p = np.vstack([np.full((len(pieces), 1), 0.01), np.zeros((1, 1))])
    raw = np.frombuffer(b"then", np.uint8)
    ((own, lattice),) = list(langid.lattices(pieces, raw, np.array([0]), np.array([4]), 1))
    known = set(pieces.all)

    def cuts(w):
        return [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in known for rest in cuts(w[k:])] if w else [[]]

    weight, all_cuts = Counter(), cuts(b"\1then")
    z = sum(0.01 ** len(c) for c in all_cuts)
    for c in all_cuts:
        for x in c:
            weight[x] += 0.01 ** len(c) / z
    got = lattice.expected(p, np.ones((1, 1)))[:, 0]
    assert {pieces.all[i]: round(got[i], 9) for i in np.flatnonzero(got)} == {k: round(v, 9) for k, v in weight.items()}


def test_prefix_shortens_until_recall():
    assert depth_for(0.8, 0.9995, 16, 8) == 4
    assert depth_for(0.8, 0.5, 16, 8) == 8
    assert depth_for(0.5, 0.999999, 2, 8) == 1
    assert measured_recall({}, 8, 0.8, 16, 8) == 0
    assert measured_recall({128: 10**6}, 8, 0.8, 16, 8) > 0.9999999
    assert 0.94 < measured_recall({103: 10**6, 60: 10**9}, 8, 0.8, 16, 8) < 0.96


def test_blockwise_links_are_all_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(60, 50).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    own = np.arange(len(sets)) % 3
    total = np.zeros(len(sets), int)
    for i in range(3):
        for j in range(i, 3):
            total += links_within(sets, np.flatnonzero(own == i), np.flatnonzero(own == j), 0.5)[0]
    brute = [sum(len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) and len(a) > 0 for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    assert total.tolist() == brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = binpack.best_fit_decreasing(sizes, 100)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    # the plain rule: the fullest open row that still has room
    loads = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, x in enumerate(loads) if x + s <= 100]
        if fit:
            loads[max(fit, key=lambda i: loads[i])] += s
        else:
            loads.append(s)
    assert sorted(sum(sizes[i] for i in r) for r in rows) == sorted(loads)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 700), st.integers(0, 3)), max_size=40))
def test_packer_keeps_limits_and_every_id(examples):
    limits = packing.Limits(tokens=256, segments=5, loss=180)
    packer, out = packing.Packer(limits, pool=12), []
    for k, (n, every) in enumerate(examples):
        bears = np.arange(n) % (every + 1) == 0
        ids = np.arange(n, dtype=np.uint32) + 1000 * k
        out += packer.add(packing.Part(k, 0, n, ids, np.concatenate([[0], np.cumsum(bears)]).astype(np.int32)))
    out += packer.finish()
    for row in out:
        assert sum(len(p.ids) for p in row) <= 256 and len(row) <= 5 and sum(p.loss for p in row) <= 180
    for k, (n, _) in enumerate(examples):
        parts = sorted((p for row in out for p in row if p.key == k), key=lambda p: p.start)
        assert np.array_equal(np.concatenate([p.ids for p in parts]), np.arange(n) + 1000 * k)


def test_chains_follow_order_and_pay_for_gaps():
    p = np.array([0, 5, 10, 15, 400, 406, 412])
    r = np.array([100, 105, 110, 115, 20, 26, 32])
    assert sorted(substring.chain(p, r)) == [(0, 23, 100, 123), (400, 420, 20, 40)]
    assert substring.chain(np.array([0, 200]), np.array([0, 200])) == []
    mixed = substring.chain(np.array([0, 4, 8, 12]), np.array([50, 9, 58, 62]))
    assert mixed[0] == (0, 20, 50, 70)


def test_edits_are_insertions_and_deletions():
    assert substring.edits(list("kitten"), list("kitten"), 3) == 0
    assert substring.edits(list("abcdef"), list("abxdef"), 5) == 2
    assert substring.edits(list("abc"), list("xyz"), 3) == 4


def test_license_overlaps_are_resolved():
    d = licenses.Detection
    long, short, other = d(0, 6, "gpl-3.0", 3, 0.9), d(1, 4, "gpl", 1, 0.6), d(5, 8, "mit", 1, 0.6)
    assert licenses.resolve([short, other, long]) == [long, other]
    assert licenses.resolve([short, short]) == [short]
    assert len(licenses.rules()) > 300
    assert all(any(w in r.pattern for w in (r.keyword,)) for r in licenses.rules())


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    net = quality.fit(x[:2400], y[:2400])
    p = net.probability(x[2400:])
    assert ((p > 0.5) == y[2400:]).mean() > 0.7
    assert abs(p.mean() - y[2400:].mean()) < 0.08
    assert quality.fit(x[:5], np.ones(5)).probability(x[:3]).min() > 0.99
    assert quality.fit(np.zeros((0, 8)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_shapes_tell_case_signs_and_repeats():
    def of(t):
        h, _ = quality.shapes(*buffers(pa.array([t])))
        return h.tolist()

    assert of("aa bb")[0] == of("xyzzy q")[0]
    assert of("aa")[0] != of("AA")[0] != of("aa!!")[0]
    assert of("foo foo")[1] != of("foo bar")[1]
    assert of("") == []


@pytest.mark.parametrize("n", [50, 51, 65, 66, 200])
def test_winnow_has_a_seed_in_every_window(n):
    h = np.concatenate([np.random.default_rng(n).integers(0, 1 << 60, n).astype(np.uint64), np.full(n, 7, np.uint64)])
    ptr = np.array([0, n, n, 2 * n])
    at = substring.winnow(substring.Runs(h).all(35), ptr, 35, 16)
    for a, b in ((0, n), (n, 2 * n)):
        assert all(np.any((at >= i) & (at < i + 16)) for i in range(a, b - 49))
        assert not np.any((at > b - 35) & (at < b))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 35])
def test_runs_of_words(n):
    h = np.array([1, 2, 3, 1, 2, 3] * 12, np.uint64)
    g = substring.Runs(h).all(n)
    assert np.array_equal(substring.Runs(h).at(np.arange(5), n), g[:5])
    assert len(g) == len(h) - n + 1 and len(set(g[:3].tolist())) == 3 and np.array_equal(g[3:], g[:-3])
    assert np.array_equal(substring.running(h, n, np.maximum), [h[i : i + n].max() for i in range(len(h) - n + 1)])


DETECTIONS = st.lists(st.builds(lambda a, n, label, p: licenses.Detection(a, a + n, label, p, 0.5), st.integers(0, 12), st.integers(1, 6), st.sampled_from("xyz"), st.integers(1, 3)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(DETECTIONS)
def test_resolve_matches_all_against_all(found):
    def beaten(d):
        return any(k.start <= d.start and d.end <= k.end and k.priority >= d.priority and ((k.start, k.end) != (d.start, d.end) or k.priority > d.priority) for k in found)

    assert licenses.resolve(found) == sorted({d for d in found if not beaten(d)}, key=lambda d: (d.start, d.end, d.label))


def test_many_license_mentions_take_time_in_proportion():
    scanner = licenses.Scanner()
    w = licenses._words_of([b"the mit license and x; " * 100_000])
    began = time.perf_counter()
    assert len(scanner.detections(w)[0]) == 100_000 and len(scanner.places(w)) == 100_000
    assert time.perf_counter() - began < 15


def test_signatures_hold_their_keywords():
    order = licenses.rules()
    assert len({r.pattern for r in order}) == len(order) > 400
    assert all(r.keyword in r.pattern for r in order)


def test_long_words_are_summed_over_all_cuts():
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    p = np.vstack([np.maximum(rng.random((len(pieces), 2)) / len(pieces), 1e-8), np.zeros((1, 2))])
    number = {x: i for i, x in enumerate(pieces.all)}
    texts = ["donaudampfschifffahrtsgesellschaft" * 5, "这是一个很长的句子没有空格所以它是一个词", "a" * 300, "short", "x" * 33]
    raw, offs = buffers(pa.array(texts))
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    got = langid.long_words(pieces, p, raw, offs[:-1][order], size[order])
    for i, r in enumerate(order.tolist()):
        word = bytes([langid.MARK]) + texts[r].encode()
        alpha = [np.zeros(2)] + [np.full(2, -np.inf)] * len(word)
        for e in range(1, len(word) + 1):
            terms = [alpha[e - k] + np.log(p[number[word[e - k : e]]]) for k in range(1, min(e, pieces.longest) + 1) if word[e - k : e] in number]
            alpha[e] = np.logaddexp.reduce(terms, axis=0)
        assert np.allclose(got[i], alpha[-1])
    scorer = langid.Scorer(langid.Model(["a", "b"], p, vocabulary("piece_bpe_32k.model")))
    both = scorer.words(np.arange(5, dtype=np.uint64), raw, offs[:-1], offs[1:])
    assert np.allclose(both[order], got)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_window_set_in_flat_arrays(monkeypatch, bits):
    """Hits and items as by plain comparison, also where many windows share a hash; ten bytes a byte of text or so."""
    import pyarrow as pa

    from sealcol.llm import decontaminate as D
    from sealcol.llm.vectext import buffers, find_words, windows

    from .fixtures import prose, words

    mask = np.uint64((1 << bits) - 1)
    monkeypatch.setattr(D, "windows", lambda w, n: (lambda at, g: (at, g & mask))(*windows(w, n)))
    items = [prose(i % 9, 6 + i % 9) for i in range(40)] + ["", None, "ka", "KA", prose(3, 60)]
    ids = [str(i) for i in range(len(items))]
    known = D.WindowSet(ids, pa.array(items, pa.string()), 8)
    docs = [prose(i % 9, 80) + " ka " + prose(100 + i, 30) for i in range(12)] + ["", "lo ka", prose(3, 59)]
    w = find_words(*buffers(pa.array(docs)))
    hit, found = known.scan(w)
    for r, text in enumerate(docs):
        own, want, of = words(text), [False] * len(words(text)), set()
        for i, item in enumerate(items):
            x = words(item)
            m = min(8, len(x))
            runs = {tuple(x[a : a + m]) for a in range(len(x) - m + 1)} if m else set()
            for a in range(len(own) - m + 1):
                if m and tuple(own[a : a + m]) in runs:
                    want[a : a + m] = [True] * m
                    of.add(ids[i])
        assert hit[w.ptr[r] : w.ptr[r + 1]].tolist() == want and found.get(r, set()) == of


def test_window_set_is_small():
    import pyarrow as pa

    from sealcol.llm.decontaminate import BROADCAST_BYTES, WindowSet

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 40)) for _ in range(4000)]
    size = sum(map(len, texts))
    assert WindowSet([str(i) for i in range(len(texts))], pa.array(texts), 10).size * BROADCAST_BYTES / size < 150e6
