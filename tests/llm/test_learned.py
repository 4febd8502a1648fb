"""The trained operators against slow, plain versions of their training and their scores, on small tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealcol.llm import langid, quality
from sealcol.llm.queries import vocabulary
from sealcol.llm.vectext import buffers

from .fixtures import corpus, frame, prose, words

PIECES = "piece_bpe_32k.model"


def shaped(text):
    """(shape, whether the string before is the same) of each white-space separated string."""
    out, before = [], None
    for raw in re.findall(rb"[^\x09-\x0d\x20]+", (text or "").encode()):
        kinds = ["a" if 0x61 <= c <= 0x7A or c >= 0x80 else "A" if 0x41 <= c <= 0x5A else "0" if 0x30 <= c <= 0x39 else f"={c}" for c in raw]
        out.append((tuple(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]), raw == before))
        before = raw
    return out


class Rows:
    """The table row of a token, asked for by itself."""

    def __init__(self):
        self.known = {}

    def word(self, w):
        if w not in self.known:
            self.known[w] = int(quality.streams(*buffers(pa.array([w])))[0][0][0])
        return self.known[w]

    def shape(self, kinds, again):
        if (kinds, again) not in self.known:
            one = "".join({"a": "k", "A": "K", "0": "7"}.get(k) or chr(int(k[1:])) for k in kinds)
            text = f"{one} {one}" if again else one
            self.known[kinds, again] = int(quality.streams(*buffers(pa.array([text])))[1][0][-1])
        return self.known[kinds, again]

    def of(self, text):
        return [[self.word(w) for w in words(text)], [self.shape(*s) for s in shaped(text)]]


@pytest.fixture(scope="module")
def marked():
    """(doc_id, text) and labels: what has digits in it is of class 0."""
    rows = corpus() + [(1000 + i, prose(i, 30) if i % 2 else prose(i, 10) + " 12 A-7, 7 7 " + prose(i, 9)) for i in range(80)]
    return rows, [(1000 + i, i % 2) for i in range(80)] + [(None, 1), (1001, None), (5000, 1)]


def test_word_vectors_and_pools_equal_plain_sums(spark, marked):
    rows, known = marked[0], Rows()
    places, signs = quality.index_vectors()
    index = np.zeros((quality.STREAMS * quality.BUCKETS, quality.DIMS))
    for r, at in enumerate(places):
        index[r, at] = signs
    table = np.zeros_like(index)
    for _, text in rows:
        for ids in known.of(text):
            for i, a in enumerate(ids):
                for b in ids[i + 1 : i + 3]:
                    table[a] += index[b]
                    table[b] += index[a]
    long = np.sqrt((table**2).sum(axis=1, keepdims=True))
    want = np.divide(table, long, out=np.zeros_like(table), where=long > 0)
    got = quality.word_vectors(frame(spark, rows).repartition(5))
    assert np.allclose(got, want, atol=1e-6)
    pools = quality.pooled(got, *buffers(pa.array([t for _, t in rows], pa.string())))
    for (_, text), pool in zip(rows, pools):
        plain = [want[ids].mean(axis=0) if ids else np.zeros(quality.DIMS) for ids in known.of(text)]
        assert np.allclose(pool, np.concatenate(plain), atol=1e-4)


def test_quality_scores_equal_the_plain_network(spark, marked):
    rows, labels = marked
    docs, known = frame(spark, rows), Rows()
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, told, F.col("doc_id") % 3 != 1)
    net = model.net

    def plain(text):
        x = np.concatenate([model.table[ids].mean(axis=0) if ids else np.zeros(quality.DIMS) for ids in known.of(text)])
        hidden = [math.tanh(net.b1[j] + sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(len(x)))) for j in range(len(net.b1))]
        return 1 / (1 + math.exp(-max(-40, min(40, (net.b2 + sum(h * w for h, w in zip(hidden, net.w2))) / net.temperature))))

    # ids may repeat: as bags of (id, score)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in quality.score(docs, model).collect()))
    want = sorted(((i is not None, i or 0, plain(t)) for i, t in rows))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)
    held = [(s, i % 2) for some, i, s in got if some and i >= 1000 and i % 3 == 1]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.9


LONG = "donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft"


@pytest.fixture(scope="module")
def spoken():
    """(doc_id, text, lang): words above 32 bytes, in one case without spaces at all, and languages of one class each."""
    rows = [(i, f"the then other {prose(i, 6, ('the', 'ing', 'ion', 'and'))}", "en") for i in range(12)]
    rows += [(100 + i, f"{LONG} der die {prose(i, 5, ('sch', 'ein', 'ung', 'ß'))}", "de") for i in range(12)]
    rows += [(200 + i, "这是一个很长的句子没有空格所以它是一个词" + "的是不了"[i % 4], "zh") for i in range(12)]
    return rows + [(300, None, "en"), (301, "", "de"), (302, "the", None), (None, LONG, "de"), (303, " 12 !", "zh")]


def test_language_training_and_scores_equal_plain_sums(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), vocabulary(PIECES), train_docs=10**6, rounds=2, smooth=0.05)
    known = langid.Pieces(vocabulary(PIECES))
    number = {x: i for i, x in enumerate(known.all)}
    langs = sorted({lang for *_, lang in spoken if lang})

    def sums(word, p, j):
        """log of the sums over all cuts of what is before each place, and of what is after it."""
        word = bytes([langid.MARK]) + word.encode()
        edges = [(e - k, e, number[word[e - k : e]]) for e in range(1, len(word) + 1) for k in range(1, min(e, known.longest) + 1) if word[e - k : e] in number]
        ahead, behind = [0.0] + [-math.inf] * len(word), [-math.inf] * len(word) + [0.0]
        for a, b, i in edges:
            ahead[b] = np.logaddexp(ahead[b], ahead[a] + math.log(p[i, j]))
        for a, b, i in reversed(edges):
            behind[a] = np.logaddexp(behind[a], behind[b] + math.log(p[i, j]))
        return edges, ahead, behind

    counts = Counter((langs.index(lang), w) for _, text, lang in spoken if lang for w in words((text or "").lower()))
    p = np.full((len(known), len(langs)), 1 / len(known))
    for _ in range(2):
        uses = np.full(p.shape, 0.05)
        for (j, w), n in counts.items():
            edges, ahead, behind = sums(w, p, j)
            for a, b, i in edges:
                uses[i, j] += n * math.exp(ahead[a] + math.log(p[i, j]) + behind[b] - ahead[-1])
        p = np.maximum(uses / uses.sum(axis=0), langid.FLOOR)
    assert model.langs == langs
    assert np.allclose(model.p[:-1], p, rtol=1e-6, atol=1e-12)

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for i, text, _ in spoken:
        own = words((text or "").lower())
        if not re.search(r"[^\W\d_]", text or ""):
            assert got[i] == ("und", 0.0)
            continue
        logs = [sum(sums(w, p, j)[1][-1] for w in own) for j in range(len(langs))]
        best = int(np.argmax(logs))
        assert got[i][0] == langs[best]
        assert math.isclose(got[i][1], 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)


def test_language_of_an_empty_table_and_of_ties(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), vocabulary(PIECES), rounds=1)
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.keep_known(docs.limit(0), model).count() == 0
    # two languages of equal texts: the first in order, with half of the probability
    twins = spark.createDataFrame([(1, "same words", "xx"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    model = langid.train(twins, F.lit(True), vocabulary(PIECES), rounds=1)
    assert {(r["lang_pred"], round(r["score"], 9)) for r in langid.predict(twins, model).collect()} == {("aa", 0.5)}
