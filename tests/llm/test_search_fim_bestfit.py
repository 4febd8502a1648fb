"""Ranked search, fill-in-the-middle and certified best-fit packing against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealcol.llm import bestfit, fim, search
from sealcol.llm.queries import op11_ranked_search, op12_fill_in_middle, op13_best_fit_packing, vocabulary

from . import fixtures
from .fixtures import bench, corpus, frame, prose, words

SF = "/root/testdata/sf0.001"
TOKENIZER = vocabulary("word_bpe_49k.json")


# ranked search


def ranked(rows, items, top):
    """(item, rank, doc, score) by the rule, one document at a time."""
    docs = [(i, Counter(words(t))) for i, t in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for (i, c), n in zip(docs, lengths):
            score = 0
            for t in terms:
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(found[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("segment_docs, segment_bytes, top, block", [(1000, 1 << 24, 50, 512), (3, 1 << 24, 2, 2), (100, 2000, 5, 1)])
def test_search_equals_brute_force(spark, segment_docs, segment_bytes, top, block):
    items = [(r["item_id"], r["text"]) for r in bench(spark).collect()] + [(20, fixtures.BASE), (21, "no such word zzz"), (22, "ka"), (None, "lo é")]
    queries = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, block int")
    index = search.build_index(frame(spark), segment_docs=segment_docs, segment_bytes=segment_bytes)
    assert got(search.search(index, queries, top=top, block=block)) == ranked(corpus(), items, top)


def test_search_ties_and_windows(spark):
    """Equal texts at the threshold keep the smallest ids, in whatever segment they are."""
    rows = [(i, prose(i % 7, 30)) for i in range(900, 0, -1)] + [(5, "rare ka"), (5, "rare ka")]
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), segment_docs=100)
    items = [(1, prose(3, 5)), (2, "rare"), (3, prose(1, 30) + " rare")]
    assert got(search.search(index, spark.createDataFrame(items, "item_id long, text string"), top=20)) == ranked(rows, items, 20)


def test_search_skips(spark):
    """With a full heap, documents that cannot get in are not scored; what is ranked does not change."""
    rng = np.random.default_rng(1)
    n = 20_000
    lists = []
    for share, w in ((0.5, 3), (0.2, 40), (0.01, 900)):
        doc = np.flatnonzero(rng.random(n) < share)
        impact = rng.integers(1, 100, len(doc))
        lists.append((doc, impact, w, int(impact.max()) * w))
    heap = search.Heap(10)
    scored = search.wand(lists, n, list(range(n)), heap)
    whole = np.zeros(n, np.int64)
    for doc, impact, w, _ in lists:
        whole[doc] += impact * w
    best = sorted(range(n), key=lambda i: (-whole[i], i))[:10]
    assert heap.key == best and heap.score.tolist() == whole[best].tolist()
    assert scored < n // 10


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "ka")], "item_id long, text string")
    assert search.search(search.build_index(empty), queries).count() == 0
    assert search.search(search.build_index(frame(spark)), queries.limit(0)).count() == 0
    named = search.build_index(frame(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert {r["doc_id"] for r in search.search(named, queries, top=500).collect()} == {None if i is None else f"d{i}" for i, t in corpus() if "ka" in words(t)}


def test_index_counts(spark):
    index = search.build_index(frame(spark), segment_docs=4)
    counted = {r["word"]: r["n"] for r in index.filter("word is not null").groupBy("word").agg(F.sum("df").alias("n")).collect()}
    assert counted == Counter(w for _, t in corpus() for w in set(words(t)))


# fill in the middle


@pytest.mark.parametrize("unit", [fim.LINES, fim.WORDS, fim.SENTENCES])
def test_boundaries_are_the_grammar(spark, unit):
    texts = ["".join(x) for n in range(5) for x in itertools.product("a .\n", repeat=n)] + ["\r\n x\n\x85", "é\n\U0001f600\n\n", "a\x00\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fim.units(F.col("t"), unit).alias("u"))
    for r in df.collect():
        assert r["u"] == re.findall(unit.grammar, r["t"]), repr(r["t"])


def middle(doc_id, text, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(u)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    more = [(200 + i, t) for i, t in enumerate(["\n", "\n\n", "a\nb", "a\nb\n", "<P>", "x<S", "<\n<S\n>P>\n", "a\r\nb\r", "é\n" * 30_000, "one <M> two", "<", ">\n<M"])]
    return corpus() + more + [(300 + i, "\n".join(prose(i, 40).split())) for i in range(40)]


def test_fim_equals_brute_force_and_round_trips(spark):
    rows = fim_rows()
    out = fim.transform(frame(spark, rows))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, *middle(i, t)) for i, t in rows), key=repr)
    back = out.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out.select("form").distinct().collect()}


def test_fim_rates_and_empty_table(spark):
    some = fim.transform(frame(spark, fim_rows()), rates=fim.Rates(transformed=0))
    assert {r["form"] for r in some.select("form").distinct().collect()} == {"plain"}
    assert fim.transform(frame(spark).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>PSM\na"), max_size=12), st.integers(0, 10**6))
def test_fim_parts_are_found_again(text, doc_id):
    """Sentinels stand where they were put, whatever the text has of their characters."""
    n, form, p, m, s, output = middle(doc_id, text)
    if form != "plain":
        parts = re.split(fim.SENTINEL, output)
        assert parts == ["", p, s, m] if form == "psm" else parts == ["", s, p, m]


# certified best fit


def fewest(sizes, width):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[k] and room not in rooms[:i]:
                place(k + 1, rooms[:i] + [room - sizes[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [width - sizes[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_best_packing(sizes):
    sizes = sorted(sizes, reverse=True)
    bound = bestfit.lower_bound(np.bincount(sizes, minlength=21), 20)
    assert -(-sum(sizes) // 20) <= bound <= fewest(sizes, 20)


def test_bound_proves_more_than_volume():
    assert bestfit.lower_bound(np.bincount([60] * 3 + [50] * 2, minlength=101), 100) == 4
    assert bestfit.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5
    assert bestfit.lower_bound(np.zeros(101, int), 100) == 0


def check_pieces(rows, pieces, width, tokenizer=TOKENIZER):
    """Each text's ids in order, cut only where they are longer than a sequence; sequences without gaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, a in enumerate(range(0, len(ids), width)):
            raw = ids[a : a + width].tobytes()
            want[i, piece, a, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    of = defaultdict(list)
    for p in pieces:
        of[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in of.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= width
    return len(of)


@pytest.mark.parametrize("items, width", [(8192, 4096), (7, 256), (1, 256)])
def test_bestfit_packs_every_id_once(spark, items, width):
    packed = bestfit.pack(frame(spark).repartition(3), tokenizer=TOKENIZER, items=items, width=width)
    n = check_pieces(corpus(), packed.pieces.collect(), width)
    assert n == packed.n_sequences >= packed.bound
    if items == 8192:
        assert n == packed.bound
    raw = packed.pieces.select(F.crc32("ids").alias("a"), "ids_crc32", F.length("ids").alias("b"), "length").collect()
    assert all(r["a"] == r["ids_crc32"] and r["b"] == 4 * r["length"] for r in raw)


def test_exchange_closes_gaps(spark):
    """Partitions of a few documents leave room that the exchange uses: close to what one partition needs."""
    docs = spark.createDataFrame([(i, prose(i, 20 + i % 90)) for i in range(300)], "doc_id long, text string")
    one = bestfit.pack(docs, tokenizer=TOKENIZER, width=512, items=10_000)
    many = bestfit.pack(docs, tokenizer=TOKENIZER, width=512, items=20)
    alone = bestfit.pack(docs, tokenizer=TOKENIZER, width=512, items=20, rounds=1)
    assert many.bound == one.bound <= one.n_sequences <= one.bound + 1
    assert many.rounds > 1 and many.n_sequences < alone.n_sequences
    assert many.n_sequences == check_pieces([tuple(r) for r in docs.collect()], many.pieces.collect(), 512)


def test_bestfit_of_nothing(spark):
    packed = bestfit.pack(frame(spark).limit(0), tokenizer=TOKENIZER)
    assert packed.pieces.count() == packed.n_sequences == packed.bound == 0


# the queries


def test_queries_on_whole_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(op11_ranked_search(spark, SF)) == ranked(docs, items, 50)
    check_pieces(docs, op13_best_fit_packing(spark, SF).collect(), 4096)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in docs:
        n, form, p, m, s, out = middle(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t)))
    assert got(op12_fill_in_middle(spark, SF)) == sorted(want, key=repr)
