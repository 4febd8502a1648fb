"""Ranked lexical search: an inverted index by segments, and WAND over each with one heap a query that a task carries along.

``build_index`` cuts every scan partition into segments of bounded text and writes, per segment, its documents (ids and lengths)
and a posting list for each of its words: ordinals of documents in ascending order of id, and frequencies. No shuffle; a word
that is everywhere is one short list a segment.

``search`` takes the lists of the asked words out of the index, deals them by shard (a hash of the segment) and, segment by
segment, ranks the queries: lists lie by their next document, their maximum impacts are added up until the sum can beat the
heap's threshold, and the list where that happens names the pivot; documents before it cannot get in and are never scored. From
the pivot on, a window of documents is taken at once: those whose lists' maxima together beat the threshold are scored, the
others are skipped. A heap lives as long as its task, so later segments start with a threshold. Shard heaps are
merged by a window that keeps ``top`` a query.

A score sums, over a query's words once each, w * ((1e9 * tf) div (1000 * tf + 20 * m)), all in 64-bit integers: w is floor(1000 *
ln((2N + 2) / (2df + 1))), m is 100 - 50 + ((50 * n * N) div L) for a document of n words. N, L and df are those of the whole index.

Words are known inside a segment by a 64-bit hash, in the index by their bytes. Defined cases: null and empty texts and texts
without words are in no list and count in neither N nor L; very long texts are indexed whole, in a segment of their own if need
be; repeated rows are documents of their own; null ids are ordered first; queries of one id are one query with all their words,
null being an id too; queries without words, or with words that no document has, have no rows; equal scores are ordered by
id; an empty table gives an empty index and no rows; extra columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, materialise, shared_dir
from .vectext import LOWER, UPPER, WORD, chunks, find_words

#: A segment ends at so many bytes of text or documents, whichever comes first (one document at least).
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 32_768
#: Queries that a task ranks at a time, and the widest window of documents.
BLOCK, WINDOW = 512, 2048


@dataclass(frozen=True)
class Weights:
    """The fixed values of the scoring rule."""

    base: int = 100
    share: int = 50
    scale: int = 20
    unit: int = 1000


# the index


class Segment:
    """Word counts of the documents of one segment."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.known = np.zeros(0, np.uint64)
        self.words: list[bytes] = []

    def add(self, ids: list, raw: np.ndarray, offs: np.ndarray) -> None:
        w = find_words(raw, offs)
        first = len(self.ids)
        self.ids += ids
        self.lengths += np.diff(w.ptr).tolist()
        self.size += len(raw)
        if not len(w):
            return
        order = np.argsort(w.h, kind="stable")
        h, row = w.h[order], w.row[order]
        starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
        self.parts.append((h[starts], row[starts] + first, np.diff(np.concatenate([starts, [len(h)]]))))
        heads = starts[np.concatenate([[True], h[starts][1:] != h[starts][:-1]])]
        k = np.searchsorted(self.known, h[heads])
        k[k == len(self.known)] = 0
        new = heads[self.known[k] != h[heads]] if len(self.known) else heads
        if len(new):
            at = np.searchsorted(self.known, h[new])
            self.known = np.insert(self.known, at, h[new])
            found = [w.low[a:b].tobytes() for a, b in zip(w.start[order[new]].tolist(), w.end[order[new]].tolist())]
            merged: list[bytes] = []
            last = 0
            for place, word in zip(at.tolist(), found):
                merged += self.words[last:place]
                merged.append(word)
                last = place
            self.words = merged + self.words[last:]

    def lists(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """(word, ordinals, frequencies), and documents put into the order of their ids."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] if self.ids[i] is not None else 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids = [self.ids[i] for i in order]
        self.lengths = [self.lengths[i] for i in order]
        if not self.parts:
            return
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        doc = rank[doc]
        by = np.lexsort((doc, h))
        h, doc, tf = h[by], doc[by], tf[by]
        edge = np.searchsorted(h, self.known).tolist() + [len(h)]
        for word, a, b in zip(self.words, edge, edge[1:]):
            yield word, doc[a:b], tf[a:b]


def _least(x: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _index_schema(kind: str) -> str:
    return f"segment long, word string, df long, docs binary, tfs binary, ids array<{kind}>, lengths array<bigint>"


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index as rows: one per segment with a null word, ids and lengths; one per segment and word with its list."""
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = _index_schema(src.schema[0].dataType.simpleString())
    ids_type = to_arrow_type(T.ArrayType(src.schema[0].dataType))

    def written(number: int, s: Segment) -> Iterator[pa.RecordBatch]:
        lists = list(s.lists())  # orders the documents first
        rows: list[tuple] = [(number, None, len(s.ids), b"", b"", s.ids, s.lengths)]
        for word, doc, tf in lists:
            d, t = _least(doc), _least(tf)
            rows.append((number, word, len(doc), d.tobytes(), t.tobytes(), None, None))
            if len(rows) == 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), ids_type, pa.list_(pa.int64()))
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays[1] = arrays[1].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["segment", "word", "df", "docs", "tfs", "ids", "lengths"])

    def run(batches):
        number, segment = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, raw, offs in chunks(batch.column(1)):
                if segment.ids and (segment.size + len(raw) > segment_bytes or len(segment.ids) + b - a > segment_docs):
                    yield from written(number, segment)
                    number, segment = number + 1, Segment()
                segment.add(ids[a:b], raw, offs)
        if segment.ids:
            yield from written(number, segment)

    return src.mapInArrow(run, schema)


def build_index(docs: DataFrame, **options) -> DataFrame:
    """postings(), written to the shared folder. Words lie in order inside a segment, so that few are read where few are asked."""
    path = f"{shared_dir(docs.sparkSession)}/inverted-{uuid.uuid4().hex}"
    rows = postings(docs, **options)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


# ranking


def _read(docs: bytes, tfs: bytes, df: int) -> tuple[np.ndarray, np.ndarray]:
    width = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    return np.frombuffer(docs, width[len(docs) // df]).astype(np.int64), np.frombuffer(tfs, width[len(tfs) // df]).astype(np.int64)


class Heap:
    """The best ``top`` (score, id) of one query so far; equal scores by ascending id, null first."""

    def __init__(self, top: int):
        self.top, self.score, self.key = top, np.zeros(0, np.int64), []

    @property
    def threshold(self) -> int:
        """The least score that may still get in: that of the last place, which a smaller id can take over."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, keys: list) -> None:
        score = np.concatenate([self.score, score])
        keys = self.key + keys
        order = sorted(range(len(keys)), key=lambda i: (-score[i], keys[i] is not None, keys[i] if keys[i] is not None else 0))[: self.top]
        self.score, self.key = score[order], [keys[i] for i in order]


def wand(lists: list[tuple[np.ndarray, np.ndarray, int, int]], n_docs: int, ids: list, heap: Heap, window: int = WINDOW) -> int:
    """Ranks one segment for one query; gives how many documents were scored.

    A list is (ordinals, impacts without weight, weight, the largest impact); ordinals ascend. Lists whose maxima together cannot reach the threshold
    never make a document: the pivot is the first document at which they can.
    """
    docs, most = [x[0] for x in lists], np.array([x[3] for x in lists], np.int64)
    at = np.zeros(len(lists), np.int64)
    ends = np.array([len(d) for d in docs])
    scored, width = 0, 64
    while True:
        alive = np.flatnonzero(at < ends)
        if not len(alive):
            return scored
        here = np.array([docs[i][at[i]] for i in alive])
        order = np.argsort(here, kind="stable")
        reach = np.cumsum(most[alive[order]])
        threshold = heap.threshold
        p = int(np.searchsorted(reach, threshold))
        if p == len(order):
            return scored  # all that is left together stays below
        pivot = int(here[order[p]])
        stop = min(n_docs, pivot + width)
        width = min(window, 2 * width)
        size = stop - pivot
        bound, score = np.zeros(size, np.int64), np.zeros(size, np.int64)
        cut = []
        for i in alive:
            a, b = np.searchsorted(docs[i], (pivot, stop))
            at[i] = b
            if a < b:
                own = docs[i][a:b] - pivot
                bound[own] += most[i]
                cut.append((i, a, b, own))
        wanted = bound >= threshold
        if not wanted.any():
            continue
        for i, a, b, own in cut:
            keep = wanted[own]
            score[own[keep]] += lists[i][1][a:b][keep] * lists[i][2]
        scored += int(wanted.sum())
        good = np.flatnonzero(wanted & (score >= threshold))
        if len(good) > heap.top:  # all that tie with the last place stay for the heap to order
            least = np.partition(score[good], len(good) - heap.top)[len(good) - heap.top]
            good = good[score[good] >= least]
        if len(good):
            heap.add(score[good], [ids[pivot + g] for g in good.tolist()])


def search(index: DataFrame, queries: DataFrame, *, top: int = 50, id_col: str = "item_id", text_col: str = "text", key: str = "doc_id", weights: Weights = Weights(), block: int = BLOCK) -> DataFrame:
    """Each query's ``top`` documents: the query's id, rank (from 1), the document's id under ``key`` and score."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("asked", UPPER, LOWER), F.lit(WORD), F.lit(0))))
    asked = queries.select(col(id_col).alias("item"), col(text_col).cast("string").alias("asked")).select("item", word.alias("word")).distinct()
    total = index.filter("word is null").select(F.explode("lengths").alias("n")).agg(F.sum((F.col("n") > 0).cast("long")).alias("N"), F.sum("n").alias("L")).first()
    N, L = total["N"] or 0, total["L"] or 0
    n_blocks = -(-max(1, asked.select("item").distinct().count()) // block)
    df = index.filter("word is not null").select("word", "df").join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * N + 2)) / (2 * F.col("df") + 1))).cast("long")
    uses = asked.join(df, "word").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")).groupBy("block", "word").agg(F.collect_list(F.struct("item", w.alias("w"))).alias("uses"))
    uses = materialise(uses, "asked-words")
    # every segment's documents go to every block of queries, its lists to those that ask for them
    blocks = uses.select("block").distinct().select("block", F.lit(None).cast("string").alias("word"), F.array().cast(uses.schema["uses"].dataType).alias("uses"))
    wanted = uses.unionByName(blocks).withColumnRenamed("word", "asked_word")
    dealt = index.join(wanted, index["word"].eqNullSafe(F.col("asked_word")))
    dealt = dealt.repartition(F.col("block"), F.col("segment")).sortWithinPartitions("block", "segment", F.col("word").asc_nulls_first())
    item_type, doc_type = asked.schema["item"].dataType, index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, item_type), T.StructField(key, doc_type), T.StructField("score", T.LongType())])
    arrow = [to_arrow_type(t) for t in (item_type, doc_type)]

    def run(batches):
        now, heaps = None, {}
        segment, lists, ids, doc_m = None, {}, [], np.zeros(0, np.int64)

        def flush():
            rows = [(item, k, int(s)) for item, h in heaps.items() for k, s in zip(h.key, h.score)]
            heaps.clear()
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow[0]), pa.array(b, arrow[1]), pa.array(c, pa.int64())], names=[id_col, key, "score"])

        def rank():
            for item, own in lists.items():
                if item not in heaps:
                    heaps[item] = Heap(top)
                wand(own, len(ids), ids, heaps[item])

        for batch in batches:
            for r in range(batch.num_rows):
                own = (batch.column("block")[r].as_py(), batch.column("segment")[r].as_py())
                if own != segment:
                    rank()
                    if now != own[0]:
                        yield from flush()
                    segment, lists, now = own, {}, own[0]
                    ids = batch.column("ids")[r].as_py()
                    n = np.array(batch.column("lengths")[r].as_py(), object)
                    doc_m = np.array(weights.base - weights.share + (weights.share * n * N) // max(L, 1), np.int64)
                    continue
                doc, tf = _read(batch.column("docs")[r].as_py(), batch.column("tfs")[r].as_py(), batch.column("df")[r].as_py())
                impact = (weights.unit**3 * tf) // (weights.unit * tf + weights.scale * doc_m[doc])
                most = int(impact.max())
                for use in batch.column("uses")[r].as_py():
                    if use["w"]:
                        lists.setdefault(use["item"], []).append((doc, impact, use["w"], most * use["w"]))
        rank()
        yield from flush()

    found = dealt.select("block", "segment", "word", "df", "docs", "tfs", "ids", "lengths", "uses").mapInArrow(run, schema)
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.col(key).asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(id_col, "rank", key, "score")

