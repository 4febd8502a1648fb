"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

An item's windows are its runs of ``window`` words (10); an item of fewer words, but not none, is one window. Each hit is
verified word by word, so a hash collision never counts. The hash set (flat arrays, some ten times the text) is broadcast only
while the benchmark's text is at most ``broadcast_bytes``. Beyond that, windows whose hash a bitmap of FILTER_BITS does not rule out are joined with the
benchmark's on hash and words, by sort-merge, and their places put together by row; the result is the same. The corpus is
then written once, with row numbers, and each text is marked before anything is cut.

Defined cases: null or empty text has no words, no hits and is clean; very long texts are scanned whole; an item without words has no window; repeated items
and items that share a window all count; an item of null id marks words but is not listed; rows are independent, so
repeated rows get equal results; an empty benchmark leaves every document clean. Only the named columns are looked at:
``scan`` returns the id and its own columns, ``decontaminate`` exactly the input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, materialise, with_fields
from .vectext import Words, bitmap, buffers, chunks, find_words, member, windows

BROADCAST_BYTES = 8 << 20
#: Bits of the bitmap that windows of documents are looked up in before they are joined: it is of one size for any benchmark.
FILTER_BITS = 1 << 25


class WindowSet:
    """Windows of the benchmark in flat arrays, by number of words: some ten bytes for each byte of its text, in all.

    Of each number of words: sorted hashes; of each hash its distinct windows (almost always one), told by the word of the
    benchmark at which one begins; and of each window the items that have it.
    """

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        w = find_words(*buffers(texts))
        self.ids = ids
        self.words = Words(np.zeros(0, np.uint64), w.start.astype(np.int32), w.end.astype(np.int32), np.zeros(1, np.int64), w.low)
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        least = np.minimum(np.diff(w.ptr), window)
        for size in np.unique(least[least > 0]).tolist():
            at, g = windows(w, size)
            row = np.searchsorted(w.ptr, at, "right") - 1
            own = least[row] == size
            self.by_size[size] = self._table(size, at[own], g[own], row[own])

    def _table(self, size: int, at: np.ndarray, g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((at, g))
        at, g, row = at[order].astype(np.int32), g[order], row[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        of = np.repeat(first, np.diff(np.append(first, len(g))))
        kind = np.zeros(len(g), np.int32)  # of one hash: which of its distinct windows
        for i in np.flatnonzero(of != np.arange(len(g))).tolist():
            if not same_words(self.words, int(at[i]), self.words, int(at[of[i]]), size):
                texts = [words_at(self.words, int(x), size) for x in at[of[i] : i + 1]]
                kind[i] = kind[of[i] + texts.index(texts[-1])] if texts[-1] in texts[:-1] else kind[of[i] : i].max() + 1
        order = np.lexsort((row, kind, g))
        at, g, row, kind = at[order], g[order], row[order], kind[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])])
        keep = new.copy()  # an item once for each window
        keep[1:] |= row[1:] != row[:-1]
        group = np.flatnonzero(new)
        table, starts = np.unique(g[group], return_index=True)
        items = np.searchsorted(np.flatnonzero(keep), group).astype(np.int32)
        return table, bitmap(table), np.append(starts, len(group)).astype(np.int32), at[group], np.append(items, keep.sum()).astype(np.int32), row[keep]

    @property
    def size(self) -> int:
        """Bytes of its arrays."""
        return sum(x.nbytes for own in self.by_size.values() for x in own) + sum(x.nbytes for x in (self.words.start, self.words.end, self.words.low))

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """For each word whether it is hit, and the items by row."""
        edge = np.zeros(len(w) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, (table, bits, kinds, begins, of, rows_of) in self.by_size.items():
            at, g = windows(w, size)
            hits = member(g, table, bits)
            if not len(hits):
                continue
            which = np.searchsorted(table, g[hits])
            rows = np.searchsorted(w.ptr, at[hits], "right") - 1
            for p, k, r in zip(at[hits].tolist(), which.tolist(), rows.tolist()):
                for x in range(kinds[k], kinds[k + 1]):
                    if same_words(w, p, self.words, int(begins[x]), size):
                        edge[p] += 1
                        edge[p + size] -= 1
                        items.setdefault(r, set()).update(self.ids[i] for i in rows_of[of[x] : of[x + 1]].tolist() if self.ids[i] is not None)
        return np.cumsum(edge[:-1]) > 0, items


def same_words(x: Words, p: int, y: Words, q: int, n: int) -> bool:
    return words_at(x, p, n) == words_at(y, q, n)


def words_at(w: Words, p: int, n: int) -> tuple[bytes, ...]:
    return tuple(filter(None, w.low[w.start[p] : w.end[p + n - 1]].tobytes().split(b"\0")))


def _window_set(bench: DataFrame, item_id: str, item_text: str, window: int) -> WindowSet:
    got = bench.select(col(item_id).cast("string").alias("i"), col(item_text).cast("string").alias("t")).toArrow()
    return WindowSet(got.column("i").to_pylist(), got.column("t").combine_chunks(), window)


def scan(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted strings), spans (word ranges hit, end exclusive)."""
    size = bench.agg(F.sum(F.octet_length(col(item_text).cast("string"))).alias("n")).first()["n"] or 0
    if size > broadcast_bytes:
        src = _numbered(docs.select(col(id_col), col(text_col).cast("string").alias(free_name(docs.select(col(id_col)), "text_"))), "row_")
        found = _found_by_join(src.select("row_", src.columns[2]), bench, item_id, item_text, window)
        out = src.join(found.hint("merge"), "row_")
        return out.select(col(id_col), "n_words", "n_hit", "items", "spans")
    held = docs.sparkSession.sparkContext.broadcast(_window_set(bench, item_id, item_text, window))
    src = docs.select(col(id_col), col(text_col).cast("string").alias(free_name(docs.select(col(id_col)), "text_")))
    schema = with_fields(docs.select(col(id_col)), "n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")

    def run(batches):
        known = held.value
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                w = find_words(raw, offs)
                hit, items = known.scan(w)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[w.ptr[1:]] - total[w.ptr[:-1]]
                spans = [[] for _ in range(b - a)]
                for r in np.flatnonzero(n_hit).tolist():
                    own = np.diff(np.concatenate([[0], hit[w.ptr[r] : w.ptr[r + 1]].astype(np.int8), [0]]))
                    spans[r] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(w.ptr)), pa.array(n_hit.astype(np.int64)), pa.array([sorted(items.get(r, ())) for r in range(b - a)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=schema.names,
                )

    return src.mapInArrow(run, schema)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number, written once, so that it stays theirs."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered").select(name, *[col(c) for c in docs.columns])


def _bench_windows(bench: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """m (words), h, words, and the items ``of`` each distinct window."""
    src = bench.select(col(item_id).cast("string").alias("item"), col(item_text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                w = find_words(raw, offs)
                least = np.minimum(np.diff(w.ptr), window)
                for m in np.unique(least[least > 0]).tolist():
                    at, g = windows(w, m)
                    row = np.searchsorted(w.ptr, at, "right") - 1
                    own = least[row] == m
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), m, np.int32)), pa.array(g[own].view(np.int64)), pa.array([w.text(p, m) for p in at[own].tolist()], pa.binary()), batch.column(0).slice(a, b - a).take(pa.array(row[own]))], names=["m", "h", "words", "item"])

    rows = src.mapInArrow(run, "m int, h long, words binary, item string")
    return materialise(rows.groupBy("m", "h", "words").agg(F.collect_set("item").alias("of")), "bench-windows")


def _found_by_join(src: DataFrame, bench: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """For rows of a number and a text: row_, n_words, n_hit, items, spans. The way for benchmarks too large to broadcast."""
    items = _bench_windows(bench, item_id, item_text, window)
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())
    words = items.groupBy(F.expr(f"shiftrightunsigned(h, 6) & {FILTER_BITS // 64 - 1}").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    held = src.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = held.value
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                w = find_words(raw, offs)
                numbers = batch.column(0).slice(a, b - a).to_numpy()
                # a row without a window tells the number of words
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.diff(w.ptr)), pa.array(np.zeros(b - a, np.int32)), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary())], names=["row_", "p", "m", "h", "words"])
                for m in sizes:
                    at, g = windows(w, m)
                    some = np.flatnonzero(known[(g >> np.uint64(6) & np.uint64(FILTER_BITS // 64 - 1)).astype(np.int64)] >> (g & np.uint64(63)) & np.uint64(1))
                    row = np.searchsorted(w.ptr, at[some], "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(at[some] - w.ptr[row]), pa.array(np.full(len(some), m, np.int32)), pa.array(g[some].view(np.int64)), pa.array([w.text(p, m) for p in at[some].tolist()], pa.binary())], names=["row_", "p", "m", "h", "words"])

    seen = materialise(src.mapInArrow(run, "row_ long, p long, m int, h long, words binary"), "text-windows")
    hits = materialise(seen.filter("m > 0").join(items.hint("merge"), ["m", "h", "words"]).select("row_", "p", (F.col("p") + F.col("m")).alias("end"), "of"), "window-hits")
    # runs of hit words: one begins where no window before it reaches
    by_row = Window.partitionBy("row_").orderBy("p", "end")
    places = hits.select("row_", "p", "end").distinct()
    places = places.withColumn("new", F.coalesce(F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1)) < F.col("p"), F.lit(True)))
    places = places.withColumn("run", F.sum(F.col("new").cast("long")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = places.groupBy("row_", "run").agg(F.min("p").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("row_").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("row_", "of").distinct().groupBy("row_").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items"))
    out = seen.filter("m = 0").select("row_", F.col("p").alias("n_words")).join(spans, "row_", "left").join(named, "row_", "left")
    none = [F.expr(f"cast(array() as array<{t}>)") for t in ("string", "struct<start:bigint,end:bigint>")]
    return out.select("row_", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, mode: str = "drop", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input's rows and columns without what the benchmark covers.

    mode "drop": rows with any hit word go. mode "cut": the text from the first to the last byte of each hit run of words
    goes, the rest of the row stays. A benchmark above ``broadcast_bytes`` is joined: rows and texts are the same.
    """
    if mode not in ("drop", "cut"):
        raise ValueError("mode is 'drop' or 'cut'")
    size = bench.agg(F.sum(F.octet_length(col(item_text).cast("string"))).alias("n")).first()["n"] or 0
    at = docs.columns.index(text_col)
    if size <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast(_window_set(bench, item_id, item_text, window))
        return docs.mapInArrow(_dropper(held, at, mode), docs.schema)
    columns, number, spans = docs.columns, free_name(docs, "row_"), free_name(docs, "spans_")
    rows = _numbered(docs, number)
    found = _found_by_join(rows.select(col(number).alias("row_"), col(text_col).cast("string").alias("text")), bench, item_id, item_text, window)
    hit = found.filter("n_hit > 0").select(F.col("row_").alias(number), F.col("spans").alias(spans)).hint("merge")
    if mode == "drop":
        return rows.join(hit, number, "left_anti").select(*[col(c) for c in columns])
    marked = rows.join(hit, number, "left").select(*[col(c) for c in columns], col(spans))
    return marked.mapInArrow(_cutter(at), docs.schema)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of true, and their ends."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _without(raw: np.ndarray, offs: np.ndarray, w: Words, r: int, hit: np.ndarray) -> str:
    """Row r's text without the runs of words that are hit."""
    whole, out, last = raw[offs[r] : offs[r + 1]].tobytes(), [], 0
    for s, e in zip(*_runs(hit)):
        out.append(whole[last : w.start[w.ptr[r] + s] - offs[r]])
        last = w.end[w.ptr[r] + e - 1] - offs[r]
    return b"".join([*out, whole[last:]]).decode("utf-8", "replace")


def _cutter(at: int):
    """Cuts the runs (start, end) that the last column tells, and drops it."""

    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(at)):
                w = find_words(raw, offs)
                piece = batch.slice(a, b - a)
                marks = piece.column(piece.num_columns - 1).to_pylist()
                piece = piece.select(piece.schema.names[:-1])
                rows = [r for r, own in enumerate(marks) if own]
                if rows:
                    texts = piece.column(at).to_pylist()
                    for r in rows:
                        hit = np.zeros(w.ptr[r + 1] - w.ptr[r], bool)
                        for x in marks[r]:
                            hit[x["start"] : x["end"]] = True
                        texts[r] = _without(raw, offs, w, r, hit)
                    piece = piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))
                yield piece

    return run


def _dropper(held, at: int, mode: str):
    def run(batches):
        known = held.value
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(at)):
                w = find_words(raw, offs)
                hit, _ = known.scan(w)
                total = np.concatenate([[0], np.cumsum(hit)])
                rows = np.flatnonzero(total[w.ptr[1:]] > total[w.ptr[:-1]])
                piece = batch.slice(a, b - a)
                if len(rows) and mode == "drop":
                    keep = np.ones(b - a, bool)
                    keep[rows] = False
                    piece = piece.filter(pa.array(keep))
                elif len(rows):
                    texts = piece.column(at).to_pylist()
                    for r in rows.tolist():
                        texts[r] = _without(raw, offs, w, r, hit[w.ptr[r] : w.ptr[r + 1]])
                    piece = piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))
                yield piece

    return run
