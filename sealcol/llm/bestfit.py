"""Best-fit packing of token ids with certified sequence counts.

A text's ids are its tokenizer's, then ``end_id``. Texts longer than a sequence are cut into pieces that fill one each, and a
last piece; no other text is cut. What does not fill a sequence is packed by partitions: best-fit decreasing in each, and beside
its count of sequences a lower bound on it, the largest that a family of dual feasible functions proves. Where count and bound
are equal the partition is certified: nobody packs it into fewer.

Partitions with a gap give up their sequences that have room, certified ones those that have nine tenths of theirs; these documents are
exchanged (dealt anew, with another hash, over as many partitions as they need) and best-fit decreasing runs again. A round's
packing is taken where it saves sequences, else what was given up stays as it was. Rounds end when what is given up fits one
partition and was packed there, or when the count reaches the bound of the whole table. Each round reads what the
last gave up and nothing else; a partition holds about ``items`` pieces, so no task grows with the table.

Defined cases: a null or empty text has ``end_id`` alone, one piece; rows are independent, repeated rows are packed as often as
they come; ids may be null and are never looked at; very long texts are cut as above; an empty table gives no pieces; extra
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binpack import best_fit_decreasing
from .common import col, materialise
from .tokens import rows_of_ids

WIDTH = 4096
#: Pieces a partition is meant to hold.
ITEMS = 8192
ROUNDS = 6
#: Rounding functions u(k) of the bound: k up to this.
ROUNDINGS = 32


def lower_bound(number: np.ndarray, width: int) -> int:
    """A proven lower bound on the sequences of ``width`` that hold number[x] pieces of each size x from 1 to width.

    A dual feasible function f gives numbers that add up to at most 1 for any sizes that fit one sequence, so the sum of f over
    all sizes needs as many sequences. Taken are, for each threshold t up to half a sequence: sizes above width - t count whole,
    sizes below t nothing, others their share; and for each k: a size of the share x counts floor((k + 1) x) / k, or x itself
    where (k + 1) x is whole. All sums are in integers of any size.
    """
    number = np.asarray(number).astype(object)
    count, total = np.cumsum(number), np.cumsum(number * np.arange(width + 1))
    best = -(-int(total[-1]) // width)
    for t in range(1, width // 2 + 1):
        whole = int(count[-1] - count[width - t])
        share = int(total[width - t] - total[t - 1])
        best = max(best, whole - (-share // width))
    x = np.arange(width + 1)
    for k in range(1, ROUNDINGS + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % width == 0, x * k, scaled // width * width)  # in units of 1 / (k * width)
        best = max(best, -(-int((number * value).sum()) // (k * width)))
    return best


def tokenised(docs: DataFrame, *, tokenizer: str, end_id: int | None, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: uid (the task's number above a count), the id, piece, start, length, ids (little-endian uint32) and their CRC-32."""
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches):
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, of = [], []
            held = 0
            for r, ids in rows_of_ids(batch.column(1), tokenizer, end_id):
                for piece, a in enumerate(range(0, len(ids), width)):
                    raw = ids[a : a + width].astype("<u4").tobytes()
                    rows.append((uid, piece, a, len(raw) // 4, raw, zlib.crc32(raw)))
                    of.append(r)
                    uid += 1
                    held += len(raw)
                if held > 32 << 20:
                    yield made(batch, rows, of)
                    rows, of, held = [], [], 0
            if rows:
                yield made(batch, rows, of)

    def made(batch, rows, of):
        uid, piece, start, length, ids, crc = zip(*rows)
        arrays = [pa.array(uid, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["uid", "id", "piece", "start", "length", "ids", "ids_crc32"])

    return src.mapInArrow(run, f"uid long, id {kind}, piece int, start long, length long, ids binary, ids_crc32 long")


PLACED = "uid long, length long, sequence_id long, offset long, part long, n_bins long, bound long, released boolean"


def _packed(width: int, number: int):
    """A function that packs one partition: rows of uid, length and part become PLACED."""

    def run(rows: pa.Table) -> pa.Table:
        uid, size = rows.column("uid").to_numpy(), rows.column("length").to_numpy()
        order = np.lexsort((uid, size))  # the same whatever order the rows come in
        uid, size, part = uid[order], size[order], int(rows.column("part")[0].as_py())
        bins = best_fit_decreasing(size.tolist(), width)
        bound = lower_bound(np.bincount(size, minlength=width + 1), width)
        room = np.array([width - int(size[own].sum()) for own in bins])
        released = room > 0
        if len(bins) == bound:  # only others' documents can help: what holds nine tenths of the room, the roomiest first
            by = np.argsort(-room, kind="stable")
            released[by[int(np.searchsorted(np.cumsum(room[by]) * 10, int(room.sum()) * 9)) + 1 :]] = False
        members = np.concatenate([np.array(own) for own in bins])
        of = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
        before = np.concatenate([np.cumsum(size[own]) - size[own] for own in bins])
        n = len(members)
        sequence = (number << 56) | (part << 32)
        columns = [uid[members], size[members], sequence + of, before, np.full(n, part), np.full(n, len(bins)), np.full(n, bound), released[of]]
        return pa.table(dict(zip(("uid", "length", "sequence_id", "offset", "part", "n_bins", "bound", "released"), [pa.array(c) for c in columns])))

    return run


@dataclass
class Packing:
    """``pieces``: id, piece, start, length, ids, ids_crc32, sequence_id, offset. ``n_sequences`` and ``bound``: those of the whole table."""

    pieces: DataFrame
    n_sequences: int
    bound: int
    rounds: int


def table_bound(pieces: DataFrame, width: int = WIDTH) -> int:
    """The bound of a whole table, from how many pieces have each length: ``width`` rows at most."""
    number = np.zeros(width + 1, object)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        number[r["length"]] = r["n"]
    return lower_bound(number, width)


def pack(docs: DataFrame, *, tokenizer: str, end_id: int | None = 1, width: int = WIDTH, items: int = ITEMS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Packing:
    """Pieces and their places. Pieces with their ids are written once, to the shared folder; rounds work on lengths alone."""
    pieces = materialise(tokenised(docs, tokenizer=tokenizer, end_id=end_id, width=width, id_col=id_col, text_col=text_col), "bestfit-pieces")
    bound = table_bound(pieces, width)
    full = pieces.filter(F.col("length") == width).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_full = full.count()
    pool, held = pieces.filter(F.col("length") < width).select("uid", "length"), None
    settled, n_bins, number = [full], n_full, 0
    waiting = pool.count()
    given_up = None  # how many sequences the pool had before
    while waiting and number < rounds:
        number += 1
        parts = -(-waiting // items)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.col("uid"), F.lit(number)), F.lit(parts)))
        new = materialise(dealt.groupBy("part").applyInArrow(_packed(width, number), PLACED), "bestfit-round")
        seen = new.groupBy("part").agg(F.first("n_bins").alias("bins"), F.first("bound").alias("bound"), F.countDistinct(F.when(F.col("released"), F.col("sequence_id"))).alias("open"), F.sum(F.col("released").cast("long")).alias("pieces"))
        got = seen.agg(F.sum("bins").alias("bins"), F.sum("open").alias("open"), F.sum("pieces").alias("pieces")).first()
        places = ("uid", "sequence_id", "offset")
        if given_up is not None and got["bins"] >= given_up:  # nothing is saved: the last packing stands
            settled.append(held.select(*places))
            held, waiting = None, 0
            break
        n_bins += got["bins"] - (given_up or 0)
        if n_bins <= bound or parts == 1 or number == rounds:
            settled.append(new.select(*places))
            held, waiting = None, 0
            break
        settled.append(new.filter(~F.col("released")).select(*places))
        held = new.filter("released")
        pool, waiting, given_up = held.select("uid", "length"), got["pieces"], got["open"]
    if held is not None:
        settled.append(held.select("uid", "sequence_id", "offset"))
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    return Packing(pieces.join(placed, "uid").drop("uid").withColumnRenamed("id", id_col), n_bins, bound, number)
