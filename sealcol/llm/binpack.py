"""Token-id output: best-fit-decreasing packing with a segment tree over capacities, as matrices with segment lengths.

A text's ids are its tokenizer's, then ``end_id``. Overlong texts are split without loss: full rows first, the rest is packed.
Rests are packed in blocks of up to ``block`` pieces, longest first, each into the open row with the least room that holds
it; a segment tree over room sizes finds that row in logarithmic time. Rows are padded with ``pad_id``. A row comes with
its cumulative segment lengths (from 0, in padding's absence to the row's ids) and with positions that restart at 0 in every
segment. ``write_matrices`` stores blocks of rows as one binary id matrix each, beside those two.

Defined cases: null and empty texts are ``end_id`` alone; repeated rows are packed as often as they come; ids may be null;
very long texts fill rows of their own; an empty table gives no rows; extra columns are not looked at. Row numbers are the partition's number above a count inside it,
the same on every retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from .common import col
from .tokens import rows_of_ids

WIDTH = 2048
#: Ids fit in two bytes for the vocabularies this is used with; checked on writing.
ID = np.dtype("<u2")


class RoomTree:
    """How many open rows have each amount of room, as a binary tree; finds the least room of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, size: int) -> int:
        """The least room >= size that some row has, or -1."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of indices whose sizes add up to at most width."""
    rows: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    tree = RoomTree(width)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room < 0:
            r, room = len(rows), width
            rows.append([])
        else:
            r = by_room[room].pop()
            tree.add(room, -1)
        rows[r].append(i)
        left = room - sizes[i]
        if left:
            by_room.setdefault(left, []).append(r)
            tree.add(left)
    return rows


def _packed(kind, tokenizer: str, end_id: int, pad_id: int, width: int, block: int, block_ids: int):
    """A function from batches of id and text to packed rows as tuples, in the order of ROW."""

    def rows_of(batches) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple[object, int, np.ndarray]] = []
        held = 0

        def close() -> Iterator[tuple]:
            nonlocal number
            for own in best_fit_decreasing([len(x[2]) for x in waiting], width):
                segments = [waiting[i] for i in own]
                lengths = [len(x[2]) for x in segments]
                ids = np.full(width, pad_id, ID)
                np.concatenate([x[2] for x in segments], out=ids[: sum(lengths)], casting="unsafe")
                positions = np.zeros(width, ID)
                positions[: sum(lengths)] = np.concatenate([np.arange(n) for n in lengths])
                yield number, sum(lengths), [x[0] for x in segments], [x[1] for x in segments], [0, *np.cumsum(lengths).tolist()], ids.tobytes(), positions.tobytes()
                number += 1

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for r, ids in rows_of_ids(batch.column(1), tokenizer, end_id):
                if len(ids) and int(ids.max()) >> 16:
                    raise ValueError("ids of this vocabulary need more than two bytes")
                for a in range(0, len(ids), width):
                    waiting.append((docs[r], a, ids[a : a + width].astype(ID)))
                    held += len(waiting[-1][2])
                if len(waiting) >= block or held >= block_ids:
                    yield from close()
                    waiting, held = [], 0
        yield from close()

    return rows_of


#: Columns of a packed row.
ROW = ("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions")


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, T.ArrayType]:
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return src, src.schema[0].dataType.simpleString(), to_arrow_type(T.ArrayType(src.schema[0].dataType))


def _few(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, pad_id: int = 0, width: int = WIDTH, block: int = 8192, block_ids: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row: row_id, n_tokens, doc_ids and starts (of its segments), cu_seqlens, ids and positions (binary, uint16, ``width`` each)."""
    src, kind, ids_type = _source(docs, id_col, text_col)
    packed = _packed(kind, tokenizer, end_id, pad_id, width, block, block_ids)
    longs = pa.list_(pa.int64())
    types = (pa.int64(), pa.int64(), ids_type, longs, longs, pa.binary(), pa.binary())

    def run(batches):
        for some in _few(packed(batches), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), types)], names=list(ROW))

    return src.mapInArrow(run, f"row_id long, n_tokens long, doc_ids array<{kind}>, starts array<bigint>, cu_seqlens array<bigint>, ids binary, positions binary")


def write_matrices(docs: DataFrame, path: str, *, tokenizer: str, rows: int = 32, end_id: int = 1, pad_id: int = 0, width: int = WIDTH, block: int = 8192, block_ids: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of pack(), as Parquet files at ``path``: one record per matrix of up to ``rows`` neighbouring rows.

    matrix_id, n_rows, ids and positions (binary, row-major uint16), cu_seqlens (each row's, one after another) and
    cu_offsets (where each row's begin); row_ids, n_tokens, doc_ids and starts of its rows. Packing and writing are one pass
    of one Python worker a task, which holds a block of pieces and a matrix.
    """
    src, kind, ids_type = _source(docs, id_col, text_col)
    packed = _packed(kind, tokenizer, end_id, pad_id, width, block, block_ids)
    longs = pa.list_(pa.int64())
    types = {"matrix_id": pa.int64(), "n_rows": pa.int64(), "ids": pa.binary(), "positions": pa.binary(), "cu_seqlens": longs, "cu_offsets": longs, "row_ids": longs, "n_tokens": longs, "doc_ids": pa.list_(ids_type), "starts": pa.list_(longs)}

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for k, some in enumerate(_few(packed(batches), rows)):
            number, size, of, starts, cu, ids, positions = zip(*some)
            ends = [0, *np.cumsum([len(x) for x in cu]).tolist()]
            record = (base + k, len(some), b"".join(ids), b"".join(positions), [x for own in cu for x in own], ends, list(number), list(size), list(of), list(starts))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(record, types.values())], names=list(types))

    schema = f"matrix_id long, n_rows long, ids binary, positions binary, cu_seqlens array<bigint>, cu_offsets array<bigint>, row_ids array<bigint>, n_tokens array<bigint>, doc_ids array<array<{kind}>>, starts array<array<bigint>>"
    src.mapInArrow(run, schema).write.option("parquet.block.size", 8 << 20).parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written matrices, as pack() gives them."""
    # bound once: a reference to a scanned column copies the whole matrix each time it is looked at
    bound = "named_struct('n', cast(n_rows as int), 'ids', ids, 'positions', positions, 'width', cast(length(ids) / n_rows as int), 'row_ids', row_ids, 'n_tokens', n_tokens, 'doc_ids', doc_ids, 'starts', starts, 'cu', cu_seqlens, 'offsets', cu_offsets)"
    cut = f"""get(transform(array({bound}), m -> transform(sequence(0, m.n - 1), j -> struct(m.row_ids[j] as row_id, m.n_tokens[j] as n_tokens, m.doc_ids[j] as doc_ids, m.starts[j] as starts,
        slice(m.cu, cast(m.offsets[j] + 1 as int), cast(m.offsets[j + 1] - m.offsets[j] as int)) as cu_seqlens,
        substring(m.ids, j * m.width + 1, m.width) as ids, substring(m.positions, j * m.width + 1, m.width) as positions))), 0)"""
    return spark.read.parquet(path).select(F.explode(F.expr(cut)).alias("r")).select(*[f"r.{c}" for c in ROW])


def digest(packed: DataFrame) -> DataFrame:
    """row_id, n_tokens, doc_ids, starts, cu_seqlens and checksums of ids and positions."""
    return packed.select("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
