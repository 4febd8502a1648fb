"""Vector bin packing of token ids into sequences, under limits on tokens, segments and loss-bearing tokens at once.

An example is a list of texts, each loss-bearing or not; its ids are those of its texts one after another, then ``end_id``.
A part that fills a sequence alone is cut off first. What is left waits in a pool; a sequence is filled by taking, again and
again, the example of the largest dot product between its demand and the room left, both as shares of the limits, among
those that fit. When none fits and at least ``min_cut`` tokens of room are left, an example is cut to fill it. Every id lies in
exactly one piece. Packing is per partition and streams: the pool holds ``pool`` examples or ``pool_ids`` ids at most, and
what it cannot fill well waits for more. A partition's last, short sequence is dealt into sequences of a power of two.

Defined cases: a null or empty text has ``end_id`` alone, an example without texts likewise; rows are independent, so
repeated rows are packed as often as they come; ids may be null; very long texts are cut into as many sequences as they fill; an
empty table gives no pieces; extra columns are not looked at, whatever their names. Sequence ids are unique: the partition's
number above the count inside it, the same on every retry of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, with_fields
from .tokens import rows_of_ids

PIECE = "start long, length long, n_loss long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Part:
    """Ids of an example from ``start`` on that are not placed yet; ``lossy`` counts loss-bearing ids before each place."""

    key: object
    start: int
    total: int
    ids: np.ndarray
    lossy: np.ndarray

    @property
    def loss(self) -> int:
        return int(self.lossy[-1] - self.lossy[0])

    def prefix(self, room: int, loss: int) -> int:
        """The longest beginning within both limits."""
        n = min(room, len(self.ids))
        if self.lossy[n] - self.lossy[0] > loss:
            n = int(np.searchsorted(self.lossy, self.lossy[0] + loss, "right")) - 1
        return n

    def cut(self, n: int) -> tuple[Part, Part]:
        return Part(self.key, self.start, self.total, self.ids[:n], self.lossy[: n + 1]), Part(self.key, self.start + n, self.total, self.ids[n:].copy(), self.lossy[n:].copy())


class Packer:
    """Takes parts, gives out full sequences: lists of parts."""

    def __init__(self, limits: Limits, pool: int = 4096, pool_ids: int = 4_000_000, min_cut: int = 8):
        self.limits, self.most, self.most_ids, self.min_cut = limits, pool, pool_ids, min_cut
        self.waiting: list[Part] = []
        self.held = 0

    def add(self, part: Part) -> Iterator[list[Part]]:
        while True:
            n = part.prefix(self.limits.tokens, self.limits.loss)
            if n == len(part.ids) and n < self.limits.tokens:
                break
            head, part = part.cut(max(1, n))
            yield [head]
            if not len(part.ids):
                return
        self.waiting.append(part)
        self.held += len(part.ids)
        if len(self.waiting) >= self.most or self.held >= self.most_ids:
            yield from self.fill(8)

    def fill(self, spare: int) -> Iterator[list[Part]]:
        """Sequences from what waits, until no more than ``spare`` sequences' worth is left."""
        lim = self.limits
        caps = np.array([lim.tokens, lim.segments, max(1, lim.loss)], float)
        parts = self.waiting
        size = np.array([len(p.ids) for p in parts], np.int64)
        loss = np.array([p.loss for p in parts], np.int64)
        live = np.ones(len(parts), bool)
        at_most = spare if spare == 0 else max(spare, 1)
        while live.any() and (spare == 0 or (int(size[live].sum()) > at_most * lim.tokens or int(live.sum()) > self.most // 2)):
            room, seats, bearing, taken = lim.tokens, lim.segments, lim.loss, []
            index = np.flatnonzero(live)
            d = np.stack([size[index] / caps[0], np.full(len(index), 1 / caps[1]), loss[index] / caps[2]], axis=1)
            free = np.ones(len(index), bool)
            while seats and room:
                fits = free & (size[index] <= room) & (loss[index] <= bearing)
                if not fits.any():
                    break
                k = int(np.where(fits, d @ (np.array([room, seats, bearing]) / caps), -1).argmax())
                free[k] = live[index[k]] = False
                taken.append(parts[index[k]])
                room, seats, bearing = room - size[index[k]], seats - 1, bearing - loss[index[k]]
            if seats and room >= self.min_cut and free.any():
                rest = np.flatnonzero(free)
                k = rest[size[index[rest]].argmax()]
                i = index[k]
                n = parts[i].prefix(int(room), int(bearing))
                if 0 < n < size[i]:
                    head, parts[i] = parts[i].cut(n)
                    taken.append(head)
                    size[i], loss[i] = len(parts[i].ids), parts[i].loss
            yield taken
        self.waiting = [p for p, alive in zip(parts, live) if alive]
        self.held = sum(len(p.ids) for p in self.waiting)

    def finish(self) -> Iterator[list[Part]]:
        """What is left; sequences short of the limit are dealt into powers of two."""
        for taken in self.fill(0):
            left = sum(len(p.ids) for p in taken)
            if left + self.min_cut > self.limits.tokens:
                yield taken
                continue
            while left:
                n = size = 1 << (left.bit_length() - 1)
                out = []
                while n:
                    p = taken.pop(0)
                    if len(p.ids) > n:
                        head, rest = p.cut(n)
                        taken.insert(0, rest)
                        p = head
                    out.append(p)
                    n -= len(p.ids)
                left -= size
                yield out


def pack(examples: DataFrame, texts: Column, *, tokenizer: str, end_id: int | None = 1, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """One row per piece: the id and PIECE's columns (ids: little-endian unsigned 32-bit).

    ``texts`` is a string column (one loss-bearing text) or array<struct<text:string,loss:boolean>>.
    """
    src = examples.select(col(id_col), texts.alias("texts_"))
    nested = src.schema[1].dataType.simpleString().startswith("array")
    schema = with_fields(examples.select(col(id_col)), PIECE)

    def parts_of(batch):
        key = batch.column(0)
        if not nested:
            for r, ids in rows_of_ids(batch.column(1), tokenizer, end_id):
                yield Part(key[r], 0, len(ids), ids, np.arange(len(ids) + 1, dtype=np.int32))
            return
        lists = batch.column(1).to_pylist()
        flat = [x or {"text": "", "loss": False} for own in lists for x in own or []]
        ids = [x for _, x in rows_of_ids(pa.array([x["text"] for x in flat], pa.string()), tokenizer, None)]
        k = 0
        for r, own in enumerate(lists):
            some = list(range(k, k + len(own or [])))
            k += len(some)
            last = [] if end_id is None else [np.array([end_id], np.uint32)]
            whole = np.concatenate([*[ids[i] for i in some], *last, np.zeros(0, np.uint32)])
            bears = np.concatenate([*[np.full(len(ids[i]), bool(flat[i]["loss"])) for i in some], *[np.ones(1, bool) for _ in last], np.zeros(0, bool)])
            yield Part(key[r], 0, len(whole), whole, np.concatenate([[0], np.cumsum(bears)]).astype(np.int32))

    def run(batches):
        packer, kind, rows = Packer(limits), None, []
        sequence = TaskContext.get().partitionId() << 32

        def out(sequences):
            nonlocal sequence
            for taken in sequences:
                offset = 0
                for p in taken:
                    rows.append((p.key, p.start, len(p.ids), p.loss, p.total, sequence, offset, p.ids.astype("<u4").tobytes()))
                    offset += len(p.ids)
                sequence += 1

        def batch_of():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in columns[0]], kind), *[pa.array(c, t) for c, t in zip(columns[1:], [pa.int64()] * 6 + [pa.binary()])]], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for part in parts_of(batch):
                if len(part.ids):
                    out(packer.add(part))
                if len(rows) >= 4000:
                    yield batch_of()
        out(packer.finish())
        if rows:
            yield batch_of()

    return src.mapInArrow(run, schema)


def conversations(turns: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", bearing: str = "assistant") -> DataFrame:
    """Instruction data from a table of turns: id and texts (array<struct<text,loss>>, in order); turns of ``bearing`` bear loss."""
    turn = F.struct(col(order_col).alias("o"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.coalesce(col(role_col) == bearing, F.lit(False)).alias("loss"))
    got = turns.groupBy(col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return got.select(col(id_col), F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).alias("texts"))
