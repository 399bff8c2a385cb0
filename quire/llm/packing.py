"""Packing of tokenized documents into sequences, online and in bounded space.

Each task tokenizes its rows in order and keeps a fixed number of open windows. A document's whole windows are closed at once; the piece that
is left goes into the open window with the least room that still holds it; where none holds it, the fullest window is emitted and
a fresh one opened. Windows still open at the end of a task are leftovers. They are merged by further rounds of the same kind over fewer tasks,
then laid end to end in each last task and cut at the window size, so that only the last window of a task is short.

Defined results: a null text counts as empty, one piece that holds the closing id alone; repeated rows are packed each; an empty table gives an
empty result. A text of any length is cut into windows; it is the most that a task holds at once, beside 500 rows of others. A row that is tokenized again after a lost executor goes to the same place, as its partition is read in the same order.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import Encoder
from quire.llm.common import arrow_rows, load, settle_table

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, open boolean, ids binary"
#: Pieces that are held before they go on, 4 KB each at most where ids are kept.
FLUSH = 500
#: Documents of an Arrow batch.
ROWS = 500


class Windows:
    """A bounded number of open windows, by best fit. emit(window id, pieces, closed)."""

    def __init__(self, size: int, most: int, emit: Callable[[list, bool], None]):
        self.size, self.most, self.emit = size, most, emit
        self.room: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, piece, length: int) -> None:
        k = bisect.bisect_left(self.room, (length, -1))
        if k < len(self.room):
            room, number = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                _, full = self.room.pop(0)
                self.emit(self.held.pop(full), True)
            room, number = self.size, self.next
            self.next += 1
            self.held[number] = []
        self.held[number].append(piece)
        if room == length:
            self.emit(self.held.pop(number), True)
        else:
            bisect.insort(self.room, (room - length, number))

    def finish(self) -> None:
        for _, number in self.room:
            self.emit(self.held.pop(number), False)
        self.room = []


def encoded(encode: Encoder, batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple]:
    """(id, ids) of each row of (id, text), in parts of about `most` bytes or one row, so that no batch is held as strings as a whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
        part = batch.slice(a, b - a)
        yield from zip(part.column(0).to_pylist(), encode.ids([t or "" for t in part.column(1).to_pylist()]))


def pack(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 1024, open_windows: int = 64, vocabulary: str | None = None, end_id: int = 0, keep_ids: bool = False, fan_in: int = 64) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian, null unless keep_ids)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    schema = PIECE.format(id=kind.simpleString())

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(held.value), TaskContext.get().partitionId()
        end = np.uint32(end_id)
        out: list[tuple] = []
        count = 0

        def emit(pieces: list, closed: bool) -> None:
            nonlocal count
            at = 0
            for doc, start, ids, total in pieces:
                raw = ids.tobytes()
                out.append((doc, start, len(ids), zlib.crc32(raw), total, task, count, at, not closed, raw if keep_ids or not closed else None))
                at += len(ids)
            count += 1

        windows = Windows(size, open_windows, emit)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "window", "offset", "open", "ids"]
        types = [None, *[pa.int64()] * 7, pa.bool_(), pa.binary()]

        def flushed(id_type) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, types)], names=names)
            out.clear()
            return made

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, ids in encoded(encode, batch):
                ids = np.append(ids, end).astype("<u4")
                total = len(ids)
                whole = total - total % size
                for start in range(0, whole, size):
                    emit([(doc, start, ids[start : start + size], total)], True)
                if whole < total:
                    windows.place((doc, whole, ids[whole:].copy(), total), total - whole)  # not a view of the whole document
                if len(out) >= FLUSH:
                    yield flushed(id_type)
        windows.finish()
        if id_type is not None:
            yield flushed(id_type)

    with arrow_rows(docs.sparkSession, ROWS):
        first = settle_table(docs.select(id_col, text_col).mapInArrow(pieces_of, schema))
    done = [first.where(~F.col("open")).withColumn("level", F.lit(0))]
    rest = first.where("open")
    tasks, level = 1 + (first.agg(F.max("task")).first()[0] or 0), 1
    while tasks > 1:  # each round gathers the leftovers of fan_in tasks
        tasks = -(-tasks // fan_in)
        with arrow_rows(docs.sparkSession, ROWS):
            rest = settle_table(merged(rest, schema, size, open_windows, tasks, last=tasks == 1, keep_ids=keep_ids, fan_in=fan_in))
        done.append(rest.where(~F.col("open")).withColumn("level", F.lit(level)))
        rest, level = rest.where("open"), level + 1
    if level == 1:
        with arrow_rows(docs.sparkSession, ROWS):
            rest = settle_table(merged(rest, schema, size, open_windows, 1, last=True, keep_ids=keep_ids, fan_in=fan_in))
        done.append(rest.where(~F.col("open")).withColumn("level", F.lit(level)))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    number = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft("task", 34) + F.col("window")
    return packed.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset", "ids")


def merged(rest: DataFrame, schema: str, size: int, open_windows: int, tasks: int, last: bool, keep_ids: bool, fan_in: int) -> DataFrame:
    """Leftover windows of many tasks packed again in `tasks` tasks; in the last round laid end to end and cut."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[tuple] = []
        count = 0

        def emit(pieces: list, closed: bool) -> None:
            nonlocal count
            at = 0
            for doc, start, length, raw, total in pieces:
                out.append((doc, start, length, zlib.crc32(raw), total, task, count, at, not closed, raw if keep_ids or not closed else None))
                at += length
            count += 1

        windows = Windows(size, open_windows, emit)
        laid: list[tuple] = []
        room = size
        names = types = None

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for batch in batches:
            names, types = batch.schema.names, batch.schema.types
            for doc, start, length, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids"))):
                if not last:
                    windows.place((doc, start, length, raw, total), length)
                    continue
                at = 0
                while at < length:
                    n = min(room, length - at)
                    laid.append((doc, start + at, n, raw[4 * at : 4 * (at + n)], total))
                    at, room = at + n, room - n
                    if not room:
                        emit(laid, True)
                        laid, room = [], size
                if len(out) >= FLUSH:
                    yield flushed()
        windows.finish()
        if laid:
            emit(laid, True)
        if out:
            yield flushed()

    order = ["task", "window", "offset"]
    gathered = rest.repartition(tasks, F.floor(F.col("task") / fan_in)) if tasks > 1 else rest.repartition(1)
    return gathered.sortWithinPartitions(*order).mapInArrow(again, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents")).drop("ids")
