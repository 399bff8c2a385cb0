"""Repeated passages removed by suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or earlier in the same document.

1. Anchors. Every start of such a string points to the least of the 32-byte hashes in it, the leftmost on ties: equal strings point to the same place in
   them. Runs of starts that share an anchor are grouped by the anchor's hash (its class) and by all their text. A run whose text occurs
   earlier is covered as it is; a class with one member holds nothing that repeats. Both need no sorting, and are the bulk of any corpus.
2. Suffixes. Runs of one class with different texts may still share some strings. They are brought together by class, and
   a suffix array is built over them by the difference-cover algorithm: triples at two of three positions are sorted and named, the names are
   sorted in the same way (no deeper than `length` bytes), the third positions are sorted by their first letter and the name behind it, and
   both are merged. Neighbours in the array with `length` equal bytes form groups; all but the first of a group are covered.
3. Spans. The covered strings of a document are united and cut out.

A passage that many documents share makes a class of any size. Each task sends its earliest of equal runs only, and covers the others at once. A class with many
members that still differ is dealt out again by the strings' hashes, in parts that hold `crowd` members times the strings of a run at most, and each
task sends one of equal strings. Buckets are as many as the bytes of all texts ask for, so what a task holds doesn't grow with the table.

The suffixes are sorted class by class, and not all in one order: equal strings are of one class, so nothing is lost, and a class fits a task.

Defined results: null and empty texts have 0 bytes and nothing removed; rows with a null id come before all others; different texts of one id, or of none, are
documents of their own, in an order of their hashes; equal rows are one document, and none of them is earlier; an empty table gives an empty
result. Matches never cross documents. Runs of one class are compared by 64-bit hashes of their text, what is suffix-sorted by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import load, settle, settle_table
from quire.llm.near_dedup import mixed

U = np.uint64
GRAM = 32
#: Bytes of text whose runs make a bucket.
BUCKET_BYTES = 16 << 20
BASE = U(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, for hashes of substrings."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if len(self.up) <= n:
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, U(pow(int(BASE), -1, 2**64)))]))
        letter = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(letter[text] * self.up[:n], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """For each window the place of its least value, the leftmost on ties."""
    value, place, n = h, np.arange(len(h), dtype=np.int32), 1
    while n < width:
        step = min(n, width - n)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        n += step
    return place


def chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Documents in the order of their ids, up to `most` bytes at once, or one text."""
    ids = batch.column(0).to_pylist()
    texts = batch.column(1)
    order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
    names, held, size = [], [], 0
    for k in order:
        raw = (texts[k].as_py() or "").encode()
        if held and size + len(raw) > most:
            yield names, held
            names, held, size = [], [], 0
        names.append(ids[k])
        held.append(raw)
        size += len(raw)
    if held:
        yield names, held


def runs_of(ids: list, texts: list[bytes], length: int, powers: Powers):
    """Runs of starts by anchor, in the order of (id, start): class, text hash, id, first start, starts less one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    if n < length:
        return None
    edge = np.cumsum(sizes) - sizes
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(valid, edge[long], 1)
    np.add.at(valid, edge[long] + sizes[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(starts):
        return None
    sums = powers.sums(raw)
    grams = (sums[GRAM:] - sums[:-GRAM]) * powers.down[: n - GRAM + 1]
    grams ^= grams >> U(31)
    grams *= U(0xBF58476D1CE4E5B9)
    anchor = least_in_window(grams, length - GRAM + 1)[starts]
    begin = np.ones(len(starts), bool)
    begin[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], anchor[first]
    doc = np.searchsorted(edge, lo, side="right") - 1
    # documents without a byte share their edge with the next one; the last of equal edges holds the bytes
    text = powers.hashes(sums, lo, hi + length) + mixed((at - lo).astype(np.uint64))
    return mixed(grams[at]), text, np.array(ids, np.int64)[doc], (lo - edge[doc]).astype(np.int32), (hi - lo).astype(np.uint16)


ROW = [("class", "<u8"), ("text", "<u8"), ("id", "<i8"), ("lo", "<i4"), ("n", "<u2")]


def packed(columns) -> bytes:
    return b"".join(np.ascontiguousarray(c).astype(t).tobytes() for c, (_, t) in zip(columns, ROW))


def unpacked(blobs: list[bytes], row=ROW) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in row)
    parts: list[list[np.ndarray]] = [[] for _ in row]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, (_, t) in enumerate(row):
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


SPANS = ["id", "lo", "stop", "class", "members"]
SPAN_TYPE = "id long, lo int, stop int, class long, members long"


def spans(ids, lo, stop, cls=None, members=None) -> pa.RecordBatch:
    n = len(ids)
    nothing = pa.nulls(n, pa.int64())
    cols = [pa.array(ids.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(stop.astype(np.int32)), nothing if cls is None else pa.array(cls.view(np.int64)), nothing if members is None else pa.array(members.astype(np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=SPANS)


def first_of(key: np.ndarray) -> np.ndarray:
    """For each place the first one that has its key."""
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first[which]


class Earliest:
    """Of runs that a task has met more than once: their keys, and the earliest place it has sent. Dropped when it holds `most`."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.key, self.id, self.lo = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def covers(self, key: np.ndarray, ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        if not len(self.key):
            return np.zeros(len(key), bool)
        return (self.key[at] == key) & ((self.id[at] < ids) | ((self.id[at] == ids) & (self.lo[at] < lo)))

    def learn(self, key: np.ndarray, ids: np.ndarray, lo: np.ndarray) -> None:
        if len(self.key) + len(key) > self.most:
            self.__init__(self.most)
        every = [np.concatenate(x) for x in ((self.key, key), (self.id, ids), (self.lo, lo))]
        order = np.lexsort((every[2], every[1], every[0]))
        first = np.ones(len(order), bool)
        first[1:] = every[0][order][1:] != every[0][order][:-1]
        self.key, self.id, self.lo = (x[order][first] for x in every)


def anchored(docs: DataFrame, id_col: str, text_col: str, length: int, buckets: int, most: int = 2 << 20) -> DataFrame:
    """Covered runs (class null), and the runs that have to be sorted, with the number of different ones in their class."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sent = Powers(), Earliest()
        for batch in batches:
            for ids, texts in chunks(batch, most):
                found = runs_of(ids, texts, length, powers)
                if found is None:
                    continue
                cls, text, doc, lo, n = found
                key = mixed(cls * BASE + text)
                begun = first_of(key)
                again = begun != np.arange(len(key))
                same = again & (doc == doc[begun]) & (lo == lo[begun])  # a row that repeats
                one = ~again & ~sent.covers(key, doc, lo)
                if again.any():
                    repeated = one & np.isin(key, key[again])
                    sent.learn(key[repeated], doc[repeated], lo[repeated])
                rows: list[tuple[int, bytes, bool]] = []
                if not one.all():
                    rows.append((int(cls[0]) % buckets, packed([c[~one & ~same] for c in (cls, text, doc, lo, n)]), True))
                cls, text, doc, lo, n = (c[one] for c in (cls, text, doc, lo, n))
                bucket = (cls >> U(24)) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=U(2**63)))
                for a, b in zip(edges, [*edges[1:], len(order)]):
                    part = order[a:b]
                    rows.append((int(bucket[part[0]]), packed([c[part] for c in (cls, text, doc, lo, n)]), False))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.bool_()))], names=["bucket", "runs", "covered"])

    def settle_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cls, text, doc, lo, n = unpacked(blobs)
        order = np.lexsort((lo, doc, text, cls))
        cls, text, doc, lo, n = (c[order] for c in (cls, text, doc, lo, n))
        new_class = np.ones(len(cls), bool)
        new_class[1:] = cls[1:] != cls[:-1]
        new_text = new_class.copy()
        new_text[1:] |= text[1:] != text[:-1]
        stop = lo + n.astype(np.int32) + length
        begun = np.maximum.accumulate(np.where(new_text, np.arange(len(cls)), 0))
        gone = (doc != doc[begun]) | (lo != lo[begun])
        if gone.any():
            yield spans(doc[gone], lo[gone], stop[gone])
        which = np.cumsum(new_class) - 1
        members = np.bincount(which[new_text], minlength=which[-1] + 1 if len(which) else 0)
        sort = new_text & (members[which] > 1)
        if sort.any():
            yield spans(doc[sort], lo[sort], stop[sort], cls[sort], members[which][sort])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for bucket, blob, covered in zip(*(batch.column(c).to_pylist() for c in ("bucket", "runs", "covered"))):
                if covered:
                    _, _, doc, lo, n = unpacked([blob])
                    yield spans(doc, lo, lo + n.astype(np.int32) + length)
                    continue
                if held and bucket != at:
                    yield from settle_bucket(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from settle_bucket(held)

    sent = docs.select(id_col, text_col).mapInArrow(send, "bucket long, runs binary, covered boolean")
    return sent.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, SPAN_TYPE)


def named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the values, equal for equal ones, and how many there are."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of s in order, by the difference cover {1, 2} modulo 3; suffixes that agree on `depth` letters may stand in any order.

    s: numbers from 1 to below 2**30, below 2**30 of them."""
    n = len(s)
    if n < 3 or depth <= 1:
        return np.argsort(s, kind="stable") if depth <= 1 else np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    bits = int(max(int(s.max()), n)).bit_length() + 1
    if bits > 31:
        raise ValueError("more letters than a pair of them has bits for")
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])

    def pairs(i: np.ndarray) -> np.ndarray:
        """Numbers in the order of the two letters at each place, of few enough bits for a third beside them; they compare within one call."""
        two_letters = (t[i] << bits) | t[i + 1]
        return two_letters if 3 * bits <= 63 else named(two_letters)[0]

    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # the former with an empty one at n, which parts the names of both
    sample = np.concatenate([one, two])
    names, distinct = named((pairs(sample) << bits) | t[sample + 2])
    if distinct == len(sample) or depth <= 3:
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_array(names, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    pair = (t[zero] << bits) | rank[zero + 1]
    zero_order = np.argsort(pair, kind="stable")
    zero, pair = zero[zero_order], pair[zero_order]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    both = np.concatenate([twos, zero])
    triple = (pairs(both) << bits) | rank[both + 2]
    place = np.arange(len(zero)) + np.searchsorted((t[ones] << bits) | rank[ones + 1], pair) + np.searchsorted(triple[: len(twos)], triple[len(twos) :])
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    # suffixes that agree beyond the depth may compare either way; keep places distinct and ascending
    place = np.maximum.accumulate(place - np.arange(len(place))) + np.arange(len(place))
    rest[place] = False
    out[place] = zero
    out[rest] = sorted_sample
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, first_key: np.ndarray) -> np.ndarray:
    """Which starts have a string that an earlier one (smaller first_key) has too."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    index = np.zeros(len(text), np.int64)
    index[starts] = np.arange(len(starts))
    order = suffix_array(text.astype(np.int64) + 1, length)
    order = order[wanted[order]]
    same = np.zeros(len(order), bool)
    step, reach = 20_000, np.arange(length)
    for a in range(1, len(order), step):
        x, y = order[a : a + step], order[a - 1 : a - 1 + step][: len(order[a : a + step])]
        same[a : a + step] = (text[x[:, None] + reach] == text[y[:, None] + reach]).all(axis=1)
    group = np.cumsum(~same)
    k = index[order]
    out = np.zeros(len(starts), bool)
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    out[k] = first_key[k] > np.minimum.reduceat(first_key[k], begins)[np.cumsum(np.diff(group, prepend=-1) > 0) - 1]
    return out


SEGMENT = [("class", "<u8"), ("sub", "<u4"), ("subs", "<u4"), ("id", "<i8"), ("lo", "<i4"), ("n", "<u2")]


def sorted_runs(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str, length: int, buckets: int, crowd: int = 2000, most: int = 1 << 19) -> DataFrame:
    """Covered strings among the runs that have to be sorted."""
    wanted = runs.groupBy("id").agg(F.collect_list(F.struct("lo", "stop", "class", "members")).alias("runs"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, texts, found = (batch.column(c) for c in ("id", "text", "runs"))
            out: dict[int, list[tuple]] = {}
            local: list[tuple] = []
            known: dict[tuple[int, int], tuple[int, int]] = {}
            for k in np.argsort(ids.to_numpy(), kind="stable").tolist():
                doc, raw = ids[k].as_py(), (texts[k].as_py() or "").encode()
                for run in sorted(found[k].as_py(), key=lambda r: r["lo"]):
                    lo, stop, cls, subs = run["lo"], run["stop"], run["class"] % 2**64, -(-run["members"] // crowd)
                    piece = raw[lo:stop]
                    if len(piece) < stop - lo:  # of another row with the same id
                        continue
                    which = [0]
                    if subs > 1:
                        h = string_hashes(np.frombuffer(piece, np.uint8), length, powers)
                        fresh = []
                        for at, x in enumerate(h.tolist()):
                            if known.setdefault((cls, x), (doc, lo + at)) == (doc, lo + at):
                                fresh.append(x % subs)
                            else:
                                local.append((doc, lo + at))
                        which = sorted(set(fresh))
                    for sub in which:
                        out.setdefault((cls * 31 + sub * 0x9E3779B1) % 2**64 % buckets, []).append((cls, sub, subs, doc, lo, stop - lo - length, piece))
            rows = []
            if local:
                doc, lo = np.array([x[0] for x in local], np.int64), np.array([x[1] for x in local], np.int32)
                rows.append((int(lo[0]) % buckets, np.ascontiguousarray(doc).tobytes() + lo.tobytes(), None))
            for bucket, segments in out.items():
                cols = list(zip(*segments))
                rows.append((bucket, b"".join(np.array(c, t).tobytes() for c, (_, t) in zip(cols, SEGMENT)), b"".join(cols[-1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "runs", "texts"])

    def settle_bucket(blobs: list[bytes], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        cls, sub, subs, doc, lo, n = unpacked(blobs, SEGMENT)
        text = np.frombuffer(b"".join(texts), np.uint8)
        size = n.astype(np.int64) + length
        edge = np.cumsum(size) - size
        order = np.lexsort((sub, cls))
        key = cls[order] + sub[order].astype(np.uint64) * BASE
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        groups = np.append(np.flatnonzero(new), len(order))
        ends = np.cumsum(size[order])
        a = 0
        while a < len(groups) - 1:  # whole groups, up to `most` bytes or one group, however large
            base = ends[groups[a] - 1] if groups[a] else 0
            b = max(a + 1, int(np.searchsorted(ends[groups[1:] - 1], base + most, side="right")))
            part = order[groups[a] : groups[b]]
            a = b
            m = size[part]
            at = np.cumsum(m) - m
            piece = text[np.repeat(edge[part] - at, m) + np.arange(int(m.sum()))]
            counts = n[part].astype(np.int64) + 1
            offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            start, owner = np.repeat(at, counts) + offset, np.repeat(part, counts)
            if (subs[part] > 1).any():
                h = powers.hashes(powers.sums(piece), start, start + length)
                mine = h % subs[owner].astype(np.uint64) == sub[owner]
                start, owner, offset = start[mine], owner[mine], offset[mine]
            where = lo[owner] + offset
            by = np.lexsort((where, doc[owner]))
            step = (np.diff(doc[owner][by], prepend=0) != 0) | (np.diff(where[by], prepend=0) != 0)
            rank = np.empty(len(start), np.int64)
            rank[by] = np.cumsum(step)
            gone = repeated_starts(piece, start, length, rank)
            if gone.any():
                yield joined(doc[owner][gone], where[gone], length)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, texts, at = [], [], None
        for batch in batches:
            for bucket, blob, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "runs", "texts"))):
                if text is None:
                    n = len(blob) // 12
                    yield joined(np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i4", n, 8 * n).astype(np.int64), length)
                    continue
                if blobs and bucket != at:
                    yield from settle_bucket(blobs, texts)
                    blobs, texts = [], []
                at = bucket
                blobs.append(blob)
                texts.append(text)
        if blobs:
            yield from settle_bucket(blobs, texts)

    sent = rows.mapInArrow(send, "bucket long, runs binary, texts binary")
    return sent.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, SPAN_TYPE)


def string_hashes(piece: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    sums = powers.sums(piece)
    a = np.arange(len(piece) - length + 1)
    return powers.hashes(sums, a, a + length)


def joined(ids: np.ndarray, lo: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of single strings, next ones put together."""
    order = np.lexsort((lo, ids))
    ids, lo = ids[order], lo[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (lo[1:] > lo[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return spans(ids[first], lo[first], lo[last] + length)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """((id, text, place), bytes of all texts). place orders the documents: the id, or where ids are null or stand for several texts, a number by id and
    hash of the text."""
    number, own = F.col(id_col).cast("long"), F.xxhash64(text_col)
    each = docs.groupBy(number.alias("id")).agg(F.min(own).alias("a"), F.max(own).alias("b"), F.sum(F.octet_length(text_col)).alias("bytes"))
    whole, odd = each.agg(F.sum("bytes"), F.bool_or(F.col("id").isNull() | (F.col("a") != F.col("b")))).first()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not odd:
        return rows.withColumn("place", F.col("id").cast("long")), whole or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(number.alias("n"), own.alias("h")).distinct().repartitionByRange(parts, "n", "h").sortWithinPartitions("n", "h")
    texts = settle(texts.withColumn("place", F.monotonically_increasing_id()))
    joined = rows.join(texts, F.col("id").cast("long").eqNullSafe(F.col("n")) & (F.xxhash64("text") == F.col("h")))
    return joined.select("id", "text", "place"), whole or 0


def covered_spans(rows: DataFrame, whole: int, length: int) -> DataFrame:
    """Of numbered() rows: (id, lo, stop) by place, strings of bytes that also start earlier; they may overlap."""
    if not GRAM <= length < 1 << 16:
        raise ValueError(f"length must be {GRAM} or more, and below 65,536")
    buckets = 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // (4 * BUCKET_BYTES)))
    found = settle_table(anchored(rows, "place", "text", length, buckets))
    sort = found.where(F.col("class").isNotNull())
    more = settle_table(sorted_runs(rows, sort, "place", "text", length, buckets))
    return found.where(F.col("class").isNull()).unionByName(more).select("id", "lo", "stop")


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = 100) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that remain."""
    rows, whole = numbered(docs, id_col, text_col)
    gone = covered_spans(rows, whole, length).groupBy(F.col("id").alias("gone")).agg(F.collect_list(F.struct("lo", "stop")).alias("spans"))
    rows = rows.join(gone, F.col("place") == F.col("gone"), "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def one(raw: bytes, found: pa.ListScalar) -> tuple[int, int, int, bytes]:
        kept, at, removed, count = [], 0, 0, 0
        if found.is_valid:
            lo, stop = (np.minimum(e.to_numpy(), len(raw)) for e in found.values.flatten())
            order = np.argsort(lo, kind="stable")
            lo, stop = lo[order], np.maximum.accumulate(stop[order])
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > stop[:-1]
            first = np.flatnonzero(new)
            for a, b in zip(lo[first].tolist(), stop[np.append(first[1:], len(lo)) - 1].tolist()):
                if b > a:
                    kept.append(raw[at:a])
                    at, removed, count = b, removed + b - a, count + 1
        kept.append(raw[at:])
        return len(raw), removed, count, b"".join(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [one((text.as_py() or "").encode(), found) for text, found in zip(part.column("text"), part.column("spans"))]
                cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
