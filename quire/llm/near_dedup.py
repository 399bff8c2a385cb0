"""Near-duplicate documents by one-permutation MinHash.

Words are lower-cased in A-Z; a document's set holds its distinct word shingles as 64-bit hashes. One permutation: the hash range is cut into
bins, and a bin's value is its least hash. An empty bin takes the value of the first full bin in an order of its own (optimal
densification). Bands of bins make buckets; at 0.85 there are 48 bands of 7 bins, which miss a pair with probability 1e-8.

Documents with equal sets are first put together: one of them stands for all. Then buckets are worked through in rounds. In a round every
bucket has a few centres, each member is paired with the centres of its bucket only (a star), pairs are confirmed on full sets, and the
centres leave the bucket. A bucket is done when all that are left in it are linked already. The number of centres grows from round to
round, so a round's pairs are bounded by members times centres, and in the end no pair of a bucket that could join two groups is left out.

A pair is emitted only if its parities leave it possible: every shingle flips one of 1024 bits of its document, so the number of bits in which two documents
differ is at most the size of their symmetric difference, and a pair with more than a link allows is none. The bound is exact and almost tight up to some thousand
shingles; for longer texts it is weak, and their pairs are told apart by their full sets. Shingles are compared as 64-bit hashes throughout.

Defined results: a text without words has an empty set, no link, and itself as its component; rows that share an id are one document; a row with a null id
is linked with nothing, has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import load, settle, settle_table, small, tidy

U = np.uint64
#: 64-bit words of a document's parities.
PARITY = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], known: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs (document, hash) of the distinct shingles of all texts."""
    found = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    h = np.fromiter((known[w] for ws in found for w in ws), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
    full = place <= np.repeat(np.maximum(sizes - k, 0), sizes)
    full &= (sizes >= k)[doc] if len(h) else full
    at = np.flatnonzero(full)
    s = np.full(len(at), U(k))
    for j in range(k):
        s = mixed(s * U(0x9E3779B97F4A7C15) + h[at + j])
    owner = doc[at]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):  # the whole sequence is one shingle
        more = np.array([0] * len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            x = np.array([U(len(found[d]))])
            for word in found[d]:
                x = mixed(x * U(0x9E3779B97F4A7C15) + U(known[word]))
            more[i] = x[0]
        s, owner = np.concatenate([s, more]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], s[keep]


def signatures(doc: np.ndarray, h: np.ndarray, n: int, bins: int, orders: np.ndarray) -> np.ndarray:
    """(n, bins) values; rows of documents without shingles are 0. doc and h are sorted; orders[i] ranks the full bins for bin i."""
    sig = np.zeros((n, bins), np.uint64)
    full = np.zeros((n, bins), bool)
    b = (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (b[1:] != b[:-1])
    sig[doc[first], b[first]] = h[first]
    full[doc[first], b[first]] = True
    rows, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(bins):
        if not len(rows):
            break
        other = orders[empty, attempt]
        hit = full[rows, other]
        sig[rows[hit], empty[hit]] = sig[rows[hit], other[hit]]
        rows, empty = rows[~hit], empty[~hit]
    return sig


def parities(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY) words: each shingle flips the bit of its document that its lowest bits name."""
    wide = 64 * PARITY
    odd = np.bincount(doc * wide + (h & U(wide - 1)).astype(np.int64), minlength=n * wide) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, wide), axis=1).view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """(id, n, key_a, key_b, bands, parity): set size, 128 bits that equal sets share, bucket hashes and parities."""
    kind = docs.schema[id_col].dataType.simpleString()
    bins = bands * rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        rng = np.random.default_rng(seed)
        orders = np.argsort(rng.random((bins, bins)), axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                m = part.num_rows
                doc, h = shingle_sets(part.column(1).to_pylist(), known, k)
                n = np.bincount(doc, minlength=m)
                edge = np.cumsum(n) - n
                sums = [np.zeros(m, np.uint64) for _ in range(2)]
                for i, total in enumerate(sums):
                    upto = np.concatenate([[U(0)], np.cumsum(mixed(h + U(1 + i)))])
                    total += upto[edge + n] - upto[edge]
                sig = signatures(doc, h, m, bins, orders).reshape(m, bands, rows)
                band = np.arange(1, bands + 1, dtype=np.uint64) * np.ones((m, 1), np.uint64)
                for r in range(rows):
                    band = mixed(band * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[n > 0].ravel().view(np.int64)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * PARITY), pa.array(parities(doc, h, m).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), held, bits], names=["id", "n", "key_a", "key_b", "bands", "parity"]
                )

    return docs.select(id_col, text_col).mapInArrow(make, f"id {kind}, n long, key_a long, key_b long, bands array<long>, parity array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, shingles)"""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                doc, h = shingle_sets(part.column(1).to_pylist(), known, k)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["id", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(make, f"id {kind}, shingles array<long>")


def united(links: DataFrame) -> DataFrame:
    """(id, component) of a bounded number of settled links, in one pass of one task."""
    kind = links.schema["u"].dataType.simpleString()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}

        def root(x):
            while (up := least.setdefault(x, x)) != x:
                least[x] = x = least[up]
            return x

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(u), root(v)
                least[max(a, b)] = min(a, b)
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), kinds), pa.array([root(x) for x in list(least)], kinds)], names=["id", "component"])

    return links.coalesce(1).mapInArrow(unite, f"id {kind}, component {kind}")


def components(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """(u, v) links to (id, component): the least id reachable, by alternating large and small stars until only stars are left: every u has one
    v, and no v is a u. Links that are such stars already need no round; up to `most` links, counted, a single task unites them, with the same result."""
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if now.limit(most + 1).count() <= most:
        return settle(united(now))
    while True:
        ends = now.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"))
        if ends.join(now.select(F.col("v").alias("u"), F.lit(True).alias("hub")).distinct(), "u", "left").where("a <> b or hub").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        now = settle(large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Of the settled pairs (u, v) those that are links, by their full sets; sets that no pair needs are not moved."""
    needed = settle(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct())
    held = shingles.join(small(needed), "id", "left_semi")
    one = lambda c: held.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(one("u"), "u").join(one("v"), "v").withColumn("common", F.size(F.array_intersect("set_u", "set_v")))
    return both.where(100 * F.col("common") >= percent * (F.size("set_u") + F.size("set_v") - F.col("common"))).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80, rows: int = 7, miss: float = 1e-8, growth: int = 32) -> DataFrame:
    """(id, n_shingles, component_id) for each row, of links with 100 * intersection >= percent * union.

    There are as many bands of `rows` bins as leave a pair at the threshold apart with probability `miss`.
    growth: from round to round a bucket has so many times the centres; the number of rounds is the logarithm of the largest bucket's unlinked members."""
    bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1
    sketches = settle_table(sketch(docs, id_col, text_col, k, bands, rows))
    filled = sketches.where((F.col("n") > 0) & F.col("id").isNotNull())
    # the least id stands for all with its set; equal sets have equal bands
    sets = settle_table(
        filled.groupBy("key_a", "key_b").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    )
    del filled
    tidy(docs.sparkSession)  # what the sets were grouped with
    bits = [f"p{i}" for i in range(PARITY)]
    members = sets.select(F.explode(F.array_distinct("bands")).alias("bucket"), "id", "n")
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    live = members.join(crowded, "bucket")
    shown = sets.select("id", *(F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(bits)))
    live = settle(live.join(shown, "id").withColumn("comp", F.col("id")))
    del members, crowded, shown
    tidy(docs.sparkSession)  # all members of all buckets
    shingles = links = tested = comps = None
    centres, turn = 1, 0
    while not live.isEmpty():
        if shingles is None:
            held = live.select(F.col("id").alias(id_col)).distinct()
            shingles = settle_table(full_sets(docs.select(id_col, text_col).join(held, id_col, "left_semi"), id_col, text_col, k))
            del held
            tidy(docs.sparkSession)
        placed = live.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(centres)))
        chosen = settle(placed.groupBy("bucket", "part").agg(F.min(F.struct("id", "n", "comp", *bits)).alias("c")))
        differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"c.{p}"))) for p in bits[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("c.p0"))))
        star = live.join(chosen.select("bucket", "c"), "bucket").where(
            (F.col("comp") != F.col("c.comp")) & (100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n"))) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("c.n")))
        )
        pairs = star.select(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v")).distinct()
        pairs = settle(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        found = settle(confirmed(pairs, shingles, percent))
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comps = components(links)
        # centres have met all of their bucket; a bucket whose rest is of one component has no more to find
        rest = placed.join(chosen.select("bucket", "part", F.col("c.id").alias("gone")), ["bucket", "part"]).where("id <> gone").drop("part", "gone", "comp")
        rest = rest.withColumn("comp", F.col("id")) if comps is None else rest.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        rest = settle(rest)
        more = rest.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
        live = settle(rest.join(more, "bucket"))
        centres, turn = centres * growth, turn + 1
        del placed, chosen, star, found, rest, more
        tidy(docs.sparkSession)
    sets = sets.drop("bands", "parity")
    owner = sets if comps is None else sets.join(comps, "id", "left")
    owner = owner.withColumn("component", F.col("id") if comps is None else F.coalesce("component", "id"))
    owner = owner.where((F.col("copies") > 1) | (F.col("component") != F.col("id"))).select("key_a", "key_b", "component")
    out = sketches.drop("bands", "parity").join(owner, ["key_a", "key_b"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
