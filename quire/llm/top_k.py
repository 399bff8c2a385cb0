"""Exact top-k search by inner product, with a pivot table.

Components are turned into whole numbers, so scores are exact. For every vector its distances to a table of pivots are kept. By the triangle inequality each pivot
gives a lower bound of the distance from a query to a vector; the greatest of them bounds the inner product from above, and what is bounded
below a query's k-th score so far is not scored; a vector that could tie is.

Vectors are laid out by their nearest pivot and their distance to it, then cut into blocks and these into strips, each with the interval of its distances to
every pivot. The table eliminates at three levels: pairs of a block of queries and a block of vectors before their data meet; strips of a
block, taken in the order of their bounds until these fall below all scores; and single vectors of a strip where few queries are left.

Queries and vectors meet block by block: each pair of a query block and a vector block that is left is one row of a join, dealt by the numbers of both, so a
task holds two blocks and the k best of its queries. Pivots, and the scores a query starts from, come from a sample of at most `sample` vectors; every
vector is in the index, so this changes the speed only. On vectors without any structure (random directions in many dimensions) distances to pivots hardly
differ, little can be eliminated, and nearly all pairs are scored.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; shorter vectors count as padded with zeros; a row that
repeats an id is a candidate of its own, and a query is not its own candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import load, settle, settle_table, small

#: Vectors of an index block, of a query block and of a strip.
BLOCK, ASKED, STRIP = 1024, 4096, 64
COLUMNS = ["n", "uids", "ids", "vectors", "reach"]
#: Slack for distances, which are kept as 32-bit numbers.
NEAR, FAR = 1 - 1e-6, 1e-3


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d2, 0))


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Far apart from each other: each next one is farthest from those before."""
    if not len(x):
        return x
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(most, len(x)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def laid_out(rows: DataFrame, dims: int, pivots: np.ndarray, scale: float, parts: int) -> DataFrame:
    """(uid, id, v) sorted by nearest pivot and distance to it, in `parts` partitions; ranges of both, so a crowded pivot is split."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(padded(batch.column("v"), dims, scale), held.value)
            cell = far.argmin(axis=1) if far.shape[1] else np.zeros(batch.num_rows, np.int64)
            at = far[np.arange(len(cell)), cell] if far.shape[1] else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(at)], names=[*batch.schema.names, "cell", "at"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"uid long, id long, v {kind}, cell int, at double")
    many = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["cell", "at", "uid"]
    return placed.repartitionByRange(many, *order).sortWithinPartitions(*order).coalesce(parts).select("uid", "id", "v")


def padded(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """Whole components, one row a vector."""
    sizes = np.array([len(v.values) for v in column], np.int64)
    x = np.zeros((len(sizes), dims))
    if len(sizes):
        inside = np.arange(dims)[None, :] < sizes[:, None]
        x[inside] = column.flatten().to_numpy()
    return whole(x, scale)


def blocks_of(rows: DataFrame, dims: int, pivots: np.ndarray, scale: float, size: int) -> DataFrame:
    """(n, uids, ids, vectors, reach, low, high, longest): reach holds distances to the pivots as 32-bit numbers, low and high their intervals, longest the greatest squared length."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = padded(part.column("v"), dims, scale)
                narrow = np.float32 if np.abs(x).max(initial=0) < 2**24 else np.float64
                reach = distances(x, held.value).astype(np.float32)
                cols = [part.column("uid").to_numpy().tobytes(), part.column("id").to_numpy().tobytes(), x.astype(narrow).tobytes(), reach.tobytes()]
                low, high = ([f(axis=0).astype(np.float64).tolist()] for f in (reach.min, reach.max))
                edges = [pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64())), pa.array([float((x * x).sum(axis=1).max())])]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *(pa.array([c], pa.binary()) for c in cols), *edges], names=[*COLUMNS, "low", "high", "longest"])

    return rows.mapInArrow(make, "n int, uids binary, ids binary, vectors binary, reach binary, low array<double>, high array<double>, longest double")


def opened(row: dict, dims: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, uids, ids, vectors, reach = (row[prefix + c] for c in COLUMNS)
    kind = np.float32 if len(vectors) == 4 * n * dims else np.float64
    return np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(n, dims).astype(np.float64), np.frombuffer(reach, np.float32).reshape(n, -1).astype(np.float64)


def numbered(blocks: DataFrame, wide: int, step: int = 1 << 16) -> DataFrame:
    """blocks with each number qb of a query block, from 0 to below wide; in two steps, so that no row holds all numbers at once."""
    first = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(wide, 1) - 1).cast("long"), F.lit(step).cast("long"))))
    return first.withColumn("qb", F.explode(F.sequence("qb", F.least(F.col("qb") + step, F.lit(max(wide, 1)).cast("long")) - 1)))


def block_bound() -> Column:
    """Of the inner products of any query of a block (q_low, q_high, q_longest) with any vector of another (low, high, longest)."""
    over = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    gap = F.greatest(F.coalesce(F.greatest(over("low", "q_high"), over("q_low", "high")), F.lit(0.0)) * NEAR - FAR, F.lit(0.0))
    return (F.col("longest") + F.col("q_longest") - gap * gap) / 2 + 0.5


def search(vectors: DataFrame, is_query, id_col="vec_id", vector_col="embedding", k: int = 5, scale: float = 256.0, pivots: int = 32, sample: int = 2000) -> DataFrame:
    """(query_id, rank, id, score) of the k best vectors for each row for which the column is_query holds."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    rows = settle_table(rows.withColumn("uid", F.monotonically_increasing_id()))  # a row's own number, as ids may repeat
    held, wanted, dims = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce("q", F.lit(False))), F.max(F.size("v"))).first()
    dims = dims or 1
    picked = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    seen = np.zeros((len(picked), dims))
    for r, row in enumerate(picked):
        seen[r, : len(row["v"])] = row["v"]
    seen = whole(seen, scale)
    seen_ids = np.array([row["id"] for row in picked], np.int64)
    table = choose_pivots(seen, pivots)
    start = vectors.sparkSession.sparkContext.broadcast((seen_ids, seen))
    groups = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = laid_out(rows.select("uid", "id", "v"), dims, table, scale, max(groups, -(-held // (64 * BLOCK))))
    index = settle_table(blocks_of(index, dims, table, scale, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    asked = laid_out(rows.where("q").select("uid", "id", "v"), dims, table, scale, max(1, -(-wanted // (2 * ASKED))))  # so that a query block is nearly full
    asked = blocks_of(asked, dims, table, scale, ASKED).withColumn("block", F.monotonically_increasing_id())

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                floor = floors(opened(one.to_pylist()[0], dims), *start.value, k)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([floor.tobytes()], pa.binary()), pa.array([float(floor.min())])], names=[*one.schema.names, "floor", "lowest"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    asked = settle_table(asked.mapInArrow(with_floor, f"{shape}, floor binary, lowest double"))
    wide = asked.count()
    numbers = settle(asked.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("qb")))
    asked = asked.join(small(numbers), "block").drop("block")
    # pairs of blocks, by their edges alone; a pair whose bound is below the least floor of its queries has nothing to find
    edges = settle(asked.select("qb", *(F.col(c).alias(f"q_{c}") for c in ("low", "high", "longest")), "lowest"))
    pairs = numbered(index.select("block", "low", "high", "longest"), wide).join(small(edges), "qb").where(block_bound() >= F.col("lowest")).select("block", "qb")
    queries = asked.select("qb", "floor", *(F.col(c).alias(f"q_{c}") for c in COLUMNS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["qb"] != at:
                    if at is not None:
                        yield best.rows()
                    at, best = row["qb"], Best(opened(row, dims, "q_"), np.frombuffer(row["floor"], np.float64), k)
                best.meet(opened(row, dims))
        if at is not None:
            yield best.rows()

    # dealt by both numbers, so that the blocks of a query block spread over tasks; the query block goes where its pairs are
    dealt = index.select("block", *COLUMNS).join(pairs, "block").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    right = queries.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    joined = dealt.join(right, ["qb", "g"]).select("qb", "floor", *COLUMNS, *(f"q_{c}" for c in COLUMNS))
    found = joined.sortWithinPartitions("qb").mapInArrow(meet, "query long, query_id long, id long, score long")
    own = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def floors(q, ids: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of each query reaches at least: the k-th best of the sample without its own id."""
    if len(ids) <= k:
        return np.full(len(q[0]), -np.inf)
    scores = q[2] @ seen.T
    scores[q[1][:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


class Best:
    """The k best vectors of each query of a block. scored counts the pairs whose score was computed, of `pairs` that were met."""

    def __init__(self, queries, floor: np.ndarray, k: int):
        self.uids, self.ids, self.q, self.reach = queries
        self.k, self.edge = k, floor.copy()
        self.norms = (self.q * self.q).sum(axis=1)
        self.row, self.score, self.cand = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.pairs = self.scored = 0

    def bound(self, which: np.ndarray | slice, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """(queries, sets of vectors) upper bounds of inner products, from intervals of distances to the pivots."""
        reach = self.reach[which]
        gap = np.zeros((len(reach), len(low)))
        for p in range(reach.shape[1]):
            r = reach[:, p, None]
            np.maximum(gap, np.maximum(low[:, p] - r, r - high[:, p]), out=gap)
        return (self.norms[which][:, None] + longest - np.maximum(gap * NEAR - FAR, 0) ** 2) / 2 + 0.5

    def meet(self, block) -> None:
        uids, ids, x, far = block
        self.pairs += len(self.q) * len(x)
        cut = np.arange(0, len(x), STRIP)
        norms = (x * x).sum(axis=1)
        strips = self.bound(slice(None), np.minimum.reduceat(far, cut), np.maximum.reduceat(far, cut), np.maximum.reduceat(norms, cut))
        found: list[tuple] = []
        for s in np.argsort(-(strips - self.edge[:, None]).max(axis=0), kind="stable").tolist():
            asked = np.flatnonzero(strips[:, s] >= self.edge)
            if not len(asked):  # nor has any later one
                break
            of = np.arange(cut[s], min(cut[s] + STRIP, len(x)))
            if 4 * len(asked) < len(self.q):  # few queries: look at single vectors
                of = of[(self.bound(asked, far[of], far[of], norms[of]) >= self.edge[asked][:, None]).any(axis=0)]
            scores = self.q[asked] @ x[of].T
            self.scored += scores.size
            r, c = np.nonzero((scores >= self.edge[asked][:, None]) & (uids[of][None, :] != self.uids[asked][:, None]))
            found.append((asked[r], scores[r, c], ids[of][c]))
            if sum(len(f[0]) for f in found) > 4 * self.k * len(self.q):
                self.keep(found)
                found = []
        self.keep(found)

    def keep(self, found: list[tuple]) -> None:
        row, score, cand = (np.concatenate([old, *new]) for old, new in zip((self.row, self.score, self.cand), zip(*found) if found else ((), (), ())))
        order = np.lexsort((cand, -score, row))
        row, score, cand = row[order], score[order], cand[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        last = place == self.k - 1
        self.edge[row[last]] = np.maximum(self.edge[row[last]], score[last])
        keep = place < self.k
        self.row, self.score, self.cand = row[keep], score[keep], cand[keep]

    def rows(self) -> pa.RecordBatch:
        cols = (self.uids[self.row], self.ids[self.row], self.cand, self.score.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "id", "score"])


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.row AS qr, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
