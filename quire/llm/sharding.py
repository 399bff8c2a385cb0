"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, the rows are sorted by the index on the curve through their cells, and the curve is cut into runs
of equal numbers of rows (law `rows`) or of equal bytes (law `bytes`). Each run is a shard, so a shard covers a compact box of the
dimensions, and readers can skip shards by the least and greatest values of any of them.

The order is total: curve index, then a checksum of the text, then the id; so equal texts stand together where language, source and length are equal too, and
only there. It is made by one range sort of narrow
rows; positions come from counts for each sorted partition, so no task sees all rows and the texts are not moved to find the shards.

Defined results: null dimensions fall into cell 0; a null text has 8 bytes and checksum 0; rows that are equal in id and text are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import free_prefix, load, settle, small, without


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Indexes on the Hilbert curve of integer points (rows of cells), each below 2**bits, by Skilling's transpose form."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def category(column: Column, bits: int) -> Column:
    """A cell for equal values, from 1; null has 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(1 + F.crc32(column.cast("string").cast("binary")) % ((1 << bits) - 1))


def magnitude(column: Column, bits: int, steps: int = 8) -> Column:
    """Cells of the logarithm, `steps` to a doubling; null and what is below 0 have 0."""
    value = F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(steps * F.log2(1 + value)), F.lit((1 << bits) - 1)).cast("long")


def curve_order(rows: DataFrame, cells: list[Column], bits: int, ties: list[str], weight: Column) -> DataFrame:
    """rows with hilbert, position (from 0 in curve order), before (weights of earlier rows) and the totals."""

    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(points.to_numpy(), bits) if len(points) else np.zeros(0, np.int64))

    placed = rows.withColumn("hilbert", index(F.struct(*(c.cast("long").alias(f"c{i}") for i, c in enumerate(cells)))))
    order = ["hilbert", *ties]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("weight", weight.cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(placed.withColumn("row", F.monotonically_increasing_id()))
    part, row = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    totals = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("part_weight"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "part",
        F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("first"),
        F.coalesce(F.sum("part_weight").over(along), F.lit(0)).alias("weight_before"),
        F.sum("rows").over(everything).alias("all_rows"),
        F.sum("part_weight").over(everything).alias("all_weight"),
    )
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("part", part).withColumn("at", row).join(small(settle(totals)), "part").withColumn("position", F.col("first") + F.col("at"))
    return placed.withColumn("run", F.coalesce(F.sum("weight").over(inside), F.lit(0)) + F.col("weight_before"))


def shard_plan(docs: DataFrame, dims: list[tuple[str, str]], id_col="doc_id", text_col="text", shards: int = 24, law: str = "rows", bits: int = 8) -> DataFrame:
    """(id, size, text_crc32, hilbert, shard, slot) for each row. dims: (column, "category" or "magnitude")."""
    kinds = {"category": category, "magnitude": magnitude}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(kinds[kind](F.col(c), bits).alias(f"d{i}") for i, (c, kind) in enumerate(dims)),
    )
    placed = curve_order(rows, [F.col(f"d{i}") for i in range(len(dims))], bits, ["text_crc32", "id"], F.col("size"))
    if law == "rows":  # the first all_rows % shards shards have one row more
        base, more = F.floor(F.col("all_rows") / shards), F.col("all_rows") % shards
        edge = (base + 1) * more
        shard = F.when(F.col("position") < edge, F.floor(F.col("position") / (base + 1))).otherwise(more + F.floor((F.col("position") - edge) / F.greatest(base, F.lit(1))))
        first = shard * base + F.least(shard, more)
        placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("position") - first).cast("long"))
    elif law == "bytes":  # by the middle of each row
        shard = F.least(F.floor((2 * F.col("run") + F.col("weight")) * shards / (2 * F.col("all_weight"))), F.lit(shards - 1))
        placed = placed.withColumn("shard", shard.cast("int"))
        firsts = placed.groupBy("shard").agg(F.min("position").alias("shard_first"))
        placed = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("position") - F.col("shard_first"))
    else:
        raise ValueError(f"law {law!r}: rows or bytes")
    return placed.select("id", "size", "text_crc32", "hilbert", "shard", "slot")


def write_shards(docs: DataFrame, path: str, dims: list[tuple[str, str]], id_col="doc_id", **options) -> DataFrame:
    """Write the rows as one folder of Parquet a shard, sorted by slot. Returns the plan.

    Rows of one id, or of none, meet the plan by the checksum of their text as well, and equal ones by their number among these, which may stand for
    either. A column of docs that is named shard or slot is replaced."""
    text_col = options.get("text_col", "text")
    plan = settle(shard_plan(docs, dims, id_col, **options))
    own = free_prefix("shard__", docs.columns)
    key = [F.col("id").alias(f"{own}id"), F.col("text_crc32").alias(f"{own}crc")]
    kept = without(docs.columns, ["shard", "slot"])
    rows = docs.withColumn(f"{own}id", F.col(id_col)).withColumn(f"{own}crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    place = plan.select(*key, "shard", "slot")
    odd = plan.groupBy("id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(*key)
    odd = settle(odd)
    right = place.select(*(F.col(c).alias(f"{own}{n}") for c, n in ((f"{own}id", "p_id"), (f"{own}crc", "p_crc"), ("shard", "p_shard"), ("slot", "p_slot"))))
    of = lambda c: F.col(f"{own}{c}")
    if odd.isEmpty():
        joined = rows.join(right, (of("id") == of("p_id")) & (of("crc") == of("p_crc")))
    else:
        number = lambda a, b, *by: F.row_number().over(Window.partitionBy(of(a), of(b)).orderBy(*by))
        left = rows.withColumn(f"{own}k", number("id", "crc", F.xxhash64(*kept)))
        right = right.withColumn(f"{own}p_k", number("p_id", "p_crc", of("p_shard"), of("p_slot")))
        joined = left.join(right, of("id").eqNullSafe(of("p_id")) & (of("crc") == of("p_crc")) & (of("k") == of("p_k")))
    joined = joined.select(*kept, of("p_shard").alias("shard"), of("p_slot").alias("slot"))
    joined = joined.repartitionByRange(docs.sparkSession.sparkContext.defaultParallelism * 3, "shard", "slot")
    joined.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return plan.select(F.col("id").alias(id_col), "shard", "slot")


#: Fixed values of the query: dimensions and their quantisation.
DIMS = [("lang", "category"), ("source", "category"), ("n_chars", "magnitude")]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), DIMS)
    return plan.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
