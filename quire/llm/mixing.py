"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key from its id. Within a source the keys order the rows; equal ranges of the key (runs) give distributed
prefix sums of the sizes, and only the run in which a source's budget ends is sorted row by row. A source whose target is above its size
is taken whole as often as it fits, then cut the same way.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, ordered last; rows that share an id
(repeated rows, null ids) share their key and what the cut leaves for them, in proportion to their sizes; an empty table gives an empty
result. Other columns are kept as they are; one that is named like a column of the result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, free_prefix, load, settle, small, without, word_count

#: Weights in code point order of the sources, repeating.
WEIGHTS = (3, 1, 2)


def key_of(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The targets share `share` times all sizes by weight, none above `cap` times its source; what is above is shared again by weight
    among the others. That fixed point is found in one pass: in the order of cap / weight, the first sources are full, and the others get
    one common rate times their weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    full = cap * F.col("source_size")
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rate = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("weight")).withColumn("rate", rate)
    common = F.max(F.when(F.col("rate") <= F.col("ratio"), F.col("rate"))).over(everything)  # the first: later ones are lower
    return ranked.withColumn("common", common).select(
        "source", "source_size", F.when(F.col("common").isNull(), F.col("full")).otherwise(F.least("full", F.col("common") * F.col("weight"))).alias("target")
    )


def cuts(keyed: DataFrame, goal: DataFrame, digits: int = 3) -> DataFrame:
    """For each source: whole rounds, the key at which its budget ends, and the numbers left for and held by the rows of that key."""
    runs = keyed.groupBy("source", F.substring("key", 1, digits).alias("run")).agg(F.sum("size").alias("run_size"))
    along = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    budget = goal.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("rounds"),
    ).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("rounds") * F.col("source_size"))
    at = (
        runs.withColumn("before", F.coalesce(F.sum("run_size").over(along), F.lit(0)))
        .join(small(settle(budget)), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("run_size")))
        .select("s", "source_size", "target", "rounds", "run", (F.col("rest") - F.col("before")).alias("left"))
    )
    at = settle(at)
    inside = (
        keyed.withColumn("run", F.substring("key", 1, digits))
        .join(small(at.select("s", "run", "left")).withColumnRenamed("run", "r"), F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
        .groupBy("s", "key", "left")
        .agg(F.sum("size").alias("held"))
    )
    before = F.coalesce(F.sum("held").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("left", F.col("left") - before).where((F.col("left") >= 0) & (F.col("left") < F.col("held")))
    inside = inside.select(F.col("s").alias("s2"), F.col("key").alias("cut_key"), "left", "held")
    return budget.join(inside, F.col("s").eqNullSafe(F.col("s2")), "left").select(
        "s", "source_size", "target", "rounds", "cut_key", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("held", F.lit(1)).alias("held")
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed="mix", weights=WEIGHTS, share=1.5, cap=2.0, prefix="mix_") -> DataFrame:
    """The rows of docs with the columns size, source_size, target and taken (words taken, repeats counted), each after the prefix."""
    keyed = settle(docs.select(F.col(source_col).alias("source"), key_of(F.col(id_col), seed).alias("key"), word_count(F.col(text_col)).alias("size")))
    goal = settle(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    plan = settle(cuts(keyed, goal))
    own = free_prefix("plan__", docs.columns)
    plan = plan.select(*(F.col(c).alias(f"{own}{c}") for c in plan.columns))
    of = lambda c: F.col(f"{own}{c}")
    joined = docs.withColumn(f"{own}size", word_count(F.col(text_col))).join(small(plan), F.col(source_col).eqNullSafe(of("s")))
    key = key_of(F.col(id_col), seed)
    part = F.when(of("cut_key").isNull() | (key > of("cut_key")), F.lit(0)).when(key < of("cut_key"), of("size")).otherwise(F.floor(of("size") * of("left") / of("held"))).cast("long")
    made = {"size": of("size"), "source_size": of("source_size"), "target": of("target"), "taken": of("rounds") * of("size") + part}
    return joined.select(*without(docs.columns, [f"{prefix}{c}" for c in made]), *(v.alias(f"{prefix}{c}") for c, v in made.items()))


def expand(mixed: DataFrame, text_col="text", prefix="mix_") -> DataFrame:
    """The rows as the mix has them: whole copies, then for the row at a cut the words that are left for it; without the four columns of the mix.

    n_chars, where there is one, follows the text."""
    plain = without(mixed.columns, [f"{prefix}{c}" for c in ("size", "source_size", "target", "taken")])
    own = free_prefix("cut__", mixed.columns)
    size, taken, text = F.col(f"{prefix}size"), F.col(f"{prefix}taken"), F.col(text_col)
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0)).cast("int")
    cut = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))
    copies = mixed.withColumn(f"{own}words", F.explode(F.concat(F.array_repeat(F.lit(0), whole), cut)))
    words = F.col(f"{own}words")
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    first = F.slice(F.split(F.ltrim(text, F.lit(SPACE)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), words)
    out = copies.withColumn(text_col, F.when(words > 0, F.concat(lead, F.array_join(first, ""))).otherwise(text))
    if "n_chars" in plain and text_col != "n_chars":
        out = out.withColumn("n_chars", F.when(words > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*plain)


def mixed_rows(docs: DataFrame, text_col="text", **options) -> DataFrame:
    """Rows of docs as often as the mix takes them, all columns kept, whatever their names."""
    prefix = free_prefix("mix_", docs.columns)
    return expand(mix(docs, text_col=text_col, prefix=prefix, **options), text_col, prefix)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
                  md5('mix-' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, cap / weight AS ratio,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM w),
c AS (SELECT source, source_size, cap, weight, max(CASE WHEN rate <= ratio THEN rate END) OVER () AS common FROM r),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.rounds, floor(b.target)::BIGINT - b.rounds * b.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS held
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + CASE WHEN rest >= upto THEN size WHEN rest <= upto - held THEN 0 ELSE floor(size * (rest - upto + held) / held) END)::BIGINT AS taken
FROM p
"""
