"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Base statistics of every whole text are turned into a short vector. For each language and source a minimum-covariance-determinant estimate
is found by concentration steps: distances to the present centre, the h rows that are nearest, their mean and covariance again. Two starts
are followed, and the smaller determinant wins; a reweighting step follows. Rows beyond a chi-square cutoff are rejected.

At any size a step is one aggregation: rows are counted and summed by (group, distance bin), and the nearest bins that hold h rows make the
next estimate. The vector is kept in whole 64ths, so sums are exact and don't depend on the order of rows. A group with fewer than
`least` rows takes the estimate of its language, then that of all rows.

Defined results: a null text counts as empty (no words, fails the base rule); null languages and sources are groups of their own; rows that
fail the base rule take no part in the estimates; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, let, load, settle, small, without, words

P = 4
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


#: Bits of a packed window hash that hold its place.
PLACE = 22


def window_hashes(ws: Column) -> Column:
    return F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    )


def packed_windows(h: Column) -> Column:
    """Sorted leading hash bits with places, for texts in which a window occurs twice; null for the others and for enormous ones."""
    some = (F.size(F.array_distinct(h)) < F.size(h)) & (F.size(h) < 1 << PLACE)
    mask = F.lit(-1 << PLACE)
    return F.when(some, F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))))


def repeat_words(h: Column, packed: Column) -> Column:
    """Number of words in three-word windows that occur twice or more in a text. Windows are compared by 64-bit hashes."""
    lead = lambda k: F.shiftright(F.get(packed, k), PLACE)
    near = F.filter(packed, lambda x, k: (F.shiftright(x, PLACE) == lead(k + 1)) | ((k > 0) & (F.shiftright(x, PLACE) == lead(F.abs(k - 1)))))
    near = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    near = F.when(packed.isNotNull(), near).when(F.size(h) < 1 << PLACE, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(h) - 1))

    def covered(placed: Column) -> Column:
        at = lambda k: F.get(placed, k)["h"]
        twice = F.filter(placed, lambda x, k: (x["h"] == at(k + 1)) | ((k > 0) & (x["h"] == at(F.abs(k - 1)))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))

    return let(F.sort_array(F.transform(near, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))), covered)


def base_statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def vector() -> list[Column]:
    """Transformed statistics: length, word length, rate of symbols, rate of repeated words; natural logarithms in 64ths."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    x = [F.log1p(F.col("n_words")), 2 * F.log(chars / n), F.log1p(200 * F.col("n_symbols") / chars), F.log1p(20 * F.col("n_repeat_words") / n)]
    return [F.round(64 * v).cast("long") for v in x]


#: Standard deviation, in 64ths, below which a coordinate's spread counts as noise.
FLOOR = 24.0


def factored(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """n, s_i, q_i_j to mean m_i and the Cholesky factor l_i_j of the covariance."""
    df = sums.select(*keys, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *((F.col(f"q{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in PAIRS))
    for i, j in PAIRS:
        c = factor * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR**2 if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1.0))) if i == j else c / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))).drop(*(f"q{i}{j}" for i, j in PAIRS))


def squared_distance() -> Column:
    """Of x0.. from the estimate in the same row, by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((F.pow(v, F.lit(2.0)) for v in z), F.lit(0.0))


def moments() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS),
    ]


def chi2_even(x: float, half: int) -> float:
    """Chi-square distribution with 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi2_point(p: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_even(mid, half) < p else (low, mid)
    return low


def estimates(vectors: DataFrame, share: float = 0.75, steps: int = 6, least: int = 80) -> DataFrame:
    """(g, x0..) to one reweighted estimate for each g with `least` rows."""
    rows = vectors.groupBy("g").agg(*moments(), *(F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)))
    rows = settle(rows.where(F.col("n") >= least))
    total = rows.select("g", F.col("n").alias("all_n"))
    classical = factored(rows, ["g"], 1.0).withColumn("start", F.lit(0))
    spread = lambda i: F.greatest((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, F.lit(FLOOR))
    coordinates = rows.select(
        "g",
        *(F.get(f"p{i}", F.lit(1)).cast("double").alias(f"m{i}") for i in range(P)),
        *((spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS),
        F.lit(0.0).alias("logdet"),
        F.lit(1).alias("start"),
    )
    now = settle(classical.unionByName(coordinates))
    point = chi2_point(share, P // 2)
    factor = share / chi2_even(point, P // 2 + 1)
    grade = F.floor(16 * F.log2(1 + F.col("d2"))).cast("int")
    for step in range(steps):
        binned = vectors.join(small(now), "g").withColumn("d2", squared_distance()).groupBy("g", "start", grade.alias("bin")).agg(*moments())
        upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        near = binned.join(small(total), "g").withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < share * F.col("all_n"))
        sums = near.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS))))
        now = settle(factored(sums, ["g", "start"], factor))
    best = now.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now = settle(now.join(best, ["g", "start"]))
    inner = vectors.join(small(now), "g").withColumn("d2", squared_distance()).where(F.col("d2") <= chi2_point(0.975, P // 2))
    return settle(factored(inner.groupBy("g").agg(*moments()), ["g"], 0.975 / chi2_even(chi2_point(0.975, P // 2), P // 2 + 1)))


def judge(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", reject: float = 1e-7, least: int = 80, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The `carry` columns of every row (all but the text if not given) with the statistics, base_failed, kept and distance2, these with a prefix.

    A column to carry that is named like one of these is replaced by it; where it must stay, choose another prefix."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    carry = without([c for c in docs.columns if c != text_col] if carry is None else carry, [prefix + c for c in (*made, "kept", "distance2")])
    named = [F.col(c).alias(f"in_{k}") for k, c in enumerate(carry)]
    stats = docs.select(*named, F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"), words(F.col(text_col)).alias("ws"), *(c.alias(n) for n, c in base_statistics(F.col(text_col)).items()))
    stats = stats.select("*", F.size("ws").cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), window_hashes(F.col("ws")).alias("h")).drop("ws")
    stats = stats.select("*", packed_windows(F.col("h")).alias("packed"))
    stats = stats.select("*", repeat_words(F.col("h"), F.col("packed")).cast("long").alias("n_repeat_words")).drop("h", "packed")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    text_of = lambda *c: F.to_json(F.array(*(F.col(x).cast("string") for x in c)))  # noqa: E731  null and "null" differ
    stats = stats.select("*", *(v.alias(f"x{i}") for i, v in enumerate(vector())), F.array(text_of("g_lang", "g_source"), text_of("g_lang"), F.lit("[]")).alias("levels"))
    stats = settle(stats)
    passed = stats.where(~F.col("base_failed")).select(F.explode("levels").alias("g"), *(f"x{i}" for i in range(P)))
    found = estimates(passed, least=least)
    one = lambda at: small(found).select(F.col("g").alias(f"g{at}"), F.struct(*(c for c in found.columns if c != "g")).alias(f"e{at}"))
    joined = stats
    for at in range(3):
        joined = joined.join(one(at), F.get("levels", F.lit(at)) == F.col(f"g{at}"), "left")
    joined = joined.withColumn("e", F.coalesce("e0", "e1", "e2")).select("*", "e.*").withColumn("d2", squared_distance())
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi2_point(1 - reject, P // 2)))
    return joined.select(
        *(F.col(f"in_{k}").alias(c) for k, c in enumerate(carry)), *(F.col(c).alias(prefix + c) for c in made), kept.alias(f"{prefix}kept"), F.col("d2").alias(f"{prefix}distance2")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
