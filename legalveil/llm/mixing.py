"""Mixing sources to target weights, with DataFrame operations only.

Each row gets a hash-random key. Keys of a source are dealt into ranges of about ``range_rows``
rows, so a hot source is many ranges and never one task. Sizes are summed by range, a prefix sum
runs over the few ranges of each source, and a second one inside each range; a row therefore knows
how many words of its source come before it. A source takes whole epochs while its target allows,
and then rows in key order up to its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
RANGE_ROWS = 8_192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: its words, rows, weight and target.

    Sources in code-point order (null last) take the weights in turn. All share ``share`` times
    the words; a target stops at ``most`` times its source, and the excess goes to the others by
    weight until none is above. In order of cap / weight that is one pass: the level is the
    largest of (budget - caps before) / (weight from here on)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("level", (budget - before) / rest)
    level = F.max("level").over(Window.partitionBy())
    return by.select("source", "source_size", "n_rows", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", seed="mix", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, epochs, last_taken.

    ``taken`` = ``epochs`` * size + ``last_taken``; the row at the cut takes only what is left of
    the budget. Null or empty text has size 0 and takes nothing; a null source is a source of its
    own; repeated rows each count; an empty table gives no rows. The key is md5 of seed and id, so
    reruns agree; ties (equal ids) are settled by size."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "of")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    ranges = F.ceil(F.col("n_rows") / F.lit(range_rows))
    dealt = (
        sizes.join(t, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
        .withColumn("key", key)
        .withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * ranges / F.lit(2.0**32)).cast("long"))
    )
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    through = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(through), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", whole)
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("ahead") - F.col("inside")
    rows = rows.withColumn("last_taken", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last_taken")).alias("taken"), "epochs", "last_taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each document as often as the mix takes it: its epochs, and once more where the
    last pass takes at least half of it. Texts stay whole. Documents without words take no part."""
    got = mix(docs, **options)
    copies = F.col("epochs") + F.when((F.col("last_taken") > 0) & (2 * F.col("last_taken") >= F.col("size")), 1).otherwise(0)
    one = got.filter("size > 0").groupBy(F.col("doc_id").alias("__lv_id")).agg(F.max(copies).alias("__lv_copies")).filter("__lv_copies > 0")
    key = options.get("id_col", "doc_id")
    out = docs.join(one.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__lv_id")))
    return out.withColumn("__lv_copy", F.explode(F.sequence(F.lit(1), F.col("__lv_copies")))).select(*docs.columns)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || doc_id) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(weight * max(level) OVER (), cap) AS target FROM v),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(CAST(floor(target - epochs * source_size) AS BIGINT) - ahead, size)) AS BIGINT) AS taken FROM r
"""
