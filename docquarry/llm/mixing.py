"""Mixing sources to target weights by systematic sampling (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, n_words, spread, unit_interval, with_columns_free

ADDED = ("size", "source_size", "target", "copies", "taken")
_KEY = ("_src", "_size", "_sub")
#: Rows of one source, size and digest from which on ids that are there often are dealt out by themselves.
HOT = 1 << 16


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (of whole numbers) in an order, up to and with each row, without one task for all rows.

    The rows are dealt out by ranges of the order; a window runs within each range, and what stands in the
    ranges before it is added from a table of one row a range.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(c).alias(f"_all{n}") for n, c in sums.items()])
    totals = totals.select("_r", *[F.coalesce(F.sum(f"_all{n}").over(before), F.lit(0)).alias(f"_all{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranges.join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    return joined.withColumns({n: F.sum(c).over(within) + F.col(f"_all{n}") for n, c in sums.items()}).select(*df.columns, *sums)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Targets of sources: ``share`` of all sizes dealt by weight, none above ``ceiling`` times its source.

    ``sizes`` has ``_src`` (null allowed) and ``source_size``; one row per source. Sources take the
    weights in turn by code point, null last. The excess over a ceiling goes to the others by weight
    until none is above: with sources in order of ceiling / weight, source k is full exactly when its
    ratio is at most (total - ceilings before k) / (weights from k on); that level rises up to the first
    source that is not full and falls after it, so the largest level of a source not full is the one.
    Ranks and running sums are worked out range by range, so no task holds all sources.
    """
    ranked = _running(sizes, [F.col("_src").isNull(), F.col("_src")], {"_rank": F.lit(1)})
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    weighed = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    summed = _running(weighed, [F.col("_ratio"), F.col("_rank")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    summed = materialize(summed, "mix-levels")
    total, all_weights = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    level = (F.lit(total * float(share)) - (F.col("_caps") - F.col("_cap"))) / (F.lit(all_weights) - F.col("_weights") + F.col("_weight"))
    found = summed.agg(F.max(F.when(F.col("_ratio") > level, level))).first()[0]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found) * F.col("_weight"))
    return summed.select("_src", "source_size", target.alias("target"))


def _same_group(left: DataFrame, right: DataFrame, *names: str) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[f"_of{n}"]) for n in (*_KEY, *names)])


def _dealt_out(base: DataFrame, groups: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and groups with a key of its own for each row of a crowd: an id, or no id, that fills a group.

    A crowd stands behind the other rows of its source and size, in order of a digest of the whole row, then in 256
    parts by place: equal rows may stand in any order, so any part of them is as good as another.
    """
    full = groups.where(F.col("_n") > HOT).select(*[F.col(c).alias(f"_of{c}") for c in _KEY])
    if full.isEmpty():
        return base, groups
    crowded = base.join(full, _same_group(base, full)).groupBy(*_KEY, "_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT // 16)
    crowds = materialize(crowded.select(*[F.col(c).alias(f"_of{c}") for c in (*_KEY, "_id")], F.lit(True).alias("_crowd")), "mix-crowds")
    digest = F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    part = F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, 2)
    placed = base.withColumn("_own", F.concat(F.lit("r"), digest, part))
    joined = placed.join(crowds, _same_group(placed, crowds, "_id"), "left").withColumn("_sub", F.when(F.col("_crowd"), F.col("_own")).otherwise(F.col("_sub")))
    rows = materialize(joined.select(*base.columns), "mix-rows")
    return rows, materialize(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")), "mix-groups")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` in place of the text, written once: texts are counted in one scan."""
    return materialize(with_columns_free(docs, "size").withColumn("size", n_words(F.col(text_col))).drop(text_col), "mix-sizes")


def mix_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
    size_col: str | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken: how often the mix takes each document.

    Each document of a source is expected rate = target / source_size times. Documents of a source stand
    in order of falling size (ties: two hex digits of md5 of the id, then the id); document i emits once
    for each whole number between u + (i-1) * rate and u + i * rate, where u is one random offset of the
    source. As neighbours have like sizes, the words taken miss the target by about one large document.

    The running position of a document needs no pass over its source in one task: counts by (source,
    size) and by (source, size, md5 digits) are summed first, and only the order within the last group
    is a window over rows, so neither a hot source nor a hot size meets in one task. An id that is there HOT / 16
    times in a group of over HOT rows (or so many rows without id) comes behind the others of its size, dealt out further.

    ``size_col`` names a column that has the sizes already, where the text is not at hand (``sized``).

    Null text: size 0; a very long text counts whole. Null source: a source of its own, last. Null ids: in any order after the others.
    Repeated rows count one by one. Size 0 documents are placed like others (they add no words); a source
    of size 0 has target 0 and takes none. No rows: no rows. Columns named like the added ones are replaced.
    """
    base = (
        with_columns_free(docs, *[c for c in ADDED if c != size_col], *_KEY, "_in", "_id")
        .withColumn("size", F.col(size_col) if size_col else n_words(F.col(text_col)))
        .withColumn("_src", F.col(source_col).cast("string"))
        .withColumn("_size", -F.col("size"))
        .withColumn("_id", F.col(id_col))
        .withColumn("_sub", F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 2))
    )
    base, groups = _dealt_out(base, materialize(base.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")), "mix-groups"), docs.columns)
    ranked = base.withColumn("_in", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.col(id_col).asc_nulls_last())))
    by_size = groups.groupBy("_src", "_size").agg(F.sum("_n").alias("_m"))
    per_source = by_size.groupBy("_src").agg(F.sum(-F.col("_size") * F.col("_m")).alias("source_size"))
    targets = source_targets(per_source, weights, share, ceiling)
    before_size = by_size.withColumn(
        "_ahead", F.sum("_m").over(Window.partitionBy("_src").orderBy("_size")) - F.col("_m")
    )
    within = groups.withColumn(
        "_aside", F.sum("_n").over(Window.partitionBy("_src", "_size").orderBy("_sub")) - F.col("_n")
    )
    offsets = (
        within.alias("w")
        .join(before_size.alias("b"), F.col("w._src").eqNullSafe(F.col("b._src")) & (F.col("w._size") == F.col("b._size")))
        .join(targets.alias("t"), F.col("w._src").eqNullSafe(F.col("t._src")))
        .select(
            F.col("w._src").alias("_osrc"), F.col("w._size").alias("_osize"), F.col("w._sub").alias("_osub"),
            (F.col("_ahead") + F.col("_aside")).alias("_start"), "source_size", "target",
        )
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_interval(F.col("_src"), seed)
    rank = F.col("_start") + F.col("_in")
    crossed = F.floor(offset + rank * rate) - F.floor(offset + (rank - 1) * rate)
    placed = ranked.join(
        offsets,
        ranked["_src"].eqNullSafe(offsets["_osrc"])
        & (ranked["_size"] == offsets["_osize"])
        & (ranked["_sub"] == offsets["_osub"]),
    )
    return (
        placed.withColumn("copies", F.least(crossed, F.ceil(rate)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*_KEY, "_id", "_osrc", "_osize", "_osub", "_in", "_start")
    )


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as ``mix_sources`` takes it, columns as they were."""
    columns = docs.columns
    mixed = mix_sources(docs, **options).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mix_sources(sized(docs), size_col="size").select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS sub
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM w),
l AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, rk) - cap))
            / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS found FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(found * weight, cap)) AS target FROM f),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.sub, d.doc_id NULLS LAST) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor(u + i * rate) - floor(u + (i - 1) * rate), ceil(rate))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM c
"""
