"""Near-duplicates with links checked on shingles: SimHash links (operator 3), and the pairs that fingerprints miss (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize
from docquarry.llm.minhash import FULL, similar_roots, sketched
from docquarry.llm.shingles import maybe_among
from docquarry.llm.simhash import fingerprint_links


def simhash_pairs(sets: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v) of sets by operator 3: of one fingerprint (each with one of its class), or linked at ``most`` bits."""
    narrow = sets.select("_fp", "_set").distinct()
    classes = materialize(narrow.groupBy(F.col("_fp").alias("fp")).agg(F.min("_set").alias("rep")), "similar-classes")
    equal = narrow.join(classes, narrow["_fp"] == classes["fp"]).select(F.col("_set").alias("u"), F.col("rep").alias("v"))
    links = fingerprint_links(classes.select("fp"), most)
    left, right = classes.toDF("u", "ru"), classes.toDF("v", "rv")
    return equal.union(links.join(left, "u").join(right, "v").select("ru", "rv"))


def keep_first(docs: DataFrame, found: DataFrame, row_key: Column) -> DataFrame:
    """One row of ``docs`` of each ``_group`` of ``found`` (_id, _row, _group), ``_row`` being the row's hash ``row_key``.

    The smallest id stays, null ids last, of rows with that id one. Rows that are alone in their group are
    not shuffled; the others meet what is to be kept by their hash. A row travels as one struct, so its
    columns may have any names.
    """
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = materialize(found.groupBy("_group").agg(first.alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_group", "k.row"), "groups")
    touched = found.join(groups, "_group").select("_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_key.alias("_row"))
    marked = maybe_among(packed, "_row", touched)
    keyed = touched.distinct().join(groups.select(F.col("row").alias("_row"), F.lit(True).alias("_first")).distinct(), "_row", "left")
    met = marked.where("_maybe").join(keyed.withColumn("_known", F.lit(True)), "_row", "left")
    # A row that the filter let through without being one of them stays, as often as it stands there.
    strays = met.where("_known is null").select("_doc")
    kept = met.where("_first").dropDuplicates(["_row"]).select("_doc")
    return marked.where("not _maybe").select("_doc").union(strays).union(kept).select("_doc.*")


def keep_one_of_each(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 5, most: int = 4, full: int = FULL) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates: the smallest id stays (null ids last), of rows with that id one.

    Near-duplicates have 4/5 or more of their shingles of ``width`` words in common (Jaccard, repeats
    counted once; a shorter text is one shingle); groups are the connected components. Links come from
    operator 3 (fingerprints at ``most`` bits), each checked on its shingles. Fingerprints miss most pairs
    with a Jaccard near the bound, so what they leave is completed by operator 13's bands and sketches,
    which miss one of exactly 0.8 once in some 2e7 times.

    Null and empty texts have the empty set and are one group. Repeated rows are one group. Very long texts
    count whole. No rows: no rows. Columns of any names come back as they are.
    """
    row_key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key.alias("_row"))
    sets = materialize(sketched(narrow, width, ("_id", "_row"), fingerprint=True), "shingle-sets")
    roots = similar_roots(sets, narrow.select("_row", "_text"), width, simhash_pairs(sets, most), full=full)
    found = sets.select("_id", "_row", "_set").join(roots, sets["_set"] == roots["node"], "left").select("_id", "_row", F.coalesce("root", "_set").alias("_group"))
    return keep_first(docs, found, row_key)
