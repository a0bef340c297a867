"""SimHash near-duplicates (operator 3) by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import LOWER_ASCII, bounded_batches, discard, materialize, spread, with_columns_free
from docquarry.llm.components import components

ADDED = ("fingerprint", "component_id")
#: Fingerprints of one table slot that are compared in one task; fuller slots are cut into tiles of this size.
TILE = 4096
#: Look-ups of a fingerprint at most, and the cost of one as a number of comparisons.
_MOST_LOOKUPS, _ROW_COST = 1200, 20


def shingles_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included; the whole sequence if shorter."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], 42) for b, e in zip(begins[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes: a bit is 1 if set in over half of them; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)))


def simhash(text: str | None, width: int = 4) -> int:
    return majority(shingles_hashes(text, width))


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """``docs`` without the text, with the fingerprint as a signed long ``_fp``."""
    columns = [c for c in docs.columns if c != text_col]
    schema = docs.select(*columns).schema.add("_fp", "long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found)], names=[*columns, "_fp"])

    return docs.mapInArrow(make, schema)


def segment_plan(most: int, n: int = 0) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Bits of the segments, and the radius looked at in each, for links at ``most`` differing bits among n fingerprints.

    If every segment differed in more than its radius, the whole would differ in at least the sum of
    (radius + 1), which is more than ``most``; so some segment lies within its radius. Few wide segments
    keep slots thin and need many look-ups, many narrow ones the other way round: of 2 or 3 segments (4 from
    5 bits on) those are taken that cost least by the look-ups and the meetings to be expected in slots.
    """
    if not 0 <= most <= 11:
        raise ValueError("links are found at 0 to 11 differing bits")
    plans = []
    for k in (2, 3) if most <= 4 else (2, 3, 4):
        bits, radii = _segments(64, k, most)
        balls = [sum(comb(b, d) for d in range(r + 1)) for b, r in zip(bits, radii, strict=True)]
        if sum(balls) <= _MOST_LOOKUPS:
            plans.append((_ROW_COST * sum(balls) + sum(x * n / 2**b for x, b in zip(balls, bits, strict=True)), bits, radii))
    return min(plans)[1:]


def _segments(width: int, k: int, most: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Bits and radii of k segments of ``width`` bits."""
    bits = tuple(width // k + (s >= k - width % k) for s in range(k))
    return bits, tuple((most + 1) // k + (s < (most + 1) % k) - 1 for s in range(k))


def _slots(fp: Column, plan: tuple[tuple[int, ...], tuple[int, ...]]) -> tuple[Column, Column]:
    """Keys of the table slots that hold a fingerprint, and of the slots it looks into besides.

    A slot is (segment, value) in one long. Of two that differ the one of smaller value looks at the
    larger, so each meeting takes place once. A segment of radius -1 takes no part.
    """
    homes, probes, shift = [], [], 0
    for s, (bits, radius) in enumerate(zip(*plan, strict=True)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))
        tag = s << 40
        if radius >= 0:
            homes.append(value + F.lit(tag))
        masks = [sum(1 << b for b in flips) for n in range(1, radius + 1) for flips in combinations(range(bits), n)]
        if masks:
            probes.append(_larger_in_ball(value, masks, tag))
        shift += bits
    return F.array(*homes), F.concat(*probes) if probes else F.array().cast("array<bigint>")


def _slots_within(fp: Column, slot: Column, plan: tuple[tuple[int, ...], tuple[int, ...]], most: int) -> tuple[Column, Column]:
    """The same within a full slot, for the bits beside the segment that all its tenants have in common."""
    homes = probes = F.array().cast("array<bigint>")
    shift = 0
    for s, bits in enumerate(plan[0]):
        below = fp.bitwiseAND(F.lit((1 << shift) - 1))
        above = F.shiftleft(F.shiftrightunsigned(fp, shift + bits), shift) if shift + bits < 64 else F.lit(0)
        rest = below.bitwiseOR(above.cast("long"))
        inner_homes, inner_probes = _slots(rest, _segments(64 - bits, 3, most))
        here = F.shiftrightunsigned(slot, 40) == s
        homes, probes = F.when(here, inner_homes).otherwise(homes), F.when(here, inner_probes).otherwise(probes)
        shift += bits
    return homes, probes


def _larger_in_ball(value: Column, masks: list[int], tag: int) -> Column:
    ball = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))
    return F.transform(F.filter(ball, lambda x: x > value), lambda x: x + F.lit(tag))


def _forest(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (pairs within ``most`` bits) of left x right, as a spanning forest: fewer than their number together."""
    nodes, inverse = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    ur = right.view(np.uint64)
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(ur ^ left[i].view(np.uint64)) <= most)
        for j in dict.fromkeys(b[near].tolist()) if len(near) else ():
            x, y = find(int(a[i])), find(j)
            if x != y:
                root[y] = x
                out.append((int(nodes[a[i]]), int(nodes[j])))
    return out


def _link_slots(most: int):
    """Within partitions sorted by slot: links between what lives in a slot and what lives there or looks in."""

    def pairs(homes: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
        if len(homes) == 1:  # nearly all slots
            near = np.bitwise_count(others.view(np.uint64) ^ homes.view(np.uint64)[0]) <= most
            return [(int(homes[0]), int(x)) for x in others[near] if x != homes[0]]
        return _forest(homes, np.concatenate((homes, others)), most)

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat((rest, frame), ignore_index=True)
            cell = frame["cell"].to_numpy()
            cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            begin = int(cut[-1]) if len(cut) else 0
            yield _linked(frame.iloc[:begin], pairs)
            rest = frame.iloc[begin:]
        if rest is not None:
            yield _linked(rest, pairs)

    return link


def _linked(frame: pd.DataFrame, pairs) -> pd.DataFrame:
    fp, home, cell = frame["fp"].to_numpy(), frame["home"].to_numpy(), frame["cell"].to_numpy()
    cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
    n_home = np.add.reduceat(home.astype(np.int64), begin) if len(fp) else np.empty(0, np.int64)
    out: list[tuple[int, int]] = []
    for b, e in zip(begin[(n_home > 0) & (end - begin > 1)], end[(n_home > 0) & (end - begin > 1)], strict=True) if len(fp) else ():
        here = home[b:e]
        out += pairs(fp[b:e][here], fp[b:e][~here])
    return pd.DataFrame({"u": np.array([x for x, _ in out], np.int64), "v": np.array([y for _, y in out], np.int64)})


def _visits(rows: DataFrame, homes: Column, probes: Column, name: str) -> DataFrame:
    """``rows`` by the slots they stand in (home) and those they look into."""
    standing = rows.withColumn(name, F.explode(homes)).withColumn("home", F.lit(True))
    return standing.union(rows.withColumn(name, F.explode(probes)).withColumn("home", F.lit(False)))


def _full(visits: DataFrame, *keys: str) -> DataFrame:
    """Slots with more than TILE tenants, and how many tiles that makes."""
    counted = visits.where("home").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    return counted.select(*keys, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))


def fingerprint_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (u, v) that connect all of ``distinct`` (fp: long, no repeats) at ``most`` or fewer differing bits.

    Every fingerprint stands in the slot of each of its segments and looks into the slots within the
    segment's radius (``segment_plan``); each slot's meetings are checked on all 64 bits. What comes out of
    a slot is a spanning forest of its links, so its length is that of the slot and not its square, and no
    connection is lost.

    All who visit a slot with more than TILE tenants are dealt out once more, by segments of the bits that
    they do not have in common. Should such an inner slot be full again, it is cut into tiles by a hash of
    the fingerprint, and all its visitors come to each tile: no task holds more than a tile of tenants.
    """
    plan = segment_plan(most, distinct.count())
    visits = _visits(distinct.select("fp"), *_slots(F.col("fp"), plan), "slot")
    # Full slots are written before visits meet them: mostly there are none, else the joins stand on plain exchanges.
    full = materialize(_full(visits, "slot"), "simhash-full")
    if full.isEmpty():
        return _linked_cells(visits.select("fp", "home", F.xxhash64("slot").alias("cell")), most)
    marked = visits.join(full, "slot", "left")
    plain = marked.where("tiles is null").select("fp", "home", F.xxhash64("slot").alias("cell"))
    inner = _visits(marked.where("tiles is not null").select("fp", "slot"), *_slots_within(F.col("fp"), F.col("slot"), plan, most), "sub")
    tiled = inner.join(materialize(_full(inner, "slot", "sub"), "simhash-full"), ["slot", "sub"], "left")
    tiled = tiled.withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    own = F.col("tile") == F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1)))
    deep = tiled.select("fp", (F.col("home") & own).alias("home"), F.xxhash64("slot", "sub", "tile").alias("cell"))
    return _linked_cells(plain.union(deep), most)


def _linked_cells(rows: DataFrame, most: int) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_link_slots(most), "u long, v long")


def simhash_near_duplicates(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 4, most: int = 4, group_col: str | None = None
) -> DataFrame:
    """``docs`` without the text, with fingerprint (16 hex digits) and component_id.

    Copies meet as one fingerprint, by an aggregation with map-side combine, before anything is paired;
    fingerprints link by multi-index hashing (``fingerprint_links``), and groups are the connected
    components of links. component_id is the smallest id in the group; ``group_col`` names a column
    for the group's own key, which exists for groups without ids too.

    Null or empty text, or only separators: fingerprint zero, linked like any other. Null ids are no
    candidates for component_id (null only if a group has no id). Repeated rows share a fingerprint. No
    rows: no rows. Texts of any length are hashed whole. Clashing columns are replaced.
    """
    marked = materialize(fingerprints(with_columns_free(docs, *ADDED, "_fp"), text_col, width), "fingerprints")
    classes = materialize(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("first_id")), "simhash-classes")
    roots = components(fingerprint_links(classes.select("fp"), most))
    # What the joins below look up is written first: they then stand on plain exchanges, and a hot key is split.
    linked = materialize(classes.join(roots, classes["fp"] == roots["node"]).select("fp", "first_id", "root"), "simhash-linked")
    smallest = materialize(linked.groupBy("root").agg(F.min("first_id").alias("least")), "simhash-smallest")
    grouped = linked.join(smallest, "root").select(F.col("fp").alias("_of"), "least", "root")
    group = [F.coalesce("root", "fp").alias(group_col)] if group_col else []
    of_class = classes.join(grouped, F.col("fp") == F.col("_of"), "left").select("fp", F.coalesce("least", "first_id").alias("component_id"), *group)
    of_class = materialize(of_class, "simhash-groups")
    discard(classes, linked, smallest)
    return (
        marked.join(of_class, marked["_fp"] == of_class["fp"])
        .withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0")))
        .drop("_fp", "fp")
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return simhash_near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def brute_force(texts: Sequence[tuple[int | None, str | None]], width: int = 4, most: int = 4) -> list[tuple]:
    """All pairs, for small fixtures."""
    prints = [simhash(t, width) for _, t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(prints[i] ^ prints[j]).count("1") <= most:
                    label[j] = label[i] = min(label[i], label[j])
    out = []
    for i, (key, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if label[j] == label[i] and texts[j][0] is not None]
        out.append((key, f"{prints[i]:016x}", min(ids, default=None)))
    return out
