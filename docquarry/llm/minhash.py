"""Near-duplicates by banded MinHash and odd sketches (operator 13), each link checked on whole sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import bounded_batches, discard, materialize, split_words, spread, with_columns_free
from docquarry.llm.components import components
from docquarry.llm.shingles import LEAST, maybe_among, set_key, texts_of, verified
from docquarry.llm.simhash import majority, shingles_hashes

ADDED = ("n_shingles", "component_id", "kept")
#: A pair of Jaccard 0.8 shares none of 32 bands of 4 samples once in 2e7 times.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, as so many longs, and how often a pair of the bound may be thought too far apart.
WORDS, MISS = 8, 1e-9
#: Sets in a slot from which on they are dealt out again by their other bands.
FULL = 4096
_SKETCH = [f"s{i}" for i in range(WORDS)]
_DRAWN = np.random.default_rng(13).integers(0, 1 << 63, (3, SAMPLES), np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Multiply and shift, twice: all bits of the result depend on all bits of ``x``."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def samples(members: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes: for each of SAMPLES functions the least value."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    hashes = members.view(np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * _DRAWN[0]).min(axis=0), out=least)
    return least


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """Keys [sets, BANDS] of samples [sets, SAMPLES]."""
    parts = drawn.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for row in range(ROWS):
        key = _mixed(key ^ parts[:, :, row])
    return key.view(np.int64)


def odd_sketches(drawn: np.ndarray) -> np.ndarray:
    """Parity bitmaps [sets, WORDS] of samples [sets, SAMPLES]: each sample flips the bit that it hashes to.

    Samples that two sets share flip the same bits of both, so the XOR of their sketches is the sketch of
    those in which they differ.
    """
    n_bits = 64 * WORDS
    place = (_mixed(drawn ^ _DRAWN[2]) % np.uint64(n_bits)).astype(np.int64)
    odd = np.zeros((len(drawn), n_bits), bool)
    rows = np.arange(len(drawn))
    for i in range(SAMPLES):
        odd[rows, place[:, i]] ^= True
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def most_apart(miss: float = MISS) -> int:
    """Bits in which the sketches of two sets of Jaccard 4/5 differ at most, but for a share of ``miss`` of such pairs.

    The samples that differ are binomial; two elements for each of them go to random bits, and the number
    of odd bits after so many throws is a chain of its own.
    """
    n_bits = 64 * WORDS
    z = np.zeros(n_bits + 1)
    z[0] = 1.0
    of_samples = np.ones(1)
    for _ in range(SAMPLES):
        of_samples = np.convolve(of_samples, (LEAST[0] / LEAST[1], 1 - LEAST[0] / LEAST[1]))
    share = np.arange(n_bits + 1) / n_bits
    total = np.zeros(n_bits + 1)
    for p in of_samples:
        total += p * z
        for _ in range(2):
            z = np.concatenate(([0.0], (z * (1 - share))[:-1])) + np.concatenate(((z * share)[1:], [0.0]))
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > miss)[-1])


def estimated(apart: int) -> float:
    """The Jaccard that sketches ``apart`` bits from each other stand for."""
    n_bits = 64 * WORDS
    return 1 + n_bits / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * apart / n_bits)))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The set of each text's shingles as sorted hashes: each different word of the batch is hashed once, neighbours are combined as arrays."""
    words, ends = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[np.asarray(coded.indices)]
    factors = _DRAWN[1][:width]
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * factors[k]
    total = _mixed(total).view(np.int64)
    out = []
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - begin >= width:
            out.append(np.unique(total[begin : end - width + 1]))
        else:  # the whole sequence, and its length
            n = end - begin
            out.append(_mixed((hashes[begin:end] * factors[:n]).sum(keepdims=True) + np.uint64(n)).view(np.int64) if n else np.empty(0, np.int64))
    return out


def sketched(rows: DataFrame, width: int, passed: Sequence[str], *, fingerprint: bool = False) -> DataFrame:
    """``passed`` columns of ``rows`` (with ``_text``), the hash of the set of shingles, its size, bands and odd sketch.

    An empty set has no bands. ``fingerprint`` adds operator 3's ``_fp``.
    """
    schema = rows.select(*passed).schema.add("_set", "long").add("_n", "long")
    schema = schema.add("_fp", "long") if fingerprint else schema
    schema = schema.add("bands", T.ArrayType(T.LongType()))
    schema = reduce(lambda found, name: found.add(name, "long"), _SKETCH, schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            keys, sizes, prints, drawn = [], [], [], np.empty((batch.num_rows, SAMPLES), np.uint64)
            texts = batch.column(len(passed))
            if fingerprint:
                hashes = [shingles_hashes(t, width) for t in texts.to_pylist()]
                prints = [majority(h) for h in hashes]
                sets = [np.sort(np.unique(h).view(np.int64)) for h in hashes]
            else:
                sets = shingle_sets(texts, width)
            for i, members in enumerate(sets):
                keys.append(set_key(members))
                sizes.append(len(members))
                drawn[i] = samples(members)
            some = np.array(sizes) > 0
            ends = np.concatenate(([0], np.cumsum(some))).astype(np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(drawn)[some].ravel()), mask=pa.array(~some))
            made = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            made += [pa.array(np.array(prints, np.uint64).view(np.int64))] if fingerprint else []
            made += [bands, *map(pa.array, np.ascontiguousarray(odd_sketches(drawn).T))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *made], names=schema.names)

    return rows.select(*passed, "_text").mapInArrow(make, schema)


def _close(left: str, right: str, most: int) -> Column:
    """Sets whose sizes allow the bound and whose odd sketches are not too far apart for it."""
    sizes = LEAST[1] * F.least(F.col(f"{left}._n"), F.col(f"{right}._n")) >= LEAST[0] * F.greatest(F.col(f"{left}._n"), F.col(f"{right}._n"))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in _SKETCH])
    return sizes & (apart <= most)


def shared_slots(classes: DataFrame) -> DataFrame:
    """(key, _set, _n, sketch) of ``classes`` in each slot of a band that holds more than one set; the others leave by a filter, unshuffled."""
    visits = classes.where("bands is not null").select("_set", "_n", *_SKETCH, F.explode("bands").alias("key"))
    shared = materialize(visits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "minhash-shared")
    found = maybe_among(visits, "key", shared).where("_maybe").drop("_maybe").join(shared, "key", "left_semi")
    found = materialize(found, "minhash-slots")
    discard(shared)
    return found


def star_pairs(slots: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v) of each set in a slot with one of the slot's sets, if their sketches are close: as many as there are rows."""
    first = F.min(F.struct(F.xxhash64("_set").alias("o"), "_set", "_n", *_SKETCH)).alias("f")
    stars = materialize(slots.groupBy("key").agg(first).select("key", "f.*").drop("o"), "minhash-stars")
    met = slots.alias("a").join(stars.alias("b"), "key").where((F.col("a._set") != F.col("b._set")) & _close("a", "b", most))
    return met.select(F.col("a._set").alias("u"), F.col("b._set").alias("v"))


def open_slots(slots: DataFrame, roots: DataFrame, classes: DataFrame, full: int) -> DataFrame:
    """Rows (key, _set, _n, root, sketch) of the slots that hold sets of different components.

    A slot of more than ``full`` sets is dealt out again by all other bands of its sets: two of the bound that
    share it share another band too, but for once in 1e7 times.
    """
    labelled = slots.join(roots.toDF("_set", "found"), "_set", "left").withColumn("root", F.coalesce("found", "_set")).drop("found")
    counted = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("tenants")).where("lo <> hi")
    counted = materialize(counted.select("key", (F.col("tenants") > full).alias("full")), "minhash-open")
    left = materialize(labelled.join(counted, "key"), "minhash-left")
    again = left.where("full").join(classes.select("_set", "bands"), "_set").withColumn("other", F.explode("bands")).where("other <> key")
    again = again.withColumn("key", F.xxhash64("key", "other")).select("key", "_set", "_n", "root", *_SKETCH)
    return left.where("not full").select("key", "_set", "_n", "root", *_SKETCH).union(again)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by its first column, cut so that equal keys stand in one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        if key[0] == key[-1]:
            if held and held[-1].column(0)[0].as_py() != key[0]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch)
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield pa.concat_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _slots_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Begin and end of each key with two rows or more."""
    key = np.asarray(batch.column(0))
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    yield from ((b, e) for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if e - b > 1)


class _Slot:
    """The sets of one slot: which can be links by their sizes and sketches, and are not connected yet."""

    def __init__(self, columns: list[np.ndarray], most: int):
        self.sets, self.sizes, self.roots = columns[:3]
        self.sketch = np.stack(columns[3:], axis=1).view(np.uint64)
        self.most = most

    def apart(self, i: int, rows: slice | np.ndarray) -> np.ndarray:
        """Bits between sketch i and those of ``rows``; more than can be where the pair is none to look at."""
        z = np.bitwise_count(self.sketch[rows] ^ self.sketch[i]).sum(axis=1, dtype=np.int64)
        n, m = self.sizes[rows], self.sizes[i]
        fits = (self.roots[rows] != self.roots[i]) & (LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m)) & (z <= self.most)
        return np.where(fits, z, 64 * WORDS + 1)


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names]


def undecided(rows: DataFrame, most: int) -> DataFrame:
    """The rows of sets that have one in their slot, not connected to them, to which the sketches allow a link."""
    names = ["key", "_set", "_n", "root", *_SKETCH]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            columns = _arrays(batch, names[1:])
            hold = np.zeros(batch.num_rows, bool)
            for begin, end in _slots_of(batch):
                slot = _Slot([c[begin:end] for c in columns], most)
                for i in range(end - begin):
                    if not hold[begin + i]:
                        near = slot.apart(i, slice(None)) <= most
                        hold[begin:end] |= near
                        hold[begin + i] = near.any()
            yield batch.filter(pa.array(hold))

    ordered = rows.select(*names).repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(find, ordered.schema)


def links_in_slots(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Links (u, v) that connect what is linked in each slot, by whole sets: ``rows`` has the bands and texts (_text) too.

    Sets of a slot that the sketches allow to link are compared by all their shingles, unless they are connected
    already, in the first slot that they share; so out comes a forest, shorter than the slot. A set of the
    slot's largest component is compared with those of others only.
    """

    def link(slot: _Slot, bands: np.ndarray, key: int, texts: pa.Array) -> Iterator[tuple[int, int]]:
        names, n = np.unique(slot.roots, return_counts=True)
        dealt_again = not (bands[0] == key).any()
        meet = []
        for i in np.flatnonzero(slot.roots != names[n.argmax()]).tolist():
            near = np.flatnonzero(slot.apart(i, slice(None)) <= most)
            if len(near) and not dealt_again:
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == key]
            if len(near):
                meet.append((i, near))
        if not meet:
            return
        needed = np.unique(np.concatenate([np.array([i for i, _ in meet]), *(near for _, near in meet)])).tolist()
        sets = shingle_sets(texts.take(pa.array(needed)), width)
        size = np.array([len(x) for x in sets])
        _, members = np.unique(np.concatenate(sets), return_inverse=True)
        parts = dict(zip(needed, np.split(members, np.cumsum(size)[:-1]), strict=True))
        there = np.zeros(int(members.max()) + 1, bool)
        for i, near in meet:
            there[parts[i]] = True
            for j in near.tolist():
                if slot.roots[i] != slot.roots[j]:
                    common = int(np.count_nonzero(there[parts[j]]))
                    if LEAST[1] * common >= LEAST[0] * (len(parts[i]) + len(parts[j]) - common):
                        yield int(slot.sets[i]), int(slot.sets[j])
                        slot.roots[slot.roots == slot.roots[j]] = slot.roots[i]
            there[parts[i]] = False

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            keys, *columns = _arrays(batch, ["key", "_set", "_n", "root", *_SKETCH])
            bands = np.asarray(batch.column(batch.schema.get_field_index("bands")).flatten()).reshape(-1, BANDS)
            texts = batch.column(batch.schema.get_field_index("_text"))
            found = []
            for begin, end in _slots_of(batch):
                slot = _Slot([c[begin:end].copy() for c in columns], most)
                found += link(slot, bands[begin:end], int(keys[begin]), texts.slice(begin, end - begin))
            table = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["u", "v"])

    ordered = rows.select("key", "_set", "_n", "root", *_SKETCH, "bands", "_text").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(find, "u long, v long")


def similar_roots(sets: DataFrame, narrow: DataFrame, width: int, more: DataFrame | None = None, *, full: int = FULL) -> DataFrame:
    """(node, root): the connected components of all pairs of different ``sets`` (of ``narrow``) with Jaccard 4/5 or more.

    Sets meet in the slots of their bands. First each is compared with one set of each of its slots (and by
    the pairs ``more``), so most of a large group of near copies becomes one component in as many comparisons as
    it has rows in slots. Where a slot still holds sets of different components that the sketches allow to link,
    they are compared there, with whole sets at hand: no list of pairs is made that grows with the square of a
    group. Only links that hold on the whole sets count.
    """
    most = most_apart()
    columns = [F.first(c).alias(c) for c in ("_n", "bands", *_SKETCH)]
    classes = materialize(sets.where("_n > 0").groupBy("_set").agg(*columns), "minhash-classes")
    slots = shared_slots(classes)
    pairs = star_pairs(slots, most)
    links = verified(pairs.union(more) if more is not None else pairs, sets, narrow, width)
    roots = materialize(components(links), "minhash-roots")
    left = materialize(undecided(open_slots(slots, roots, classes, full), most), "minhash-undecided")
    texts = texts_of(left.select("_set").distinct(), sets, narrow).join(classes.select("_set", "bands"), "_set")
    links = links.union(materialize(links_in_slots(left.join(texts, "_set"), width, most), "minhash-links"))
    found = components(links)
    discard(slots, classes, left)
    return found


def minhash_near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """``docs`` without the text, with n_shingles, component_id and kept.

    Documents link whose sets of ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle)
    have 4/5 or more in common. component_id is the smallest id of the group, kept says that it is the
    row's own. Copies meet as one set before anything is compared. A pair of exactly 0.8 goes unseen with a
    chance of some 5e-8 (bands) and 1e-9 (sketches), closer ones still less; no pair below the bound links.

    Null and empty texts have the empty set, link with nothing and are kept. Repeated rows share a group, and
    all that carry its smallest id are kept. A null id is no candidate (null component, kept false, only if a
    group has no id). Texts of any length count whole. Clashing columns are replaced. No rows: no rows.
    """
    rows = with_columns_free(docs, *[c for c in ADDED if c not in (text_col, id_col)])
    carried = [c for c in rows.columns if c != text_col]
    packed = rows.select(F.struct(*carried).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_row"))
    sets = materialize(sketched(packed, width, ("_doc", "_id", "_row")), "minhash-sets")
    roots = similar_roots(sets, packed.select("_row", "_text"), width)
    # What the joins look up is written first: they then stand on plain exchanges, and a hot key is split.
    ids = sets.where("_n > 0").groupBy("_set").agg(F.min("_id").alias("first_id"))
    linked = materialize(ids.join(roots, ids["_set"] == roots["node"], "left").select("_set", "first_id", F.coalesce("root", "_set").alias("root")), "minhash-linked")
    smallest = materialize(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "minhash-smallest")
    groups = materialize(linked.join(smallest, "root").select(F.col("_set").alias("of"), "component_id"), "minhash-groups")
    discard(linked, smallest)
    found = sets.select("_doc", "_id", "_n", "_set").join(groups, (F.col("_set") == F.col("of")) & (F.col("_n") > 0), "left")
    component = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    kept = F.when(F.col("_n") > 0, F.coalesce(component == F.col("_id"), F.lit(False))).otherwise(True)
    return found.select("_doc.*", F.col("_n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return minhash_near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(texts: Sequence[tuple[int | None, str | None]], width: int = 4) -> list[tuple]:
    """All pairs, for small fixtures: id, size of the set, component, kept."""
    sets = [set(shingles_hashes(t, width).tolist()) for _, t in texts]
    label = list(range(len(texts)))

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and LEAST[1] * len(a & b) >= LEAST[0] * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    out = []
    for i, (key, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
        least = min(ids, default=None)
        out.append((key, len(sets[i]), least, not sets[i] or (key is not None and key == least)))
    return out
