"""LM scoring (operator 7): smoothed bigram probabilities from a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import LOWER_ASCII, bounded_batches, discard, materialize, spread, tidy, with_columns_free

ADDED = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Keys of the end of a text and of the context before its first word: no word hashes to an even number.
END, BEGIN = 2, 4
_CACHED_WORDS = 300_000
_GATHER = 4_000_000
_U = np.uint64


class WordKeys(dict):
    """Word to its 64-bit key (odd); filled as words come, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7) | 1
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (public-domain splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unigram_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words) | _U(1)


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) + words * _U(3)) & ~_U(1)


def token_keys(texts: list[str | None], keys: WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens (each text's words, then one end), and the number of tokens of each text."""
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    get = keys.__getitem__
    for i, text in enumerate(texts):
        words = (text or "").encode().translate(LOWER_ASCII).split()
        flat.extend(map(get, words))
        flat.append(END)
        sizes[i] = len(words) + 1
    return np.array(flat, np.uint64), sizes


def contexts(tokens: np.ndarray) -> np.ndarray:
    """The token before each; BEGIN at the start of a text."""
    before = np.empty_like(tokens)
    before[:1] = BEGIN
    before[1:] = np.where(tokens[:-1] == END, _U(BEGIN), tokens[:-1])
    return before


#: Probes of an entry at each of its levels. At 10 bits a (entry, level) pair, 1 % of probes of others hit.
PROBES, BITS = 4, 10
#: Text behind one part of the filter; a part is built in one task and has a size of its own.
PART_BYTES = 1 << 20
_LEVELS = 65


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2 n), exact below 2^53; 0 for 0."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def _place(key: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    """Bit of a probe within a part of ``size`` bits."""
    add = (level * 0x9E3779B97F4A7C15 + probe * 0xD1B54A32D192ED03) & ((1 << 64) - 1)
    return mixed(key + _U(add)) % (size if isinstance(size, np.ndarray) else _U(size))


def part_bits(key: np.ndarray, level: np.ndarray, n_bits: int) -> bytes:
    """The part of the filter that holds these n-grams: an entry of level q is a member under 1, 2, ... q."""
    size = max(64, -(-n_bits * int(level.sum()) // 64) * 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = key[level >= q]
        for probe in range(PROBES):
            bits[_place(some, q, probe, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LogBloom:
    """Levels of n-gram keys by repeated membership probes, which stop at the first miss. Parts of no bits hold nothing."""

    def __init__(self, parts: int, found: dict[int, bytes]):
        size = np.full(parts, 8, np.int64)
        for i, raw in found.items():
            size[i] = 8 * len(raw)
        begin = np.cumsum(size) - size
        self.bits = np.zeros(int(size.sum()) // 8, np.uint8)
        for i, raw in found.items():
            self.bits[begin[i] // 8 : begin[i] // 8 + len(raw)] = np.frombuffer(raw, np.uint8)
        self.parts, self.size, self.begin = parts, size.astype(np.uint64), begin.astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        part = ((keys >> _U(40)) % _U(self.parts)).astype(np.int64)
        begin, size = self.begin[part], self.size[part]
        level = 1
        while len(live) and level < _LEVELS:
            for probe in range(PROBES):
                at = begin[live] + _place(keys[live], level, probe, size[live])
                live = live[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
            found[live] = level
            level += 1
        return found


_PARTS = "part int, bits binary, words array<bigint>, counts array<bigint>, stats array<bigint>"


def ngram_parts(docs: DataFrame, text_col: str, parts: int, n_bits: int = BITS) -> DataFrame:
    """Exact counts of all tokens (odd keys) and token pairs (even keys) of the texts, one row for each part of the keys.

    A row has the part's filter, its tokens with their counts, and for each level how many tokens and pairs
    it has and what their counts add up to (``stats``: four runs of 65). Tasks sum over some millions of
    tokens before they hand on, so a frequent word costs a row each time and not one an occurrence; counts
    are dealt out once, and pairs leave the task that adds them up only as bits and sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n = WordKeys(), [], 0

        def gathered() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            found = np.concatenate((unigram_keys(tokens), bigram_keys(contexts(tokens), tokens)))
            key, times = np.unique(found, return_counts=True)
            part = ((key >> _U(40)) % _U(parts)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], names=["part", "key", "n"])

        for batch in bounded_batches(batches):
            held.append(token_keys(batch.column(0).to_pylist(), keys)[0])
            n += len(held[-1])
            if n >= _GATHER:
                yield gathered()
                held, n = [], 0
        if n:
            yield gathered()

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        key, place = np.unique(group["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        n = np.bincount(place, group["n"].to_numpy(np.float64)).astype(np.int64)
        level, word = level_of(n), key & _U(1) == 1
        stats = [np.bincount(level[some], weight, _LEVELS) for some in (word, ~word) for weight in (None, n[some])]
        row = {"part": int(group["part"].iloc[0]), "bits": part_bits(key, level, n_bits), "words": key[word].view(np.int64), "counts": n[word]}
        return pd.DataFrame([row | {"stats": np.concatenate(stats).astype(np.int64)}])

    return docs.select(text_col).mapInArrow(count, "part int, key long, n long").groupBy("part").applyInPandas(add_up, _PARTS)


class Counted(NamedTuple):
    """Sums over all n-grams: tokens, different tokens, pair occurrences beyond those seen once, mean count by level."""

    tokens: int
    distinct: int
    seen_again: int
    word_means: np.ndarray
    pair_means: np.ndarray


def counted(parts: DataFrame) -> Counted:
    """At most 260 numbers come to the driver. A level stands for the mean count of its tokens or pairs."""
    stats = np.zeros(4 * _LEVELS)
    for r in parts.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        stats[r["i"]] = r["x"]
    word_n, word_sum, pair_n, pair_sum = stats.reshape(4, _LEVELS)
    guess = np.concatenate(([0.0], 1.5 * np.exp2(np.arange(_LEVELS - 1))))  # for levels that only false positives reach
    means = [np.divide(total, n, out=guess.copy(), where=n > 0) for n, total in ((word_n, word_sum), (pair_n, pair_sum))]
    return Counted(int(word_sum.sum()), int(word_n.sum()), int(pair_sum[2:].sum()), *means)


#: Text of one chunk, whose n-grams are asked for together, and parts of the filter that answer in one task.
CHUNK_BYTES, ANSWERING = 8 << 20, 8


def in_chunks(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with _uid (rising along each partition) and _chunk (the _uid of its first row), written once, so that both stand."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = chunk = (context.partitionId() if context else 0) << 40
        held = 0
        for batch in bounded_batches(batches):
            n, n_bytes = batch.num_rows, batch.column(batch.schema.get_field_index(text_col)).nbytes
            if held and held + n_bytes > chunk_bytes:
                chunk, held = uid, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uid + np.arange(n)), pa.array(np.full(n, chunk))], names=[*batch.schema.names, "_uid", "_chunk"])
            uid, held = uid + n, held + n_bytes

    schema = T.StructType([*docs.schema.fields]).add("_uid", T.LongType()).add("_chunk", T.LongType())
    return materialize(docs.mapInArrow(number, schema), "lm-chunks")


def _dealt(word_keys: np.ndarray, pair_keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words and pairs of some text in the order of the parts that answer: keys, their places before, and who answers."""
    keys = np.concatenate((word_keys, pair_keys))
    by = ((keys >> _U(40)) % _U(parts)).astype(np.int32) // ANSWERING
    order = np.argsort(by.astype(np.uint16) if parts <= ANSWERING << 16 else by, kind="stable")  # short numbers sort by digits
    return keys[order], order, by[order]


def _different(keys: np.ndarray) -> np.ndarray:
    """The different keys in rising order: np.unique hashes, which takes longer than sorting here."""
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]


def levels_asked(chunked: DataFrame, text_col: str, parts: DataFrame, n: int) -> DataFrame:
    """(chunk, first, by, levels) for tables of ``in_chunks``, whose filter of ``n`` parts is in no one place.

    The different words and pairs of a chunk go once to the tasks that hold their parts, 8 bytes each in one row for each
    such task, and a byte for each comes back. Where a chunk is read by two tasks each asks for its rows (``first``: the
    least _uid of them).
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, chunk, first = WordKeys(), [], None, 0

        def gathered() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            found, _, by = _dealt(unigram_keys(_different(tokens)), _different(bigram_keys(contexts(tokens), tokens)), n)
            begin = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
            ends = np.append(begin, len(by)).astype(np.int32) * np.int32(8)
            packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(found)])
            return pa.RecordBatch.from_arrays([pa.array(by[begin]), pa.array(np.full(len(begin), chunk)), pa.array(np.full(len(begin), first)), packed], names=["by", "chunk", "first", "keys"])

        for batch in bounded_batches(batches):
            uids, chunks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and chunks[begin] != chunk:
                    yield gathered()
                    held = []
                if not held:
                    chunk, first = chunks[begin], uids[begin]
                held.append(token_keys(batch.column(0).slice(begin, end - begin).to_pylist(), keys)[0])
        if held:
            yield gathered()

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        model = LogBloom(n, dict(zip(held["part"].to_pylist(), held["bits"].to_pylist(), strict=True)))
        packed = asked["keys"].to_pylist()
        levels = model.levels(np.frombuffer(b"".join(packed), np.uint64)).astype(np.int8).tobytes()
        ends = np.cumsum([0, *(len(x) // 8 for x in packed)]).tolist()
        said = pa.array([levels[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table({"chunk": asked["chunk"], "first": asked["first"], "by": asked["by"], "levels": said})

    asked = chunked.select(text_col, "_uid", "_chunk").mapInArrow(ask, "by int, chunk long, first long, keys binary")
    held = parts.select("part", "bits", F.floor(F.col("part") / ANSWERING).cast("int").alias("by"))
    return asked.groupBy("by").cogroup(held.groupBy("by")).applyInArrow(answer, "chunk long, first long, by int, levels binary")


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each different key of each row (rows rising), how often it stands there, and where the rows' lists begin."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
    times = np.diff(first, append=len(r)).astype(np.int32)
    return order[first], times, np.searchsorted(r[first], np.arange(rows + 1)).astype(np.int32)


def _rarity(groups: list[tuple[float, int]], seen_again: int) -> float:
    """k for which the sum of n * c / (c + k) over groups (mean count c, tokens n) is ``seen_again``."""
    low, high = 1e-6, 1e12
    for _ in range(200):
        k = math.sqrt(low * high)
        if sum(n * c / (c + k) for c, n in groups) > seen_again:
            low = k
        else:
            high = k
    return math.sqrt(low * high)


def is_held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    """Rows that are not learnt from: crc32 of the id as text, modulo; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(True))


def score_texts(
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    part_bytes: int = PART_BYTES,
    n_bits: int = BITS,
    frequent: int = 1 << 17,
    most_bytes: int = 1 << 27,
) -> DataFrame:
    """``docs`` without the text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from all texts that are not held out. score is the log10 probability of the text under
    p(w | v) = a * c(v w) / c(v) + (1 - a) * (c(w) + 1) / (N + V + 1) with a = c(v) / (c(v) + k), where all
    counts c come from the log-frequency Bloom filter by repeated membership probes. Every token and pair
    is put in, those seen once too. The filter has a part for each ``part_bytes`` of text, each as wide as
    its entries need (``n_bits`` each). Up to ``most_bytes`` it is broadcast; the parts of a larger one stay apart, the
    different n-grams of each chunk of text ask them (``levels_asked``), and chunks meet their answers, with the same scores. The share
    of pairs seen once is the (Good-Turing) chance of an unseen pair, and k is such that a is one minus
    that share on average.

    base_score and n_known need exact counts: the most frequent tokens, at most ``frequent`` of them, go
    along with the task; all other occurrences are joined to the whole table of counts and summed. No
    token of the join is frequent, so it has no hot key. Texts are tokenised twice and never shuffled; with the parts
    apart three times, and once dealt out by chunks.

    Null and empty texts consist of the end alone. Null ids are held out. Repeated rows are learnt from
    and scored one by one. Very long texts are scored whole, in one task. Without training text N and V are 0 and each token has probability 1 (base).
    No rows: no rows. Clashing columns are replaced. Words meet by 64-bit hash.
    """
    spark = docs.sparkSession
    base = with_columns_free(docs, *ADDED, "_uid", "_base", "_known", "_rare", "_chunk").withColumn("held_out", is_held_out(F.col(id_col)))
    n_bytes = base.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n_parts = max(1, -(-n_bytes // part_bytes))
    parts = materialize(ngram_parts(base.where(~F.col("held_out")), text_col, n_parts, n_bits), "lm-parts")
    sums = counted(parts)
    unigrams = parts.select(F.inline(F.arrays_zip(F.col("words").alias("key"), F.col("counts").alias("n"))))
    unigrams = unigrams.toDF("key", "n")
    n_train = sums.tokens
    denominator = float(n_train + sums.distinct + 1)

    sizes = unigrams.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.sum("n").alias("n"))
    sizes = sizes.collect()
    least, left = n_train + 1, frequent
    for r in sorted(sizes, key=lambda r: -r["bin"]):
        if r["m"] > left:
            break
        least, left = r["least"], left - r["m"]
    rarity = _rarity([(r["n"] / r["m"], r["n"]) for r in sizes], sums.seen_again)
    known = unigrams.where(F.col("n") >= least).toPandas().sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
    top_keys, top_counts = known["key"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64)

    apart = (parts.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > most_bytes
    shared = None if apart else spark.sparkContext.broadcast(LogBloom(n_parts, {r["part"]: bytes(r["bits"]) for r in parts.select("part", "bits").collect()}))
    columns = [c for c in base.columns if c != text_col]
    rare_type = pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int32())]))

    def scored_rows(batch: pa.RecordBatch | pa.Table, uids: np.ndarray, keys: WordKeys, levels: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        """The columns that are worked out; ``levels`` gives those of different words and of the pair at each token."""
        tokens, sizes = token_keys(batch.column(text_col).to_pylist(), keys)
        begin = np.cumsum(sizes) - sizes
        words, inverse = np.unique(tokens, return_inverse=True)
        word_keys = unigram_keys(words)
        at = np.minimum(np.searchsorted(top_keys, word_keys), max(0, len(top_keys) - 1))
        hit = top_keys[at] == word_keys if len(top_keys) else np.zeros(len(words), bool)
        exact = np.where(hit, top_counts[at] if len(top_keys) else 0, 0)
        is_top = hit[inverse]
        base_sum = np.add.reduceat(np.log10(exact + 1.0)[inverse], begin)
        n_known = np.add.reduceat(is_top.astype(np.int64), begin)
        word_levels, pair_levels = levels(word_keys, bigram_keys(contexts(tokens), tokens))
        before = np.where(np.arange(len(tokens)) == np.repeat(begin, sizes), -1, np.concatenate(([0], inverse[:-1])))
        # The beginning stands before each text once, as often as the end does.
        before = np.where(before >= 0, before, int(np.searchsorted(words, END)))
        word_count = sums.word_means[word_levels]
        before_count = word_count[before]
        pair_count = np.minimum(sums.pair_means[pair_levels], before_count)
        pair = np.divide(pair_count, before_count, out=np.zeros(len(tokens)), where=before_count > 0)
        weight = np.divide(before_count, before_count + rarity, out=np.zeros(len(tokens)), where=before_count > 0)
        p = weight * pair + (1 - weight) * (word_count[inverse] + 1) / denominator
        total = np.add.reduceat(np.log10(p), begin)
        row, rare = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(~is_top)
        at, times, ends = _distinct(row[rare], word_keys[inverse[rare]], len(sizes))
        members = [pa.array(word_keys[inverse[rare[at]]].view(np.int64)), pa.array(times)]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(members, names=["key", "m"]), type=rare_type)
        return [pa.array(uids), pa.array(sizes), pa.array(n_known), pa.array(base_sum), pa.array(total), lists]

    names = [*columns, "_uid", "n_tokens", "_known", "_base", "score", "_rare"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, model = WordKeys(), shared.value
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch in bounded_batches(batches):
            made = scored_rows(batch, uid + np.arange(batch.num_rows), keys, lambda words, pairs: (model.levels(words), model.levels(pairs)))
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=names)

    def score_chunk(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers, keys, out = rows.sort_by("_uid"), answers.sort_by([("first", "ascending"), ("by", "ascending")]), WordKeys(), []
        firsts, starts = np.unique(answers["first"].to_numpy(), return_index=True)
        begins, ends = np.searchsorted(rows["_uid"].to_numpy(), firsts), [*starts[1:].tolist(), len(answers)]
        for begin, end, a, b in zip(begins, [*begins[1:], len(rows)], starts.tolist(), ends, strict=True):
            said = np.frombuffer(b"".join(answers["levels"].slice(a, b - a).to_pylist()), np.int8)

            def levels(words: np.ndarray, pairs: np.ndarray, said: np.ndarray = said) -> tuple[np.ndarray, np.ndarray]:
                pair_keys, place = np.unique(pairs, return_inverse=True)
                found = np.empty(len(said), np.int64)
                found[_dealt(words, pair_keys, n_parts)[1]] = said
                return found[: len(words)], found[len(words) :][place]

            own = rows.slice(begin, end - begin)
            made = scored_rows(own, own["_uid"].to_numpy(), keys, levels)
            out.append(pa.table([*[own.column(c) for c in columns], *made], names=names))
        return pa.concat_tables(out)

    schema = T.StructType(base.select(*columns).schema.fields)
    for name, kind in (("_uid", T.LongType()), ("n_tokens", T.LongType()), ("_known", T.LongType()), ("_base", T.DoubleType()), ("score", T.DoubleType())):
        schema = schema.add(name, kind)
    schema = schema.add("_rare", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("m", T.IntegerType())])))
    if apart:  # each step's shuffle files go before the next one writes
        tidy(spark)
        chunked = in_chunks(base, text_col)
        answers = materialize(levels_asked(chunked, text_col, parts, n_parts), "lm-levels")
        tidy(spark)
        found = chunked.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score_chunk, schema)
        scored = materialize(found, "lm-scores")
        discard(chunked, answers)
        tidy(spark)
    else:
        scored = materialize(base.mapInArrow(score, schema), "lm-scores")
    rare = scored.select("_uid", F.inline("_rare"))
    found = rare.join(unigrams.where(F.col("n") < least), "key").groupBy("_uid").agg(
        F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("_more"), F.sum("m").alias("_found")
    )
    return (
        scored.drop("_rare")
        .join(found, "_uid", "left")
        .withColumn("n_known", F.col("_known") + F.coalesce("_found", F.lit(0)))
        .withColumn("train_tokens", F.lit(n_train).cast("long"))
        .withColumn("base_score", F.col("_base") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(denominator)))
        .select(*columns, *ADDED[1:])
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return score_texts(docs).select("doc_id", *ADDED)
