"""License scans (operator 2): exact containment of license templates in blocks of text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import bounded_batches, spread, with_columns_free
from docquarry.llm.license_texts import LICENSE_TEXTS

#: Fixed values of the query: its base phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Opening sentences of common licenses, matched by containment.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
    ),
)
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")

#: Word bytes as they are, A-Z in lower case, all others a space: splitting on spaces gives the words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
BLOCK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    phrase: bool  # a base phrase: all words, standing consecutively

    def least(self, threshold: float) -> int:
        """Distinct words that a block must share with it."""
        n = len(set(self.words))
        return n if self.phrase else max(1, math.ceil(threshold * n - 1e-9))


def make_templates(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> list[Template]:
    found = [Template(label, tuple(words_of(text)), True) for text, label in phrases]
    return found + [Template(label, tuple(words_of(text)), False) for label, text in templates]


def template_table(
    table: DataFrame, label_col: str = "label", text_col: str = "text", *, most: int = 20_000, most_bytes: int = 64 << 20
) -> list[tuple[str, str]]:
    """Templates for ``scan_licenses`` from a table of whole license texts: they go along with the tasks, so rows and bytes have a bound."""
    rows = table.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > most or size > most_bytes:
        raise ValueError(f"more than {most} templates" if n > most else f"templates of more than {most_bytes} bytes")
    rows = rows.collect()
    return sorted((r["label"], r["text"]) for r in rows)


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> DataFrame:
    """How often each word of the templates stands in all texts: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in bounded_batches(batches):
            for text in batch.column(0).to_pylist():
                total.update(filter(vocabulary.__contains__, words_of(text)))
        names = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in names], pa.string()), pa.array([total[w] for w in names], pa.int64())], names=["word", "n"]
        )

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class BlockScan:
    """Finds the blocks of one text that meet a template, by prefix, length and positional filters.

    A block for a template of m distinct words is a run of ``stretch`` * its words (at least its words);
    blocks begin at every word. Words are known by their rank in the global frequency order, rarest
    first. A block that shares ``least`` of the m words has one of the m - least + 1 rarest (its prefix),
    so only the surroundings of prefix words are looked at; the rest of the text costs one dictionary
    look-up a word.
    """

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int], threshold: float, stretch: float, every: bool = False):
        self.every = every
        ranked = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(ranked)}
        self.templates = [t for t in templates if t.words]
        self.sets, self.least, self.width = [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            ordered = sorted({self.rank[w] for w in t.words})
            least = t.least(threshold)
            self.sets.append({r: p for p, r in enumerate(ordered)})
            self.least.append(least)
            self.width.append(len(t.words) if t.phrase else max(len(t.words), int(stretch * len(t.words))))
            for p, r in enumerate(ordered[: len(ordered) - least + 1]):
                self.prefix.setdefault(r, []).append((k, p))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment): for phrases each place, for others each best block of a hit run, or every block."""
        rank, prefix = self.rank, self.prefix
        known = [(i, r) for i, r in enumerate(map(rank.get, words)) if r is not None]
        if not known:
            return []
        starts: dict[int, set[int]] = {}
        at = dict(known)
        for i, r in known:
            for k, p in prefix.get(r, ()):
                of, width, least = self.sets[k], self.width[k], self.least[k]
                if self.templates[k].phrase:
                    starts.setdefault(k, set()).update(i - j for j, w in enumerate(self.templates[k].words) if rank[w] == r)
                    continue
                # Length filter: the reach of all blocks through i must hold enough words of the template.
                low, high = i - width + 1, i + width - 1
                near = [(j, at[j]) for j in range(max(0, low), min(len(words), high + 1)) if at.get(j) in of]
                if len({x for _, x in near}) < least:
                    continue
                # Positional filter: a block whose rarest shared word is this one shares at most the m - p from here on.
                if len({x for _, x in near if of[x] >= p}) < least:
                    continue
                starts.setdefault(k, set()).update(j for j, _ in near if j <= i)
        found = []
        for k, begins in starts.items():
            template = self.templates[k]
            if template.phrase:
                m = len(template.words)
                found += [(k, s, s + m, 1.0) for s in sorted(begins) if s >= 0 and tuple(words[s : s + m]) == template.words]
                continue
            of, width, least = self.sets[k], self.width[k], self.least[k]
            best: tuple[int, int, int, float] | None = None
            for s in sorted(begins):
                inside = [(j, at[j]) for j in range(s, min(len(words), s + width)) if at.get(j) in of]
                share = len({x for _, x in inside})
                if share < least:
                    continue
                hit = (k, s, inside[-1][0] + 1, share / len(of))
                if self.every:
                    found.append(hit)
                    continue
                if best is not None and s < best[2]:
                    best = max(best, hit, key=lambda x: (x[3], -(x[2] - x[1]), -x[1]))
                    continue
                if best is not None:
                    found.append(best)
                best = hit
            if best is not None:
                found.append(best)
        return found


def scan_licenses(
    docs: DataFrame,
    *,
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES + LICENSE_TEXTS,
    threshold: float = 0.9,
    stretch: float = 1.5,
    every_block: bool = False,
) -> DataFrame:
    """``docs`` without the text, with word count, base places, labels, score and the matching blocks.

    An exact set-similarity join of all blocks of all texts with the templates: containment = distinct
    words shared / distinct words of the template >= ``threshold``; blocks are runs of ``stretch`` times
    the template's words. The base phrases are templates of containment 1 whose words must also stand
    consecutively. The order of words is by their frequency in all documents, counted first over the
    whole table; only the templates' own words are counted, so what comes to the driver and goes to the
    tasks has the size of the template list: openings and whole texts of common licenses, or a table of the
    caller's by ``template_table``.
    No text is shuffled. ``blocks`` has every place of a base phrase, and of blocks of one template that
    overlap in a row the best one (highest containment, then shortest, then first), or with ``every_block`` all
    that meet the threshold and begin with a word of the template, each up to its last such word.

    score: the largest containment found, 0 without one. Null or empty text: no words, no labels, score 0.
    Places overlap freely and repeats all count. Texts of any length are scanned once, word by word.
    Repeated rows are scanned one by one and alike; no rows: no rows. Clashing columns are replaced.
    """
    chosen = make_templates(phrases, templates)
    vocabulary = frozenset(w for t in chosen for w in t.words)
    frequency = {r["word"].encode(): r["n"] for r in word_frequencies(docs, text_col, vocabulary).collect()}
    scan = BlockScan(chosen, frequency, threshold, stretch, every_block)
    kept = with_columns_free(docs, *ADDED)
    columns = [c for c in kept.columns if c != text_col]
    schema = T.StructType(
        [*kept.select(*columns).schema.fields]
        + [T.StructField(c, T.LongType()) for c in ADDED[:4]]
        + [T.StructField(c, T.StringType()) for c in ADDED[4:6]]
        + [T.StructField("score", T.DoubleType()), T.StructField("blocks", BLOCK_TYPE)]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = scan.templates
        block = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
        for batch in bounded_batches(batches):
            out: list[list] = [[] for _ in ADDED]
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                words = words_of(text)
                hits = scan.scan(words)
                base = [h for h in hits if kinds[h[0]].phrase]
                row = (
                    len(words),
                    len(base),
                    min((h[1] for h in base), default=None),
                    max((h[1] for h in base), default=None),
                    ",".join(sorted({kinds[h[0]].label for h in base})),
                    ",".join(sorted({kinds[h[0]].label for h in hits})),
                    max((h[3] for h in hits), default=0.0),
                    [{"label": kinds[k].label, "start": s, "end": e, "containment": c} for k, s, e, c in sorted(hits, key=lambda h: (h[1], h[0]))],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kept_columns = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            made = [pa.array(v, t) for v, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept_columns, *made], names=[*columns, *ADDED])

    return kept.mapInArrow(judge, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scan_licenses(docs).select("doc_id", *ADDED[:7])
