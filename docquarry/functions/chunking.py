"""Structure-aware chunks of bounded size, as small Arrow helpers around pure functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.markdown import Blocks
from docquarry.functions.text import WHITE, clean_markdown, inject_links

# Default chunk size, and the size up to which a code block stays whole.
MAX_BYTES = 800
WHOLE_CODE_BYTES = 8192
#: Chunk rows of one Arrow batch, about: a document is never divided between two.
_ROWS = 10_000

#: Texts of fewer characters are packed sentence by sentence; so are texts with white space in longer runs.
_FEW, _RUN = 32_768, 64
_WIDE_WHITE = re.compile(f"[{''.join(c for c in WHITE if c > chr(127))}]")
_WHITE_BYTE, _ENDS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"\t\n\x0b\x0c\r ", b".!?\n"))
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$")


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def slice_bytes(text: str, max_bytes: int) -> list[str]:
    """Slices of at most ``max_bytes`` bytes, cut between characters; at least one character each."""
    if text.isascii():
        return [text[i : i + max(1, max_bytes)] for i in range(0, len(text), max(1, max_bytes))]
    raw, out, start = text.encode(), [], 0
    while start < len(raw):
        end = min(start + max(1, max_bytes), len(raw))
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:  # the limit is less than this character
            end += 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        out.append(raw[start:end].decode())
        start = end
    return out


def pack(text: str, max_bytes: int) -> list[str]:
    """Sentences joined up to ``max_bytes``, the last one of a chunk repeated at the start of the next.

    The space after each sentence counts, so a chunk can pass the limit through its repeated sentence.
    A sentence over the limit ends the chunk, is sliced, and is not repeated.
    """
    if len(text) < _FEW or not (text.isascii() or _WIDE_WHITE.search(text) is None):
        return _pack_each(text, max_bytes)
    spans = _sentences(np.frombuffer(text.encode(), np.uint8))
    return _pack_each(text, max_bytes) if spans is None else _pack_spans(*spans, max_bytes)


def _pack_each(text: str, max_bytes: int) -> list[str]:
    """One sentence after the other, for short texts and for those with white space beyond ASCII."""
    out: list[str] = []
    held: list[str] = []  # the sentences of the open chunk
    length, last = 0, ""
    measure = len if text.isascii() else size_of
    for found in _SENTENCE.findall(text):
        sentence = found.strip(WHITE)
        if not sentence:
            continue
        n = measure(sentence)
        if n > max_bytes:
            if held:
                out.append(" ".join(held))
                held, length = [], 0
            out += slice_bytes(sentence, max_bytes)
            continue
        if held and length + n > max_bytes:
            out.append(" ".join(held))
            held, length = ([last], measure(last) + 1) if last else ([], 0)
        held.append(sentence)
        length += n + 1
        last = sentence
    if held:
        out.append(" ".join(held))
    return out


def _sentences(raw: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None:
    """The text with a space wherever one character stands between two sentences, and where these begin and end, trimmed.

    Also how many of the gaps up to each sentence are not one character. None if white space comes in long runs.
    """
    ends = np.flatnonzero(_ENDS[raw]) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    begins = np.concatenate(([0], ends[:-1]))
    for move, at, step in ((begins, 0, 1), (ends, -1, -1)):
        for turn in range(_RUN + 1):
            loose = np.flatnonzero(begins < ends)
            loose = loose[_WHITE_BYTE[raw[move[loose] + at]]]
            if not len(loose):
                break
            if turn == _RUN:
                return None
            move[loose] += step
    kept = begins < ends
    begins, ends = begins[kept], ends[kept]
    single = begins[1:] - ends[:-1] == 1
    joined = raw.copy()
    joined[ends[:-1][single]] = 0x20
    return joined.tobytes(), begins, ends, np.concatenate(([0], np.cumsum(~single)))


def _pack_spans(joined: bytes, begins: np.ndarray, ends: np.ndarray, gaps: np.ndarray, max_bytes: int) -> list[str]:
    """The same over the places of the sentences: where a chunk ends is looked up in the running sum of sizes."""
    size = ends - begins
    giants = np.flatnonzero(size > max_bytes).tolist()
    total = np.concatenate(([0], np.cumsum(size + 1))).tolist()
    first, last, gap = begins.tolist(), ends.tolist(), gaps.tolist()
    out: list[str] = []

    def say(j: int, k: int) -> None:
        if gap[j] == gap[k]:
            out.append(joined[first[j] : last[k]].decode())
        else:
            out.append(" ".join([joined[first[i] : last[i]].decode() for i in range(j, k + 1)]))

    at = 0
    for giant in [*giants, len(first)]:
        j = at  # the first sentence of the open chunk
        while at < giant:
            # All sentences up to this one fit: their sizes and the spaces between them are within the limit.
            end = bisect_right(total, total[j] + max_bytes + 1, at + 1, giant + 1) - 1
            at = max(at + 1, end)
            say(j, at - 1)
            j = at - 1  # it is repeated, and the next one follows whatever its size
        if giant < len(first):
            out += slice_bytes(joined[first[giant] : last[giant]].decode(), max_bytes)
        at = giant + 1
    return out


class Chunks:
    """Sink of Markdown blocks that makes chunks: one a paragraph, item, code block or run of table rows."""

    def __init__(self, max_bytes: int):
        self.max_bytes = max_bytes
        self.done: list[str] = []
        self.parts: list[str] = []
        self.head: list[str] | None = None
        self.header = ""

    def say(self, text: str) -> None:
        self.parts.append(text)

    def flush(self) -> None:
        block, self.parts = "".join(self.parts), []
        if len(block) > self.max_bytes or size_of(block) > self.max_bytes:
            self.done += pack(block, self.max_bytes)
        elif kept := block.strip(WHITE):
            self.done.append(kept)
        elif block:
            self.parts = [block]  # blank text stays for what follows

    def code(self, text: str) -> None:
        block = "".join(self.parts) + "```\n" + text
        block += ("" if block.endswith("\n") else "\n") + "```"
        self.parts = []
        whole = size_of(block) <= max(self.max_bytes, WHOLE_CODE_BYTES)
        self.done += [block] if whole else slice_bytes(block, self.max_bytes)

    def table_start(self) -> None:
        block = "".join(self.parts)
        self.parts = [block + "\n"] if block and not block.endswith("\n") else [block]

    def table_head(self, opens: bool) -> None:
        if opens:
            self.head = self.parts
            self.parts = []
        else:
            self.header = "".join(self.parts) + "\n"
            self.parts = [*(self.head or []), self.header]

    def row_end(self) -> None:
        block = "".join([*self.parts, "\n"])
        if size_of(block) > self.max_bytes:
            self.done.append(block.strip(WHITE))
            block = self.header
        self.parts = [block]

    def table_end(self) -> None:
        self.flush()


def chunks_of(text: str, max_bytes: int = MAX_BYTES, heading_sep: str = "") -> list[str]:
    """Chunks of an already cleaned Markdown text.

    Headings do not end a chunk: their text stands before what follows, joined by ``heading_sep``.
    """
    sink = Chunks(max_bytes)
    Blocks(sink, text, heading_sep)
    if "".join(sink.parts).strip(WHITE):
        sink.flush()
    return sink.done


def _arrays(function: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return each


def byte_slices(text: Column, max_bytes: int = MAX_BYTES) -> Column:
    return _arrays(lambda t: slice_bytes(t, max_bytes))(text)


def pack_sentences(text: Column, max_bytes: int = MAX_BYTES) -> Column:
    return _arrays(lambda t: pack(t, max_bytes))(text)


def chunk_markdown(text: Column, max_bytes: int = MAX_BYTES, heading_sep: str = "") -> Column:
    """Chunks of a Markdown text column, images and comments cleaned out first."""
    return _arrays(lambda t: chunks_of(t, max_bytes, heading_sep))(clean_markdown(text))


def chunk_documents(
    documents: DataFrame, max_bytes: int = MAX_BYTES, *, path_col: str = "source_path", text_col: str = "text", heading_sep: str = ""
) -> DataFrame:
    """One row a chunk: source_path, chunk_index from 0 (in order, without gaps), text.

    Link definitions of the whole document go in front of it first. Documents are chunked whole, each in
    the partition where it lies; there is no shuffle. Null and blank texts give no rows.
    """
    given = documents.where(F.length(F.col(text_col)) > 0)
    cleaned = given.select(F.col(path_col).alias("source_path"), clean_markdown(inject_links(F.col(text_col))).alias("text"))
    schema = T.StructType([cleaned.schema["source_path"], T.StructField("chunk_index", T.LongType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, chunks, owner = 0, [], []
            for i, text in enumerate(batch.column(1)):
                found = chunks_of(text.as_py(), max_bytes, heading_sep)
                chunks += found
                owner += [i] * len(found)
                n += len(found)
                if n >= _ROWS or i == batch.num_rows - 1:
                    at = np.array(owner, np.int64)
                    index = np.arange(n) - np.searchsorted(at, at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(index), pa.array(chunks, pa.string())], names=schema.names)
                    n, chunks, owner = 0, [], []

    return cleaned.mapInArrow(cut, schema)
