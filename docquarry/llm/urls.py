"""URL filters (operator 9): all glob rules at once by a bit-parallel Shift-And automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import bounded_batches, with_columns_free

ADDED = ("host", "path", "rule", "verdict", "globs")


#: Stands behind the host in the text that the automaton reads: host rules end their host with it, so no
#: path or query can pass for a host; other globs do not see it.
HOST_END = "\x00"


class HostRule(NamedTuple):
    """Allows or blocks a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return "*." + _quoted(self.host) + HOST_END + _quoted(self.path) + "**"


#: Fixed values of the query: its host rules.
RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Globs that block where no host rule fits: admin pages, sessions in the query, archives, spam hosts.
BLOCK_GLOBS = ("**/wp-admin/**", "**/cgi-bin/**", r"**\?**phpsessid=**", "**.exe", "**.zip", *(f"*{x}*{HOST_END}**" for x in ("casino", "cheap-pills", "free-bets")))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class ShiftAnd:
    """Globs packed into the words of one bit vector.

    ``*`` is any run of bytes but ``/`` and HOST_END, ``**`` any run, ``?`` one byte, a backslash quotes. A glob with
    m single-byte items takes m + 1 bits: bit 0 is its start, bit k means that k items are matched; a
    wildcard sets a loop on the bit it stands at. One step over byte c is
    D = ((D << 1) & step[c]) | (D & loop[c]), with the carry of the shift passed between the words. The
    byte HOST_END leaves all states as they are for globs that do not hold it.
    """

    def __init__(self, globs: Sequence[str]):
        items = [self._parse(g) for g in globs]
        self.bits = sum(len(x) + 1 for x, _ in items)
        self.words = max(1, (self.bits + 63) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for single, loops in items:
            self._set(self.start, at)
            for k, byte in enumerate(single, 1):
                for c in range(256) if byte is None else (byte,):
                    self._set(self.step[c], at + k)
            for k, slash in loops.items():
                for c in range(1, 256):
                    if slash or c != 0x2F:
                        self._set(self.loop[c], at + k)
            end = at + len(single)
            if 0 not in single:
                for k in range(at, end + 1):
                    self._set(self.loop[0], k)
                    self.step[0][k // 64] &= ~np.uint64(1 << (k % 64))
            self.final.append((end // 64, np.uint64(1 << (end % 64))))
            at = end + 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        single: list[int | None] = []
        loops: dict[int, bool] = {}
        raw, i = glob.encode(), 0
        while i < len(raw):
            c = raw[i : i + 1]
            if c == b"*":
                run = len(raw[i:]) - len(raw[i:].lstrip(b"*"))
                loops[len(single)] = loops.get(len(single), False) or run > 1
                i += run
                continue
            if c == b"\\" and i + 1 < len(raw):
                i += 1
                c = raw[i : i + 1]
                single.append(c[0])
            else:
                single.append(None if c == b"?" else c[0])
            i += 1
        return single, loops

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Matrix [texts, globs] of whole-text matches; no padding: texts leave as they end."""
        n = len(texts)
        length = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(length) - length)[order]
        sorted_length = length[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for j in range(int(sorted_length[0]) if n else 0):
            live = int(np.searchsorted(-sorted_length[:live], -j, side="left"))
            d, byte = state[:live], flat[begin[:live] + j]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (d & self.loop[byte])
        found = np.empty((n, len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            found[order, g] = (state[:, word] & bit) != 0
        return found


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    """From the ``?`` on, without the fragment; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _no_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "\x01")


def filter_urls(
    pages: DataFrame,
    *,
    url_col: str = "url",
    rules: Sequence[HostRule] = RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``globs`` (the blocking globs that match).

    Each canonical URL (host in lower case, path, query; no scheme, no fragment) runs once
    through one automaton that holds all host rules, as globs, and all blocking globs. The longest
    matching host rule gives the verdict (ties: block before allow, then the smaller name); without one,
    a matching blocking glob blocks and anything else is allowed. A host rule sees the host and the path
    only: a mark between host and path, which no wildcard of it crosses, keeps its host apart. Blocking
    globs match '.' + host + path + query as a whole; one that holds HOST_END tells host from path. NUL in a URL counts as U+0001.

    The automaton is small (bytes x words of the rules) and goes with the task; there is no shuffle.
    Null URL or one without ``://``: empty host and path, no rule, allowed. Any length of URL works in
    memory in proportion to the batch's bytes. Repeated rows stand one by one; no rows: no rows. Columns
    that clash with added ones are replaced.
    """
    rules = tuple(rules)
    globs = [r.glob for r in rules] + list(block_globs)
    automaton = ShiftAnd(globs)
    ranking = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict != "block", rules[i].name))
    names, verdicts, extra = [r.name for r in rules], [r.verdict for r in rules], list(block_globs)

    kept = with_columns_free(pages, *ADDED, "_canonical")
    columns = kept.columns
    ready = kept.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}).withColumn(
        "_canonical", F.concat(F.lit("."), _no_nul(F.col("host")), F.lit(HOST_END), _no_nul(F.concat("path", url_query(F.col(url_col)))))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            texts = [x.encode() for x in batch.column(batch.schema.get_field_index("_canonical")).to_pylist()]
            hit = automaton.match(texts)
            best = np.full(len(texts), -1)
            for i in reversed(ranking):
                best[hit[:, i]] = i
            blocked = hit[:, len(rules) :]
            any_blocked = blocked.any(axis=1)
            rule = [names[i] if i >= 0 else None for i in best]
            verdict = [verdicts[i] if i >= 0 else ("block" if b else "allow") for i, b in zip(best, any_blocked, strict=True)]
            matched = [[extra[g] for g in np.flatnonzero(row)] for row in blocked]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in (*columns, "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(matched, pa.list_(pa.string()))],
                names=[*columns, *ADDED],
            )

    schema = ready.drop("_canonical").schema.add("rule", "string").add("verdict", "string").add("globs", T.ArrayType(T.StringType()))
    return ready.mapInArrow(judge, schema)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's'), '') AS query
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (
  SELECT u.*, (SELECT arg_max({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) FROM r
    WHERE ('.' || u.host) LIKE ('%.' || rhost) AND starts_with(u.path, rpath)) AS best
  FROM u)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN whole LIKE '%/wp-admin/%' OR whole LIKE '%/cgi-bin/%' OR query LIKE '?%phpsessid=%'
         OR whole LIKE '%.exe' OR whole LIKE '%.zip' OR host LIKE '%casino%' OR host LIKE '%cheap-pills%' OR host LIKE '%free-bets%'
         THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, host || path || query AS whole FROM b)
"""
