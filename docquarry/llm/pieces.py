"""SentencePiece encoding and decoding (operator 8): sampled segmentations by forward filtering, backward sampling."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import bounded_batches, spread, with_columns_free
from docquarry.llm.lm import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ADDED = ("pieces", "n_pieces")
#: Units up to this length are filtered all together; a longer one is cut where no piece crosses, and what
#: is longer still is filtered on its own, with scaling.
_LONG = 60
#: Log probability of a character that has no piece and is spelt in bytes.
_SPELT = -20.0
#: Added to the log weight of a piece for each of its characters: all segmentations of a unit have as many
#: characters, so shares stay as they are, and weights of units up to _LONG stay within doubles.
_LIFT = 10.0
#: Characters that are encoded at once, and characters of different units whose lattices a task keeps (some 55 bytes
#: each): the Python workers of all cores stand beside the executor's heap in one container.
_PART, _KEPT = 80_000, 400_000
_U = np.uint64
#: Base of the hash of units, odd so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_SPACE, _LINE = 0x20, 0x0A


class Vocabulary:
    """Pieces with spaces for the model's space marks, and a log probability for each.

    The model file ranks its pieces; a piece of rank r gets the log probability -alpha * log(r + 1).
    Byte pieces spell characters without a piece, the space mark U+2581 among them, so that every text
    has a segmentation and is given back exactly.
    """

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_id: dict[int, int] = {}
        self.log_p: dict[str, tuple[int, float]] = {}
        raw: list[bytes] = []
        rank = 0
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i):
                raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                raw.append(text.encode())
                self.log_p[text] = (i, -alpha * math.log(rank + 1))
                rank += 1
        assert len(self.byte_id) == 256, "the model has no byte pieces"
        assert not any(re.search("[^ ] |\n", x) for x in self.log_p), "a piece goes across the borders of units"
        self.raw = pa.array(raw, pa.binary())
        self.longest = max(map(len, self.log_p))
        self._tables()

    def _tables(self) -> None:
        """Open addressing from a hash of a prefix of a piece to its number, and from there to the piece."""
        pieces = list(self.log_p)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.zeros((len(pieces), self.longest), np.uint64)
        flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.repeat(np.arange(len(pieces)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        h, prefixes = np.zeros(len(pieces), np.uint64), []
        whole = np.empty(len(pieces), np.uint64)
        for n in range(1, self.longest + 1):
            h = rolled(h, codes[:, n - 1])
            prefixes.append(h[sizes >= n])
            whole[sizes == n] = h[sizes == n]
        self.keys = np.unique(np.concatenate(prefixes))
        assert len(self.keys) == len({x[:n] for x in pieces for n in range(1, len(x) + 1)}), "two prefixes have one hash"
        self.ids = np.array([i for i, _ in self.log_p.values()], np.int32)
        self.lifted = np.exp(np.array([s for _, s in self.log_p.values()]) + _LIFT * sizes)
        self.piece = np.full(len(self.keys), -1, np.int32)  # of a prefix that is a piece
        self.piece[np.searchsorted(self.keys, whole)] = np.arange(len(pieces))
        size = 1 << (len(self.keys) * 3).bit_length()
        self.mask = _U(size - 1)
        self.slots = np.full(size, -1, np.int32)
        for k, slot in enumerate((mixed(self.keys) & self.mask).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.slots[slot] = k

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the prefix with this hash, -1 for none."""
        slot = mixed(keys) & self.mask
        found = self.slots[slot]
        open_ = np.flatnonzero(found >= 0)
        open_ = open_[self.keys[found[open_]] != keys[open_]]
        while len(open_):
            slot[open_] = (slot[open_] + _U(1)) & self.mask
            found[open_] = self.slots[slot[open_]]
            open_ = open_[found[open_] >= 0]
            open_ = open_[self.keys[found[open_]] != keys[open_]]
        return found

    def spell(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def weight(self, number: np.ndarray) -> np.ndarray:
        """Lifted weights of pieces; a character that is spelt has the number -2."""
        return np.where(number >= 0, self.lifted[np.maximum(number, 0)], math.exp(_SPELT + _LIFT))


def rolled(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of a string and one more character: 64-bit, so two texts of one length meet with chance 2^-64."""
    return (h ^ (c + _U(1))) * _U(0x9E3779B97F4A7C15) + (h >> _U(29))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


@lru_cache(maxsize=4)
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


def uniform(seed: np.ndarray, unit: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """32 random bits of a row's unit and step: they depend on nothing else, so neither batches nor reruns matter."""
    x = mixed(seed + unit.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return mixed(x ^ (np.asarray(step, np.uint64) * _U(0xC2B2AE3D27D4EB4F))) >> _U(32)


def arcs_of(chars: np.ndarray, left: np.ndarray, vocab: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the characters where a piece of that length begins, and the pieces' numbers.

    ``left`` is how many characters of the unit stand from each on. A character without a piece of its own
    has the number -2. A beginning that no piece has is not followed further.
    """
    out = []
    wide = chars.astype(np.uint64)
    live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    for n in range(1, vocab.longest + 1):
        if n > 1:
            keep = left[live] >= n
            live, h = live[keep], h[keep]
        h = rolled(h, wide[live + n - 1])
        prefix = vocab.find(h)
        number = np.where(prefix >= 0, vocab.piece[np.maximum(prefix, 0)], -1)
        if n == 1:
            number[number < 0] = -2
        some = number != -1
        out.append((live[some], number[some]))
        going = prefix >= 0
        live, h = live[going], h[going]
    return out


def crossings(chars: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How many pieces of the units' lattices go across the border before each character."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))
    change = np.zeros(len(chars) + 1, np.int64)
    for n, (begin, _) in enumerate(arcs_of(chars, left, vocab), 1):
        change[begin + 1] += 1
        change[begin + n] -= 1
    return np.cumsum(change)[:-1]


class Lattices:
    """All piece lattices of a list of different units, filtered forward.

    Nodes are the places between characters, unit by unit. The arcs into a node stand together from
    ``into[node]`` on, the longest piece first; ``bound`` is the share of the forward weight that an arc
    and those before it bring, in 2^-32, so 32 random bits sample the last piece before a node.
    """

    def __init__(self, chars: np.ndarray, size: np.ndarray, vocab: Vocabulary):
        self.chars = chars
        self.rooms: dict[str, np.ndarray] = {}
        self.begin = np.cumsum(size) - size  # the unit's first character
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        self.into = np.zeros(int(size.sum()) + len(size), np.int64)
        self.source, self.number, self.bound, self.char = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32), np.empty(0, np.uint32)
        if len(chars):
            self._filter(size, vocab)

    def _filter(self, size: np.ndarray, vocab: Vocabulary) -> None:
        chars, nodes = self.chars, len(self.into)
        place = np.arange(len(chars)) - np.repeat(self.begin, size)  # within the unit
        node = np.repeat(self.first, size) + place
        found = arcs_of(chars, np.repeat(size, size) - place, vocab)
        source = [node[at] for at, _ in found]
        weight = [vocab.weight(number) for _, number in found]
        target = np.concatenate([x + n for n, x in enumerate(source, 1)])
        if len(size) and size.max() > _LONG:
            share_of = _scaled_shares(source, weight, self.first, nodes)
        else:
            forward = np.zeros(nodes)
            forward[self.first] = 1.0
            flat_source, flat_weight = np.concatenate(source), np.concatenate(weight)
            flat_begin = np.concatenate([place[at].astype(np.uint8) for at, _ in found])
            order = np.argsort(flat_begin, kind="stable")
            cuts = np.concatenate(([0], np.cumsum(np.bincount(flat_begin))))
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = order[b:e]
                np.add.at(forward, target[part], forward[flat_source[part]] * flat_weight[part])
            share_of = [forward[x] * w / forward[x + n] for n, (x, w) in enumerate(zip(source, weight, strict=True), 1)]
        arcs = np.bincount(target, minlength=nodes)
        self.into = np.cumsum(arcs) - arcs
        self.source, self.number = np.empty(len(target), np.int32), np.empty(len(target), np.int32)
        self.bound, self.char = np.empty(len(target), np.uint32), np.zeros(len(target), np.uint32)
        next_, total = self.into.copy(), np.zeros(nodes)
        for n in range(vocab.longest, 0, -1):  # one arc of each length at most ends at a node
            end = source[n - 1] + n
            total[end] += share_of[n - 1]
            at = next_[end]
            self.source[at], self.number[at] = source[n - 1], found[n - 1][1]
            self.bound[at] = np.minimum(np.floor(total[end] * 2.0**32), 2.0**32 - 1)
            if n == 1:
                self.char[at] = chars[found[0][0]]
            next_[end] += 1
        self.bound[(self.into + arcs - 1)[arcs > 0]] = (1 << 32) - 1

    def append(self, other: Lattices) -> None:
        """Put the other's units behind these. Arrays get room for half as much again, so they are seldom copied, and one by one."""
        chars, nodes, arcs = len(self.chars), len(self.into), len(self.source)
        moved = {
            "chars": other.chars, "begin": other.begin + chars, "first": other.first + nodes, "last": other.last + nodes,
            "into": other.into + arcs, "source": other.source + np.int32(nodes), "number": other.number, "bound": other.bound, "char": other.char,
        }
        for name, more in moved.items():
            own = getattr(self, name)
            n, room = len(own) + len(more), self.rooms.get(name, own)
            if len(room) < n:
                room = self.rooms[name] = np.empty(n * 3 // 2, own.dtype)
                room[: len(own)] = own
            room[len(own) : n] = more
            setattr(self, name, room[:n])

    def sample(self, unit: np.ndarray, seed: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of a sampled segmentation of each occurrence, in order, and how many each has."""
        node, start = self.last[unit], self.first[unit]
        live = np.flatnonzero(node > start)
        who, arcs, steps, step = [], [], np.zeros(len(unit), np.int64), 0
        while len(live):
            bits = uniform(seed[live], ordinal[live], step).astype(np.uint32)
            arc = self.into[node[live]]
            open_ = np.flatnonzero(self.bound[arc] < bits)
            while len(open_):
                arc[open_] += 1
                open_ = open_[self.bound[arc[open_]] < bits[open_]]
            who.append(live)
            arcs.append(arc)
            before = self.source[arc]
            node[live] = before
            steps[live] += 1
            step += 1
            live = live[before > start[live]]
        end = np.cumsum(steps)
        out = np.empty(int(steps.sum()), np.int64)
        for k, (w, a) in enumerate(zip(who, arcs, strict=True)):
            out[end[w] - 1 - k] = a
        return out, steps

    def sample_one(self, seed: int, ordinal: int) -> np.ndarray:
        """The same for a single long unit, arc by arc."""
        n = int(self.last[0])
        bits = uniform(np.full(n, seed, np.uint64), np.full(n, ordinal), np.arange(n)).tolist()
        into, bound, source = self.into.tolist(), self.bound.tolist(), self.source.tolist()
        out, node = [], n
        while node:
            arc, drawn = into[node], bits[len(out)]
            while bound[arc] < drawn:
                arc += 1
            out.append(arc)
            node = source[arc]
        return np.array(out[::-1], np.int64)


def _scaled_shares(source: list[np.ndarray], weight: list[np.ndarray], first: np.ndarray, nodes: int) -> list[np.ndarray]:
    """Shares of the arcs of each length, by a pass over all nodes that rescales the forward weights as it goes."""
    longest = len(source)
    flat = np.concatenate(source)
    order = np.argsort(flat, kind="stable")
    ends = (flat + np.repeat(np.arange(1, longest + 1), [len(x) for x in source]))[order].tolist()
    weights = np.concatenate(weight)[order].tolist()
    cuts = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=nodes)))).tolist()
    forward, scaled = [0.0] * (nodes + longest), [0] * nodes
    begins = set(first.tolist())
    power = 0
    for i in range(nodes):
        if i in begins:
            forward[i] = 1.0
        x = forward[i]
        if 0.0 < x < 1e-100 or x > 1e100:
            factor, power = (1e100, power + 1) if x < 1 else (1e-100, power - 1)
            forward[i : i + longest + 1] = [y * factor for y in forward[i : i + longest + 1]]
            x = forward[i]
        scaled[i] = power
        for k in range(cuts[i], cuts[i + 1]):
            forward[ends[k]] += x * weights[k]
    log_f = np.log(np.array(forward[:nodes]))
    level = np.array(scaled) * math.log(1e100)
    return [np.exp(log_f[x] + np.log(w) - log_f[x + n] + level[x + n] - level[x]) for n, (x, w) in enumerate(zip(source, weight, strict=True), 1)]


class Encoder:
    """Encodes batches of texts; lattices of the units met so far are kept, up to _KEPT characters of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.kept = Lattices(np.empty(0, np.uint32), np.empty(0, np.int64), self.vocab)
        self.keys, self.unit = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _units(self, chars: np.ndarray, row_begin: np.ndarray) -> np.ndarray:
        """Where units begin: a line end by itself; a run of spaces with the word behind it.

        A unit over _LONG characters is cut at each border that no piece of its lattice crosses: what
        stands between two of these borders is segmented by itself either way.
        """
        space, line = chars == _SPACE, chars == _LINE
        begins = line | np.concatenate(([True], line[:-1])) | (space & ~np.concatenate(([False], space[:-1])))
        begins[row_begin] = True
        at = np.flatnonzero(begins)
        size = np.diff(at, append=len(chars))
        long = size > _LONG
        if not long.any():
            return at
        whole = np.repeat(long, size)
        inside = np.flatnonzero(whole)
        begins[inside[crossings(chars[inside], size[long], self.vocab) == 0]] = True
        return np.flatnonzero(begins)

    def _numbers(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each unit's lattice in ``kept``; units that are new are filtered and kept first."""
        power, inverse = _powers(_BASE, len(chars)), _powers(pow(_BASE, -1, 1 << 64), len(chars))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(chars.astype(np.uint64) + _U(1)) * power)))
        keys = mixed((total[begin + size] - total[begin]) * inverse[begin] ^ size.astype(np.uint64))
        distinct, first, inverse_of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.kept.chars) > _KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            some = first[new]
            picked = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(int(size[some].sum()))
            number = len(self.kept.first) + np.arange(len(some))
            self.kept.append(Lattices(chars[picked], size[some], self.vocab))
            keys, unit = np.concatenate((self.keys, distinct[new])), np.concatenate((self.unit, number))
            order = np.argsort(keys, kind="stable")
            self.keys, self.unit = keys[order], unit[order]
        unit = self.unit[np.searchsorted(self.keys, distinct)][inverse_of]
        # Units meet by hash; each is then compared with the one it met, character by character.
        own = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        met = np.repeat(self.kept.begin[unit] - (np.cumsum(size) - size), size) + np.arange(len(own))
        if not np.array_equal(self.kept.last[unit] - self.kept.first[unit], size) or not np.array_equal(chars[own], self.kept.chars[met]):
            raise ValueError("two different units have one 64-bit hash")
        return unit

    def encode(self, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and the number of each text's ids."""
        vocab = self.vocab
        given = np.array([bool(t) for t in texts])
        rows = np.flatnonzero(given)
        if not len(rows):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        lengths = np.fromiter((len(texts[r]) + 1 for r in rows), np.int64, len(rows))
        chars = np.frombuffer("".join([" " + texts[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
        row_begin = np.cumsum(lengths) - lengths
        begin = self._units(chars, row_begin)
        size = np.diff(begin, append=len(chars))
        n_units = np.diff(np.searchsorted(begin, row_begin), append=len(begin))
        row = np.repeat(rows, n_units)
        ordinal = np.arange(len(begin)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        short = size <= _LONG
        unit = self._numbers(chars, begin[short], size[short]) if short.any() else np.empty(0, np.int64)
        arcs, steps = self.kept.sample(unit, seeds[row[short]], ordinal[short])
        flat, width = _spelt(vocab, self.kept.number[arcs], self.kept.char[arcs])
        per_unit = np.zeros(len(begin), np.int64)
        per_unit[short] = np.bincount(np.repeat(np.arange(len(unit)), steps), width, minlength=len(unit))
        if not short.all():
            cuts, parts, done = np.cumsum(per_unit), [], 0
            for k in np.flatnonzero(~short).tolist():
                one = Lattices(chars[begin[k] : begin[k] + size[k]], size[k : k + 1], vocab)
                arcs = one.sample_one(int(seeds[row[k]]), int(ordinal[k]))
                ids, _ = _spelt(vocab, one.number[arcs], one.char[arcs])
                parts += [flat[done : cuts[k]], ids]
                done = cuts[k]
                per_unit[k] = len(ids)
            flat = np.concatenate([*parts, flat[done:]])
        return flat, np.bincount(row, per_unit, minlength=len(texts)).astype(np.int64)


def _spelt(vocab: Vocabulary, number: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces by number, characters without a piece in bytes; and how many ids each has become."""
    width = np.ones(len(number), np.int64)
    spelt = np.flatnonzero(number == -2)
    ids = np.where(number >= 0, vocab.ids[np.maximum(number, 0)], 0).astype(np.int32)
    if not len(spelt):
        return ids, width
    code = char[spelt]
    width[spelt] = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    flat = np.repeat(ids, width)
    begin = (np.cumsum(width) - width)[spelt]
    table = np.array([vocab.byte_id[b] for b in range(256)], np.int32)
    for size, lead in ((1, 0x00), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        some = width[spelt] == size
        for k in range(size):
            bits = (code[some] >> np.uint32(6 * (size - 1 - k))) & np.uint32(0x3F if k else 0x7F >> (size - 1 if size > 1 else 0))
            flat[begin[some] + k] = table[bits + np.uint32(0x80 if k else lead)]
    return flat, width


def _in_parts(texts: list[str | None], seeds: np.ndarray, encoder: Encoder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``encode`` over runs of texts of about _PART characters, so memory follows the longest text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= _PART or i == len(texts) - 1:
            yield encoder.encode(texts[begin : i + 1], seeds[begin : i + 1])
            begin, held = i + 1, 0


def encode_pieces(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL, alpha: float = 1.0, seed: int = 0, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``pieces`` (ids of a sampled segmentation of the whole text) and n_pieces.

    A segmentation is drawn with the probability of its pieces among all segmentations: weights are
    summed forward over the lattice of pieces, then pieces are sampled from the end backward. The draws
    depend on (seed, id) alone, so reruns, batches and partitions give the same pieces. No piece spans
    the border between units (spaces and the word after them), so the lattice of a text is the chain of
    its units' lattices; each different unit is filtered once, and a task keeps the lattices of the units
    it has met within a bound. ``model`` is a path that executors can read; the file is not trained or
    copied. There is no shuffle.

    Null text: null pieces, n_pieces 0. Empty text: no pieces. Characters without a piece are spelt in
    bytes. Rows that repeat an id and text get the same pieces; a null id is an id of its own. Very long
    texts are encoded whole; a unit of any length too, cut first where no piece crosses, and what is left
    over 60 characters in time in proportion to its length. No rows: no rows. Clashing columns are replaced.
    Without ``keep_text`` the text column goes, and texts do not come back from the Python workers.
    """
    base = with_columns_free(docs, *ADDED, "_seed").withColumn("_seed", F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(id_col).isNull()))
    columns = [c for c in base.columns if c != "_seed" and (keep_text or c != text_col)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model, alpha))
        for batch in bounded_batches(batches):
            at = batch.schema.get_field_index
            texts = batch.column(at(text_col)).to_pylist()
            seeds = batch.column(at("_seed")).to_numpy(zero_copy_only=False).view(np.uint64)
            flat, sizes = (np.concatenate(x) for x in zip(*_in_parts(texts, seeds, encoder), strict=True))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            missing = np.array([t is None for t in texts] + [False])
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=missing), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in columns], lists, pa.array(sizes)], names=[*columns, *ADDED])

    schema = T.StructType([*[base.schema[c] for c in columns], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    return base.mapInArrow(encode, schema)


def decoded_texts(lists: pa.ListArray, raw: pa.BinaryArray) -> pa.Array:
    """The texts of lists of ids, without the space in front: pieces are taken all together and cut up again."""
    missing = lists.is_null()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    taken = raw.take(lists.flatten())
    if not len(taken):
        return pc.if_else(missing, pa.scalar(None, pa.string()), "")
    places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8)
    ends = places[np.concatenate(([0], np.cumsum(sizes)))]
    has = np.diff(ends) > 0
    ends[1:] -= np.cumsum(has).astype(np.int32)
    data = np.delete(data[: places[-1]], places[(np.cumsum(sizes) - sizes)[has]])
    whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    try:
        texts = whole.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
    return pc.if_else(missing, pa.scalar(None, pa.string()), texts)


def decode_pieces(frame: DataFrame, *, pieces_col: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``frame`` with the text of its pieces: what ``encode_pieces`` was given, character for character.

    Null pieces: null. Ids outside the vocabulary, and null ids in a list, fail; bytes that are no UTF-8
    become U+FFFD. No rows: no rows. A clashing column is replaced.
    """
    base = with_columns_free(frame, into)
    names = [*base.columns, into]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary(model, 1.0).raw
        for batch in bounded_batches(batches):
            lists = batch.column(batch.schema.get_field_index(pieces_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded_texts(lists, raw)], names=names)

    return base.mapInArrow(decode, T.StructType([*base.schema.fields, T.StructField(into, T.StringType())]))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    back = decode_pieces(encode_pieces(docs))
    return back.select(
        "doc_id",
        "n_pieces",
        F.size(F.array_distinct("pieces")).cast("long").alias("n_distinct"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )
