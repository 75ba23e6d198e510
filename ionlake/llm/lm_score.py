"""Code length of texts under context-tree weighting, beside a word unigram base.

The model reads lower-cased UTF-8 bytes, each decomposed into eight binary decisions. Every
decision has a context tree over the preceding bytes: a node of depth d keeps the zeros and ones
seen after d given bytes, estimates by Krichevsky-Trofimov, and is weighted half and half against
the product of its children; nodes of the full depth have no children. All contexts of the
training texts are nodes. A context that training never met predicts as the longest one that it met.

How it is spread: texts are taken in blocks of about BLOCK_BYTES. A block gives its distinct
(context, byte) pairs and their training counts, sorted with the nearest context byte first, so a
subtree is a run of rows. The runs are cut into units, sets of neighbouring subtrees below one
parent, whose borders come from a sample of positions. One task adds a unit's pairs up over all
blocks and weights its subtrees; what their parents need is one short row a unit, so the trunk above
the units is settled on the driver from sums alone. A second look at each unit mixes the trunk's
share in and gives every block the log probabilities of its own pairs, in its own order; the block
adds them up by text. Words go the same way, dealt by hash: a block asks for the counts of its
distinct words. Nothing holds more than a unit or a block, and all counts grow with the corpus.
"""

from __future__ import annotations

import io
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, shared_checkpoint, slices, text_or_empty

#: Seven bytes of context and the byte they precede are one 64-bit word; deeper rows sort slower and take more room.
DEPTH = 7
FOLDS, HELD_OUT = 5, 1
#: Text of a block; a longer text is a block alone.
BLOCK_BYTES = 8 << 20
#: Positions whose pairs are made at once, and about how many are sorted at once.
CHUNK, SORTED = 1 << 20, 9 << 20
#: Training text behind a unit; from MAX_UNITS units on they grow instead.
UNIT_BYTES, MAX_UNITS = 8 << 20, 1 << 14
#: Sampled positions a unit, for the borders of units alone; borders lie within BORDER bytes of context.
SAMPLED, BORDER = 400, 6
#: Positions that a text of the sample gives at least.
TOGETHER = 16
END_TOKEN = b" "  # holds white space, so no word is equal to it
LN2, LN_PI = np.log(2.0), np.log(np.pi)
BITS = 8
DECISIONS = 255


# Rows: a (context, byte) pair is the byte string c1 c2 ... cD b, nearest context byte first, held
# right-aligned in one or more 64-bit words, the most significant word first.


def pair_rows(data: np.ndarray, first: int, depth: int) -> list[np.ndarray]:
    """The pairs at ``data[first:]``; at least max(depth, 8) bytes lie before ``first``."""
    n = len(data) - first
    byte = data[first:].astype(np.uint64)
    # eight bytes before the position, read little-endian: the nearest is the most significant
    near = np.ndarray(n, "<u8", data, first - 8, (1,)).astype(np.uint64)
    eight = np.uint64(8)
    if depth <= 7:
        return [(near >> np.uint64(8 * (8 - depth)) << eight) | byte]
    if depth == 8:
        return [(near >> np.uint64(56)).astype(np.uint8), (near << eight) | byte]
    text = [data[first - j : len(data) - j] for j in range(1, depth + 1)] + [data[first:]]
    words = []
    for end in range(len(text), 0, -8):
        word = np.zeros(n, np.uint64)
        for own in text[max(0, end - 8) : end]:
            word = (word << eight) | own
        words.append(word)
    return words[::-1]


def _order(words: list[np.ndarray]) -> np.ndarray:
    if len(words) == 1:
        return np.argsort(words[0])
    if len(words) == 2 and words[0].dtype == np.uint8:
        head = words[0]
        order = np.argsort(head, kind="stable")
        ends = np.cumsum(np.bincount(head, minlength=256))
        low = words[1][order]
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            if b - a > 1:
                order[a:b] = order[a:b][np.argsort(low[a:b])]
        return order
    return np.lexsort(words[::-1])


def _sorted(words: list[np.ndarray]) -> list[np.ndarray]:
    if len(words) == 1:
        return [np.sort(words[0])]
    if len(words) == 2 and words[0].dtype == np.uint8:
        head = words[0]
        sizes = np.bincount(head, minlength=256)
        low, ends = words[1][np.argsort(head, kind="stable")], np.cumsum(sizes)
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            low[a:b].sort()
        return [np.repeat(np.arange(256, dtype=np.uint8), sizes), low]
    order = np.lexsort(words[::-1])
    return [w[order] for w in words]


def _changes(words: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(words[0]), bool)
    new[1:] = words[-1][1:] != words[-1][:-1]
    for w in words[:-1]:
        new[1:] |= w[1:] != w[:-1]
    return new


def distinct(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted, and how often each occurs."""
    words = _sorted(words)
    at = np.flatnonzero(_changes(words))
    return [w[at] for w in words], np.diff(np.r_[at, len(words[0])])


def merged(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of several parts added up: (distinct rows, sums, the place of each input row)."""
    words = [np.concatenate(w) for w in zip(*(p[0] for p in parts))]
    n = np.concatenate([p[1] for p in parts])
    order = _order(words)
    words = [w[order] for w in words]
    new = _changes(words)
    at = np.flatnonzero(new)
    place = np.empty(len(n), np.int64)
    place[order] = np.cumsum(new) - 1
    return [w[at] for w in words], np.add.reduceat(n[order], at) if len(at) else n, place


def _by_first_byte(parts: list[tuple[list[np.ndarray], np.ndarray]], depth: int):
    """``merged`` for parts that are sorted, one nearest context byte after the other, so that little is held twice.

    Yields (rows, sums, place of each of the byte's input rows, [(start, end) of those in each part]).
    """
    cuts = [np.searchsorted(_byte(words, depth, 0), np.arange(257)) for words, _ in parts]
    for b in range(256):
        own = [(int(c[b]), int(c[b + 1])) for c in cuts]
        if any(y > x for x, y in own):
            yield (*merged([([w[x:y] for w in words], n[x:y]) for (words, n), (x, y) in zip(parts, own)]), own)


def _without_farthest(words: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """c1 ... c(d-1) b from c1 ... cd b."""
    words = [w.astype(np.uint64, copy=False) for w in words]
    last = (words[-1] >> np.uint64(16) << np.uint64(8)) | (words[-1] & np.uint64(255))
    out = [last]
    for k in range(len(words) - 2, -1, -1):
        out[0] = out[0] | ((words[k] & np.uint64(255)) << np.uint64(56))
        out.insert(0, words[k] >> np.uint64(8))
    return out[1:] if depth % 8 == 0 and len(out) > 1 else out


def _byte(words: list[np.ndarray], depth: int, j: int) -> np.ndarray:
    """Byte j of each row's string."""
    from_end = depth - j
    return (words[len(words) - 1 - from_end // 8] >> np.uint64(8 * (from_end % 8))).astype(np.uint8)


def border_number(words: list[np.ndarray], depth: int, width: int) -> np.ndarray:
    """The first ``width`` bytes of each row as a number."""
    out = np.zeros(len(words[0]), np.int64)
    for j in range(width):
        out = (out << 8) | _byte(words, depth, j)
    return out


# Weights.


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series at x + 7."""
    z = x + 7.0
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    return series - np.log(shift)


_SMALL = np.arange(1 << 15, dtype=np.float64)
_HALF, _WHOLE = _log_gamma(_SMALL + 0.5) - LN_PI / 2, _log_gamma(_SMALL + 1.0)


def _from(table: np.ndarray, n: np.ndarray, add: float, less: float) -> np.ndarray:
    if not len(n) or n.max() < len(table):
        return table[n]
    large = n >= len(table)
    out = table[np.where(large, 0, n)]
    out[large] = _log_gamma(n[large] + add) - less
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _from(_HALF, zeros, 0.5, LN_PI / 2) + _from(_HALF, ones, 0.5, LN_PI / 2) - _from(_WHOLE, zeros + ones, 1.0, 0.0)


def weighted(kt: np.ndarray, below: np.ndarray, total: np.ndarray) -> np.ndarray:
    high = np.maximum(kt, below)
    return np.where(total > 0, high + np.log(1.0 + np.exp(np.minimum(kt, below) - high)) - LN2, 0.0)


def visit(state, total: np.ndarray, ones: np.ndarray, stop: np.ndarray | float):
    """(mixed, left, last) after a node on the way down.

    ``mixed``: probability of a one gathered so far; ``left``: weight not yet spent; ``last``: the
    estimate of the deepest node met, which what is left goes to where the way ends.
    """
    mixed, left, last = state
    seen = total > 0
    own = (ones + 0.5) / (total + 1.0)
    share = np.where(seen, left * stop, 0.0)
    return mixed + share * own, left - share, np.where(seen, own, last)


class Level:
    """Rows of one depth: their bytes, where contexts begin, counts, and the place of each in the level above."""

    def __init__(self, words: list[np.ndarray], n: np.ndarray):
        self.byte, self.n, self.up = (words[-1] & np.uint64(255)).astype(np.uint8), n, None
        self.fresh = _changes([*words[:-1], words[-1] >> np.uint64(8)])

    def decisions(self, bit: int):
        """Nodes of a binary decision: (their first rows, node of each row, totals, ones)."""
        first = self.fresh
        if bit:
            prefix = self.byte >> np.uint8(BITS - bit)
            first = first.copy()
            first[1:] |= prefix[1:] != prefix[:-1]
        starts = np.flatnonzero(first)
        is_one = (self.byte >> np.uint8(BITS - 1 - bit)) & np.uint8(1)
        return starts, np.cumsum(first) - 1, np.add.reduceat(self.n, starts), np.add.reduceat(self.n * is_one, starts)


def levels_of(words: list[np.ndarray], n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels from ``depth`` up to ``top``."""
    out = [Level(words, n)]
    for d in range(depth, top, -1):
        words, n, out[-1].up = merged([(_without_farthest(words, d), n)])
        out.append(Level(words, n))
    return out


def _weights(levels: list[Level], bit: int):
    """Bottom-up: for each level (starts, node of each row, totals, ones, kt, weighted, node in the level above of each node)."""
    out, below, up = [], None, None
    for k, level in enumerate(levels):
        starts, node, total, ones = level.decisions(bit)
        kt = log_kt(total - ones, ones)
        if k:
            up = node[levels[k - 1].up[out[-1][0]]]
            out[-1][6] = up
            below = np.bincount(up, out[-1][5], len(starts))
        out.append([starts, node, total, ones, kt, weighted(kt, below, total) if k else kt, None])
    return out


def subtree_sums(levels: list[Level]) -> np.ndarray:
    """(3, DECISIONS): zeros and ones seen, and the sum of ln weighted probabilities, over the top nodes."""
    out = np.zeros((3, DECISIONS))
    for bit in range(BITS):
        starts, _, total, ones, _, pw, _ = _weights(levels, bit)[-1]
        decision = (1 << bit) - 1 + (levels[-1].byte[starts].astype(np.int64) >> (BITS - bit))
        for k, values in enumerate((total - ones, ones, pw)):
            out[k] += np.bincount(decision, values, DECISIONS)
    return out


def log_probabilities(levels: list[Level], state: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) of the deepest level's rows; ``state`` (3, DECISIONS) is that of the parent."""
    out = np.ones(len(levels[0].n))
    for bit in range(BITS):
        own = _weights(levels, bit)
        decision = (1 << bit) - 1 + (levels[-1].byte[own[-1][0]].astype(np.int64) >> (BITS - bit))
        now = tuple(state[:, decision])
        for k in range(len(own) - 1, -1, -1):
            starts, node, total, ones, kt, pw, up = own[k]
            if k < len(own) - 1:
                now = tuple(x[up] for x in now)
            now = visit(now, total, ones, np.exp(np.minimum(0.0, kt - LN2 - pw)) if k else 1.0)
        one = (now[0] + now[1] * now[2])[node]
        is_one = ((levels[0].byte >> np.uint8(BITS - 1 - bit)) & np.uint8(1)).astype(bool)
        out *= np.where(is_one, one, 1.0 - one)
    return np.log10(out)


# Units and the trunk above them.


class Units:
    """Sets of neighbouring subtrees: (parent's bytes, first child byte), in the rows' order."""

    def __init__(self, own: list[tuple[bytes, int]], width: int):
        self.own, self.width = own, width
        self.starts = np.array([int.from_bytes((p + bytes([b])).ljust(width, b"\0"), "big") for p, b in own], np.int64)

    @staticmethod
    def plan(rows: np.ndarray, wanted: int, width: int) -> Units:
        """About ``wanted`` units from the border numbers of sampled positions."""
        rows, own = np.sort(rows), []
        most = max(1.0, len(rows) / max(1, wanted))

        def split(prefix: bytes, part: np.ndarray):
            at = np.searchsorted(part >> (8 * (width - len(prefix) - 1)) & 255, np.arange(257))
            held = most + 1
            for b in range(256):
                n = at[b + 1] - at[b]
                if n > most and len(prefix) + 1 < width:
                    split(prefix + bytes([b]), part[at[b] : at[b + 1]])
                    held = most + 1
                elif held + n > most:
                    own.append((prefix, b))
                    held = n
                else:
                    held += n

        split(b"", rows)
        return Units(own, width)

    def cut(self, words: list[np.ndarray], depth: int) -> np.ndarray:
        """Where each unit's rows begin among sorted rows, and the end."""
        return np.r_[np.searchsorted(border_number(words, depth, self.width), self.starts), len(words[0])]


def trunk(units: Units, sums: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The state (3, DECISIONS) above every unit that has rows."""
    inner = {p[:k] for p, _ in units.own for k in range(len(p) + 1)}
    total = {p: np.zeros((3, DECISIONS)) for p in inner}
    for k, own in sums.items():
        total[units.own[k][0]] += own
    kt, pw = {}, {}
    for p in sorted(inner, key=len, reverse=True):
        zeros, ones, below = total[p]
        kt[p] = log_kt(zeros.astype(np.int64), ones.astype(np.int64))
        pw[p] = weighted(kt[p], below, zeros + ones)
        if p:
            total[p[:-1]] += np.stack([zeros, ones, pw[p]])
    state = {}
    for p in sorted(inner, key=len):
        before = state[p[:-1]] if p else (np.zeros(DECISIONS), np.ones(DECISIONS), np.full(DECISIONS, 0.5))
        state[p] = visit(before, total[p][0] + total[p][1], total[p][1], np.exp(np.minimum(0.0, kt[p] - LN2 - pw[p])))
    return {k: np.stack(state[units.own[k][0]]) for k in sums}


# Blobs.


def pack_numbers(values: np.ndarray) -> bytes:
    """A column of numbers by byte planes, compressed."""
    raw = values.view(f"<u{values.itemsize}")
    planes = [(raw >> raw.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(values.itemsize)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    planes, out = raw.reshape(size, -1), np.zeros(len(raw) // size, f"<u{size}")
    for k in range(size):
        out |= planes[k].astype(out.dtype) << out.dtype.type(8 * k)
    return out.view(kind)


def pack_pairs(words: list[np.ndarray], n: np.ndarray, depth: int) -> bytes:
    """Sorted rows as what differs from the row before: the first byte that does, and the bytes from there on."""
    bytes_of = [_byte(words, depth, j) for j in range(depth + 1)]
    first = np.zeros(len(n), np.uint8)
    for j in range(depth, -1, -1):
        first[1:][bytes_of[j][1:] != bytes_of[j][:-1]] = j
    large = n >= 255
    parts = [np.array([len(n)], "<u8"), first, np.where(large, 255, n).astype(np.uint8), n[large].astype("<u8"), *(own[first <= j] for j, own in enumerate(bytes_of))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def unpack_pairs(data: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    rows = int.from_bytes(raw[:8].tobytes(), "little")
    first, n = raw[8 : 8 + rows], raw[8 + rows : 8 + 2 * rows].astype(np.int64)
    large, at = n == 255, 8 + 2 * rows
    n[large] = raw[at : at + 8 * large.sum()].view("<u8")
    at += 8 * int(large.sum())
    words = [np.zeros(rows, np.uint64) for _ in range(-(-(depth + 1) // 8))]
    if depth == 8:
        words[0] = words[0].astype(np.uint8)
    for j in range(depth + 1):
        fresh = first <= j
        fresh[0] = True
        place = np.cumsum(fresh) - 1
        held = int(place[-1]) + 1
        own, at = raw[at : at + held][place], at + held
        from_end = depth - j
        k = len(words) - 1 - from_end // 8
        words[k] |= own.astype(words[k].dtype) << words[k].dtype.type(8 * (from_end % 8))
    return words, n


def _rounded(values: np.ndarray) -> np.ndarray:
    """As 32-bit numbers of 15 significant bits, which compress well: a relative error of at most 1 in 32,000."""
    bits = values.astype(np.float32).view(np.uint32)
    return (bits + np.uint32(1 << 8)) >> np.uint32(9) << np.uint32(9)


# Tasks.


def _blocks(batches):
    """(block, ids, held out, lower-cased texts) of about BLOCK_BYTES; the same for the same rows."""
    block, ids, held, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0
    for part in (x for batch in batches for x in slices(batch, "text", 500)):
        kind = part.schema.field("id").type
        for i, h, t in zip(*(part.column(c).to_pylist() for c in ("id", "held_out", "text"))):
            if texts and size + len(t) > BLOCK_BYTES:
                yield block, pa.array(ids, kind), held, texts
                block, ids, held, texts, size = block + 1, [], [], [], 0
            ids.append(i)
            held.append(h)
            texts.append(t.lower())
            size += len(t) + 1
    if texts:
        yield block, pa.array(ids, kind), held, texts


def _chunks(texts: list[bytes], depth: int):
    """(document of each position, pairs) for about CHUNK positions of whole texts or parts of one at a time."""
    before = max(depth, 8)
    pad, parts, sizes, docs, total = b"\0" * before, [], [], [], 0

    def made():
        data = np.frombuffer(b"".join(parts), np.uint8)
        words = pair_rows(data, before, depth)
        own = np.repeat(np.array(docs, np.int32), sizes)[before:]
        keep = np.ones(len(data), bool)
        starts = np.cumsum(sizes) - sizes
        keep[(starts[:, None] + np.arange(before)).ravel()] = False
        keep = keep[before:]
        return own[keep], [w[keep] for w in words]

    for k, t in enumerate(texts):
        data = pad + t + b"\0"
        for at in range(before, len(data), CHUNK):
            parts.append(data[at - before : at + CHUNK])
            sizes.append(len(parts[-1]))
            docs.append(k)
            total += sizes[-1]
            if total >= CHUNK:
                yield made()
                parts, sizes, docs, total = [], [], [], 0
    if parts:
        yield made()


def _runs(texts: list[bytes], depth: int):
    """Distinct pairs and how often each occurs, of about SORTED positions at a time."""
    held, size = [], 0
    for _, words in _chunks(texts, depth):
        held.append(words)
        size += len(words[0])
        if size >= SORTED:
            yield distinct(_joined(held))
            held, size = [], 0
    if held:
        yield distinct(_joined(held))


def _joined(parts: list) -> list[np.ndarray]:
    """Each word of all parts, one part after the other; empties ``parts``."""
    columns = list(zip(*parts))
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _block_pairs(texts: list[bytes], held: list[bool], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The block's distinct pairs, sorted, with their training counts."""
    learned, asked = ([(words, n.astype(np.int32)) for words, n in _runs([t for t, h in zip(texts, held) if h == out], depth)] for out in (False, True))
    if len(learned) == len(asked) == 1 and depth <= 7:  # what only the held-out texts ask goes between, with no counts
        ((rows,), n), ((other,), _) = learned.pop(), asked.pop()
        place = np.searchsorted(rows, other)
        fresh = np.flatnonzero(rows[np.minimum(place, len(rows) - 1)] != other)
        return [np.insert(rows, place[fresh], other[fresh])], np.insert(n, place[fresh], 0)
    found = learned + [(words, np.zeros_like(n)) for words, n in asked]
    del learned, asked
    if len(found) == 1:
        return found[0]
    made = [(words, n) for words, n, _, _ in _by_first_byte(found, depth)]
    found.clear()
    n = np.concatenate([n for _, n in made])
    return _joined([made.pop(0)[0] for _ in range(len(made))]), n


def _word_group(word: bytes, groups: int) -> int:
    return zlib.crc32(word) % groups


def _numbered_words(texts: list[bytes]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """The distinct words in the order they come, the end first, and the numbers of each text's words."""
    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    index[END_TOKEN]
    number = index.__getitem__
    found = []
    for t in texts:
        words = t.split()
        found.append(np.fromiter(map(number, words), np.int32, len(words)))
    return index, found


def _word_groups(words, groups: int) -> dict[int, np.ndarray]:
    """The places of the words of each group, groups and places ascending."""
    group = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(groups)
    order = np.argsort(group, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(group))]
    return {g: order[a:b] for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a}


def _block_words(texts: list[bytes], held: list[bool], groups: int):
    """The block's distinct words by group, with their training counts: (group, words, counts)."""
    index, found = _numbered_words(texts)
    own = [x for x, h in zip(found, held) if not h]
    counts = np.bincount(np.concatenate([np.zeros(len(own), np.int32), *own]), minlength=len(index))
    words = list(index)
    for g, places in _word_groups(words, groups).items():
        yield g, list(map(words.__getitem__, places.tolist())), counts[places]


def _ask(units: Units, groups: int, depth: int):
    """Rows (unit, block, data): a block's pairs by unit, and its words by group as units below zero."""

    def ask(batches):
        for block, _, held, texts in _blocks(batches):
            words, n = _block_pairs(texts, held, depth)
            cut = units.cut(words, depth)
            rows = [(k, pack_pairs([w[a:b] for w in words], n[a:b], depth)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            for g, own, counts in _block_words(texts, held, groups):
                data = np.r_[len(own), counts].astype("<u8").tobytes() + b"\n".join(own)
                rows.append((-1 - g, zstandard.ZstdCompressor(level=1).compress(data)))
            for k in range(0, len(rows), 64):
                unit, data = zip(*rows[k : k + 64])
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array([block] * len(unit), pa.int64()), pa.array(data, pa.binary())], names=["unit", "block", "data"])

    return ask


def _asked_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 * n + 8 :].split(b"\n"), np.frombuffer(raw, "<u8", n, 8).astype(np.int64)


def _groups(batches, columns: list[str]):
    """Runs of rows with the same first column: (its value, lists of the others)."""
    name, held = None, []
    for batch in batches:
        for own, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if own != name:
                if held:
                    yield name, list(zip(*held))
                name, held = own, []
            held.append(row)
    if held:
        yield name, list(zip(*held))


def _unit_rows(data: list[bytes], depth: int):
    parts = [unpack_pairs(d, depth) for d in data]
    return (*merged(parts), [len(p[1]) for p in parts])


def _counted_words(data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The counts of the distinct words of all blocks, and the places of each block's words among them."""
    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    counts, asked = np.zeros(0, np.int64), []
    for d in data:
        names, n = _asked_words(d)
        places = np.fromiter(map(index.__getitem__, names), np.int64, len(names))
        if len(index) > len(counts):
            counts = np.r_[counts, np.zeros(max(len(index), 2 * len(counts)) - len(counts), np.int64)]
        counts[places] += n  # a block's words are distinct
        asked.append(places)
    return counts[: len(index)], asked


def _sum_up(units: Units, depth: int):
    """One row a unit: what the trunk needs of it; of words, tokens and distinct words of the training texts."""

    def sum_up(batches):
        for unit, (data,) in _groups(batches, ["unit", "data"]):
            if unit < 0:
                n, _ = _counted_words(data)
                tokens, known, out = int(n.sum()), int((n > 0).sum()), b""
            else:
                words, n, _, _ = _unit_rows(data, depth)
                out = pack_numbers(subtree_sums(levels_of(words, n, depth, len(units.own[unit][0]) + 1)).T.ravel())
                tokens = known = 0
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([tokens]), pa.array([known]), pa.array([out], pa.binary())], names=["unit", "tokens", "known", "sums"])

    return sum_up


def _answer(units: Units, depth: int):
    """Rows (block, unit, data) that answer what the blocks asked, from rows sorted by unit."""

    def answer(batches):
        for unit, (block, data, state) in _groups(batches, ["unit", "block", "data", "state"]):
            if unit < 0:
                counts, asked = _counted_words(data)
                out = [pack_numbers(counts[own]) for own in asked]
            else:
                above = np.frombuffer(state[0], np.float64).reshape(DECISIONS, 3).T
                words, n, place, sizes = _unit_rows(data, depth)
                value = _rounded(log_probabilities(levels_of(words, n, depth, len(units.own[unit][0]) + 1), above))[place]
                ends = np.cumsum(sizes)
                out = [pack_numbers(value[a:b]) for a, b in zip(ends - sizes, ends)]
            for k in range(0, len(out), 64):
                m = len(out[k : k + 64])
                yield pa.RecordBatch.from_arrays([pa.array(block[k : k + m], pa.int64()), pa.array([unit] * m, pa.int32()), pa.array(out[k : k + m], pa.binary())], names=["block", "unit", "data"])

    return answer


#: The unit number of a block's own texts: they come before the answers.
TEXTS = -(1 << 31)


def _text_rows(batches):
    """A block's texts, compressed."""
    for block, ids, held, texts in _blocks(batches):
        rows = pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(texts, pa.binary())], names=["id", "held_out", "text"])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([TEXTS], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["block", "unit", "data"])


def _add_up(units: Units, groups: int, depth: int, tokens: int, distinct_words: int):
    """A row for each text, from rows sorted by block: its texts, then the answers."""

    def add_up(batches):
        total = np.log10(tokens + 0.5 * (distinct_words + 1))
        for block, (unit, data) in _groups(batches, ["block", "unit", "data"]):
            rows = pa.ipc.open_stream(data[0]).read_all().combine_chunks()
            held, texts = rows.column("held_out").to_pylist(), rows.column("text").to_pylist()
            answers = dict(zip(unit[1:], data[1:]))
            value = np.concatenate([unpack_numbers(answers[k], np.float32) for k in sorted(answers) if k >= 0])
            score = _scores(texts, depth, value)
            index, words = _numbered_words(texts)
            count, end = np.zeros(len(index), np.int64), index[END_TOKEN]
            for g, places in _word_groups(index, groups).items():
                count[places] = unpack_numbers(answers[-1 - g], np.int64)
            worth, found = np.log10(count + 0.5) - total, count > 0
            lengths, known, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for k, ids in enumerate(words):
                lengths[k], known[k], base[k] = len(ids), found[ids].sum() + found[end], worth[ids].sum() + worth[end]
            yield from pa.Table.from_arrays(
                [rows.column("id"), rows.column("held_out"), pa.array(lengths + 1), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            ).to_batches(max_chunksize=10_000)

    return add_up


def _scores(texts: list[bytes], depth: int, value: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's pairs; ``value`` follows the sorted distinct pairs of all."""
    found, spread = [], []
    kind = np.uint16 if len(texts) < 1 << 16 else np.uint32
    for doc, words in _chunks(texts, depth):
        order = _order(words)
        words = [w[order] for w in words]
        at = np.flatnonzero(_changes(words))
        found.append(([w[at] for w in words], np.zeros(len(at), np.int8)))
        spread.append((doc.astype(kind)[order], np.diff(np.r_[at, len(order)]).astype(np.int32), np.empty(len(at), np.float32)))
    total = 0
    for words, n, place, spans in _by_first_byte(found, depth):
        if total + len(n) > len(value):
            break
        own, done = value[total : total + len(n)][place], 0
        for (_, _, worth), (x, y) in zip(spread, spans):
            worth[x:y] = own[done : done + y - x]
            done += y - x
        total += len(n)
    else:
        if total == len(value):
            score = np.zeros(len(texts))
            for doc, times, worth in spread:
                score += np.bincount(doc, np.repeat(worth.astype(np.float64), times), len(texts))
            return score
    raise RuntimeError("the documents came in another order when read again; checkpoint them first")


def _sample_borders(depth: int, width: int):
    """The borders at ``times`` random positions of each text, whatever its length."""

    def sample(batches):
        for batch in batches:
            for text, times, salt in zip(batch.column("text"), batch.column("times").to_pylist(), batch.column("salt").to_pylist(), strict=True):
                t, at = text.as_py().lower(), 0
                places = np.sort(np.random.default_rng(salt).integers(0, len(t) + 1, times))
                for _, words in _chunks([t], depth):
                    n = len(words[0])
                    own = places[np.searchsorted(places, at) : np.searchsorted(places, at + n)] - at
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(border_number([w[own] for w in words], depth, width))], names=["border"])
                    at += n

    return sample


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, folds: int = FOLDS, held_fold: int = HELD_OUT, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held_fold``; scores all.
    A-Z are lower-cased. ``score`` is log10 of the probability of the bytes and an end mark under
    trees of ``depth`` bytes of context, any number from 1; ``base_score`` is that of the add-half
    word unigram. Null text is empty: an end alone. With no training rows every token is unknown and
    all bytes are equally likely. A text of any length is scored whole; rows that repeat each other
    are scored each; extra columns are ignored; an empty table gives an empty result. ``docs`` is read
    twice and has to give its rows in the same order both times, as files do; it is an error if not.
    """
    if depth < 1:
        raise ValueError("depth must be positive")
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    size, count, held = rows.agg(F.sum(F.octet_length("text") + F.lit(1)).cast("long"), F.count(F.lit(1)), F.sum(F.col("held_out").cast("long"))).first()
    wanted = int(min(MAX_UNITS, max(1, -(-(size or 0) // unit_bytes))))
    width = min(BORDER, depth)
    # the sample settles borders of units only: the result is the same for any borders. A text gives its share of
    # SAMPLED positions a unit, and rows that repeat each other are drawn apart
    rate = min(1.0, SAMPLED * wanted / max(1, size or 0))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30)))
    drawn = F.floor(rate * (F.octet_length("text") + 1) / TOGETHER + F.col("salt") / F.lit(float(1 << 30)))
    sample = salted.withColumn("times", drawn.cast("int") * TOGETHER).where("times > 0").select("text", "times", "salt")
    borders = sample.mapInArrow(_sample_borders(depth, width), "border long").toArrow().column("border").to_numpy() if wanted > 1 else np.zeros(0, np.int64)
    units = Units.plan(borders, wanted, width)
    groups = max(1, wanted // 4)
    parts = min(len(units.own) + groups, 20_000)

    asked = rows.mapInArrow(_ask(units, groups, depth), "unit int, block long, data binary")
    pairs = shared_checkpoint(asked.withColumn("part", F.pmod("unit", F.lit(parts)).cast("int")).repartitionById(parts, "part").sortWithinPartitions("unit", "block").drop("part"))
    got = pairs.mapInArrow(_sum_up(units, depth), "unit int, tokens long, known long, sums binary").collect()  # one short row a unit
    tokens, known = sum(r["tokens"] for r in got), sum(r["known"] for r in got)
    sums = {r["unit"]: unpack_numbers(bytes(r["sums"]), np.float64).reshape(DECISIONS, 3).T for r in got if r["unit"] >= 0}
    states = trunk(units, sums)
    # at most MAX_UNITS rows of 6 KB
    state = F.broadcast(spark.createDataFrame([(k, bytearray(s.T.tobytes())) for k, s in states.items()], "unit int, state binary"))
    answers = pairs.join(state, "unit", "left").select("unit", "block", "data", "state").mapInArrow(_answer(units, depth), "block long, unit int, data binary")
    texts = rows.mapInArrow(_text_rows, "block long, unit int, data binary")
    spread = max(parts, 2 * rows.rdd.getNumPartitions())
    together = texts.unionByName(answers).repartition(spread, "block").sortWithinPartitions("block", "unit")
    kind = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = together.mapInArrow(_add_up(units, groups, depth, tokens, known), kind)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
