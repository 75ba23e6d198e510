"""Unigram segmentation over a fixed piece vocabulary, and decoding.

White space becomes a marker, a marker is put in front, and the text is cut into the pieces whose
log scores add up highest: Viterbi's algorithm over a double-array trie of the pieces' UTF-8
bytes. A character that no piece covers falls back to its bytes. As no piece holds a marker or a
line feed after another character, the best path passes every such place, so the text is cut
there first and each distinct chunk of a batch is segmented once, all of them in step: first
every piece that lies in a chunk is found, then the paths grow start by start.

The vocabulary file orders its pieces by merge rank and has no probabilities. Log scores are
derived from the rank by a Zipf-Mandelbrot law; they are never trained.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

MARK = "▁"
#: Shift of the rank law, and what an uncovered character costs below the worst piece.
SHIFT, FALLBACK_COST = 2.7, 10.0
CACHE_CHUNKS = 300_000
#: Chunks of up to LONG characters are segmented in step, about TOGETHER characters at a time; longer ones one by one.
LONG, TOGETHER = 96, 150_000
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class DoubleArray:
    """A trie in two arrays: from state s, byte b leads to base[s] + b + 1 if check of it is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][b]
            value[at] = v
        size = 4 * len(children) + 1024
        base, check, held = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], free, queue, place = 0, 1, deque([0]), {0: 0}
        while queue:
            node = queue.popleft()
            s = place[node]
            held[s] = value[node]
            own = sorted(children[node])
            if not own:
                continue
            codes = np.array(own) + 1
            while check[free] != -1:
                free += 1
            offset, tries = max(1, free - int(codes[0])), 0
            while (check[offset + codes] != -1).any():
                offset, tries = offset + 1, tries + 1
                if offset + 600 >= size:
                    base = np.concatenate([base, np.zeros(size, np.int32)])
                    check = np.concatenate([check, np.full(size, -1, np.int32)])
                    held = np.concatenate([held, np.full(size, -1, np.int32)])
                    size *= 2
            if tries > 20:  # the cells passed are nearly full: later searches start behind them
                free = max(free, offset + int(codes[0]))
            base[s] = offset
            check[offset + codes] = s
            for b in own:
                place[children[node][b]] = offset + b + 1
                queue.append(children[node][b])
        # a state without children points at 300 cells behind all others, which nothing checks
        last = np.flatnonzero(check != -1).max() + 1
        leaf = [place[k] for k, c in enumerate(children) if not c]
        base = np.concatenate([base[:last], np.zeros(600, np.int32)])
        base[leaf] = last
        self.base = base
        self.check = np.concatenate([check[:last], np.full(600, -1, np.int32)])
        self.value = np.concatenate([held[:last], np.full(600, -1, np.int32)])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; -1 where the trie has none."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)


class Pieces:
    """Pieces, their log scores and byte fallbacks, from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.text: list[bytes] = [b""] * n
        usable = {}
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.text[k] = k, bytes([b])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.text[k] = piece.encode()
                if "\n" in piece or MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {k} spans a chunk's end")
                usable[piece.encode()] = k
        ranks = {k: r for r, k in enumerate(sorted(usable.values()))}
        law = np.log(np.arange(len(ranks)) + SHIFT)
        norm = np.log(np.exp(-law).sum())
        self.score = np.zeros(n)
        for k, r in ranks.items():
            self.score[k] = -law[r] - norm
        self.fallback = float(self.score.min()) - FALLBACK_COST
        self.trie = DoubleArray(usable)
        self.usable = usable


def viterbi(chunks: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ids of all chunks, one after the other, where each chunk's ids end, and its score.

    Of equal scores the path found from the earliest start stays. A chunk takes a cell for each byte
    and one for its end; no piece leads beyond an end.
    """
    held = pa.array(chunks, pa.string())
    at = np.frombuffer(held.buffers()[1], np.int32, len(chunks) + 1)
    length = np.diff(at)
    last = at[1:] + np.arange(len(chunks))  # the cells of the chunks' ends
    first = last - length
    data = np.full(last[-1] + 1, 256, np.int32)
    inside = np.ones(len(data), bool)
    inside[last] = False
    data[inside] = np.frombuffer(held.buffers()[2], np.uint8, at[-1])
    # every piece that lies in a chunk, by start and end; what a character without a piece of its own falls back to
    trie, score = pieces.trie, pieces.score
    starts = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
    lead = data[starts]
    one = starts + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    alone = np.zeros(len(starts), bool)
    live, cell, state = np.arange(len(starts)), starts, np.zeros(len(starts), np.int32)
    found = []
    while len(live):
        state = trie.step(state, data[cell])
        ok = np.flatnonzero(state >= 0)
        live, cell, state = live[ok], cell[ok] + 1, state[ok]
        value = trie.value[state]
        hit = np.flatnonzero(value >= 0)
        own = live[hit]
        found.append((own, cell[hit], value[hit]))
        alone[own[one[own] == cell[hit]]] = True
    own = np.flatnonzero(~alone)
    found.append((own, one[own], np.full(len(own), -1, np.int32)))
    own, end, piece = (np.concatenate(x) for x in zip(*found))
    begin = starts[own]
    worth = np.where(piece >= 0, score[piece], pieces.fallback)
    # start by start in all chunks at once: from one start, no two pieces end at the same cell
    place = (np.arange(len(data)) - np.repeat(first, length + 1))[begin].astype(np.min_scalar_type(length.max()))
    order = np.argsort(place, kind="stable")
    begin, end, piece, worth = begin[order], end[order], piece[order], worth[order]
    best, back, taken = np.full(len(data), -np.inf), np.zeros(len(data), np.int64), np.full(len(data), -1, np.int32)
    best[first] = 0
    cuts = np.r_[0, np.cumsum(np.bincount(place))]
    for x, y in zip(cuts[:-1], cuts[1:]):
        s, e, value = begin[x:y], end[x:y], worth[x:y]
        value = best[s] + value
        better = np.flatnonzero(value > best[e])
        e = e[better]
        best[e], back[e], taken[e] = value[better], s[better], piece[x:y][better]
    # the cells where a token of the best path ends
    path = np.zeros(len(data), bool)
    now, floor = last[length > 0], first[length > 0]
    while len(now):
        path[now] = True
        now = back[now]
        more = np.flatnonzero(now > floor)
        now, floor = now[more], floor[more]
    cells = np.flatnonzero(path)
    ids, size = taken[cells], np.ones(len(cells), np.int64)
    bare = ids < 0
    size[bare] = (cells - back[cells])[bare]
    stops = np.r_[0, np.cumsum(size)]
    if bare.any():
        ids, spread = np.repeat(ids, size), np.repeat(bare, size)
        source = np.arange(len(ids)) + np.repeat(back[cells] - stops[:-1], size)
        ids[spread] = pieces.byte_ids[data[source[spread]]]
    return ids, stops[np.searchsorted(cells, last, side="right")], best[last]


def viterbi_long(chunk: bytes, pieces: Pieces) -> tuple[list[int], float]:
    """The same for one long chunk, in time and memory proportional to its length."""
    base, check, value, score = pieces.trie.base, pieces.trie.check, pieces.trie.value, pieces.score
    n = len(chunk)
    best, back, piece = np.full(n + 1, -np.inf).tolist(), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        if best[s] == -np.inf:
            continue
        b = chunk[s]
        one = s + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
        single, state = False, 0
        for e in range(s, n):
            to = int(base[state]) + chunk[e] + 1
            if check[to] != state:
                break
            state, found = to, int(value[to])
            if found >= 0:
                single = single or e + 1 == one
                got = best[s] + float(score[found])
                if got > best[e + 1]:
                    best[e + 1], back[e + 1], piece[e + 1] = got, s, found
        if not single and best[s] + pieces.fallback > best[one]:
            best[one], back[one], piece[one] = best[s] + pieces.fallback, s, -1
    at, ids = n, []
    while at:
        s = back[at]
        ids += [piece[at]] if piece[at] >= 0 else [int(pieces.byte_ids[b]) for b in reversed(chunk[s:at])]
        at = s
    return ids[::-1], best[n]


class PieceEncoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache: dict[str, tuple[bytes, float]] = {}
        mark = MARK.encode()
        self._mark_bytes = np.array([pieces.byte_ids[b] for b in mark], "<u4").tobytes()

    def _fill(self, chunks: list[str]) -> None:
        parts, size = [[]], 0
        for c in chunks:
            if len(c) > LONG:
                ids, value = viterbi_long(c.encode(), self.pieces)
                self.cache[c] = (np.array(ids, "<u4").tobytes(), value)
                continue
            if size > TOGETHER:
                parts.append([])
                size = 0
            parts[-1].append(c)
            size += len(c)
        for part in filter(None, parts):
            ids, ends, score = viterbi(part, self.pieces)
            data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            self.cache.update(zip(part, zip([data[x:y] for x, y in zip([0, *ends], ends)], score.tolist())))

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """Little-endian uint32 ids and log score of each text. A marker character in the text itself is written as bytes."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif MARK in t:
                parts = t.split(MARK)
                own = [CHUNK.findall((MARK if k == 0 else "") + p.replace(" ", MARK)) for k, p in enumerate(parts)]
                joined = own[0]
                for x in own[1:]:
                    joined = [*joined, "", *x]
                cut.append(joined)
            else:
                cut.append(CHUNK.findall(MARK + t.replace(" ", MARK)))
        self.cache[""] = (self._mark_bytes, self.pieces.fallback)
        present = set().union(*cut)
        missing = list(present - self.cache.keys())
        if len(self.cache) + len(missing) > CACHE_CHUNKS:  # what these texts use stays
            present.add("")
            self.cache = {c: self.cache[c] for c in present & self.cache.keys()}
        self._fill(missing)
        get, out = self.cache.__getitem__, []
        for chunks in cut:
            got = list(map(get, chunks))
            out.append((b"".join([x[0] for x in got]), sum([x[1] for x in got])))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces' markers become spaces, byte pieces their bytes, the marker in front goes."""
        if not ids:
            return ""
        spaced = self._spaced()
        data = b"".join([spaced[k] for k in np.frombuffer(ids, "<u4").tolist()])
        return data[1:].decode("utf-8", "replace")

    def _spaced(self) -> list[bytes]:
        if not hasattr(self, "_spaced_pieces"):
            mark, byte = MARK.encode(), set(self.pieces.byte_ids.tolist())
            self._spaced_pieces = [p if k in byte else p.replace(mark, b" ") for k, p in enumerate(self.pieces.text)]
        return self._spaced_pieces


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, n_byte_tokens, log_score, ids_crc32, round_trip[, ids].

    ``round_trip`` says that decoding the ids gives the text back. Null and empty texts have no
    tokens; a text of any length is encoded whole. Repeated rows get a row each; extra columns are
    ignored; an empty table gives none. ``model_path`` is a SentencePiece model file; it is read once,
    by the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def encode(batches):
        encoder = PieceEncoder(model.value)
        is_byte = np.zeros(len(encoder.pieces.text), bool)
        is_byte[encoder.pieces.byte_ids] = True
        for batch in batches:
            for own in slices(batch, "text", 500):
                texts = own.column("text").to_pylist()
                rows = []
                for t, (ids, score) in zip(texts, encoder.encode(texts)):
                    codes = np.frombuffer(ids, "<u4")
                    rows.append((len(codes), int(is_byte[codes].sum()), score, zlib.crc32(ids), encoder.decode(ids) == t, codes.astype(np.int32) if with_ids else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
                arrays = [own.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text"))
    names = ["id", "n_tokens", "n_byte_tokens", "log_score", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_byte_tokens long, log_score double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encode, kind).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text. Null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def decode(batches):
        encoder = PieceEncoder(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                own = batch.slice(k, 500)
                texts = [encoder.decode(np.array(x or [], "<u4").tobytes()) for x in own.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
