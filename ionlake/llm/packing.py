"""Best-fit packing of tokenised documents, certified by lower bounds.

Pieces are dealt to groups of bounded size by hash. Each group packs its pieces best-fit
decreasing and computes a lower bound on its bin count from dual feasible functions. Full bins
are final. A group whose count meets its bound is certified: no packing of its pieces is better,
so all its bins are final but the emptiest, which another group's pieces may yet fill. While the
total is above the bound of all pieces together, the pieces of the other bins with gaps are
exchanged: pooled, dealt anew to fewer groups and packed again. Every step moves rows of a few
numbers, never text.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, slices, text_or_empty, worker_state

CAPACITY = 4096
SEPARATOR = 1
#: Pieces a group packs at once (about 60 bytes each).
GROUP_PIECES = 200_000
#: Rounds of exchange at most; the result states the count that was reached beside the bound.
MAX_ROUNDS = 6
#: Entries of a worker's cache from white-space chunks to ids; the older half goes when full.
CACHE_CHUNKS = 1_200_000
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ž]+)([.,;:!?|*$%&#()]*)")


class ChunkEncoder:
    """Token ids (little-endian uint32 bytes) of whole texts by a cache of blank-separated chunks.

    A text is cut at the vocabulary's special tokens first, as they stand in it, and each is its own
    id. Right for tokenizers that lower-case, drop white space, and pre-tokenise letters and other
    symbols apart, never across a blank or a line feed, such as ``word_bpe_49k.json``. A chunk of
    letters and a plain tail is the ids of the letters and those of the tail; new letter words are
    encoded many at a time as one text, all others each by itself.
    """

    def __init__(self, vocabulary: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = {t.content: np.uint32(k).tobytes() for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if special else None
        # special tokens are cut out before; what looks like one after lower-casing is plain text
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {"": b""}
        self.most = cache_chunks

    def _one(self, chunks: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, got)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of composed Latin letters, each of which is one pre-token."""
        out = {}
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(part)), side="right").tolist()
            data, at = ids.tobytes(), 0
            for w, end in zip(part, ends):
                out[w] = data[4 * at : 4 * end]
                at = end
        return out

    def _fill(self, chunks: list[str]) -> None:
        cache, plain, other = self.cache, [], []
        for c in chunks:
            m = PLAIN.fullmatch(c)
            if m and m[1].lower().isalpha():
                plain.append((c, m[1].lower(), m[2]))
            else:
                other.append(c)
        cache.update(self._words(list({w for _, w, _ in plain}.difference(cache))))
        cache.update(self._one(list({t for _, _, t in plain}.difference(cache))))
        cache.update([(c, cache[w] + cache[t]) for c, w, t in plain])
        for k in range(0, len(other), 5000):
            cache.update(self._one(other[k : k + 5000]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self._encode(texts)
        parts = [self.cut.split(t) for t in texts]  # plain, special, plain, ...
        plain = iter(self._encode([x for own in parts for x in own[::2]]))
        return [b"".join(self.special[x] if k % 2 else next(plain) for k, x in enumerate(own)) for own in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        # A-Z alone are lowered here; the tokenizer lowers the rest its own way
        split = [t.encode().lower().decode().replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > self.most:  # the newer half stays
            items = list(self.cache.items())
            self.cache = dict(items[len(items) // 2 :])
            self.cache[""] = b""
        self._fill(list(set().union(*split).difference(self.cache)))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str, cache_chunks: int) -> DataFrame:
    """Pieces of each document: its ids, then the separator, cut every ``capacity`` tokens.

    ``row`` numbers the input rows, so that rows that repeat each other can be told apart.
    """

    def cut(batches):
        row = TaskContext.get().partitionId() << 33
        encoder = worker_state(f"{cache_chunks} chunks of {vocabulary}", lambda: ChunkEncoder(vocabulary, cache_chunks))  # tasks share its cache
        for batch in batches:
            for part in slices(batch, "text", 500):
                ids, rows = part.column("id").to_pylist(), []
                for doc, data in zip(ids, encoder.encode(part.column("text").to_pylist())):
                    data += SEPARATOR.to_bytes(4, "little")
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), row))
                    row += 1
                names = ["id", "piece", "start", "length", "crc", "row"]
                kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long, row long")


def bin_lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``counts[n]`` pieces of each length n.

    The best of two families of dual feasible functions. For a threshold t up to half the
    capacity, a length above capacity - t counts as a whole bin, one below t as nothing and the
    rest as its share (t = 0 is the volume bound). For k from 1 to 10, a length counts as its
    whole number of (k+1)-ths of a bin, in k-ths. The sum of the images bounds the bins.
    """
    if not counts.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    volume = np.concatenate([[0], np.cumsum(counts * size)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 11):
        scaled = size * (k + 1)
        image = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((counts * image).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # gaps that some bin has, sorted
    used = 0
    for k in order.tolist():
        need = int(lengths[k])
        at = bisect_left(gaps, need)
        if at < len(gaps):
            gap = gaps[at]
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                del gaps[at]
        else:
            gap, own, used = capacity, used, used + 1
        bins[k], offsets[k] = own, capacity - gap
        left = gap - need
        if left:
            if not by_gap[left]:
                insort(gaps, left)
            by_gap[left].append(own)
    return bins, offsets, used


def _pack_group(capacity: int, round_no: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lengths, rows, piece = (table.column(c).to_numpy() for c in ("length", "row", "piece"))
        order = np.lexsort((piece, rows, -lengths))
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        final = fill == capacity
        if used == bin_lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
            # certified, no packing of these pieces has fewer bins: only the emptiest takes part again
            final[np.arange(used) != fill.argmin()] = True
        number = (round_no << 56) + (key[0].as_py() << 24) + bins
        return table.drop_columns("g").append_column("bin", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("final", pa.array(final[bins]))

    return pack


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, cache_chunks: int = CACHE_CHUNKS, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, sequences, lower_bound.

    ``sequences`` is their number in all and ``lower_bound`` a number that no packing can go below;
    the exchange ends when they meet, when one group holds all open pieces, or after ``max_rounds``.
    Null and empty texts are a separator alone. Only a document of more than ``capacity`` tokens is
    cut, however long. Rows that repeat each other are packed each by itself; extra columns are
    ignored and an empty table gives an empty result. ``vocabulary`` is the tokenizer's file, which
    every machine must have; a worker's cache holds ``cache_chunks`` entries of about 200 bytes and
    trades memory for time alone.
    """
    pieces = shared_checkpoint(tokenized_pieces(docs, vocabulary, capacity, id_col, text_col, cache_chunks))
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_length.items():
        counts[length] = n
    bound = bin_lower_bound(counts, capacity)
    full = pieces.where(F.col("length") == capacity)
    kind = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", bin long, offset long, final boolean"
    part = pieces.where(F.col("length") < capacity)
    count = sum(n for length, n in by_length.items() if length < capacity)
    total = settled = by_length.get(capacity, 0)
    done, rounds = [], 0
    while count:
        groups = -(-count // group_pieces)
        # by row, so copies of a row spread; the round takes part, so every round brings other documents together
        dealt = part.withColumn("g", F.pmod(F.xxhash64("row", "piece", F.lit(rounds)), F.lit(groups)))
        packed = shared_checkpoint(dealt.groupBy("g").applyInArrow(_pack_group(capacity, rounds), kind))
        # a bin's first piece stands for it
        starts = F.col("offset") == 0
        stats = packed.agg(F.sum(starts.cast("int")).alias("bins"), F.sum((starts & F.col("final")).cast("int")).alias("final"), F.sum((~F.col("final")).cast("int")).alias("open")).first()
        total = settled + stats["bins"]
        rounds += 1
        if total <= bound or groups == 1 or rounds == max_rounds:
            done.append(packed)
            break
        done.append(packed.where("final"))
        settled, count = settled + stats["final"], stats["open"]
        part = packed.where(~F.col("final")).select(*pieces.columns)
    packed_all = None
    for d in done:
        own = d.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")
        packed_all = own if packed_all is None else packed_all.unionByName(own)
    # full pieces are sequences of their own; negative ids keep them apart
    alone = full.select(*pieces.columns, (-F.abs(F.monotonically_increasing_id()) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed_all = alone if packed_all is None else packed_all.unionByName(alone)
    return packed_all.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", F.lit(total).cast("long").alias("sequences"), F.lit(bound).cast("long").alias("lower_bound")
    )

