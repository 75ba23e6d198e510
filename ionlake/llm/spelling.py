"""Spelling variants: words one edit apart, found by hashes of their one-letter deletions.

A word's prefix and suffix polynomial hashes give the hash of the word without its i-th code point for
all i at once, as NumPy integers. Two words are one edit apart exactly if both lose a letter at the same
place and agree (replacement), or one loses a letter and becomes the other (insertion, deletion).
Keys are dealt by their upper bits and sorted within the partitions by Spark's radix sort, which spills;
runs of equal keys are then compared as strings, so a collision of hashes links nothing.

A run of one string holds at most the letters of the alphabet for each place: its links are counted and
its best word is found in one pass, without listing pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shared_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWERED = str.maketrans(UPPER, LOWER)
#: Characters of a text that are split at a time.
PIECE = 1 << 20
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
#: Rows of keys that a partition of the sort takes on average.
KEY_ROWS = 500_000
BASE = 0x9E3779B97F4A7C15 | 1


def runs(text: str):
    """Lists of the letter runs of a text, a piece of the text at a time; no run is cut."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text) and (rest := RUN.match(text, end)):
            end = rest.end()
        yield RUN.findall(text, start, min(end, len(text)))
        start = end


def noisy(doc_id: str, run: str, every: int) -> str:
    """The lower-cased run, without one code point where ``every`` divides the crc32 of id and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def _counts(every: int, min_letters: int):
    def apply(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own: Counter = Counter()
                for part in runs(text.as_py() or ""):
                    own.update(part)
                lowered: Counter = Counter()
                for run, n in own.items():
                    lowered[run.translate(_LOWERED)] += n
                for run, n in lowered.items():
                    if len(run) >= min_letters:
                        word = noisy(doc_id or "", run, every)
                        if len(word) >= min_letters:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return apply


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_letters: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): words of at least ``min_letters`` code points that occur ``min_count`` times or more over all texts."""
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    partial = rows.mapInArrow(_counts(every, min_letters), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(code_points: np.ndarray) -> np.ndarray:
    """Spreads code points over 64 bits, so that no two words cancel by their letters' differences."""
    x = code_points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> np.ndarray:
    """Hashes of words of one length: column 0 of the word itself, column i + 1 of the word without code point i."""
    length = len(words[0])
    letters = _letters(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length))
    base = np.uint64(BASE)
    with np.errstate(over="ignore"):
        prefix = np.zeros((len(words), length + 1), np.uint64)
        suffix = np.zeros((len(words), length + 1), np.uint64)
        power = np.ones(length + 1, np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * base + letters[:, i]
            power[i + 1] = power[i] * base
        for i in range(length - 1, -1, -1):
            suffix[:, i] = letters[:, i] * power[length - 1 - i] + suffix[:, i + 1]
        without = prefix[:, :-1] * power[length - 1 - np.arange(length)] + suffix[:, 1:]
        return _mixed(np.concatenate([suffix[:, :1], without], axis=1))


def _keys(batches):
    """(key, at, word, n): at is -1 for the whole word, else the place of the deleted code point."""
    for batch in batches:
        by_length: dict[int, tuple[list, list]] = {}
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words, counts = by_length.setdefault(len(word), ([], []))
            words.append(word)
            counts.append(n)
        for length, (words, counts) in by_length.items():
            step = max(1, 200_000 // (length + 1))
            for s in range(0, len(words), step):
                own = words[s : s + step]
                keys = deletion_keys(own).view(np.int64)
                rows = np.repeat(np.arange(len(own)), length + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()),
                        pa.array(np.tile(np.arange(-1, length, dtype=np.int32), len(own))),
                        pa.array(own, pa.string()).take(pa.array(rows)),
                        pa.array(np.repeat(np.array(counts[s : s + step], np.int64), length + 1)),
                    ],
                    names=["key", "at", "word", "n"],
                )


def links(members: list[tuple[int, str, int]]):
    """(word, near words, n of the best, best) of the members (at, word, n) of one key, after comparing strings.

    The best is the near word of largest n, the smallest of those that tie.
    """
    stars: dict[str, tuple[list, dict]] = {}
    for at, word, n in members:
        rest = word if at < 0 else word[:at] + word[at + 1 :]
        whole, places = stars.setdefault(rest, ([], {}))
        if at < 0:
            whole.append((-n, word))
        else:
            places.setdefault(at, []).append((-n, word))
    for whole, places in stars.values():
        for group in places.values():  # replaced at one place
            yield from _mates(group)
        if whole and places:  # the words that lose a letter and become this one
            longer = {x for group in places.values() for x in group}
            best = min(longer)
            yield whole[0][1], len(longer), -best[0], best[1]
            for _, word in longer:
                yield word, 1, -whole[0][0], whole[0][1]


def _mates(group: list[tuple[int, str]]):
    if len(group) > 1:
        first, second = sorted(group)[:2]
        for mate in group:
            best = second if mate == first else first
            yield mate[1], len(group) - 1, -best[0], best[1]


def _linked(batches):
    """Goes through sorted keys; a run that a batch cuts goes on in the next."""
    held: list = []
    held_key = None

    def out(rows):
        word, n_near, n, best = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        wanted = np.flatnonzero(np.diff(edges) > 1)
        rows = []
        if held_key is not None and keys[0] != held_key:
            rows += links(held) if len(held) > 1 else []
            held, held_key = [], None
        columns = [batch.column(c) for c in ("at", "word", "n")]
        part = lambda a, b: list(zip(*(c.slice(a, b - a).to_pylist() for c in columns), strict=True))
        first, last = int(edges[1]), int(edges[-2])
        if held_key is not None:
            held += part(0, first)
        inner = [k for k in wanted.tolist() if edges[k + 1] <= last and not (k == 0 and held_key is not None)]
        for k in inner:
            rows += links(part(int(edges[k]), int(edges[k + 1])))
        if held_key is None:
            held, held_key = part(last, batch.num_rows), keys[-1]
        elif last > 0:  # the held run has ended in this batch
            rows += links(held) if len(held) > 1 else []
            held, held_key = part(last, batch.num_rows), keys[-1]
        if rows:
            yield out(rows)
    if len(held) > 1 and (rows := list(links(held))):
        yield out(rows)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_letters: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are the maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run loses
    one code point where ``every`` divides the crc32 of ``<id>:<run>`` (0: never). ``form`` is the near word of
    largest n, if that is at least ``ratio`` times the word's, and ``root`` the end of the forms. Null and empty
    texts have no words; a null id counts as the empty text; repeated rows count each; texts of any length
    are read whole, and other columns are ignored. Without words the result is empty.
    """
    if min_letters < 2 or ratio < 2:
        raise ValueError("min_letters and ratio must be at least 2")
    words = shared_table(word_counts(docs, id_col, text_col, every, min_letters, min_count), "words")
    size = words.agg(F.sum(F.length("word") + 1).alias("keys"), F.max("n").alias("most")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["keys"] or 0) // KEY_ROWS))
    keys = words.mapInArrow(_keys, "key long, at int, word string, n long")
    # the upper 31 bits of the key, scaled to the partitions
    radix = F.shiftrightunsigned("key", 33) * parts
    dealt = keys.repartitionById(parts, F.shiftright(radix, 31).cast("int")).sortWithinPartitions("key")
    found = dealt.mapInArrow(_linked, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    rich = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(rich, F.col("best.word")).alias("form"), F.when(rich, -F.col("best.less")).alias("form_n")
    )
    formed = shared_table(formed, "forms")
    chain = int(math.log(max(1, (size["most"] or 1) / min_count), ratio)) + 1  # forms grow by the ratio each
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(chain)))):
        jump = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = shared_table(ends.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
