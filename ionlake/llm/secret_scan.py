"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over the characters of tokens are trained from labelled samples:
random strings (the values the fixed patterns find in the corpus, and seeded draws from usual
key alphabets) and ordinary identifiers (all other tokens of the corpus). A long token whose
log-likelihood ratio is surely on the random side is a secret too.

The trained state is two tables of 67 x 67 counts. Texts are scanned one by one, whole.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, worker_state

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORD_PARTS = ("passw", "secret", "token", "api")
#: Characters of tokens; a token is a maximal run of them.
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Shortest token the models judge; ratio in nats that a token needs, in total and a character.
MIN_TOKEN, MIN_RATIO, MIN_RATIO_PER_CHAR = 20, 12.0, 0.5
#: Seeded random strings, of each alphabet, that join the corpus' own in training.
SYNTHETIC_PER_ALPHABET, SEED = 2000, 7
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", TOKEN_CHARS[:62], TOKEN_CHARS[:64])
EDGE = len(TOKEN_CHARS)
SYMBOLS = EDGE + 1

_code = np.full(256, EDGE, np.int64)
for _k, _c in enumerate(TOKEN_CHARS):
    _code[ord(_c)] = _k
_blank_others = bytes(c if chr(c) in TOKEN_CHARS else 32 for c in range(256))


def base_spans(text: str, data: bytes, tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points.

    ``tokens`` are the runs of TOKEN_CHARS in ``data``; each fixed pattern lies in a text only if
    a cheap test of them or of the bytes passes.
    """
    found = []
    low = data.lower()
    if any(k.encode() in low for k in KEYWORD_PARTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, tokens), default=0) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    found.sort()
    return found


def _pairs(tokens: list[bytes]) -> np.ndarray:
    """Counts of neighbouring symbols; an edge symbol stands before and after each token."""
    if not tokens:
        return np.zeros(SYMBOLS * SYMBOLS, np.int64)
    codes = _code[np.frombuffer(b" " + b" ".join(tokens) + b" ", np.uint8)]
    return np.bincount(codes[:-1] * SYMBOLS + codes[1:], minlength=SYMBOLS * SYMBOLS)


def _count_pairs(batches):
    """Per partition: symbol pairs of ordinary tokens (label 0) and of the patterns' values (1)."""
    worker_state("symbol pairs", dict)  # drops what other operators kept in this worker
    counts = [np.zeros(SYMBOLS * SYMBOLS, np.int64), np.zeros(SYMBOLS * SYMBOLS, np.int64)]
    for batch in batches:
        for part in slices(batch, "text", 500):
            ordinary, values = [], []
            for data in part.column("text").to_pylist():
                tokens = data.translate(_blank_others).split()
                text = data.decode() if len(data) else ""
                spans = base_spans(text, data, tokens)
                if spans:
                    own = [t for a, kind, b in spans for t in TOKEN.findall(text, a, b) if len(t) >= 8]
                    values += [t.encode() for t in own]
                    mine = set(values[len(values) - len(own) :])
                    tokens = [t for t in tokens if t not in mine]
                ordinary += [t for t in tokens if len(t) >= 4]
            counts[0] += _pairs(ordinary)
            counts[1] += _pairs(values)
    for label in (0, 1):
        at = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[label][at], pa.int64())], names=["label", "pair", "n"])


def synthetic_secrets() -> list[bytes]:
    rng = random.Random(SEED)
    return ["".join(rng.choices(a, k=rng.randint(20, 48))).encode() for a in ALPHABETS for _ in range(SYNTHETIC_PER_ALPHABET)]


def log_ratio_table(ordinary: np.ndarray, values: np.ndarray) -> np.ndarray:
    """ln P(next | char, random) - ln P(next | char, ordinary), add-half smoothed.

    The corpus' own values weigh as much as the synthetic ones together, whatever their number.
    """
    drawn = _pairs(synthetic_secrets()).reshape(SYMBOLS, SYMBOLS).astype(float)
    values = values.reshape(SYMBOLS, SYMBOLS).astype(float)
    if values.sum():
        values *= min(1.0, drawn.sum() / values.sum())
    out = np.zeros((SYMBOLS, SYMBOLS))
    for sign, counts in ((1, drawn + values), (-1, ordinary.reshape(SYMBOLS, SYMBOLS).astype(float))):
        out += sign * np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    return out


def train_models(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ratio table, from every text of ``docs``; at most 2 x 67 x 67 numbers come back."""
    texts = docs.select(text_or_empty(docs[text_col]).cast("binary").alias("text"))
    counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for r in texts.mapInArrow(_count_pairs, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"]] = r["n"]
    return log_ratio_table(counts[0], counts[1])


def ratio(table: np.ndarray, token: str) -> float:
    codes = _code[np.frombuffer(f" {token} ".encode(), np.uint8)]
    return float(table[codes[:-1], codes[1:]].sum())


def find_secrets(text: str, data: bytes, table: np.ndarray) -> tuple[list, list]:
    """Fixed-pattern spans, and all spans with the models' added; sorted by start, then kind."""
    tokens = data.translate(_blank_others).split()
    base = base_spans(text, data, tokens)
    spans = list(base)
    if max(map(len, tokens), default=0) >= MIN_TOKEN:
        for m in TOKEN.finditer(text):
            n = m.end() - m.start()
            if n >= MIN_TOKEN and ratio(table, m[0]) >= max(MIN_RATIO, MIN_RATIO_PER_CHAR * n):
                if all(b <= m.start() or a >= m.end() for a, _, b in base):
                    spans.append((m.start(), 3, m.end()))
        spans.sort()
    return base, spans


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Offsets are code points, end exclusive. Trains on ``docs`` unless a ratio table is given.
    Null and empty texts have no spans; a text of any length is scanned whole; repeated rows give a
    row each; extra columns are ignored; an empty table gives none.
    """
    table = train_models(docs, text_col) if table is None else table

    def scan(batches):
        for batch in batches:
            for own in slices(batch, "text", 500):
                counts, digests, lists = [], [], []
                for data in own.column("text").to_pylist():
                    base, spans = find_secrets(data.decode(), data, table)
                    counts.append([sum(x[1] == kind for x in spans) for kind in range(4)])
                    digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                    lists.append(_join(spans))
                columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([own.column("id"), *columns, pa.array(digests), pa.array(lists)], names=names)

    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    names = ["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return rows.mapInArrow(scan, kind).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", table: np.ndarray | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; all columns stay.

    Overlapping spans are replaced as one. Null texts stay null.
    """
    table = train_models(docs, text_col) if table is None else table

    def clean(data: bytes) -> bytes:
        text = data.decode()
        out, at = [], 0
        for a, _, b in find_secrets(text, data, table)[1]:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return data if not out else "".join([*out, text[at:]]).encode()

    def redact(batches):
        for batch in batches:
            for own in slices(batch, text_col, 500):
                texts = [None if t is None else clean(t.encode()).decode() for t in own.column(text_col).to_pylist()]
                yield own.set_column(own.schema.get_field_index(text_col), own.schema.field(text_col), pa.array(texts, pa.string()))

    return docs.mapInArrow(redact, docs.schema)
