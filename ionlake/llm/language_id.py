"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language from its affixes, character n-grams and a lexicon of
frequent words; learned transitions tie neighbouring words, so code-switched text is split where
the evidence turns. Forward-backward gives each word's label probabilities; a document's language
has the largest mean. The chain runs over the whole text: blocks of words become transfer
matrices, the blocks of a document are joined exactly, and all blocks of a batch run in step.

Fitting reads the whole texts of at most ``SAMPLE_DOCS`` different documents a language, chosen by
hash, as runs of neighbouring words, and splices runs of different languages so that transitions see
real switches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, text_or_empty

#: Documented bound of the training sample: documents of each language.
SAMPLE_DOCS = 120
#: Words of a training sequence before splicing; a text is as many as it takes.
RUN_WORDS = 24
#: Letters of a chain position; a longer run of letters is several, each sharing OVERLAP with the one before.
LONGEST, OVERLAP = 40, 2
FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 17
LEXICON_MIN = 4
SPLICED, EPOCHS, BATCH, RATE, RIDGE, SEED = 4, 6, 256, 0.15, 1e-6, 11
BLOCK = 64
CACHE_WORDS = 300_000
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The chain's positions: runs of letters, lower-cased, long ones (such as text without blanks) cut in place."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step = LONGEST - OVERLAP
    return [w[k : k + LONGEST] for w in words for k in range(0, max(1, len(w) - OVERLAP), step)]


def word_features(word: str, lexicon) -> list[int]:
    """Hashed features: affixes to 4 letters, 2- and 3-grams within marks, and lexicon membership."""
    w = f"<{word}>"
    n = len(w)
    names = [f"p{w[:k]}" for k in range(2, min(6, n))] + [f"s{w[-k:]}" for k in range(2, min(6, n))]
    names += [w[k : k + 2] for k in range(n - 1)] + [w[k : k + 3] for k in range(n - 2)]
    names += [f"w{word}"] if word in lexicon else ["rare"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names]


def emission_rows(words: list[str], lexicon, weights: np.ndarray) -> np.ndarray:
    flat, each = [], []
    for w in words:
        f = word_features(w, lexicon)
        flat += f
        each.append(len(f))
    starts = np.cumsum([0, *each[:-1]])
    return np.add.reduceat(weights[np.array(flat)], starts, axis=0)


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(-1, keepdims=True))


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of sequences that lie one after the other in ``scores``.

    Exact forward-backward in blocks of BLOCK words.
    """
    labels = scores.shape[1]
    a = np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(scores)) - starts[of]
    row, column = first[of] + at // BLOCK, at % BLOCK
    e = np.ones((BLOCK, total, labels))
    inside = np.zeros((BLOCK, total), bool)
    e[column, row] = _potentials(scores)
    inside[column, row] = True
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(BLOCK):
        k = np.flatnonzero(inside[t])
        step = (product[k] @ a) * e[t, k, None, :]
        product[k] = step / step.max((1, 2), keepdims=True)
    ahead = np.ones((total, labels)) / labels
    behind = np.ones((total, labels))
    most = int(blocks.max(initial=0))
    for r in range(1, most):
        d = first[blocks > r] + r
        v = (ahead[d - 1, None, :] @ product[d - 1])[:, 0]
        ahead[d] = v / v.sum(1, keepdims=True)
    for r in range(most - 2, -1, -1):
        d = first[blocks > r + 1] + r
        v = (product[d + 1] @ behind[d + 1, :, None])[:, :, 0]
        behind[d] = v / v.sum(1, keepdims=True)
    forward = np.zeros((BLOCK, total, labels))
    for t in range(BLOCK):
        k = np.flatnonzero(inside[t])
        v = (ahead[k] @ a) * e[t, k]
        ahead[k] = forward[t, k] = v / v.sum(1, keepdims=True)
    for t in range(BLOCK - 1, -1, -1):
        k = np.flatnonzero(inside[t])
        forward[t, k] *= behind[k]
        v = (e[t, k] * behind[k]) @ a.T
        behind[k] = v / v.sum(1, keepdims=True)
    out = forward[column, row]
    return out / out.sum(1, keepdims=True)


def _train_field(sequences: list[tuple[list[str], np.ndarray]], lexicon, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by AdaGrad on the negative log-likelihood."""
    rng = np.random.default_rng(SEED)
    names = sorted({w for ws, _ in sequences for w in ws})
    index = {w: k for k, w in enumerate(names)}
    features = [np.array(word_features(w, lexicon)) for w in names]
    coded = [(np.array([index[w] for w in ws]), y) for ws, y in sequences]
    weights, transitions = np.zeros((BUCKETS, labels)), np.zeros((labels, labels))
    sum_w, sum_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(coded))
        for k in range(0, len(order), BATCH):
            own = [coded[i] for i in order[k : k + BATCH]]
            longest = max(len(x) for x, _ in own)
            ids = np.full((len(own), longest), -1)
            gold = np.zeros((len(own), longest), int)
            for r, (x, y) in enumerate(own):
                ids[r, : len(x)], gold[r, : len(x)] = x, y
            mask = ids >= 0
            used, place = np.unique(ids[mask], return_inverse=True)
            flat = np.concatenate([features[u] for u in used])
            each = np.array([len(features[u]) for u in used])
            rows = np.add.reduceat(weights[flat], np.cumsum(each) - each, axis=0)
            e = np.ones((*ids.shape, labels))
            e[mask] = _potentials(rows[place])
            a = np.exp(transitions - transitions.max())
            alpha, beta = np.zeros_like(e), np.ones_like(e)
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for t in range(1, longest):
                v = np.where(mask[:, t, None], (alpha[:, t - 1] @ a) * e[:, t], alpha[:, t - 1])
                alpha[:, t] = v / v.sum(1, keepdims=True)
            for t in range(longest - 2, -1, -1):
                v = np.where(mask[:, t + 1, None], (e[:, t + 1] * beta[:, t + 1]) @ a.T, 1.0)
                beta[:, t] = v / v.sum(1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(2, keepdims=True)
            both = mask[:, 1:]
            pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair = pair[both]
            pair /= pair.sum((1, 2), keepdims=True)
            grad_t = pair.sum(0)
            np.subtract.at(grad_t, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            error = gamma[mask]
            error[np.arange(len(error)), gold[mask]] -= 1
            by_word = np.zeros((len(used), labels))
            np.add.at(by_word, place, error)
            buckets, spot = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(buckets), labels))
            np.add.at(grad, spot, np.repeat(by_word, each, axis=0))
            grad = grad / len(own) + RIDGE * weights[buckets]
            grad_t = grad_t / len(own) + RIDGE * transitions
            sum_w[buckets] += grad**2
            sum_t += grad_t**2
            weights[buckets] -= RATE * grad / np.sqrt(sum_w[buckets])
            transitions -= RATE * grad_t / np.sqrt(sum_t)
    return weights, transitions


def train(docs: DataFrame, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS):
    """(languages, lexicon, weights, transitions) from labelled rows of ``docs``."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(F.col(text_col)).alias("text"))
    hashed = labelled.withColumn("deal", F.xxhash64("text", F.lit("sample")))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("deal").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], frozenset(), None, None
    # the hash leaves about twice the bound of each language; copies of a text count once, and the rest is cut at the bound
    picked = F.lit(False)
    for lang, n in sizes.items():
        picked = picked | ((F.col("lang") == lang) & (F.pmod("deal", F.lit(1 << 30)) < int(min(1.0, 2 * sample_docs / n) * (1 << 30))))
    ranked = Window.partitionBy("lang").orderBy("deal", "text")
    sample = hashed.where(picked).dropDuplicates(["lang", "deal", "text"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= sample_docs)

    def cut(batches):
        for batch in batches:
            runs, langs = [], []
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = words_of(t)
                for k in range(0, len(words), RUN_WORDS):
                    runs.append(" ".join(words[k : k + RUN_WORDS]))
                    langs.append(lang)
            for k in range(0, len(runs), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(runs[k : k + 5000], pa.string()), pa.array(langs[k : k + 5000], pa.string())], names=["words", "lang"])

    got = sorted((r["lang"], r["words"]) for r in sample.select("text", "lang").mapInArrow(cut, "words string, lang string").collect())
    number = {lang: k for k, lang in enumerate(languages)}
    windows = [(w.split(" "), number[lang]) for lang, w in got if w]
    counts = Counter(w for ws, _ in windows for w in ws)
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_MIN)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(windows))
    sequences, k = [], 0
    while k < len(order):
        # half of all sequences stay in one language, as most text does
        take = [windows[i] for i in order[k : k + int(rng.integers(1, SPLICED + 1))]]
        k += len(take)
        if rng.random() < 0.5:
            for ws, y in take:
                sequences.append((ws, np.full(len(ws), y)))
        else:
            sequences.append(([w for ws, _ in take for w in ws], np.concatenate([np.full(len(ws), y) for ws, y in take])))
    weights, transitions = _train_field(sequences, lexicon, len(languages))
    return languages, lexicon, weights.astype(np.float32), transitions


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_fold: int = HELD_OUT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, n_words, n_switches.

    Learns from at most ``sample_docs`` rows a language, whose crc32(id as text) mod ``folds`` is not
    ``held_fold`` and whose language is not null. ``score`` is the mean probability of the predicted language over the words;
    ``n_words`` counts the chain's positions: a run of over ``LONGEST`` letters is several.
    ``n_switches`` counts neighbouring words whose likeliest languages differ. A null text, or one
    without a letter, is ``und`` with score 0, and so is every text where nothing could be learned.
    A text of any length is one chain. Repeated rows get a row each; extra columns are ignored; an
    empty table gives none.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).withColumn("held_out", fold("id", folds) == held_fold)
    languages, lexicon, weights, transitions = train(rows.where(~F.col("held_out")), "text", "lang", sample_docs)
    model = docs.sparkSession.sparkContext.broadcast((languages, lexicon, weights, transitions))

    def predict(batches):
        languages, lexicon, weights, transitions = model.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(languages)), np.float32)
        for batch in batches:
            for own in slices(batch, "text"):
                n = own.num_rows
                words = [[w for w in words_of(t)] for t in own.column("text").to_pylist()]
                words = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in words]
                pred, score, switches = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, np.int64)
                lengths = np.array([len(ws) for ws in words], np.int64)
                if languages and lengths.sum():
                    missing = sorted(set().union(*words) - known.keys())
                    if len(known) + len(missing) > CACHE_WORDS:
                        known, table = {}, table[:0]
                        missing = sorted(set().union(*words))
                    if missing:
                        known.update((w, len(table) + i) for i, w in enumerate(missing))
                        table = np.concatenate([table, emission_rows(missing, lexicon, weights)])
                    some = np.flatnonzero(lengths)
                    get = known.__getitem__
                    ids = np.fromiter((i for d in some for i in map(get, words[d])), np.int64, int(lengths.sum()))
                    gamma = marginals(table[ids].astype(np.float64), lengths[some], transitions)
                    starts = np.cumsum(lengths[some]) - lengths[some]
                    means = np.add.reduceat(gamma, starts, axis=0) / lengths[some][:, None]
                    best = means.argmax(1)
                    likely = gamma.argmax(1)
                    turn = np.r_[False, likely[1:] != likely[:-1]]
                    turn[starts] = False
                    score[some] = np.clip(means[np.arange(len(some)), best], 0, 1)
                    switches[some] = np.add.reduceat(turn.astype(np.int64), starts)
                    for d, b in zip(some, best):
                        pred[d] = languages[b]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("held_out"), pa.array(pred), pa.array(score), pa.array(lengths), pa.array(switches)], names=["id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    texts = rows.select("id", "held_out", text_or_empty("text").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    return texts.mapInArrow(predict, kind).withColumnRenamed("id", id_col)
