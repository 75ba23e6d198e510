"""Near duplicates by BagMinHash, banding, and verified multiset overlap.

Signature: a document is the multiset of its five-word shingles. Each shingle drives Poisson
processes over its weight axis, cut into dyadic intervals (0,1], (1,2], (2,4], ...: interval k has
its own process with a rate as long as the interval, and a point counts when the unit cell it
falls into lies below the shingle's weight. Each point hits one of M components; a component
keeps its earliest point. Two signatures agree in a component with exactly the probability of the
weighted Jaccard similarity. A process stops once its next point cannot beat the component that
is worst off, so long documents cost little more than their first points.

Candidates: BANDS bands of the signature are bucket keys. Texts with equal words are one node
before that. A bucket links its members to its smallest node; links are verified on the true
multisets, one link a node first, then the others of nodes that this one did not take. In buckets
that hold several components after that, all likely pairs across them are verified inside tasks, a
bucket each or, of large buckets, a pair of blocks each; what comes out is links, fewer than
members. No pair is left out for the size of its bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, shared_table, slices, text_or_empty, worker_state

SHINGLE, SIMILARITY = 5, 0.8
M, BANDS = 64, 16
#: A candidate pair is dropped unverified when under M * ESTIMATE components agree, six deviations below 0.8; 0 verifies all.
ESTIMATE = 0.5
#: A task compares at most FEW members of at most TASK_BYTES of text. Larger buckets are cut into blocks of half of that, compared pair by pair.
FEW, TASK_BYTES = 2048, 8 << 20
#: Members verified against one copy of a leader's text.
MEMBERS = 2000
CACHE_WORDS = 300_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[list[bytes]], total: int) -> np.ndarray:
        known = self.known
        missing = set().union(*words).difference(known)
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = set().union(*words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        get = known.__getitem__
        return np.fromiter((h for ws in words for h in map(get, ws)), np.uint64, total)


def shingle_multisets(words: list[list[bytes]], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, weight), sorted by both; fewer than k words are one shingle."""
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = worker_state("word hashes", WordHashes).of(words, total)
    starts = np.cumsum(lengths) - lengths
    count = np.where(lengths == 0, 0, np.maximum(1, lengths - k + 1))
    doc = np.repeat(np.arange(len(words)), count)
    first = starts[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    end = (starts + lengths)[doc]
    s = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = first + j
            inside = at < end
            s = np.where(inside, mix(s * np.uint64(3) + h[np.minimum(at, total - 1)] + _GOLDEN), s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.r_[at, len(doc)])


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """Signatures (docs x m) of 64-bit values; rows of documents without elements are 0."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.where(level == 0, 1, low)
    owner, limit = doc[row], weight[row] - low
    with np.errstate(over="ignore"):
        state = mix(element[row] + _GOLDEN * (level.astype(np.uint64) + np.uint64(1)))
        time = np.zeros(len(row))
        best = np.full(docs * m, np.inf)
        while len(state):
            state = state + _GOLDEN
            r = mix(state)
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            q = mix(r ^ np.uint64(0xD6E8FEB86659FD93))
            counts = ((q >> np.uint64(16)).astype(np.float64) * 2.0**-48 * span).astype(np.int64) < limit
            np.minimum.at(best, owner[counts] * m + (q[counts] % np.uint64(m)).astype(np.int64), time[counts])
            live = time < best.reshape(docs, m).max(1)[owner]
            state, time, span, owner, limit = state[live], time[live], span[live], owner[live], limit[live]
        best[np.isinf(best)] = 0
        return mix(best.view(np.uint64)).reshape(docs, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _GOLDEN, (len(signature), bands)).copy()
        for j in range(rows):
            out = mix(out * np.uint64(5) + signature[:, j::rows])
    return out.view(np.int64)


def multiset_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (hash, weight) multisets."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    met = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[met]], b[1][met]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()


def _sign(batches):
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for own in slices(batch, "text", 500, 1 << 20):
            words = [_words(t) for t in own.column("text").to_pylist()]
            keys = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            doc, shingle, weight = shingle_multisets(words)
            signature = bag_min_hash(doc, shingle, weight, len(words))
            size = np.bincount(doc, weight, len(words)).astype(np.int64)
            # of the bits that are kept, so that equal ones tell that two texts share a band
            bands = band_keys(signature >> np.uint64(48))
            short = (signature >> np.uint64(48)).astype(np.uint16)
            length = [sum(map(len, w)) + len(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [own.column("id"), pa.array(keys, pa.binary()), pa.array(size), pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel())), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(range(row, row + len(words)), pa.int64()), pa.array(length, pa.int64())],
                names=["id", "key", "size", "bands", "sig", "row", "bytes"],
            )
            row += len(words)


def _likely(estimate: float):
    """Pairs whose signatures agree in M * estimate components at least."""

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, M) for c in ("sig_a", "sig_b"))
                yield batch.filter(pa.array((a == b).sum(1) >= M * estimate)).select(["leader", "key"])

    return likely


def _verify(similarity: float):
    """Rows sorted by (leader, salt) with the leader's own text first; pairs that are similar."""

    def verify(batches):
        name, held = None, None
        for part in (x for batch in batches for x in slices(batch, "text", 500, 1 << 20)):
            leaders, keys, firsts, texts = (part.column(c).to_pylist() for c in ("leader", "key", "first", "text"))
            doc, shingle, weight = shingle_multisets([_words(t) for t in texts])
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            found = []
            for k, (leader, key, first) in enumerate(zip(leaders, keys, firsts)):
                own = shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]]
                if first:
                    name, held = leader, own
                elif leader == name and multiset_similarity(held, own) >= similarity:
                    found.append((leader, key))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["leader", "key"])

    return verify


def verify_pairs(pairs: DataFrame, texts: DataFrame, signatures: DataFrame, similarity: float, estimate: float = ESTIMATE) -> DataFrame:
    """Those of the distinct (leader, key) pairs whose multisets are similar, stored.

    Unlikely pairs are dropped before their texts are fetched. A leader's text travels once for every MEMBERS of its members, each member's once a pair.
    """
    sig = signatures.select("key", "sig")
    both = pairs.join(sig.withColumnRenamed("sig", "sig_b"), "key").join(sig.select(F.col("key").alias("leader"), F.col("sig").alias("sig_a")), "leader")
    likely = shared_checkpoint(both.select("leader", "key", "sig_a", "sig_b").mapInArrow(_likely(estimate), "leader binary, key binary"))
    copies = likely.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies"))
    members = (
        likely.join(copies, "leader")
        .join(texts, "key")
        .select("leader", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int").alias("salt"), F.lit(False).alias("first"), "key", "text")
    )
    leaders = copies.join(texts, F.col("leader") == F.col("key")).select("leader", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(True).alias("first"), "key", "text")
    grouped = members.unionByName(leaders).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.desc("first"))
    return shared_checkpoint(grouped.mapInArrow(_verify(similarity), "leader binary, key binary"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, by alternating large and small stars.

    Nodes without edges have no row. Nothing but two numbers a round reaches the driver.
    """
    pairs = edges.toDF("u", "v").where("u <> v")
    state = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = shared_checkpoint(small)
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_component(df: DataFrame, column: str, components: DataFrame, name: str) -> DataFrame:
    own = components.select(F.col("node").alias(column), F.col("component").alias("found"))
    return df.join(own, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, estimate: float = ESTIMATE) -> DataFrame:
    """One row per input row: id, class_id, class_size, n_shingles, kept.

    Words are runs without white space, A-Z lower-cased. Two texts are linked when the weighted
    Jaccard similarity of their five-word shingles is at least ``similarity`` and they share a
    band; classes are the links' components. A pair at 0.8 is missed with a chance of 2 in 10,000 for
    want of a band and of 1 in 10 million for the ``estimate`` from signatures, under which pairs are
    dropped before their texts are compared (0: none is).
    ``class_id`` is the smallest id in the class, ``kept`` marks one row with it. A text of one to
    four words is one shingle; texts without words (null, empty, blank) form one class. Texts of any
    length are compared whole. Repeated rows are members each, and of ids that occur with several
    texts each row has its own text's class; extra columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = shared_table(rows.mapInArrow(_sign, f"id {id_type}, key binary, size long, bands array<long>, sig binary, row long, bytes long"), "signed")
    nodes = shared_table(signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes")), "nodes")

    banded = nodes.where("size > 0").select("key", "size", "bytes", F.posexplode("bands").alias("at", "band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("key", "size")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = shared_table(banded.join(heads, "band").select("band", "at", "key", "size", "bytes", F.col("head.key").alias("leader"), F.col("head.size").alias("leader_size")), "members")
    # the overlap is at most the smaller size, so sizes too far apart cannot be similar
    near = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)
    links = shared_checkpoint(members.where((F.col("key") != F.col("leader")) & near(F.col("size"), F.col("leader_size"))).select("leader", "key").distinct())
    if links.isEmpty() and members.isEmpty():
        components = spark.createDataFrame([], "node binary, component binary")
    else:
        wanted = members.select("key").distinct()
        picked = nodes.join(wanted, "key").select("key", F.col("id").alias("node_id"))
        texts = _node_texts(rows, picked)
        first = shared_checkpoint(links.groupBy("key").agg(F.min("leader").alias("leader")).select("leader", "key"))
        edges = verify_pairs(first, texts, nodes, similarity, estimate)
        # nodes that their first leader did not take try all others
        alone = links.join(edges.select("key"), "key", "left_anti").join(first, ["leader", "key"], "left_anti").select("leader", "key")
        edges = edges.union(verify_pairs(alone, texts, nodes, similarity, estimate))
        components = connected_components(edges)
        crossing = _crossing_links(members, nodes, components, texts, similarity, estimate)
        if not crossing.isEmpty():
            components = connected_components(edges.union(crossing))

    classed = _with_component(nodes.select("key", "id", "n"), "key", components, "class_key")
    classes = classed.groupBy("class_key").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = classed.join(classes, "class_key").select("key", F.col("id").alias("key_id"), "class_id", "class_size", "class_key")
    out = signed.select("id", "key", "row", F.col("size").alias("n_shingles")).join(by_key, "key")
    # of the rows with the class's smallest id exactly one is kept
    first = out.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return out.join(first, "row", "left").select(F.col("id").alias(id_col), "class_id", "class_size", "n_shingles", F.coalesce("first", F.lit(False)).alias("kept"))


def _node_texts(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """(key, text) of the picked nodes, from one row each with single blanks, stored.

    Rows are first cut down to the nodes' ids, each staying one row however many nodes have its id
    (null, or repeated), and then meet the nodes by the key of their own text.
    """

    def keyed(batches):
        for batch in batches:
            for part in slices(batch, "text", 500, 1 << 20):
                texts = [b" ".join(_words(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["key", "text"])

    near = rows.join(picked.select("node_id").distinct().hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("node_id")), "left_semi").select("text")
    own = near.mapInArrow(keyed, "key binary, text binary").dropDuplicates(["key"])
    return shared_table(own.join(picked.select("key"), "key", "left_semi"), "texts")


def _groups(batches, columns: list[str]):
    """Runs of rows with the same first column, each a list of the other columns' values."""
    name, held = None, []
    for batch in batches:
        for own, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if own != name:
                if len(held) > 1:
                    yield name, held
                name, held = own, []
            held.append(row)
    if len(held) > 1:
        yield name, held


def _likely_pairs(rows: list[list], similarity: float, estimate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing components) of a task's (side, comp, key, size, sig, at, ...) rows in different components.

    Rows of two blocks have sides 1 and 2 and meet across these only. A pair that shares an
    earlier band than the task's is left to that one.
    """
    n, sizes, at = len(rows), np.array([r[3] for r in rows], np.float64), rows[0][5]
    side = np.array([r[0] for r in rows])
    comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
    signature = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(n, M)
    found = [np.zeros((3, 0), np.int64)]
    for k in range(0, n, 256):
        own = np.arange(k, min(k + 256, n))
        near = np.minimum(sizes[own, None], sizes) >= similarity * np.maximum(sizes[own, None], sizes)
        near &= (comp[own, None] != comp) & (own[:, None] < np.arange(n)) & ((side == 0) | (side[own, None] != side))
        i, j = np.nonzero(near)
        for c in range(0, len(i), 1 << 17):
            x, y = i[c : c + (1 << 17)] + k, j[c : c + (1 << 17)]
            same = signature[x] == signature[y]
            agree = same.sum(1)
            hit = (agree >= M * estimate) & ~same.reshape(len(x), BANDS, M // BANDS)[:, :at].all(2).any(1)
            found.append(np.stack([x[hit], y[hit], agree[hit]]))
    return tuple(np.concatenate(found, 1))


def _likely_members(similarity: float, estimate: float):
    """(task, key) of the members of sorted tasks that have a likely partner in another component."""

    def scan(batches):
        for task, rows in _groups(batches, ["task", "side", "comp", "key", "size", "sig", "at"]):
            i, j, _ = _likely_pairs(rows, similarity, estimate)
            own = np.unique(np.concatenate([i, j])).tolist()
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(own), pa.int64()), pa.array([rows[k][2] for k in own], pa.binary())], names=["task", "key"])

    return scan


def _bucket_links(similarity: float, estimate: float):
    """Verified links that join the components of sorted tasks, likeliest pairs first.

    A pair whose components earlier links of its task have joined is skipped, so a task gives
    fewer links than it has members.
    """

    def verify(batches):
        for _, rows in _groups(batches, ["task", "side", "comp", "key", "size", "sig", "at", "text"]):
            i, j, agree = _likely_pairs(rows, similarity, estimate)
            if not len(i):
                continue
            bags = []
            for k in range(0, len(rows), 200):
                part = [_words(r[6]) for r in rows[k : k + 200]]
                doc, shingle, weight = shingle_multisets(part)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                bags += [(shingle[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:])]
            root = {r[1]: r[1] for r in rows}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            found = []
            order = np.argsort(-agree, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                a, b = find(rows[x][1]), find(rows[y][1])
                if a != b and multiset_similarity(bags[x], bags[y]) >= similarity:
                    root[max(a, b)] = min(a, b)
                    found.append((rows[x][2], rows[y][2]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["leader", "key"])

    return verify


def _cut(members: int, size: int):
    """Sorted rows with the number of their block: consecutive rows of a bucket, alike in ``main``.

    A block has at most ``members`` rows and ``size`` bytes of text; a longer text is one alone.
    """

    def cut(batches):
        block, name, rows, held = TaskContext.get().partitionId() << 33, None, 0, 0
        for batch in batches:
            numbers = []
            for *own, n in zip(*(batch.column(c).to_pylist() for c in ("band", "main", "bytes"))):
                if own != name or rows >= members or held + n > size:
                    block, name, rows, held = block + 1, own, 0, 0
                rows, held = rows + 1, held + n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "block"])

    return cut


def _block_tasks(large: DataFrame, similarity: float) -> DataFrame:
    """The rows of large buckets in tasks, one for each pair of a bucket's blocks (and each block alone).

    The members of a bucket's largest component have blocks of their own, which never meet each
    other: of a family of near copies with few outsiders each member travels once for each block
    of outsiders. Blocks follow the sizes, so pairs whose sizes are too far apart are left out.
    """
    counts = large.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"))
    large = large.join(most, "band").select("band", (F.col("comp") == F.col("most")).alias("main"), "at", "comp", "key", "size", "bytes", "sig")
    order = ["band", "main", "size", "key"]
    kind = large.schema.simpleString()[len("struct<") : -1] + ",block:bigint"
    blocks = shared_table(large.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(max(1, FEW // 2), TASK_BYTES // 2), kind), "blocks")
    spans = blocks.groupBy("band", "main", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = spans.select("band", F.col("main").alias("then_main"), F.col("block").alias("then"), F.col("low").alias("then_low"), F.col("high").alias("then_high"))
    pairs = spans.join(other, "band").where(
        (F.col("block") <= F.col("then")) & ~(F.col("main") & F.col("then_main")) & (F.col("high") >= similarity * F.col("then_low")) & (F.col("then_high") >= similarity * F.col("low"))
    )
    one, two = F.struct(F.col("block"), F.lit(1).alias("side")), F.struct(F.col("then").alias("block"), F.lit(2).alias("side"))
    alone = F.struct(F.col("block"), F.lit(0).alias("side"))
    dealt = pairs.select(F.xxhash64("block", "then").alias("task"), F.explode(F.when(F.col("block") == F.col("then"), F.array(alone)).otherwise(F.array(one, two))).alias("own")).select("task", "own.block", "own.side")
    return blocks.join(dealt, "block").select("task", "side", "comp", "key", "size", "sig", "at", "bytes")


def _crossing_links(members: DataFrame, nodes: DataFrame, components: DataFrame, texts: DataFrame, similarity: float, estimate: float) -> DataFrame:
    """Verified links between members of one bucket in different components, stored.

    Members of buckets with several components meet inside a task: first their signatures, to find
    the members that have a likely partner, then those members' texts. All likely pairs across
    components are verified there; only links come out. A bucket of more than FEW members or
    TASK_BYTES, such as the texts that share a long passage, is cut into blocks and every pair of
    blocks is a task, so no task holds more. The leaders, tried before, stand for their components:
    what they joined does not come here.
    """
    rest = _with_component(members.select("band", "at", "key", "size", "bytes"), "key", components, "comp")
    parts = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    mixed = shared_table(rest.join(parts.select("band", "n", "held"), "band").join(nodes.select("key", "sig"), "key"), "mixed")
    small = (F.col("n") <= FEW) & (F.col("held") <= TASK_BYTES)
    tasks = mixed.where(small).select(F.col("band").alias("task"), F.lit(0).alias("side"), "comp", "key", "size", "sig", "at", "bytes")
    large = mixed.where(~small)
    if not large.isEmpty():
        tasks = tasks.union(_block_tasks(large, similarity))
    likely = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_likely_members(similarity, estimate), "task long, key binary")
    full = tasks.join(likely, ["task", "key"]).join(texts, "key").select("task", "side", "comp", "key", "size", "sig", "at", "text")
    return shared_checkpoint(full.repartition("task").sortWithinPartitions("task").mapInArrow(_bucket_links(similarity, estimate), "leader binary, key binary"))
