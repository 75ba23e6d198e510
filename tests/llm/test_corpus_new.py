"""Spelling variants, Merkle manifest and nearest neighbours against brute-force restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.llm import spelling
from ionlake.llm.merkle import collapse, fold, fold_proofs, merkle_manifest, tampered_leaf
from ionlake.llm.spelling import deletion_keys, links, runs, spelling_variants
from ionlake.llm.vantage_trees import Tree, inner_products, nearest_neighbours, on_sphere, search


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, every=199, min_letters=6, min_count=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    out = {}
    for w, n in words.items():
        near = [o for o in words if o != w and one_edit(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        out[w] = (n, len(near), best if best and words[best] >= ratio * n else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {w: (n, near, form, words.get(form), root(w)) for w, (n, near, form) in out.items()}


def collected(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def spelled(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcßé") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    words = Counter()
    for k, w in enumerate(base):
        words[w] += 130 if k % 3 else 700
        for _ in range(10):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            other = w[:at] + rng.choice("abcßéÿ") * (kind > 0) + w[at + (kind < 2) :]
            words[other] += rng.choice((1, 4, 5, 25, 26, 130))
    words["aaaaaaa"], words["aaaaaa"], words["aaaaaab"] = 6, 30, 30  # repeated letters; a tie
    words |= {"abcdabcd": 800, "abcdabca": 130, "abcaabca": 20, "bbcdabcd": 9, "abcdabc": 9, "abcdabcdé": 9}  # forms of forms, many near words
    flat = [w.upper() if k % 7 == 0 and w.isascii() else w for k, w in enumerate(words.elements())]
    rng.shuffle(flat)
    cut = [flat[k : k + 40] for k in range(0, len(flat), 40)]
    return [(k % 30, " ".join(part) + "; x×y÷ " + "1 2") for k, part in enumerate(cut)] + [(None, "aaaaab " * 9), (3, None), (4, ""), (5, "\n\t 12 -")]


def test_spelling_variants_against_brute_force(spark):
    rows = spelled()
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string").repartition(3)
    for every in (199, 7, 0):
        got, want = collected(spelling_variants(table, every=every)), brute_variants(rows, every)
        assert got == want
    assert any(form and root != form for _, _, form, _, root in brute_variants(rows).values()) and any(near > 3 for _, near, *_ in want.values())


def test_spelling_variants_of_documents(docs, rows, empty):
    assert collected(spelling_variants(docs, min_letters=4)) == brute_variants([(i, t) for i, t, *_ in rows], min_letters=4)
    assert spelling_variants(empty).count() == 0


def test_spelling_collisions_are_compared_as_strings(spark, monkeypatch):
    rows = spelled(8)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    words = {w: n for w, (n, *_) in brute_variants(rows).items()}
    members = [(at, w, n) for w, n in words.items() for at in range(-1, len(w))]  # all under one key
    near = Counter()
    for word, n_near, *_ in links(members):
        near[word] += n_near
    assert near == Counter({w: v[1] for w, v in brute_variants(rows).items() if v[1]})
    assert table.count() == len(rows)


def test_deletion_keys_are_those_of_the_shorter_words():
    words = ["abcdefg", "aabbccd", "ÀÿÀÿÀÿa"]
    keys = deletion_keys(words)
    for k, w in enumerate(words):
        shorter = [w[:i] + w[i + 1 :] for i in range(len(w))]
        assert (deletion_keys(shorter)[:, 0] == keys[k, 1:]).all()
    assert len(np.unique(keys)) == len({w for w in words} | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))})


def test_runs_are_not_cut(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "abc defghijklmnopqrst uv " * 7 + "é" * 35
    assert [r for part in runs(text) for r in part] == spelling.RUN.findall(text)


def H(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def brute_tree(leaves, fanout):
    """(root, siblings of each leaf) by whole levels."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k in range(len(leaves)):
            start = at[k] - at[k] % fanout
            run = nodes[start : start + fanout]
            proofs[k] += run[: at[k] % fanout] + run[at[k] % fanout + 1 :]
            at[k] //= fanout
        nodes = [H(*nodes[s : s + fanout]) for s in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute_leaf(i, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))


def brute_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, brute_leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = brute_tree([leaf for _, leaf in groups[g]], fanout)
    root, upper = brute_tree([trees[g][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for (r, leaf), path in zip(groups[g], trees[g][1]):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out.append((r[0], leaf, trees[g][0], root, H(*path, *upper[k]), not hit))
    return Counter(out), root


def manifest_rows(docs, levels, fanout=2):
    proofs = fold_proofs(merkle_manifest(docs, fanout=fanout, levels=levels, carry={"claimed": tampered_leaf(docs)}), "claimed", fanout)
    rows = proofs.collect()
    assert all((bytes(r["folded_root"]) == bytes(r["root"])) == r["verified"] for r in rows)
    return Counter((r["doc_id"], *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root")), r["proof_sha256"], r["verified"]) for r in rows)


@pytest.mark.parametrize("levels,fanout", [(12, 2), (2, 2), (3, 3)])
def test_merkle_manifest_against_brute_force(spark, levels, fanout):
    rng = random.Random(2)
    rows = [(k, f"s{k % 3}", ("aa", "b", "é", None)[min(3, k % 11 // 2)], rng.randint(0, 99), "text " * rng.randint(0, 9)) for k in range(150)]
    rows += [(500, "s", "lone", 5, "one leaf"), (None, None, None, None, None), (7, "s", "aa", 2**63 - 1, "x" * 70_000), (8, "s", "aa", None, "ü😀"), rows[3], rows[3], rows[4][:3] + (1, "same id")]
    table = spark.createDataFrame([(*r[::-1], "x", 1) for r in rows], "text string, n_chars long, lang string, source string, doc_id long, leaf string, index int").repartition(4)
    want, root = brute_manifest(rows, fanout)
    assert manifest_rows(table, levels, fanout) == want


def test_merkle_manifest_of_documents(docs, rows, empty):
    want, _ = brute_manifest([(i, s, lang, len(t or ""), t) for i, t, lang, s in rows])
    assert manifest_rows(docs, 4) == want
    assert manifest_rows(empty, 4) == Counter()


def test_merkle_group_of_all_rows_is_dealt_to_ranges(spark):
    """Nine in ten rows repeat one row: no range takes much more than its share."""
    row = F.when(F.col("id") % 10 > 0, F.lit(5)).otherwise(F.col("id"))
    docs = spark.range(4000).select(row.alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(3).alias("n_chars"), F.lit("t").alias("text"))
    from ionlake.llm.merkle import _ranged

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, _ = _ranged(docs.select("doc_id"), ["doc_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * 4000 / len(sizes)
    manifest = merkle_manifest(docs, levels=5)
    assert manifest.count() == 4000 and manifest.select("root").distinct().count() == 1 and fold_proofs(manifest).where("verified").count() == 4000


def test_collapse_and_fold_agree():
    for n in (1, 2, 3, 5, 8, 13):
        for fanout in (2, 3, 4):
            leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
            steps = next(s for s in range(9) if fanout**s >= n)
            top, paths = collapse(leaves, steps, fanout)
            assert all(fold(leaf, paths[k], 0, k, n, fanout) == (top, len(paths[k])) for k, leaf in enumerate(leaves))
            assert top.hex() == brute_tree([x.hex() for x in leaves], fanout)[0]


def vectors(seed=1, n=700, dim=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 2
    x = centres[rng.integers(12, size=n)] + 0.15 * rng.normal(size=(n, dim))
    x[100:160] = x[100]  # equal vectors
    x[200:230] *= 4
    return x.astype(np.float32)


def brute_nearest(table, k=20, modulus=20):
    """Rows of (query_id, [(score, id)...]) over rows that take part, nulls last among ties."""
    ok = [(i, [float(np.float32(c)) for c in v]) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % modulus == 0:
            scored = []
            for b, (j, v) in enumerate(ok):
                if a != b:
                    total = 0.0
                    for p, r in zip(q, v):
                        total += p * r
                    scored.append((-total, j is None, j or 0))
            out += [(i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_nearest_neighbours_against_brute_force(spark):
    x = vectors()
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 9), (1060, [1.0, None] + [0.5] * 7), (1080, [math.inf] + [0.5] * 8), (1100, [math.nan] * 9)]
    rows += [(None, rows[100][1]), (40, rows[7][1]), rows[60], (1120, [3.0, 1.0])]  # no id, ids that repeat, a short vector
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, row int, score double").repartition(3)
    want = brute_nearest(rows)
    for shard_rows, block_rows in ((100_000, 1024), (60, 10)):
        got = nearest_neighbours(table, shard_rows=shard_rows, block_rows=block_rows)
        assert Counter(tuple(r) for r in got.collect()) == want
    few = table.where("vec_id in (0, 1, 2, 1040)")
    assert [(r["query_id"], r["rank"]) for r in nearest_neighbours(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert nearest_neighbours(table.limit(0)).count() == 0


def test_relaxed_pruning_looks_at_less_and_keeps_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(40, size=6000)] + 0.4 * rng.normal(size=(6000, 32))
    ids, q = np.arange(6000), np.arange(0, 6000, 20)
    most = float(np.linalg.norm(x, axis=1).max())
    found = {f: search(x, ids, ids, x[q], q, np.full(len(q), -np.inf), 20, most, f) for f in (1.0, 0.5)}
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    recall = {f: np.mean([len(set(best.row[k]) & set(true[k])) / 20 for k in range(len(q))]) for f, (best, _) in found.items()}
    assert recall[1.0] == 1.0 and recall[0.5] >= 0.9
    assert found[0.5][1] < 0.7 * found[1.0][1] and found[1.0][1] < len(q) * 6000  # exact search leaves out what the triangle inequality rules out


def test_tree_leaves_hold_every_row_and_routing_agrees():
    points = on_sphere(vectors(3).astype(float), 20.0)
    tree = Tree(points, 25)
    leaves = [k for k, v in enumerate(tree.vantage) if v is None]
    held = np.concatenate([tree.order[slice(*tree.child[k])] for k in leaves])
    assert sorted(held) == list(range(len(points)))
    routed = tree.leaf_of(points)
    for k in leaves:
        assert set(tree.order[slice(*tree.child[k])]) == set(np.flatnonzero(routed == k))
    reached = {leaf for leaf, rows in tree.leaves_within(points[:1], np.array([np.inf]))}
    assert reached == set(leaves)
    near = {leaf for leaf, rows in tree.leaves_within(points[:1], np.array([0.0]))}
    assert int(routed[0]) in near and len(near) < len(leaves)
    assert inner_products(np.array([[1.0, 2.0]]), np.array([[3.0, 4.0]])).tolist() == [11.0]
