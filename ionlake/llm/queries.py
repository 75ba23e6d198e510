"""The registered queries of this subpackage and their SQL.

SQL stands for what it can express: all of op4, op6, op8, op11, op12 and op13, and, as queries of their own, the base
columns of op3 and op5 and the round trip of op7. The rest of op1 (a tokenizer), op2 and op9 (fitted
models), op3 and op5 (context trees and Markov models), op7 and op10 (optimal splits and signatures)
has no SQL form; the tests compare those results with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .exact_dedup import exact_dedup
from .language_id import language_id
from .lm_score import lm_score
from .merkle import fold_proofs, merkle_manifest, tampered_leaf
from .near_dedup import near_dedup
from .packing import pack_documents
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .sentence_pieces import decode_pieces, encode_pieces
from .sharding import shard_by_bytes
from .spelling import spelling_variants
from .vantage_trees import nearest_neighbours


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 9))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), shards=8)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    proofs = fold_proofs(merkle_manifest(docs, carry={"claimed": tampered_leaf(docs)}), claim="claimed")
    digests = (F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root"))
    return proofs.select("doc_id", *digests, "proof_sha256", F.lower(F.hex("folded_root")).alias("folded_root"), "verified")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def lm_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word unigram columns of op3."""
    return lm_score(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5's fixed patterns."""
    return secret_scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


def pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of op7's encoding, decoded."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return decode_pieces(encode_pieces(documents(spark, sf_dir), path), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "lm_base_score": lm_base_score,
    "secret_base_counts": secret_base_counts,
    "pieces_round_trip": pieces_round_trip,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
CRC_STEPS = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, a byte at a time over the table of CRC_STEPS."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""WITH own AS (SELECT doc_id, {LOWERED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM own WINDOW same AS (PARTITION BY norm)""",
    "op6_quality_rules": f"""WITH own AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, {WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM own),
windows AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
often AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM often, range(5) AS r(j) GROUP BY k),
measured AS (SELECT k, doc_id, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (k)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS bad FROM judged GROUP BY source),
moments AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var > 0 THEN least(10000.0, greatest(2.0, mean * (1 - mean) / var - 1)) ELSE 2.0 END AS strength FROM moments),
rates AS (SELECT source, (bad + mean * strength) / (n + strength) AS host_rate, n + strength + 1 AS weight FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rate - 2 * sqrt(host_rate * (1 - host_rate) / weight) > least(0.6, greatest(0.2, 4 * mean))) AS kept, round(host_rate, 9) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source, moments""",
    "op8_sharding": f"""WITH {CRC_STEPS},
own AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
placed AS (SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER o - 1 AS place FROM own WINDOW o AS (ORDER BY digest, doc_id NULLS FIRST)),
same AS (SELECT digest, min(before) AS low, max(before + size) AS high, min(place) AS first, max(place) + 1 AS after FROM placed GROUP BY digest),
total AS (SELECT sum(size) AS bytes FROM own),
targets AS (SELECT k, bytes * k // 8 AS cut, bytes FROM total, range(1, 8) AS r(k)),
hits AS (SELECT k, cut, bytes, before, size, place, low, high, first, after FROM targets JOIN placed ON before <= cut AND cut < before + size JOIN same USING (digest)),
cuts AS (SELECT k, CASE WHEN whole AND cut - low <= high - cut THEN low WHEN whole THEN high WHEN cut - before <= before + size - cut THEN before ELSE before + size END AS edge,
  CASE WHEN whole AND cut - low <= high - cut THEN first WHEN whole THEN after WHEN cut - before <= before + size - cut THEN place ELSE place + 1 END AS rows_before
  FROM (SELECT *, high - low <= greatest(size, 0.01 * bytes / 8) AS whole FROM hits))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST((SELECT count(*) FROM cuts WHERE edge <= before) AS INTEGER) AS shard,
  CAST(place - coalesce((SELECT max(rows_before) FROM cuts WHERE edge <= before), 0) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed""",
    "op11_spelling_variants": f"""WITH RECURSIVE {CRC_STEPS},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM seen, crc),
noisy AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS form_n FROM near GROUP BY word),
formed AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * words.n THEN other END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form, word AS root FROM formed UNION ALL SELECT chain.word, formed.form, formed.word FROM chain JOIN formed ON chain.form = formed.word)
SELECT word, n, n_near, formed.form, form_n, root FROM formed JOIN chain USING (word) WHERE chain.form IS NULL""",
    "op12_merkle_manifest": f"""WITH RECURSIVE {CRC_STEPS},
own AS (SELECT *, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS counted, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS grown,
  {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang"))} AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
  doc_id IS NOT NULL AND {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AS hit FROM documents, crc),
hashed AS (SELECT doc_id, lang, sha256(head || counted || tail) AS leaf, sha256(head || CASE WHEN hit THEN grown ELSE counted END || tail) AS claim FROM own),
leaves AS (SELECT *, row_number() OVER g - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size, row_number() OVER () AS k FROM hashed WINDOW g AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (SELECT lang, 0 AS lvl, pos, leaf AS digest, size FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY lang, lvl, pos // 2, size),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper AS (SELECT 0 AS lvl, pos, subroot AS digest, size FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM upper WHERE size > 1 GROUP BY lvl, pos // 2, size),
steps AS (SELECT k, lvl, leaves.pos >> lvl AS at, nodes.digest AS sibling FROM leaves JOIN nodes ON leaves.lang IS NOT DISTINCT FROM nodes.lang AND nodes.pos = xor(leaves.pos >> lvl, 1)
  UNION ALL SELECT k, 100 + lvl, subroots.pos >> lvl, upper.digest FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang JOIN upper ON upper.pos = xor(subroots.pos >> lvl, 1)),
proofs AS (SELECT k, sha256(string_agg(sibling, '' ORDER BY lvl)) AS proof FROM steps GROUP BY k),
levels AS (SELECT k, lvl, level, up FROM leaves JOIN (SELECT DISTINCT lang, lvl, size > 1 AS up, lvl AS level FROM nodes) n ON leaves.lang IS NOT DISTINCT FROM n.lang
  UNION ALL SELECT k, 100 + lvl, lvl, up FROM leaves, (SELECT DISTINCT lvl, size > 1 AS up FROM upper)),
walk AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY lvl) AS step, lvl FROM levels WHERE up),
folded AS (SELECT k, 0 AS step, claim AS digest FROM leaves
  UNION ALL SELECT f.k, f.step + 1, sha256(CASE WHEN s.k IS NULL THEN digest WHEN s.at % 2 = 0 THEN digest || sibling ELSE sibling || digest END)
  FROM folded f JOIN walk w ON w.k = f.k AND w.step = f.step + 1 LEFT JOIN steps s ON s.k = w.k AND s.lvl = w.lvl),
ends AS (SELECT k, first(digest ORDER BY step DESC) AS folded_root FROM folded GROUP BY k),
root AS (SELECT digest AS root FROM upper WHERE size = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang JOIN ends USING (k) LEFT JOIN proofs USING (k), root""",
    "op13_nearest_neighbours": """WITH own AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM own q JOIN own c ON q.vec_id % 20 = 0 AND q.k <> c.k)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW o AS (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER o <= 20""",
    "lm_base_score": f"""WITH {CRC_STEPS},
own AS (SELECT row_number() OVER () AS k, doc_id, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 1 AS held_out, list_append({WORDS.format(LOWERED)}, ' ') AS tokens FROM documents, crc),
spread AS (SELECT k, held_out, unnest(tokens) AS token FROM own),
counts AS (SELECT token, count(*) AS c FROM spread WHERE NOT held_out GROUP BY token),
totals AS (SELECT sum(c) AS n, count(*) AS v FROM counts),
scores AS (SELECT k, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS score FROM spread LEFT JOIN counts USING (token), totals GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(score, 4) AS base_score FROM own JOIN scores USING (k), totals""",
    "secret_base_counts": r"""SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM documents""",
    "pieces_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
