"""Registered queries of this subpackage and the statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.session import read_table

from .common import documents, text_or_empty
from .conversations import damaged, repair
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .langid import held_out as language_held_out
from .langid import predict_language
from .lm_score import lm_scores
from .minhash import near_duplicates
from .mixing import mix, word_count
from .outliers import judged
from .quality import THRESHOLD, quality_scores
from .quality import held_out as quality_held_out
from .sharding import shard_slots
from .suffix_dedup import remove_repeats
from .tokens import read_documents, write_shards
from .whitening import whitened

SHARDS = 16


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id (law ``key``)."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return shard_slots(rows, "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents that bring each source near its target number of words."""
    rows = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of whole texts; one row for each document, dropped ones too."""
    return exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes under strings of 400 bytes that start more than once."""
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        (F.size("edges") / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, copied or re-parameterised: one row for each pair."""
    return contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op6_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by the byte-level network."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scores = quality_scores(docs, read_table(spark, sf_dir, "labels"))
    return scores.select(
        "doc_id",
        quality_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by the n-gram filters."""
    found = predict_language(documents(spark, sf_dir))
    return found.select("doc_id", language_held_out().alias("held_out"), "lang_pred", "score")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary; every executor's machine has the files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet-matrix shards, and each document read back from them."""
    return read_documents(write_shards(documents(spark, sf_dir), vocabulary()))


def op9_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts by the context tree, with the base of single words."""
    return lm_scores(documents(spark, sf_dir))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the leading 32 components of all of them."""
    return whitened(read_table(spark, sf_dir, "embeddings"))


def op12_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text: the base, and the outliers of each language and source."""
    return judged(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_byte_quality": op6_byte_quality,
    "op7_language_filters": op7_language_filters,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_context_tree_scores": op9_context_tree_scores,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_bit_sliced_whitening": op11_bit_sliced_whitening,
    "op12_robust_outliers": op12_robust_outliers,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jump_sharding": """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
rows AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents
),
hashed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM rows, crc_table
),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 8192 * 8192 AS piece FROM hashed
),
jumps AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS key,
    (-1)::BIGINT AS shard, 0::BIGINT AS next
  FROM numbered
  UNION ALL
  SELECT doc_id, stepped, next, floor((next + 1) * (2147483648.0::DOUBLE / ((stepped // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, next, (key * 2862933555777941757 + 1) % 18446744073709551616 AS stepped FROM jumps WHERE next < 16)
),
shards AS (SELECT doc_id, shard, next FROM jumps WHERE next >= 16)
SELECT n.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    ('0x' || substr(md5(coalesce(n.doc_id::VARCHAR, '') || ':' || piece), 1, 8))::BIGINT % 1024, n.doc_id NULLS FIRST, size, text_crc32, piece) - 1 AS slot,
  CASE WHEN next = 16 THEN 16 ELSE shard END::INTEGER AS grown_shard
FROM numbered n JOIN shards s ON n.doc_id IS NOT DISTINCT FROM s.doc_id
""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_suffix_dedup": """
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT n, s, md5(b[s + 1:s + 400]) AS h FROM (SELECT n, b, unnest(range(octet_length(b) - 399)) AS s FROM docs WHERE octet_length(b) >= 400)),
repeated AS (SELECT n, s FROM (SELECT n, s, count(*) OVER (PARTITION BY h) AS c FROM starts) WHERE c > 1),
marked AS (SELECT n, s, CASE WHEN s > lag(s) OVER (PARTITION BY n ORDER BY s) + 400 THEN 1 ELSE 0 END AS new FROM repeated),
spans AS (SELECT n, min(s) AS lo, max(s) + 400 AS hi FROM (SELECT n, s, sum(new) OVER (PARTITION BY n ORDER BY s) AS g FROM marked) GROUP BY n, g),
gaps AS (
  SELECT n, lag(hi, 1, 0) OVER (PARTITION BY n ORDER BY lo) AS a, lo AS z FROM spans
  UNION ALL SELECT n, max(hi), 9223372036854775807 FROM spans GROUP BY n
),
kept AS (SELECT g.n, string_agg(hex(b[a + 1:least(z, octet_length(b))]), '' ORDER BY a) AS k FROM gaps g JOIN docs d ON g.n = d.n GROUP BY g.n)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN runs IS NULL THEN b ELSE unhex(k) END) AS kept_sha256
FROM docs d LEFT JOIN (SELECT n, sum(hi - lo) AS removed, count(*) AS runs FROM spans GROUP BY n) r ON d.n = r.n LEFT JOIN kept ON d.n = kept.n
""",
    "op10_dart_minhash": """
WITH RECURSIVE nodes AS (
  SELECT row_number() OVER () AS n, t, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)
),
shingles AS (
  SELECT n, g, count(*) AS weight FROM (
    SELECT n, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g
    FROM nodes WHERE len(w) > 0
  ) GROUP BY ALL
),
totals AS (SELECT n, sum(weight) AS total FROM shingles GROUP BY n),
shared AS (
  SELECT x.n AS a, y.n AS b, sum(least(x.weight, y.weight)) AS common
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.n < y.n GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN totals x ON a = x.n JOIN totals y ON b = y.n
  WHERE common::DOUBLE / (x.total + y.total - common)::DOUBLE >= 0.8
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT n AS start, n FROM nodes UNION SELECT start, b FROM reach JOIN edges ON reach.n = edges.a),
firsts AS (SELECT n, min(doc_id) AS first FROM nodes JOIN documents ON t = coalesce(text, '') GROUP BY n),
classes AS (SELECT start, min(first) AS class_id FROM reach JOIN firsts ON reach.n = firsts.n GROUP BY start)
SELECT doc_id, class_id, doc_id = class_id AS kept
FROM documents JOIN nodes ON t = coalesce(text, '') JOIN classes ON nodes.n = start
""",
    "op13_conversation_repair": """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
      lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM conversations
),
picked AS (
  SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS pick
  FROM given, crc_table
),
damaged AS (
  SELECT c, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
    CASE pick WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN pick = 3 THEN 2 ELSE 1 END))
  FROM picked WHERE pick <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prior,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prior || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY c
),
best AS (
  SELECT c, n AS i, {'k': 0, 'a': ''} AS z, {'k': 10, 'a': 'II'} AS s, {'k': 5, 'a': 'I'} AS u, {'k': 0, 'a': ''} AS a FROM counts
  UNION ALL
  SELECT c, i, least(z, {'k': 5 + u.k, 'a': 'I' || u.a}, {'k': 10 + a.k, 'a': 'II' || a.a}),
    least(s, {'k': 5 + u.k, 'a': 'I' || u.a}, {'k': 10 + a.k, 'a': 'II' || a.a}),
    least(u, {'k': 5 + a.k, 'a': 'I' || a.a}), least(a, {'k': 5 + u.k, 'a': 'I' || u.a})
  FROM (
    SELECT b.c, b.i - 1 AS i,
      least({'k': 2 + z.k, 'a': 'D' || z.a}, {'k': stay + 1 + u.k, 'a': 'R' || u.a}, CASE letter WHEN 's' THEN {'k': stay + s.k, 'a': 'K' || s.a}
        WHEN 'u' THEN {'k': stay + u.k, 'a': 'K' || u.a} ELSE {'k': 1000000000, 'a': ''} END) AS z,
      least({'k': 2 + s.k, 'a': 'D' || s.a}, {'k': stay + 1 + u.k, 'a': 'R' || u.a},
        CASE WHEN letter = 'u' THEN {'k': stay + u.k, 'a': 'K' || u.a} ELSE {'k': 1000000000, 'a': ''} END) AS s,
      least({'k': 2 + u.k, 'a': 'D' || u.a}, {'k': stay + 1 + a.k, 'a': 'R' || a.a},
        CASE WHEN letter = 'a' THEN {'k': stay + a.k, 'a': 'K' || a.a} ELSE {'k': 1000000000, 'a': ''} END) AS u,
      least({'k': 2 + a.k, 'a': 'D' || a.a}, {'k': stay + 1 + u.k, 'a': 'R' || u.a},
        CASE WHEN letter = 'u' THEN {'k': stay + u.k, 'a': 'K' || u.a} ELSE {'k': 1000000000, 'a': ''} END) AS a
    FROM best b JOIN (SELECT c, i, letter, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 100000000 END AS stay FROM faulty) f
      ON b.c = f.c AND b.i = f.i
  )
),
edits AS (
  SELECT c, p, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY p) AS i
  FROM (SELECT c, unnest(range(1, length(z.a) + 1)) AS p, z.a AS audit, substr(audit, p, 1) AS e FROM best WHERE i = 0)
),
said AS (
  SELECT e.c, p, e, letter, role, text, row_number() OVER (PARTITION BY e.c ORDER BY p) AS k
  FROM edits e LEFT JOIN faulty f ON e.c = f.c AND e.i = f.i WHERE e <> 'D'
),
told AS (
  SELECT c, p, CASE WHEN e = 'K' THEN role WHEN (k + CASE WHEN first_value(e = 'K' AND letter = 's') OVER (PARTITION BY c ORDER BY p) THEN 1 ELSE 0 END) % 2 = 1
      THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
  FROM said
),
texts AS (SELECT c, string_agg(line, chr(10) ORDER BY p) AS line FROM told GROUP BY c)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.k, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit,
  sha256(coalesce(line, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM given) g LEFT JOIN counts n ON g.c = n.c LEFT JOIN best b ON g.c = b.c AND b.i = 0 LEFT JOIN texts t ON g.c = t.c
""",
}
