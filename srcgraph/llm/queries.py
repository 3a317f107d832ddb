"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(finds: str) -> Column:
    """kind:start:end of an array of finds, comma-joined."""
    return F.expr(f"array_join(transform({finds}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, the number of base finds of each kind, their digest and all spans."""
    base = "filter(finds, f -> f.base)"
    counts = [F.expr(f"cast(size(filter(finds, f -> f.base and f.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("finds").alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the automata learn from published formats and from the documents' own plain finds."""
    from .secrets import KINDS, harvest, labelled, scan_secrets, train

    docs = _documents(spark, sf_dir)
    return _digest(scan_secrets(docs, train(labelled() + harvest(docs))), KINDS)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of more than 50 words that repeat in other documents."""
    from .compact_windows import repeated_passages

    return repeated_passages(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import KINDS, find_pii

    return _digest(find_pii(_documents(spark, sf_dir)), KINDS)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE tokens, encoded and decoded again."""
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    from .warc import archive_round_trip

    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM g
"""


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, likened to that of its edited text and to the next document's."""
    from .fingerprint import fingerprint_neighbours

    return fingerprint_neighbours(_documents(spark, sf_dir))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repetition measures and verdict."""
    from .repetition import score_repetition

    return score_repetition(_documents(spark, sf_dir))


#: The limits of repetition.NGRAM_LIMITS and the rest, stated once more.
OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
s AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (dup) AS n_dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (dup), 0) AS dup_chars FROM l GROUP BY 1),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (VALUES (3), (5), (6), (7), (8), (9), (10)) AS v(n))),
r AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM g WINDOW w AS (PARTITION BY doc_id, n, gram ORDER BY i)) WHERE CASE WHEN n = 3 THEN times > 1 ELSE nth > 1 END),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM r),
h AS (SELECT c.doc_id, c.n, count(*) AS covered, sum(length(p.word)) AS chars FROM c JOIN p ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY 1, 2),
k AS (SELECT h.doc_id, max(h.chars / greatest(1, word_chars)) FILTER (n > 3) AS worst, coalesce(max(covered) FILTER (n = 3), 0) AS n_repeat_words,
             coalesce(bool_or(h.chars > (20 - n)::DOUBLE / 100 * word_chars + 60) FILTER (n > 3), false) AS bad FROM h JOIN m USING (doc_id) GROUP BY 1),
f AS (SELECT m.*, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
             coalesce(bad, false) OR coalesce(n_dup > 0.3::DOUBLE * lines + 1 OR dup_chars > 0.2::DOUBLE * s.chars + 60, false) AS bad,
             coalesce(n_dup / lines, 0) AS dup_line_share, coalesce(dup_chars / greatest(1, s.chars), 0) AS dup_line_char_share, coalesce(worst, 0) AS max_ngram_share
      FROM m LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT (base_failed OR bad) AS kept, cast(dup_line_share AS DOUBLE) AS dup_line_share, cast(dup_line_char_share AS DOUBLE) AS dup_line_char_share, cast(max_ngram_share AS DOUBLE) AS max_ngram_share FROM f
"""


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under the lattice-backed unigram model."""
    import public_tokenizers

    from .lattice_lm import score_documents

    return score_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    from .mixing import mix_sources, quality_weights

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources(_documents(spark, sf_dir), quality_weights(labels)).drop("source", "text_hash")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of likeness 85 % or more of 4-word shingles."""
    from .prefix_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


OP9_SQL = """
WITH q AS (SELECT doc_id, avg(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS w FROM labels GROUP BY 1),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
             -ln((cast('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(q.w, 1.0)::DOUBLE AS key
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, weight, source IS NULL, encode(source)) AS place FROM n),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size) AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target, cast(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM r
"""

OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
g AS (SELECT doc_id, words, unnest(CASE WHEN len(words) >= 4 THEN range(1, len(words) - 2) WHEN len(words) > 0 THEN [1] ELSE [] END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_passages": op2_passages,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_fingerprint": op6_fingerprint,
    "op7_repetition": op7_repetition,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
}

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op7_repetition": OP7_SQL, "op9_mixing": OP9_SQL, "op10_ngram_join": OP10_SQL}
