"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from voxloom.llm import byte_bpe, exact_dedup, licenses, merkle, mixing, ngram_join, packing, prefix_trie, quality, quotations, suffix_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_warc")
def _warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


@query("op2_quotations")
def _quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.conversations(_table(spark, folder, "conversations"))


@query("op4_license_scan")
def _licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_best_fit_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_documents(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op5_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query("op6_ngram_jaccard", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.d)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON d.doc_id = m.d""")
def _ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_quality_rules", r"""
WITH docs AS (SELECT doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text, host FROM docs),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM positions),
repeated AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM windows, (VALUES (0), (1), (2)) AS o(k) WHERE windows.n > 1 GROUP BY doc_id),
split AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
lines AS (SELECT doc_id, host, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines GROUP BY doc_id),
hashed AS (SELECT doc_id, host, pos, md5(array_to_string(w, ' ')) AS h, len(w) AS n FROM lines),
pages AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY pos)) AS page FROM hashed GROUP BY doc_id),
whole AS (SELECT d.doc_id, d.host, coalesce(p.page, '') AS page FROM docs d LEFT JOIN pages p ON d.doc_id = p.doc_id),
counted AS (SELECT w.host, l.h, count(DISTINCT w.page) AS n FROM whole w JOIN hashed l ON w.doc_id = l.doc_id GROUP BY w.host, l.h),
hosts AS (SELECT host, count(DISTINCT page) AS n FROM whole GROUP BY host),
often AS (SELECT c.host, c.h FROM counted c JOIN hosts o ON c.host = o.host WHERE c.n > 10 AND c.n > o.n * 0.05::DOUBLE),
lost AS (SELECT l.doc_id, sum(l.n)::BIGINT AS words, count(*)::BIGINT AS lines FROM hashed l JOIN often o ON l.host = o.host AND l.h = o.h GROUP BY l.doc_id),
base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.lines, 0)::BIGINT AS lines_removed, coalesce(l.words, 0)::BIGINT AS words_removed
  FROM words w LEFT JOIN dup d ON w.doc_id = d.doc_id LEFT JOIN repeated r ON w.doc_id = r.doc_id LEFT JOIN lost l ON w.doc_id = l.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - words_removed) >= n_words AS kept
FROM base""")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("text_key", "host")


@query("op8_byte_bpe")
def _byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query("op9_exact_dedup", r"""
WITH docs AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id FROM docs)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked""")
def _exact(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.copies(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op10_suffix_dedup")
def _suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.judge(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


CRC_SQL = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, with ``crc_table`` in the FROM clause."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of every level of each tree of ``leaves(tree, i, n, h)``, and what stands left and right of each in its run."""
    return f"""{name}_nodes(tree, l, n, i, h) AS (
  SELECT tree, 0, n, i, h FROM {leaves}
  UNION ALL SELECT tree, l + 1, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, l, n, i // 3),
{name}_beside AS (
  SELECT a.tree, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.l, a.i),
{name}_tops AS (SELECT tree, h FROM {name}_nodes WHERE n = 1)"""


@query("op11_merkle_manifest", rf"""
WITH RECURSIVE {CRC_SQL},
leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS now FROM documents, crc_table),
placed AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree_sql('low', 'placed')},
subroots AS (SELECT '' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low_tops),
{_tree_sql('top', 'subroots')},
low_walk(doc_id, tree, l, i, proof, h) AS (
  SELECT doc_id, tree, 0, i, '', now FROM placed
  UNION ALL SELECT w.doc_id, w.tree, w.l + 1, w.i // 3, w.proof || b.lft || b.rgt, sha256(b.lft || w.h || b.rgt) FROM low_walk w JOIN low_beside b ON w.tree = b.tree AND w.l = b.l AND w.i = b.i),
low_end AS (SELECT doc_id, tree, arg_max(proof, l) AS proof, arg_max(h, l) AS h FROM low_walk GROUP BY doc_id, tree),
top_walk(doc_id, l, i, proof, h) AS (
  SELECT e.doc_id, 0, s.i, e.proof, e.h FROM low_end e JOIN subroots s ON e.tree = s.source
  UNION ALL SELECT w.doc_id, w.l + 1, w.i // 3, w.proof || b.lft || b.rgt, sha256(b.lft || w.h || b.rgt) FROM top_walk w JOIN top_beside b ON w.l = b.l AND w.i = b.i),
top_end AS (SELECT doc_id, arg_max(proof, l) AS proof, arg_max(h, l) AS h FROM top_walk GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM placed p JOIN subroots s ON p.tree = s.source JOIN top_end e ON p.doc_id = e.doc_id, top_tops r""")
def _merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.lines_joined_audit(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_source_mixing")
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_prefix_trie", rf"""
WITH {CRC_SQL},
turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(h ORDER BY turn NULLS FIRST, h) AS hs, list(length(text) ORDER BY turn NULLS FIRST, h) AS cs FROM turns GROUP BY conv_id),
plan AS (SELECT conv_id, hs, cs, {_crc_sql('conv_id::VARCHAR')} % 6 AS h FROM own, crc_table),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.hs, [])[1:p.h], p.hs[p.h + 1:]) AS hs, list_concat(coalesce(b.cs, [])[1:p.h], p.cs[p.h + 1:]) AS cs
  FROM plan p LEFT JOIN own b ON b.conv_id = p.conv_id - p.conv_id % 100),
steps AS (SELECT conv_id, len(hs) AS n, hs, cs, unnest(range(0, len(hs) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT array_to_string(hs[1:depth], '') AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(cs[depth], 0)) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '') AS ends FROM steps GROUP BY 1, 2),
children AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM nodes v LEFT JOIN children c ON v.node = c.node),
below AS (SELECT left(node, 64 * above) AS node, (n_children = 0)::INT AS leaf, (n_convs - 1) * chars AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted)),
sums AS (SELECT node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM counted v JOIN sums s ON v.node = s.node LEFT JOIN nodes p ON v.depth > 0 AND p.node = left(v.node, 64 * (v.depth - 1))""")
def _trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversations_trie(_table(spark, folder, "conversations"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
