"""The operators over whole tables with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fill_middle, fingerprints, jaccard_join, line_dedup, lm_scoring, mixture_packing, packing, piece_lattice, pii, prefix_trie, quality_rules, token_counts


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rules = quality_rules.learn_rules(docs, _table(spark, folder, "labels"))
    q = quality_rules.PREFIX
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality_rules.judged(docs, rules).select("doc_id", *[F.col(q + n).alias(n) for n in names])


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_held_out(_table(spark, folder, "documents"))


def op5_piece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    return piece_lattice.encode_nbest(_table(spark, folder, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.union(extra)))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link_groups(_table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    places, lengths = prefix_trie.rebuilt(prefix_trie.placed_turns(_table(spark, folder, "conversations")))
    return prefix_trie.prefix_trie(places, lengths)


def op12_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = mixture_packing.pack_mixture(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_line_dedup, op3_fingerprints, op4_lm_scoring, op5_piece_nbest, op6_personal_data, op7_packing, op8_chat_format, op9_token_counts, op10_jaccard_join, op11_prefix_trie, op12_mixture_packing, op13_fill_in_middle)
}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM shared UNION SELECT b, a FROM shared),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
""",
    "op11_prefix_trie": r"""
WITH convs AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (  -- crc32 bit by bit over the decimal id
  SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4 AS h FROM convs
), own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
prefixes AS (SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) = depth AS ended FROM members),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS n_words FROM prefixes GROUP BY prefix, depth
), edges AS (SELECT n.prefix, p.prefix AS above, p.conv_id AS parent_conv_id FROM nodes n JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
children AS (SELECT above AS prefix, count(*) AS n_children FROM edges GROUP BY above),
under AS (SELECT prefix, n_convs, n_words, unnest(range(0, depth + 1)) AS up FROM nodes),
sums AS (
  SELECT u.prefix[1:up] AS prefix, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * n_words) AS BIGINT) AS saved_tokens
  FROM under u LEFT JOIN children c ON c.prefix = u.prefix GROUP BY u.prefix[1:up]
)
SELECT n.conv_id, n.depth, e.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256, CAST(n.n_words AS BIGINT) AS n_words
FROM nodes n LEFT JOIN edges e ON e.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix JOIN sums s ON s.prefix = n.prefix
""",
    "op13_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units
), cut AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
""",
}
