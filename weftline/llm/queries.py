"""The queries opN_<name> over whole tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.chat_format import as_chain, chat_format, loss_texts, turns_back
from weftline.llm.common import id_back, table
from weftline.llm.decontaminate import overlaps
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.fingerprints import edited, fingerprint, likeness
from weftline.llm.language_id import fitted, language_id, plain_text
from weftline.llm.line_dedup import line_dedup
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.prefix_trie import conversation_trie
from weftline.llm.sentencepiece_codec import round_trip
from weftline.llm.source_audit import source_audit
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.suffix_dedup import suffix_dedup
from weftline.llm.toxicity import fit, toxicity


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = edited(table(spark, sf_dir, "documents")).select("_id", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), *(fingerprint(F.col(c)).alias(f"_f{c}") for c in ("_text", "_edited", "_other")))
    near = [likeness(F.col("_f_text"), F.col(c)).alias(n) for c, n in (("_f_edited", "near_edited"), ("_f_other", "near_next"))]
    return both.select(id_back().alias("doc_id"), "n_chars", "edited_sha256", F.col("_f_text").alias("fingerprint"), F.col("_f_edited").alias("edited_fingerprint"), *near)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, fit(documents, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (text, declared language, address suffix and host from html and url), which have a ``page_id``."""
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").withColumn("shown", plain_text(F.col("html")))
    model = fitted(documents)
    none = F.lit(None).cast("long")
    told = [F.col("lang"), F.round("probability", 6).alias("probability"), F.col("declared"), F.col("suffix"), F.col("accepted")]
    own = language_id(documents, model=model).select("doc_id", none.alias("page_id"), *told)
    return own.union(language_id(pages, "page_id", "shown", None, "url", "html", model=model).select(none.alias("doc_id"), F.col("doc_id").alias("page_id"), *told))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: What the conversation -1 says in both of its turns.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = chat_format(as_chain(rows.union(probe), "conv_id", ["turn", "role", "text"]), tree_col="conv_id", score_col=None)
    read = done.select(F.col("tree_id").alias("conv_id"), "formatted", turns_back(F.col("formatted")).alias("_turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_near_dedup,
        op3_toxicity,
        op4_sentencepiece,
        op5_decontaminate,
        op6_substring_dedup,
        op7_language_id,
        op8_suffix_dedup,
        op9_chat_format,
        op10_line_dedup,
        op11_source_audit,
        op12_exact_dedup,
        op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (g) WHERE m < doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
  GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM r),
t AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM t GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM spans),
kept AS (
  SELECT d.doc_id, string_agg(substr(h, CAST(2 * e + 1 AS BIGINT), CAST(2 * (a - e) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS k, sum(b - a) AS gone, count(*) AS n
  FROM d JOIN cuts ON cuts.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op9_chat_format": r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length(role) + length(text) + 12 + 1 + 10 + 1
    + len(regexp_extract_all(role || chr(10) || text, '<\\*(\|(im_start|im_end|endoftext|startoftext|system|user|assistant|eot_id|start_header_id|end_header_id|begin_of_text|end_of_text)\|>|/?s>|<SYS>>|</SYS>>)'))
    + len(regexp_extract_all(role || chr(10) || text, '\[\\*/?(INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]')) AS size
  FROM all_rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM d WINDOW g AS (PARTITION BY t)""",
    # the CRC-32 of a decimal number, bit by bit, makes each conversation's head
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
own AS (SELECT conv_id, list({'id': id, 'w': w} ORDER BY turn NULLS FIRST, id) AS s FROM n GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM own),
re AS (SELECT c.conv_id, list_concat(coalesce(b.s, [])[1:c.h], c.s[c.h + 1:]) AS s FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, s[1:d] AS p, d, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM re)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * struct_extract(node.p[d], 'w') ELSE 0 END AS saved FROM node LEFT JOIN kid ON kid.p = node.p),
up AS (SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_node) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, parent.conv_id AS parent_conv_id, o.n_convs, o.n_children, up.n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(o.e) AS ends_sha256
FROM own_node o JOIN up ON up.p = o.p LEFT JOIN node parent ON o.d > 0 AND parent.p = o.p[1:o.d - 1]""",
    "op11_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tok AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10),
vocab AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(n), 0) AS n FROM grp LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source GROUP BY ALL),
p AS (
  SELECT tot.lang, tot.source, kept.term, coalesce(cnt.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (tot.n + 2 * vocab.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (kept.n + 2)) // (vocab.n + 2 * vocab.v) AS BIGINT) AS q
  FROM tot JOIN vocab ON vocab.lang = tot.lang JOIN kept ON kept.lang = tot.lang LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10""",
}
