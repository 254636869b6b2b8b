"""The subpackage's registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parallaxis.llm import chat, idfiles, licences, mixture, pivots, prefixes, resampling, semantic, simhash, superkmers, toxicity, vectorcodes, warc
from parallaxis.llm._work import fresh_path, stored, table

CONTROL_CASE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control-string case, formatted, written, parsed back and digested."""
    case = chat.turns_of_records(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(CONTROL_CASE).alias("payload")))
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations")).unionByName(case)
    formatted = stored(chat.join_segments(chat.format_turns(turns)), "chat")
    return chat.read_back(formatted)


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ROLE]', '[\ROLE]'), '[TEXT]', '[\TEXT]') AS body,
    replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ROLE]', '[\ROLE]'), '[TEXT]', '[\TEXT]') AS said
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length(body) + CASE WHEN role = 'user' THEN 20 ELSE 19 + length(said) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep of their words when windows seen in smaller doc_ids go."""
    done = superkmers.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM n),
m AS (SELECT r, p, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM k),
c AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM m WHERE again),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
j AS (SELECT w.doc_id, w.ws, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM j
"""


#: Share of all documents that op3 draws, fewer than are good, and n-grams of evidence that it draws them by.
DRAWN, EVIDENCE = 0.5, 10


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of all documents, whether the classifier accepts each, and whether it is in a sample of DRAWN of all."""
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=DRAWN, evidence=EVIDENCE)
    return rows.withColumn("accepted", F.col("score") >= 0.5)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of all documents."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, looked up by URL key in the index, and read back by ranges."""
    path = fresh_path(spark, "warc")
    captures = warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.look_up(warc.build_index(captures, path), path, captures.select("key"))
    return warc.read_ranges(found, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights and sorted by position, with the position of each one's first words and their place in training order."""
    docs = table(spark, sf_dir, "documents")
    keys = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("source_key"),
        F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("queue"),
        F.coalesce(F.regexp_count("text", F.lit(mixture.WORD)), F.lit(0)).cast("long").alias("size"),
    )
    mixed = stored(mixture.place(keys.withColumn("row_id", F.monotonically_increasing_id())), "mixed")
    ordered = mixture.with_places(mixture.in_order(mixed, ["row_id", "doc_id"]))
    first = ordered.groupBy("row_id").agg(F.min("position").alias("first_position"), F.min("place").alias("first_place"))
    return mixed.join(first, "row_id", "left").select("doc_id", "size", "source_size", "target", "taken", "first_position", "first_place")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS q,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT k, sum(size)::DOUBLE AS source_size FROM d GROUP BY k),
r AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
o AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
    sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY source_size / weight, k) AS n
  FROM w),
f AS (SELECT n, free, rest FROM o WHERE free * weight / rest <= source_size * 2.0::DOUBLE ORDER BY n LIMIT 1),
t AS (SELECT o.k, o.kind, o.source_size, CASE WHEN f.n IS NULL OR o.n < f.n THEN o.source_size * 2.0::DOUBLE ELSE f.free * o.weight / f.rest END AS target FROM o LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.kind, t.source_size::BIGINT AS source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.q, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.k = t.k),
g AS (SELECT *, floor(target + 0.5::DOUBLE)::BIGINT AS goal FROM p),
h AS (
  SELECT *, greatest(0, least(size, goal - before))::BIGINT AS once, greatest(0, least(size, goal - source_size - before))::BIGINT AS twice FROM g),
a AS (
  SELECT row_number() OVER () AS r, * FROM h),
e AS (
  SELECT r, doc_id, kind, 0 AS pass, before / target::DOUBLE AS done FROM a WHERE once > 0
  UNION ALL SELECT r, doc_id, kind, 1 AS pass, (before + source_size) / target::DOUBLE AS done FROM a WHERE twice > 0),
z AS (
  SELECT r, doc_id, pass, round(CASE kind
    WHEN 0 THEN 2.0::DOUBLE * done / (sqrt(2.25::DOUBLE - 2.0::DOUBLE * done) + 1.5::DOUBLE)
    WHEN 1 THEN 2.0::DOUBLE * done / (sqrt(1.0::DOUBLE + 0.0::DOUBLE * done) + 1.0::DOUBLE)
    ELSE CASE WHEN done <= 0.375 THEN 2.0::DOUBLE * done / (sqrt(0.25::DOUBLE + 2.0::DOUBLE * done) + 0.5::DOUBLE)
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (done - 0.375::DOUBLE) / (sqrt(1.0::DOUBLE + 2.0::DOUBLE * (done - 0.375::DOUBLE)) + 1.0::DOUBLE) END
  END, 9) AS position FROM e),
n AS (SELECT r, position, row_number() OVER (ORDER BY position, doc_id, pass) - 1 AS place FROM z),
m AS (SELECT r, min(position) AS first_position, min(place) AS first_place FROM n GROUP BY r)
SELECT doc_id, size, source_size, target, once + twice AS taken, first_position, first_place
FROM a LEFT JOIN m USING (r)
"""


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that all documents hold."""
    return semantic.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def tokenizer() -> str:
    """Place of the tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to Huffman-coded files and read back."""
    path = fresh_path(spark, "ids")
    files = idfiles.write_ids(table(spark, sf_dir, "documents"), tokenizer(), path)
    return idfiles.read_documents(files, path)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS same, turn
  FROM conversations WHERE conv_id IS NOT NULL),
i AS MATERIALIZED (SELECT conv_id, strlen(text) AS bytes, same, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same) AS i FROM t),
z AS (SELECT conv_id, count(*) AS n FROM i GROUP BY conv_id),
h AS MATERIALIZED (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM z),
u AS MATERIALIZED (SELECT h.conv_id, h.base, h.h, h.n, least(h.h, coalesce(z.n, 0)) AS used FROM h LEFT JOIN z ON z.conv_id = h.base),
r AS (
  SELECT u.conv_id, i.i AS depth, i.same, i.bytes FROM u JOIN i ON i.conv_id = u.base AND i.i <= u.used
  UNION ALL SELECT u.conv_id, u.used + i.i - u.h, i.same, i.bytes FROM u JOIN i ON i.conv_id = u.conv_id AND i.i > u.h),
l AS MATERIALIZED (SELECT u.conv_id, coalesce(list(r.same ORDER BY depth) FILTER (r.same IS NOT NULL), []) AS path, coalesce(list(r.bytes ORDER BY depth) FILTER (r.same IS NOT NULL), []) AS bytes FROM u LEFT JOIN r ON r.conv_id = u.conv_id GROUP BY u.conv_id),
p AS MATERIALIZED (
  SELECT conv_id, d AS depth, len(path) = d AS ends, sha256(d::VARCHAR || array_to_string(path[1:d], '')) AS k, CASE WHEN d > 0 THEN sha256((d - 1)::VARCHAR || array_to_string(path[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM l)),
n AS MATERIALIZED (
  SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY k),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
b AS (
  SELECT p.k, sum(n.own) AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN c ON c.k = n.k GROUP BY p.k)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN b ON b.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n m ON m.k = n.up
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.books_digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the entries of round k, and the entries of the next."""
    return f"""a{k} AS MATERIALIZED (
  SELECT c.r, c.p, min(dist * 64 + e) AS best FROM (
    SELECT c.r, c.p, b.e, list_sum(list_transform(range(1, len(c.x) + 1), lambda j: (c.x[j] - b.x[j]) * (c.x[j] - b.x[j])))::BIGINT AS dist FROM c JOIN b{k} b ON b.p = c.p) c
  GROUP BY c.r, c.p),
s{k} AS (SELECT c.p, a.best % 64 AS e, j, sum(c.x[j])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN c ON c.r = a.r AND c.p = a.p CROSS JOIN w CROSS JOIN range(1, w.w + 1) t(j) GROUP BY c.p, a.best % 64, j),
m{k} AS (SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY j) AS x FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // 16 AS w FROM v),
c AS MATERIALIZED (SELECT r, p, v[p * w + 1:p * w + w] AS x FROM v CROSS JOIN w CROSS JOIN range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM c WHERE r <= 64),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2).split("s2 AS")[0].rstrip().rstrip(",")},
f AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
k AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT v.vec_id, f.code, f.error, sum(f.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f ON f.r = v.r CROSS JOIN k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_resampling": op3_quality_resampling,
    "op4_licence_scan": op4_licence_scan,
    "op5_warc_index": op5_warc_index,
    "op6_source_mixture": op6_source_mixture,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_pivots": op10_embedding_pivots,
    "op11_huffman_ids": op11_huffman_ids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op1_chat_format": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op6_source_mixture": OP6_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
