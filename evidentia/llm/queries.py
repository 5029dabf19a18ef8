"""Thin queries over the driver's tables; each derives its contract's columns from an operator's result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch

WORD = r"[^\x20\x09-\x0D]+"
LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import read_token_ids, write_token_ids

    folder = scratch(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), 0)
    return read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules, train

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))


INJECTED = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import canonical_turns, format_chats, read_chats

    rows = table(spark, sf_dir, "conversations").select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    said = json.dumps({"id": -7, "messages": [{"role": r, "content": INJECTED} for r in ("user", "assistant")]})
    records = rows.unionByName(spark.range(1).select(F.parse_json(F.lit(said)).alias("record")))
    out = read_chats(format_chats(canonical_turns(records)))
    loss = F.array_join("learnt", "")
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal_quality import ordinal_quality, train

    docs = table(spark, sf_dir, "documents")
    return ordinal_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_sampling import sample_segmentations

    out = sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "rank", (F.octet_length("ids") / 2).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "score", "log_inclusion")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "families", "n_findings", "findings")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The twin of ``op13``: each round is a pair of tables, assignments and codebooks."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM
  (SELECT v.vec_id, v.label, v.part, v.x, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
   FROM v JOIN c{r} c ON c.part = v.part) GROUP BY ALL),""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, pos, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y
         FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{r}) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(y ORDER BY pos) AS x FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.part = c.part AND n.entry = c.entry),""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda y: y IS NULL OR NOT isfinite(y)))),
v AS MATERIALIZED (SELECT vec_id, label, part, list_slice(w, part * len(w) // {parts} + 1, (part + 1) * len(w) // {parts}) AS x FROM k, range({parts}) p(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < {entries}),{"".join(steps)}
e AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h"""


QUERIES = {
    "op11_simhash": op11_simhash,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
    "op7_license_scan": op7_license_scan, "op8_piece_sampling": op8_piece_sampling,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op9_chat_format": op9_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op5_packing": op5_packing,
    "op3_token_ids": op3_token_ids,
    "op10_jaccard_join": op10_jaccard_join, "op1_substring_dedup": op1_substring_dedup, "op2_exact_dedup": op2_exact_dedup}

ORACLES = {
    "op13_vector_codes": lloyd_sql(),
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
lc AS (SELECT lang, term, sum(c) AS c FROM gc GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(gc.c, 0) AS c, CAST(1 + (1000000000 * (coalesce(gc.c, 0) + 2)) // (gn.n + 2 * v.v) AS BIGINT) AS p
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gc ON gc.lang = gn.lang AND gc.source = gn.source AND gc.term = kept.term),
q AS (SELECT lc.lang, lc.term, CAST(1 + (1000000000 * (lc.c + 2)) // (ln.n + 2 * v.v) AS BIGINT) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10""",
    "op9_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(role, '[^\\\\#:<]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\\]', '', 'g'))
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) + 14) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_AZ}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
c AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.y AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS y FROM c GROUP BY x) m ON m.x = d.doc_id""",
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM win),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op2_exact_dedup": f"""
WITH n AS (SELECT doc_id, {LOWER_AZ} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
}
