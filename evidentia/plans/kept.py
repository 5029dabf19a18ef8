"""Queries of what is kept between runs: stores, merges, extraction, seeds, whole ledgers as files, short needles.

The twins state in SQL what a key or a row must come to; none of them keeps anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import extraction, gates, merge, publishing, retrieval
from ..sources import files, snapshots
from ..sources.store import Store, scratch, state_of
from .cases import _BOOK, _book, t

#: The kept chunks of a table of documents, by session, table and state of its files.
_KEPT: dict[tuple[str, str, str], retrieval.ChunkStore] = {}


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one chunk."""
    docs = t(spark, d, "documents")
    return docs.select(F.format_string("src_%d#c0000", "doc_id").alias("chunk_id"), F.format_string("src_%d", "doc_id").alias("source_id"), "doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def kept_chunks(spark: SparkSession, d: str) -> retrieval.ChunkStore:
    """The chunk store over ``documents``: written when first asked for, and again when the table's files have changed."""
    key = spark.sparkContext.applicationId, d, state_of(spark, f"{d}/documents.parquet")
    if key not in _KEPT:
        _KEPT[key] = retrieval.ChunkStore(spark, scratch(spark, "chunks"))
        _KEPT[key].publish(chunks(spark, d))
    return _KEPT[key]


def chunk_store_reads(spark, d):
    """The chunks of all toxic documents, out of the buckets that they lie in."""
    wanted = t(spark, d, "labels").filter("toxic = 1").select(F.format_string("src_%d", "doc_id").alias("source_id"))
    found = kept_chunks(spark, d).chunks_of(wanted)
    return found.select("chunk_id", "source", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha256"))


def needle_spans(spark, d):
    """Marks, insides of words and other needles of one to six characters, in all documents."""
    needles = t(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.expr("substring(text, 1 + item_id % 9, 1 + item_id % 6)").alias("text"))
    marks = t(spark, d, "nation").select((-F.col("n_nationkey") - 1).alias("passage_id"), F.expr("get(array('.', ', ', '\\n', '  ', '--', '?', ' a ', 'é', '\\n\\n', '%', '...', ')', '«'), n_nationkey)").alias("text")).filter("text is not null")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = retrieval.find_passages(docs, needles.unionByName(marks))
    return found.groupBy("passage_id").agg(F.count("*").alias("n"), F.sum(F.col("span_start").cast("long")).alias("starts"), F.min(F.col("span_end") - F.col("span_start")).cast("long").alias("length"))


def _merged_claims(spark, d):
    known = t(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit("known").alias("state"), F.col("c_acctbal").alias("number"))
    batch = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("number"), F.col("o_orderkey").alias("seq"))
    return merge.merge(known, batch, "id", "seq", F.when(F.col("seq") % 7 == 0, "out of scope"))


def claims_merged(spark, d):
    return _merged_claims(spark, d)[0]


def claim_outcomes(spark, d):
    return _merged_claims(spark, d)[1]


def _merged_sources(spark, d):
    docs = t(spark, d, "documents")
    known = docs.select(F.col("source").alias("id")).distinct().filter("id like '%2' or id like '%5'").selectExpr("id", "'known' title", "'A' tier", "'why' tier_reason", "-1L retrieved_at", "'ready' status", "cast(null as string) error")
    batch = docs.selectExpr("source id", "concat('doc ', doc_id) title", "get(array('A', 'B', null, 'D'), cast(doc_id % 4 as int)) tier", "'new' tier_reason", "doc_id retrieved_at", "'pending' status", "if(doc_id % 11 = 0, 'gone', null) error", "doc_id seq")
    return merge.merge_sources(known, batch, "seq")


def sources_merged(spark, d):
    return _merged_sources(spark, d)[0]


def source_outcomes(spark, d):
    return _merged_sources(spark, d)[1]


def extraction_outcomes(spark, d):
    """Unchanged, confirmed, changed, forced, new, tampered, outdated, failed and missing captures of all documents."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    canonical = text.normalize(F.col("t"))
    stored = docs.filter("k % 6 <> 4").select(
        F.col("k").alias("source_id"), canonical.alias("text"), F.expr("sha2(concat('raw', k), 256)").alias("raw_sha256"), F.when(F.col("k") % 35 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2(canonical, 256)).alias("normalized_sha256"),
        F.expr("if(k % 37 = 0, 0, 1)").alias("normalizer_version"))
    captured = docs.filter("k % 29 <> 0").select(
        F.col("k").alias("source_id"), F.lit("text/plain").alias("media_type"), F.encode(F.expr("concat(t, if(k % 6 in (2, 3), ' more', '  '))"), "UTF-8").alias("content"),
        F.expr("if(k % 41 = 0, null, sha2(concat(if(k % 6 = 0, 'raw', 'new'), k), 256))").alias("raw_sha256"), F.expr("if(k % 31 = 0, 'failed', 'pending')").alias("status"), F.expr("k % 6 = 3").alias("force"))
    kept = Store(spark, scratch(spark, "texts"))
    kept.publish({"texts": stored})
    done = extraction.extract(captured, kept.read("texts"), F.col("force"))
    return done.select(F.col("source_id").alias("doc_id"), "outcome", "code", F.sha2("text", 256).alias("sha256"))


def records_written_back(spark, d):
    """Two versions of a table as JSON lines; the first one stays readable beside the second."""
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    folder = scratch(spark, "records")
    first = files.write_records(rows, folder, "id")
    again = files.read_records(spark, folder).withColumn("status", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("status")))
    second = files.write_records(again, folder, "id")
    return files.read_records(spark, folder, first).withColumn("version", F.lit(1)).unionByName(files.read_records(spark, folder, second).withColumn("version", F.lit(2)))


def _two_seeds(spark, d):
    store = Store(spark, scratch(spark, "seeds"))
    docs = t(spark, d, "documents")
    sources, texts = docs.select(F.col("doc_id").alias("source_id"), "lang"), docs.select(F.col("doc_id").alias("source_id"), "text")
    first = snapshots.freeze(store, sources, texts)
    second = snapshots.freeze(store, sources, texts.withColumn("text", F.when(F.col("source_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return store, first, second


def seed_pinned(spark, d):
    """The first of two seeds as it was, after the second one has changed a fifth of the texts."""
    store, first, _ = _two_seeds(spark, d)
    return snapshots.thaw(spark, store, first).select(F.col("source_id").alias("doc_id"), "lang", F.sha2("text", 256).alias("sha256"), "code")


def seed_blobs(spark, d):
    """How many texts each of two seeds brought: the second one only what is new in it."""
    store, _, _ = _two_seeds(spark, d)
    counts = [store.read(n).agg(F.count("*").alias("texts"), F.countDistinct("digest").alias("digests")).withColumn("name", F.lit(n)) for n in ("blobs_0000", "blobs_0001")]
    return counts[0].unionByName(counts[1])


def ledger_files(spark, d):
    """A ledger written as part files and read back: their lines and bytes."""
    folder = scratch(spark, "ledger")
    files.write_lines(_book(spark, d).ledger("md"), folder)
    listed = spark.read.option("multiLine", True).json(f"{folder}/parts.json").agg(F.sum("bytes").alias("bytes"), F.max(F.col("offset") + F.col("bytes")).alias("end"))
    read = spark.read.text(f"{folder}/parts").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("read"), F.count_if(F.col("value").startswith("   - tier")).alias("sources"))
    return listed.crossJoin(read)  # a row each


def dialogue_one_script(spark, d):
    """The pauses of one script that has the turns of all conversations as its lines, a segment for each five hundred conversations."""
    lines = t(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("n"), F.floor(F.col("conv_id") / 500).alias("segment"), F.col("role").alias("speaker"), F.concat(F.coalesce("text", F.lit("")), F.expr("get(array('', ' \\n\\t', '.\\r\\n', '!\"  \\n \\n'), cast(turn % 4 as int))")).alias("text"))
    return publishing.dialogue_plan(lines).select("segment_id", F.col("pause_after_ms").cast("long").alias("pause_after_ms"))


def locators_folded(spark, d):
    """Paths with empty, single and double steps, inside and outside a workspace."""
    made = F.expr("get(array(concat('/w/a/../b/./', k), concat('.//x/', k), concat('../out', k), concat('/other/../z', k), concat('a\\\\b\\\\', k), concat('/w/../w/c/', k), concat('a/b/../../../', k), concat('/../w//', k)), cast(k % 8 as int))")
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumn("raw", made).select("k", ids.canonical_locator(F.lit("file"), F.col("raw"), "/w").alias("locator"))


def workspace_reports(spark, d):
    """Customers as workspaces, their orders as sources."""
    spaces = t(spark, d, "customer").selectExpr(
        "c_custkey workspace", "0 n_blockers", "c_custkey % 5 revise_count", "2 n_chunked", "c_custkey % 2 = 0 has_index", "true has_plan", "1 n_claims", "0 n_open", "1 n_artifacts", "1 n_injected", "c_custkey % 3 = 0 has_provenance", "if(c_custkey % 4 = 0, 'VERIFY', 'RENDER') stored_state")
    sources = t(spark, d, "orders").selectExpr("o_custkey workspace", "get(array('ready', 'pending', 'failed'), cast(if(o_orderstatus = 'F', 0, if(o_orderstatus = 'P', 1, 2)) as int)) status")
    return publishing.status_report(spaces, sources).drop("stored_state", "revise_count")


def artifact_list(spark, d):
    """Built files named after pages; some hold a ledger between its markers."""
    rows = t(spark, d, "pages").select(F.expr("concat(get(array('build/', 'build/deep/', 'dist/'), cast(page_id % 3 as int)), if(page_id % 50 = 0, 'ledger', concat('p', page_id)), if(page_id % 4 = 1, '.txt', '.html'))").alias("path"),
        F.expr("concat(html, if(page_id % 2 = 0, '<!-- LEDGER --><ol class=\"ledger\"></ol>', '<!-- LEDGER -->'), if(page_id % 5 = 0, '', '<!-- /LEDGER -->'))").alias("html"))
    return publishing.artifacts(rows)


def package_written(spark, d):
    """A public package of documents as sources and claims, written and read back."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("k"), "source", F.coalesce("text", F.lit("")).alias("text"))
    quote = "if(k % 2 = 0, substring(text, 1, 10), repeat('q', 201))"
    evidence = F.expr(f"array(named_struct('source_id', source, 'start', cast(k as int), 'end', cast(k + 1 as int), 'quote', {quote}, 'quote_sha256', cast(null as string), 'length', cast(null as int), 'redacted', false))")
    held = docs.select(F.col("k").alias("id"), F.lit("active").alias("status"), F.lit("reported").alias("confidence"), evidence.alias("evidence"))
    sources = docs.select(F.col("source").alias("id")).distinct().select("id", F.lit("file").alias("kind"), F.expr("if(id like '%1', concat('https://x/', id), id)").alias("locator"), F.expr("concat('/w/', id)").alias("canonical_locator"), F.lit("A").alias("tier"), F.lit("x").alias("notes"))
    ordered = docs.select(F.col("k").alias("id"), F.col("k").alias("ordinal"))
    watch = gates.Watch()
    notes = gates.notes(gates.confidence(held, watch), watch)
    store = Store(spark, scratch(spark, "package"))
    publishing.package(store, sources, held, docs.select(F.concat(F.lit("t/"), F.col("k").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")), notes, "why?", "2024-01-01T00:00:00Z", ordered)
    told = store.read("provenance").agg(F.count("*").alias("sources"), F.count("locator").alias("told"), F.count("canonical_locator").alias("paths"))
    return store.read("summary").crossJoin(told).crossJoin(store.read("checksums").agg(F.count("*").alias("files"))).crossJoin(store.read("report").agg(F.count("*").alias("gates"))).crossJoin(store.read("evidence").agg(F.count("quote").alias("quotes")))  # a row each


QUERIES = {f.__name__: f for f in (
    chunk_store_reads, needle_spans, claims_merged, claim_outcomes, sources_merged, source_outcomes, extraction_outcomes, records_written_back, seed_pinned, seed_blobs, ledger_files, dialogue_one_script,
    locators_folded, workspace_reports, artifact_list, package_written,
)}

_CANON = r"rtrim(regexp_replace(regexp_replace(nfc_normalize({}), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') || chr(10)"
_TAKEN = "o AS (SELECT o_custkey AS id, o_orderstatus AS state, o_totalprice AS number, o_orderkey AS seq, o_orderkey % 7 = 0 AS bad FROM orders), k AS (SELECT c_custkey AS id, c_acctbal AS number FROM customer WHERE c_custkey % 3 <> 0)"
_DOCS = "b AS (SELECT source AS id, 'doc ' || doc_id AS title, ['A', 'B', NULL, 'D'][doc_id % 4 + 1] AS tier, doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN 'gone' END AS error, source LIKE '%2' OR source LIKE '%5' AS known FROM documents)"

ORACLES = {
    "locators_folded": "SELECT p_partkey AS k, ['b/', 'x/', '../out', '/other/../z', 'a/b/', 'c/', 'a/b/../../../', ''][p_partkey % 8 + 1] || p_partkey AS locator FROM part",
    "workspace_reports": """WITH s AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'P') AS waiting FROM orders GROUP BY 1),
w AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(ready, 0) AS ready, coalesce(waiting, 0) AS waiting FROM customer LEFT JOIN s ON c = c_custkey),
x AS (SELECT *, CASE WHEN k % 5 >= 3 THEN 'BLOCKED' WHEN n = 0 THEN 'INIT' WHEN waiting > 0 OR ready = 0 THEN 'COLLECT' WHEN ready > 2 THEN 'EXTRACT' WHEN k % 2 <> 0 THEN 'CHUNK' WHEN k % 3 = 0 THEN 'DONE' WHEN k % 4 = 0 THEN 'VERIFY' ELSE 'RENDER' END AS state FROM w)
SELECT k AS workspace, state, n AS sources, ready AS sources_ready, waiting AS sources_unsettled, CASE state WHEN 'BLOCKED' THEN 'unblock' WHEN 'INIT' THEN 'add' WHEN 'COLLECT' THEN 'extract' WHEN 'EXTRACT' THEN 'chunk' WHEN 'CHUNK' THEN 'index' WHEN 'DONE' THEN 'nothing' WHEN 'VERIFY' THEN 'package' ELSE 'verify' END AS next FROM x""",
    "artifact_list": "SELECT 'build/p' || page_id || '.html' AS path, page_id % 2 = 0 AND page_id % 5 <> 0 AS injected FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 1 AND page_id % 50 <> 0",
    "package_written": """WITH d AS (SELECT doc_id AS k, source, CASE WHEN doc_id % 2 = 0 THEN length(substr(coalesce(text, ''), 1, 10)) ELSE 201 END AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS i FROM d WHERE k % 2 = 0 AND n > 0), g AS (SELECT count(*) AS granted FROM r WHERE i <= 3), a AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS files, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (source LIKE '%1') AS told FROM documents)
SELECT 1 AS schema_version, '2024-01-01T00:00:00Z' AS generated_at, 'why?' AS question, 'public' AS visibility, a.n AS claims, a.n - granted AS redacted_quotes, sources, told, 0::BIGINT AS paths, files, 1::BIGINT AS gates, granted AS quotes FROM a, g""",
    "chunk_store_reads": "SELECT 'src_' || doc_id || '#c0000' AS chunk_id, source, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256(coalesce(text, '')) AS sha256 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "needle_spans": """WITH n AS (SELECT item_id AS passage_id, substr(text, CAST(1 + item_id % 9 AS INT), CAST(1 + item_id % 6 AS INT)) AS x FROM benchmark UNION ALL
SELECT -n_nationkey - 1, ['.', ', ', chr(10), '  ', '--', '?', ' a ', 'é', chr(10) || chr(10), '%', '...', ')', '«'][n_nationkey + 1] FROM nation WHERE n_nationkey < 13)
SELECT passage_id, count(*) AS n, CAST(sum(instr(d.text, n.x) - 1) AS BIGINT) AS starts, CAST(min(length(x)) AS BIGINT) AS length FROM n JOIN documents d ON contains(d.text, n.x) WHERE length(x) > 0 GROUP BY passage_id""",
    "claims_merged": f"""WITH {_TAKEN}, l AS (SELECT id, arg_max(state, seq) AS state, arg_max(number, seq) AS number FROM o WHERE NOT bad GROUP BY id)
SELECT id, state, number FROM l UNION ALL SELECT id, 'known', number FROM k ANTI JOIN l USING (id)""",
    "claim_outcomes": f"""WITH {_TAKEN}, f AS (SELECT id, min(seq) AS first FROM o WHERE NOT bad GROUP BY id)
SELECT seq, o.id, CASE WHEN bad THEN 'refused' WHEN seq = first AND k.id IS NULL THEN 'added' ELSE 'replaced' END AS outcome, CASE WHEN bad THEN 'out of scope' END AS detail FROM o LEFT JOIN f ON f.id = o.id LEFT JOIN k ON k.id = o.id""",
    "sources_merged": f"""WITH {_DOCS}, e AS (SELECT id, any_value(known) AS known, arg_min(title, seq) AS title, list(tier ORDER BY seq DESC)[1] AS tier, max(seq) AS retrieved_at, list(error ORDER BY seq)[1] AS error FROM b GROUP BY id)
SELECT id, CASE WHEN known THEN 'known' ELSE title END AS title, tier, 'new' AS tier_reason, retrieved_at, CASE WHEN known THEN 'ready' WHEN error IS NOT NULL THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT known THEN error END AS error FROM e""",
    "source_outcomes": f"""WITH {_DOCS}, f AS (SELECT id, min(seq) AS first FROM b GROUP BY id)
SELECT seq, b.id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN seq = first AND NOT known THEN 'added' ELSE 'refreshed' END AS outcome, error AS detail FROM b JOIN f USING (id)""",
    "extraction_outcomes": f"""WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, k % 6 <> 4 AS stored, k % 29 <> 0 AS captured, k % 6 = 3 AND k % 29 <> 0 AS forced, {_CANON.format('t')} AS old, {_CANON.format("t || CASE WHEN k % 6 IN (2, 3) THEN ' more' ELSE '  ' END")} AS new FROM d),
m AS (SELECT *, stored AND NOT forced AND (k % 35 = 0 OR k % 37 = 0) AS moved FROM s WHERE stored OR captured),
o AS (SELECT *, CASE WHEN NOT captured THEN CASE WHEN moved THEN 'drifted' ELSE 'pending' END WHEN k % 31 = 0 THEN 'failed' WHEN moved THEN 'drifted' WHEN k % 6 = 0 AND k % 41 <> 0 THEN 'unchanged' WHEN k % 41 = 0 THEN 'pending'
WHEN NOT regexp_matches(new, '\\S') THEN 'needs_extraction' WHEN forced THEN 'forced' WHEN NOT stored THEN 'extracted' WHEN new = old THEN 'confirmed' ELSE 'drifted' END AS outcome FROM m)
SELECT k AS doc_id, outcome, CASE WHEN outcome = 'drifted' THEN 'E-NORM-DRIFT' END AS code, CASE WHEN outcome IN ('forced', 'extracted', 'confirmed') THEN sha256(new) WHEN stored THEN sha256(old) END AS sha256 FROM o""",
    "records_written_back": "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS note, 1 AS version FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, o_orderpriority, 2 FROM orders",
    "seed_pinned": "SELECT doc_id, lang, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS code FROM documents",
    "seed_blobs": """SELECT 'blobs_0000' AS name, count(DISTINCT text) AS texts, count(DISTINCT text) AS digests FROM documents UNION ALL
SELECT 'blobs_0001', count(*), count(*) FROM (SELECT text || '!' FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL EXCEPT SELECT text FROM documents)""",
    "ledger_files": f"""WITH {_BOOK}, l AS (SELECT 0 AS o, '# Ledger' || chr(10) AS line UNION ALL
SELECT ordinal, CASE WHEN ordinal > 1 THEN chr(10) ELSE '' END || ordinal || '. **' || text || '**  ' || chr(10) || '   `' || label || CASE WHEN k % 2 = 0 THEN ' moving' ELSE '' END || '`' || CASE WHEN k % 2 = 0 THEN ' · as of 2024-01-01' ELSE '' END
|| CASE k % 3 WHEN 0 THEN ' · [recheck](https://x/y)' WHEN 1 THEN ' · recheck URL withheld; not an http(s) address: ftp://x' ELSE '' END || chr(10) || '   - tier ' || tier || ' · ' || title || ' · '
|| CASE WHEN shown THEN '"said <' || k || '>"' ELSE 'chars ' || k || '-' || (k + 9) END FROM e)
SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(line) + 1) AS BIGINT) AS "end", CAST(sum(strlen(line) + 1) AS BIGINT) AS read, CAST(sum(length(line) - length(replace(line, chr(10), '')) + 1) AS BIGINT) AS lines, count(*) - 1 AS sources FROM l""",
    "dialogue_one_script": r"""WITH w AS (SELECT conv_id * 10000 + turn AS n, conv_id // 500 AS segment, role, coalesce(text, '') || ['', chr(32) || chr(10) || chr(9), '.' || chr(13) || chr(10), '!"  ' || chr(10) || ' ' || chr(10)][CAST(turn % 4 + 1 AS INT)] AS text FROM conversations),
x AS (SELECT *, lead(segment) OVER v AS s, lead(role) OVER v AS r, lead(n) OVER v AS more FROM w WINDOW v AS (ORDER BY n))
SELECT 's' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS segment_id, CAST(CASE WHEN more IS NULL OR s IS DISTINCT FROM segment THEN 600 WHEN r <> role THEN 320 WHEN regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?]"?$') THEN 180 ELSE 0 END AS BIGINT) AS pause_after_ms FROM x""",
}
