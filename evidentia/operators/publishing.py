"""Dialogue plans, licence checks, packages with checksums, workspace state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import asset_name
from ..functions.text import is_http_url, strip
from ..sources.store import Store, cut
from . import gates, retrieval
from .claims import evidence_rows, redact
from .ranges import reached, running, with_next

PAUSE_BOUNDARY, PAUSE_SPEAKER, PAUSE_SENTENCE = 600, 320, 180
# Licences that an image may have.
PERMITTED = ("cc0", "pd", "public domain", "cc by", "cc by 2.0", "cc by 3.0", "cc by 4.0", "cc by-sa", "cc by-sa 2.0", "cc by-sa 3.0", "cc by-sa 4.0", "mit", "apache-2.0", "ogl", "generated")
GENERATED_LABEL = "Generated illustration"


def dialogue_plan(lines: DataFrame, script: list[str] | None = None, order: str = "n", parts: int | None = None) -> DataFrame:
    """(segment_id, speaker, text, pause_after_ms, out): pauses look one line ahead. ``script`` names columns that tell scripts apart.

    Lines are dealt into ranges of the order of all scripts, and a range gets the first line after it, so one script
    may be as long as all others together.
    """
    script = script or []
    rows = with_next(lines, [*script, order], list(dict.fromkeys([*script, order, "segment", "speaker"])), parts)
    other = reduce(Column.__or__, (~F.col(f"next.{c}").eqNullSafe(F.col(c)) for c in [*script, "segment"]))
    final = strip(F.col("text")).rlike(r"[.!?]\"?\z")
    pause = F.when(F.col("next").isNull() | other, PAUSE_BOUNDARY).when(F.col("next.speaker") != F.col("speaker"), PAUSE_SPEAKER).when(final, PAUSE_SENTENCE).otherwise(0)
    name = F.format_string("s%04d", order)
    return rows.select(*script, name.alias("segment_id"), "speaker", "text", pause.alias("pause_after_ms"), F.concat(F.lit("build/audio/"), name, F.lit(".wav")).alias("out"))


def voices(speakers: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(name, hint, voice_id): a chosen voice goes before the script's hint."""
    if chosen is None:
        return speakers.select("name", F.coalesce("voice_hint", F.lit("")).alias("hint"), F.lit(None).cast("string").alias("voice_id"))
    return speakers.join(chosen.select("name", "hint", "voice_id"), "name", "left").select("name", F.coalesce(F.nullif("hint", F.lit("")), "voice_hint", F.lit("")).alias("hint"), "voice_id")


def denied(license_: Column) -> Column:
    """Why a licence can't be used, or null."""
    low = F.lower(strip(license_))
    return F.when(low.contains("-nc"), "NonCommercial").when(low.contains("-nd"), "NoDerivatives").when(low.contains("unknown"), "unknown").when(low.contains("all rights reserved"), "all rights reserved")


def images(nodes: DataFrame) -> DataFrame:
    """(doc_id, name) of images with a source."""
    src = F.coalesce(F.col("attrs")["src"], F.lit(""))
    return nodes.filter("tag = 'img'").filter(src != "").select("doc_id", asset_name(src, F.col("attrs")["data-asset"]).alias("name"))


def licenses(nodes: DataFrame, texts: DataFrame, credits: DataFrame, files: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Findings on the images of pages and their credits (name, origin, source, credit, license, generator, prompt, sha256).

    A credit must be visible on every page that shows its image, that of an image shown nowhere on any page. A
    share-alike licence is a warning, or an error if ``strict``. ``files``: (name, sha256) of assets at hand.
    """
    used = images(nodes).distinct()
    rows = credits.withColumns({"lic": strip(F.coalesce("license", F.lit(""))), "why": denied(F.coalesce("license", F.lit("")))})
    lacks = lambda *names: F.array_compact(F.array(*(F.when(F.coalesce(F.length(n), F.lit(0)) == 0, F.lit(n)) for n in names)))
    sourced, generated = rows.filter("origin = 'sourced'"), rows.filter("origin = 'generated'")
    fields = sourced.select("name", F.explode(lacks("source", "credit", "license")).alias("f")).unionByName(generated.select("name", F.explode(lacks("generator", "prompt")).alias("f")))
    unusable = sourced.filter(F.col("why").isNotNull() | ~F.lower("lic").isin(*PERMITTED))
    owed = sourced.filter(F.lower("lic").startswith("cc by") & (F.length("credit") > 0)).select("name", "credit")
    seen = retrieval.find_passages(texts.select(F.col("doc_id").alias("source_id"), "text"), owed.select(F.col("name").alias("passage_id"), F.col("credit").alias("text"))).select(F.col("source_id").alias("doc_id"), F.col("passage_id").alias("name"))
    silent = owed.join(used, "name").join(seen, ["doc_id", "name"], "left_anti").select("name").unionByName(owed.join(used, "name", "left_anti").join(seen, "name", "left_anti").select("name")).distinct()
    bare = generated.select("name").join(used, "name").join(texts.select("doc_id", "text"), "doc_id").filter(~F.col("text").contains(GENERATED_LABEL)).select("name").distinct()
    out = [
        gates.finding(used.select("name").distinct().join(credits.select("name"), "name", "left_anti"), "licenses", "E-IMG-UNCREDITED", "name", "shown without an entry in the credits"),
        gates.finding(fields, "licenses", "E-IMG-FIELDS", "name", F.format_string("the field %s is empty", "f")),
        gates.finding(rows.filter("coalesce(origin, '') not in ('sourced', 'generated')"), "licenses", "E-IMG-FIELDS", "name", "the origin is neither sourced nor generated"),
        gates.finding(unusable, "licenses", "E-IMG-LICENSE", "name", F.format_string("cannot be used under '%s': %s", F.col("lic"), F.coalesce("why", F.lit("not among the permitted licences")))),
        gates.finding(silent, "licenses", "E-IMG-ATTRIB", "name", "its credit is not to be seen"),
        gates.finding(sourced.filter(F.lower("lic").contains("-sa")), "licenses", "W-IMG-SHAREALIKE", "name", "the whole must be shared alike", "error" if strict else "warn"),
        gates.finding(bare, "licenses", "E-IMG-UNLABELED", "name", f"generated, without the label '{GENERATED_LABEL}'"),
    ]
    if files is not None:
        changed = credits.filter("sha256 is not null").join(files.select("name", F.col("sha256").alias("actual")), "name").filter("actual <> sha256")
        out.append(gates.finding(changed, "licenses", "E-IMG-HASH", "name", "not the file whose digest was recorded"))
    return gates.union(*out)


# What a package tells about each source.
TOLD = "id kind locator canonical_locator title publisher tier tier_reason published_at retrieved_at raw_sha256 normalized_sha256 normalizer_version".split()


def provenance(sources: DataFrame, public: bool = True) -> DataFrame:
    """What a package tells about its sources; in public form addresses that aren't http stay private."""
    hidden = ("locator", "canonical_locator") if public else ()
    told = [F.when(is_http_url(F.col(c)), F.col(c)).alias(c) if c in hidden else F.col(c) for c in TOLD if c in sources.columns]
    return sources.select(*told)


def package(store: Store, sources: DataFrame, claims: DataFrame, files: DataFrame, notes: DataFrame, question: str, at: str, ordinals: DataFrame | None = None) -> int:
    """Publishes a package as one version of a store: ``provenance``, ``evidence``, ``report``, ``summary`` and ``checksums``.

    With ``ordinals`` (id, ordinal) the package is public: quotes beyond the budget give way to their hashes, private
    addresses are left out. ``files``: (path, content); ``notes``: a report of the gates, which goes in only if it has
    no errors. The summary, one row, counts claims and redactions.
    """
    public = ordinals is not None
    evidence = evidence_rows(claims)
    if public:
        numbered = evidence.join(ordinals.withColumnRenamed("id", "claim_id"), "claim_id", "left")
        evidence = redact(numbered.withColumn("ord", F.struct(F.coalesce("ordinal", F.lit(2**31 - 1)).alias("o"), "claim_id", "position"))).drop("ord", "ordinal", "granted")
    evidence = cut(evidence)
    counts = claims.agg(F.count("*").alias("claims")).crossJoin(evidence.agg(F.count_if(F.coalesce("redacted", F.lit(False))).alias("redacted_quotes")))  # a row each
    summary = counts.select(F.lit(1).alias("schema_version"), F.lit(at).alias("generated_at"), F.lit(question).alias("question"), F.lit("public" if public else "private").alias("visibility"), "claims", "redacted_quotes")
    report = notes.limit(0) if notes.filter("errors > 0").count() else notes  # a row a gate
    return store.publish({"provenance": provenance(sources, public), "evidence": evidence, "report": report, "summary": summary, "checksums": checksums(files)}, order={"checksums": ["path"]})


def checksums(files: DataFrame) -> DataFrame:
    """(path, sha256) of (path, content), by path."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).distinct().orderBy("path")


def verify_package(manifest: DataFrame, files: DataFrame, claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings on files that are missing or changed, and on citations against the canonical texts."""
    joined = manifest.join(checksums(files).withColumnRenamed("sha256", "actual"), "path", "left")
    bad = gates.checked_evidence(evidence_rows(claims), texts).filter("code is not null")
    return gates.union(
        gates.finding(joined.filter("actual is null"), "package", "E-PKG-MISSING", "path", "listed but not there"), gates.finding(joined.filter("actual <> sha256"), "package", "E-PKG-CHECKSUM", "path", "does not match its checksum"),
        gates.finding(bad, "package", F.col("code"), "claim_id", "citation does not match its source"),
    )


#: States by the first condition that holds; the tables are the truth, a stored state only tells VERIFY and RENDER apart.
STATES = (
    ("BLOCKED", "revise_count >= 3 or n_blockers > 0"), ("INIT", "n_sources = 0"), ("COLLECT", "n_unsettled > 0 or n_ready = 0"), ("EXTRACT", "n_chunked < n_ready"), ("CHUNK", "not has_index"),
    ("INDEX", "not has_plan"), ("PLAN", "n_claims = 0"), ("GROUND", "n_open > 0"), ("ADJUDICATE", "n_artifacts = 0"), ("COMPOSE", "n_injected = 0"),
    ("VERIFY", "not has_provenance and stored_state in ('VERIFY', 'PACKAGE', 'DONE')"), ("RENDER", "not has_provenance"),
)


def state(counts: DataFrame) -> DataFrame:
    """Adds the state that a workspace's counts stand for."""
    out = F.lit("DONE")
    for name, when in reversed(STATES):
        out = F.when(F.expr(when), F.lit(name)).otherwise(out)
    return counts.withColumn("state", out)


# States in which nothing is left to do by the engine itself, and what comes next in the others, by its verbs.
NEXT = {
    "INIT": "add", "COLLECT": "extract", "EXTRACT": "chunk", "CHUNK": "index", "INDEX": "plan", "PLAN": "claim_add", "GROUND": "contradictions", "ADJUDICATE": "adjudicate", "COMPOSE": "inject", "RENDER": "verify",
    "VERIFY": "package", "PACKAGE": "package", "REVISE": "verify", "DONE": "nothing", "BLOCKED": "unblock",
}


def status_report(workspaces: DataFrame, sources: DataFrame) -> DataFrame:
    """(workspace, state, stored_state, revise_count, sources, sources_ready, sources_unsettled, next) of every workspace.

    ``workspaces`` has the counts that ``state`` reads but for those of sources, which come from ``sources`` (workspace,
    status) by one aggregate; a workspace without sources has none.
    """
    unsettled = F.count_if(F.col("status").isin("pending", "needs_extraction"))
    per = sources.groupBy("workspace").agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") == "ready").alias("n_ready"), unsettled.alias("n_unsettled"))
    met = state(workspaces.join(per, "workspace", "left").na.fill(0, ["n_sources", "n_ready", "n_unsettled"]))
    following = F.create_map(*(F.lit(x) for kv in NEXT.items() for x in kv))[F.col("state")]
    return met.select("workspace", "state", "stored_state", "revise_count", F.col("n_sources").alias("sources"), F.col("n_ready").alias("sources_ready"), F.col("n_unsettled").alias("sources_unsettled"), following.alias("next"))


def artifacts(files: DataFrame, begin: str = "<!-- LEDGER -->", end: str = "<!-- /LEDGER -->") -> DataFrame:
    """(path, injected) of the pages among built files (path, html), by path: HTML at the top of ``build``, without the ledger's own page."""
    pages = files.filter(F.col("path").rlike(r"^build/[^/]+\.html$") & (F.col("path") != "build/ledger.html"))
    return pages.select("path", injected(F.col("html"), begin, end).alias("injected")).orderBy("path")


def source_counts(sources: DataFrame) -> DataFrame:
    """One row (n_sources, n_ready, n_unsettled)."""
    return sources.agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") == "ready").alias("n_ready"), F.count_if(F.col("status").isin("pending", "needs_extraction")).alias("n_unsettled"))


def injected(page: Column, begin: str, end: str) -> Column:
    """Does a page hold the ledger between its markers?"""
    a, b = F.position(F.lit(begin), page), F.position(F.lit(end), page)
    return (a > 0) & (b > a) & page.substr(a, b - a).contains('class="ledger"')


#: So many failed verifications in a row block a workspace.
MOST_REVISIONS = 3


def history_states(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(workspace, seq, action, revise_before, revise_after, state, code) of (workspace, seq, action, to_state).

    Actions are ``failed`` and ``passed`` (verifications), ``unblock`` and ``advance`` (to a state). A failure adds one to
    the count of revisions, up to the third, which blocks; passing and unblocking set it to none. So what a stretch of
    history does to the count is either "set, then so many more" or "so many more", and stretches can be put together
    in any grouping: the count before an event is the failures before it less those up to the last reset. Both are
    running values over ranges of all events in order, so one workspace may have most of them.

    Illegal steps are found and change nothing: E-STATE-BLOCKED, an advance while blocked, and E-UNBLOCK-IDLE, unblocking
    what isn't blocked; so is E-ACTION-UNKNOWN. Null workspaces are one workspace; events with one place in the order are
    taken in the order of their action.
    """
    events = events.select("workspace", "seq", "action", "to_state")
    order = [F.asc_nulls_first("workspace"), "seq", "action", "to_state"]
    action = F.col("action")
    counted = running(events, order, {"fails": F.coalesce((action == "failed").cast("long"), F.lit(0))}, parts)
    marked = reached(counted, order, F.when(action.isin("passed", "unblock"), F.col("fails")), "reset", parts)
    begins = marked.groupBy(F.col("workspace").alias("__w")).agg(F.min("fails").alias("begin"))
    own = marked.join(begins, F.col("workspace").eqNullSafe(F.col("__w")))
    before = F.least(F.lit(MOST_REVISIONS), F.col("fails") - F.greatest(F.col("begin"), F.col("reset")))
    rows = own.withColumn("revise_before", before.cast("int"))
    blocked = F.col("revise_before") >= MOST_REVISIONS
    after = F.when(action == "failed", F.least(F.lit(MOST_REVISIONS), F.col("revise_before") + 1)).when(action.isin("passed", "unblock"), 0).otherwise(F.col("revise_before"))
    rows = rows.withColumn("revise_after", after.cast("int"))
    state = (
        F.when(F.col("revise_after") >= MOST_REVISIONS, "BLOCKED").when(action.isin("failed", "unblock"), "REVISE").when(action == "passed", "VERIFY").when(action == "advance", F.col("to_state"))
    )
    code = F.when((action == "advance") & blocked, "E-STATE-BLOCKED").when((action == "unblock") & ~blocked, "E-UNBLOCK-IDLE").when(action.isNull() | ~action.isin("failed", "passed", "unblock", "advance"), "E-ACTION-UNKNOWN")
    return rows.select("workspace", "seq", "action", "revise_before", "revise_after", state.alias("state"), code.alias("code"))


def append_history(history: DataFrame, to_state: str, at: str, note: str = "") -> DataFrame:
    return history.unionByName(history.sparkSession.range(1).select(F.lit(to_state).alias("state"), F.lit(at).alias("at"), F.lit(note).alias("note")))
