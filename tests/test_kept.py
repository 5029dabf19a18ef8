"""Stores, merges, extraction, seeds, ranges and short needles against brute force and broken runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.engine import Engine
from evidentia.operators import chunking, claims, extraction, gates, merge, publishing, ranges, retrieval
from evidentia.sources import files, pages, snapshots
from evidentia.sources.store import Conflict, Store


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------------- versions


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.latest() == 0 and store.manifest() == {}
    store.publish({"a": spark.range(10), "b": spark.range(3)})
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": broken})
    assert store.latest() == 1 and store.read("a").count() == 10 and store.files.names("data") and len(store.files.names("data")) == 1


def test_readers_keep_their_version_and_neighbours_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = store.publish({"a": spark.range(10), "b": spark.range(3)})
    reader = store.read("a")
    store.publish({"a": spark.range(5).withColumn("k", F.col("id") % 2)}, partition={"a": ["k"]})
    assert reader.count() == 10 and store.read("a").count() == 5 and store.read("b").count() == 3 and store.read("a", first).columns == ["id"]
    assert [r.id for r in store.read("a").filter("k = 1").orderBy("id").collect()] == [1, 3]
    store.prune(1)
    assert store.versions() == [2] and store.read("a").count() == 5 and store.read("b").count() == 3
    with pytest.raises(Exception):
        reader.count()


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = store.publish({"a": spark.range(1)})
    store.publish({"a": spark.range(2)}, expect=base)
    with pytest.raises(Conflict):
        store.publish({"a": spark.range(3)}, expect=base)
    assert store.latest() == 2 and store.read("a").count() == 2 and len(store.files.names("data")) == 2 and store.files.names("_aside") == []


def test_records_in_order_with_nulls_and_without_rows(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(3, None), (1, "x"), (2, "é\n")], "id long, note string")
    files.write_records(rows, path, "id")
    assert tuples(files.read_records(spark, path), "id", "note") == [(1, "x"), (2, "é\n"), (3, None)]
    files.write_records(rows.limit(0), path, "id")
    assert files.read_records(spark, path).count() == 0 and files.read_records(spark, path, 1).count() == 3 and files.read_records(spark, path).columns == ["id", "note"]


# ---------------------------------------------------------------------- chunk store


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_one_source_is_read_from_its_bucket(spark, tmp_path):
    texts = spark.createDataFrame([(f"s{i}", f"# T\n\nThe word{i} and mountain {i}.\n") for i in range(40)], "source_id string, text string")
    chunks = chunking.chunk_texts(chunking.chunk(texts), texts)
    kept = retrieval.ChunkStore(spark, str(tmp_path / "c"))
    kept.publish(chunks)
    one = kept.chunks("s7")
    assert [r.source_id for r in one.collect()] == ["s7"]
    scan = plan_of(one).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "bucket" in scan and len(one.inputFiles()) == len(kept.chunks().inputFiles())
    files_read = spark.read.parquet(kept.store.folder + "/" + kept.store.manifest()["chunks"]["path"]).filter(F.col("bucket") == retrieval.bucket(F.lit("s7"))).select(F.input_file_name()).distinct().count()
    assert files_read == 1
    some = kept.chunks_of(spark.createDataFrame([("s1",), ("s2",), ("none",), ("s1",)], "source_id string"))
    assert tuples(some, "source_id") == [("s1",), ("s2",)]
    fresh, held = retrieval.build_index(chunks), kept.index()
    assert tuples(retrieval.bm25(fresh, "mountain word3"), "chunk_id", "score") == tuples(retrieval.bm25(held, "mountain word3"), "chunk_id", "score")
    assert retrieval.bm25(held, "nowhere").count() == 0 and retrieval.bm25(held, "the").count() == 0


# --------------------------------------------------------------------------- merges


def by_hand(table, batch, problem):
    """Taken one by one."""
    table, outcomes = {k: v for k, v in table}, []
    for seq, key, value in sorted(batch, key=lambda r: r[0]):
        if key is None or problem(value):
            outcomes.append((seq, key, "refused"))
            continue
        outcomes.append((seq, key, "replaced" if key in table else "added"))
        table[key] = value
    return sorted(table.items(), key=repr), sorted(outcomes, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_taking_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    table = [(k, "old") for k in range(0, 40, 3)]
    batch = [(i, rng.choice([None, 1, 1, 1, *range(50)]), rng.choice(["a", "b", "bad"])) for i in range(200)]
    df = spark.createDataFrame(rng.sample(batch, len(batch)), "seq int, id int, v string").repartition(5)
    merged, outcomes = merge.merge(spark.createDataFrame(table, "id int, v string"), df, "id", "seq", F.when(F.col("v") == "bad", "bad"))
    want = by_hand(table, batch, lambda v: v == "bad")
    assert tuples(merged, "id", "v") == want[0] and tuples(outcomes, "seq", "id", "outcome") == want[1]
    assert {r.detail for r in outcomes.collect()} == {None, "bad", "no id"}


def test_repeated_claims_and_adjudications_leave_the_last(spark):
    e = Engine(spark, claims=claims.normalize_claims(spark.createDataFrame([("Known", "x")], "text string, notes string")))
    new = spark.createDataFrame([(1, "A  claim", "first"), (2, "a claim", "second"), (3, "KNOWN", "third"), (4, None, "none")], "seq int, text string, notes string")
    assert [r.outcome for r in e.claim_add(new).orderBy("seq").collect()] == ["added", "replaced", "replaced", "refused"]
    assert tuples(e["claims"], "text", "notes") == [("KNOWN", "third"), ("a claim", "second")]
    two = spark.createDataFrame([("c", "retract", 2), ("c", "both_stand", 1)], "cluster_id string, outcome string, seq int")
    assert tuples(e.adjudicate(two), "cluster_id", "outcome") == [("c", "retract")]
    empty = merge.merge(e["claims"], new.limit(0).withColumn("id", F.lit("x")), "id", "seq")
    assert empty[0].count() == 2 and empty[1].count() == 0


def test_a_known_source_only_refreshes(spark):
    schema = "id string, title string, tier string, tier_reason string, retrieved_at string, status string, error string"
    known = spark.createDataFrame([("k", "Known", "A", "why", "1", "ready", None), ("q", "Quiet", "B", None, "1", "ready", None)], schema)
    batch = spark.createDataFrame([("k", "New", None, "w", "2", "pending", None, 1), ("n", "First", "B", "", "2", "pending", None, 2), ("n", "Second", "C", "z", "3", "pending", None, 3), ("m", "Gone", "D", "", "2", "pending", "no such file", 4), (None, "x", "A", "", "2", "pending", None, 5)], schema + ", seq int")
    e = Engine(spark, sources=known)
    assert [r.outcome for r in e.add(batch).orderBy("seq").collect()] == ["refreshed", "added", "refreshed", "failed", "refused"]
    assert tuples(e["sources"], "id", "title", "tier", "retrieved_at", "status") == [("k", "Known", None, "2", "ready"), ("m", "Gone", "D", "2", "failed"), ("n", "First", "C", "3", "pending"), ("q", "Quiet", "B", "1", "ready")]


# ----------------------------------------------------------------------- extraction

CAPTURED = "source_id string, media_type string, content binary, raw_sha256 string, status string, text string"
STORED = "source_id string, text string, raw_sha256 string, normalized_sha256 string, normalizer_version int"


def captured(spark, *rows):
    return spark.createDataFrame([(i, m, c.encode() if c is not None else None, raw, status, "clash") for i, m, c, raw, status in rows], CAPTURED)


def test_a_second_run_reads_nothing(spark, monkeypatch):
    e = Engine(spark)
    rows = captured(spark, ("a", "text/plain", "One\r\n", "r1", "pending"), ("b", "text/html", "<p>Two</p>", "r2", "pending"), ("c", "image/png", "x", "r3", "pending"), ("d", "text/plain", None, None, "pending"), ("e", "text/plain", " ", "r5", "pending"), ("f", "text/plain", "x", "r6", "failed"))
    first = e.extract(rows)
    assert tuples(first, "source_id", "outcome", "text") == [("a", "extracted", "One\n"), ("b", "extracted", "Two\n"), ("c", "needs_extraction", None), ("d", "pending", None), ("e", "needs_extraction", None), ("f", "failed", None)]
    seen = []
    route = files.route
    monkeypatch.setattr(files, "route", lambda df, *carry: (seen.append(df.count()), route(df, *carry))[1])
    again = e.extract(rows)
    assert tuples(again.filter("text is not null"), "source_id", "outcome", "text") == [("a", "unchanged", "One\n"), ("b", "unchanged", "Two\n")] and seen == [2]  # c and e have no text yet


def test_drift_is_refused_unless_forced(spark):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    stored = spark.createDataFrame([
        ("same", "T\n", "r", sha("T\n"), 1), ("spaces", "T\n", "r", sha("T\n"), 1), ("changed", "T\n", "r", sha("T\n"), 1), ("edited", "T!\n", "r", sha("T\n"), 1), ("old", "T\n", "r", sha("T\n"), 0),
        ("unrecorded", "T\n", "r", None, 1), ("gone", "T\n", "r", sha("T\n"), 1), ("failed", "T\n", "r", sha("T\n"), 1)], STORED)
    rows = captured(spark, ("same", "text/plain", "never read", "r", "pending"), ("spaces", "text/plain", "T  \n\n", "n", "pending"), ("changed", "text/plain", "U", "n", "pending"), ("edited", "text/plain", "T", "r", "pending"),
                    ("old", "text/plain", "T", "r", "pending"), ("unrecorded", "text/plain", "U", "n", "pending"), (None, "text/plain", "N", "n", "pending"), ("failed", "text/plain", "U", "n", "failed"))
    got = {r.source_id: (r.outcome, r.code, r.text, r.raw_sha256) for r in extraction.extract(rows, stored).collect()}
    assert got == {
        "same": ("unchanged", None, "T\n", "r"), "spaces": ("confirmed", None, "T\n", "n"), "changed": ("drifted", "E-NORM-DRIFT", "T\n", "r"), "edited": ("drifted", "E-NORM-DRIFT", "T!\n", "r"),
        "old": ("drifted", "E-NORM-DRIFT", "T\n", "r"), "unrecorded": ("extracted", None, "U\n", "n"), "gone": ("pending", None, "T\n", "r"), None: ("extracted", None, "N\n", "n"), "failed": ("failed", None, "T\n", "r")}
    forced = {r.source_id: (r.outcome, r.text) for r in extraction.extract(rows, stored, F.col("source_id").isin("changed", "edited")).collect()}
    assert forced["changed"] == ("forced", "U\n") and forced["edited"] == ("forced", "T\n") and forced["old"][0] == "drifted"
    assert extraction.findings(extraction.extract(rows, stored)).count() == 3
    assert extraction.extract(rows.limit(0), stored.limit(0)).count() == 0


# ---------------------------------------------------------------------------- seeds


def test_a_seed_stays_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sources = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "source_id int, title string")
    texts = spark.createDataFrame([(0, "same"), (1, "same"), (2, "two"), (3, ""), (4, None)], "source_id int, text string")
    one = snapshots.freeze(store, sources, texts)
    assert snapshots.freeze(store, sources.orderBy(F.desc("title")), texts.repartition(3)) == one and store.latest() == 1  # no text is written twice
    two = snapshots.freeze(store, sources, texts.withColumn("text", F.when(F.col("source_id") == 2, "zwei").otherwise(F.col("text"))))
    assert two != one and store.read("blobs_0000").count() == 3 and store.read("blobs_0001").count() == 1 and snapshots.seeds(store) == sorted([one, two])
    assert tuples(snapshots.thaw(spark, store, one), "source_id", "text", "code") == [(0, "same", None), (1, "same", None), (2, "two", None), (3, "", None), (4, None, None), (5, None, None)]
    tampered = store.read("blobs_0000").withColumn("text", F.when(F.col("text") == "two", "2").otherwise(F.col("text"))).filter("text <> ''")
    store.publish({"blobs_0000": tampered})
    assert [(r.source_id, r.code) for r in snapshots.thaw(spark, store, one).filter("code is not null").orderBy("source_id").collect()] == [(2, "E-SEED-CHANGED"), (3, "E-SEED-MISSING")]
    assert snapshots.thaw(spark, store, one, version=1).filter("code is not null").count() == 0
    e = Engine(spark)
    e.seed(str(tmp_path / "s"), two)
    assert e["texts"].count() == 3 and e["sources"].columns == ["id", "title"]
    none = snapshots.freeze(store, sources.limit(0), texts.limit(0))
    assert snapshots.thaw(spark, store, none).count() == 0


# --------------------------------------------------------------------------- ranges


def test_sums_and_next_rows_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), i, rng.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    want, total = {}, 0
    for n, (a, b, v) in enumerate(sorted(rows), 1):
        want[b] = (n, total)
        total += v
    for parts in (1, 3, 40):
        got = ranges.running(df, ["a", "b"], {"sum": F.col("v").cast("long"), "n": F.lit(1).cast("long")}, parts)
        assert {r.b: (r.n + 1, r["sum"]) for r in got.collect()} == want
        after = {r.b: r.next and (r.next.a, r.next.b) for r in ranges.with_next(df, ["a", "b"], ["a", "b"], parts).collect()}
        order = [(a, b) for a, b, _ in sorted(rows)]
        assert after == {b: x for (_, b), x in zip(order, [*order[1:], None])}
    assert ranges.numbered(df.limit(0), ["a"], "n").count() == 0


def test_pauses_look_past_the_end_of_a_range(spark):
    said = ["Hi.\n \n", "Hi.\t", 'Hi!"\r\n', "Hi", "so? ", "…", ""]
    lines = [(i, i // 50, "ab"[i // 3 % 2], said[i % 7]) for i in range(200)]
    got = {}
    for parts in (1, 9):
        plan = publishing.dialogue_plan(spark.createDataFrame(lines, "n int, segment int, speaker string, text string").repartition(4), parts=parts)
        got[parts] = [r.pause_after_ms for r in plan.orderBy("segment_id").collect()]
    import re

    want = [600 if i == 199 or lines[i + 1][1] != s else 320 if lines[i + 1][2] != who else 180 if re.search(r"[.!?]\"?$", t.strip()) else 0 for i, s, who, t in lines]
    assert got[1] == got[9] == want


def test_a_ledger_in_parts_is_the_ledger(spark, tmp_path):
    rows = claims.normalize_claims(spark.createDataFrame([(f"Claim é{i}", "inferred" if i % 5 == 0 else "verified") for i in range(60)], "text string, confidence string"))
    rows = rows.withColumns({"kind": F.lit("fact"), "topic_key": F.lit("t")})
    sources = spark.createDataFrame([], "id string, title string, publisher string, tier string, locator string, tier_reason string, retrieved_at string")
    e = Engine(spark, claims=rows, sources=sources, plan=spark.createDataFrame([], "ord int, claim_ids array<string>"))
    for form in ("json", "md", "html"):
        lines = e.ledger(form)
        body = claims.whole(lines).first().body
        folder = tmp_path / form
        parts = e.write_ledger(str(folder), form)
        read = b"".join((folder / "parts" / p["name"]).read_bytes() for p in parts)
        assert read.decode() == body and [p["offset"] for p in parts] == [sum(q["bytes"] for q in parts[:i]) for i in range(len(parts))] and len(parts) > 1
        assert all(body.encode()[r.offset :].startswith(r.line.encode() + b"\n") for r in lines.collect())
        assert json.loads((folder / "parts.json").read_text()) == parts
    assert len(json.loads(claims.whole(e.ledger("json")).first().body)["ledger"]) == 60
    empty = Engine(spark, claims=rows.limit(0), sources=sources, plan=e["plan"])
    assert json.loads(claims.whole(empty.ledger("json")).first().body)["ledger"] == [] and claims.whole(empty.ledger("html")).first().body == '<ol class="ledger">\n</ol>\n'


# --------------------------------------------------------------------- short needles


@pytest.mark.parametrize("few", [0, 100_000])
def test_short_needles_meet_their_texts_by_grams(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_GRAMS", few)
    rng = random.Random(2)
    alphabet = "ab .,!\n漢é😀"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, "")]
    needles = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))) for i in range(150)] + [(900, None)]
    found = retrieval.find_passages(spark.createDataFrame(texts, "source_id int, text string"), spark.createDataFrame(needles, "passage_id int, text string"))
    want = [(s, p, t.find(n), t.find(n) + len(n)) for s, t in texts for p, n in needles if t and n and n in t]
    assert tuples(found, "source_id", "passage_id", "span_start", "span_end") == sorted(want, key=repr)
    assert "NestedLoop" not in plan_of(found) and "CartesianProduct" not in plan_of(found)


# ---------------------------------------------------------------------------- gates


def test_notes_count_what_each_gate_has_seen(spark):
    rows = claims.normalize_claims(spark.createDataFrame([("a", "verified"), ("b", "unsupported"), ("c", "inferred")], "text string, confidence string"))
    rows = rows.withColumns({"kind": F.lit("fact"), "topic_key": F.lit("t")})
    sources = spark.createDataFrame([], "id string, tier string, tier_reason string")
    texts = spark.createDataFrame([], "source_id string, text string")
    watch = gates.Watch()
    found = gates.union(gates.volatility(rows, watch), gates.confidence(rows, watch), gates.tiers(rows, sources, watch), gates.quotes(rows, texts, watch))
    assert [tuple(r) for r in gates.notes(found, watch).collect()] == [
        (2, "quotes", 0, 0, 0, 0, "0 checked"), (3, "confidence", 3, 2, 2, 0, "2 of 3"), (4, "tiers", 0, 0, 0, 0, "0 checked"), (5, "volatility", 3, 0, 0, 0, "3 checked")]


# ---------------------------------------------------------------------------- pages


def test_tables_of_one_parse(spark):
    rows = spark.createDataFrame([(1, "<html><head><style>p{color:red}</style></head><body><p class='a b'>x<b>y</b></p><br></body></html>"), (2, None), (3, "")], "doc_id int, html string")
    parsed = pages.Parsed(rows, "nodes", "rules", "texts")
    for kept, alone in ((parsed.nodes, pages.dom_nodes(rows)), (parsed.rules, pages.css_rules(rows)), (parsed.texts, pages.page_texts(rows))):
        assert kept.schema == alone.schema and tuples(kept, "*") == tuples(alone, "*")
    sums = pages.subtree_sums(parsed.nodes, {"n": F.lit(1).cast("long"), "chars": F.length("own_text").cast("long")})
    got = {r.tag: (r.n, r.chars) for r in sums.filter("doc_id = 1").collect()}
    assert got["p"] == (2, 2) and got["b"] == (1, 1) and got["#document"][0] == 8 and got["br"] == (1, 0)


# -------------------------------------------------------------------- sources and packages


def test_a_source_that_cannot_be_read_is_a_failed_row(spark, tmp_path):
    for name, body in (("src_a", '{"id": "src_a", "status": "ready",\n "error": null}'), ("src_b", "{broken"), ("src_c", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "source.json").write_text(body)
    got = files.source_records(spark, str(tmp_path), "id string, status string, error string")
    assert [r for r in tuples(got, "id", "status", "error") if r[0] in ("src_a", "src_b")] == [("src_a", "ready", None), ("src_b", "failed", "source.json cannot be read")]


def test_a_package_is_one_version(spark, tmp_path):
    rows = claims.normalize_claims(spark.createDataFrame([("A claim", "verified")], "text string, confidence string")).withColumn("evidence", F.expr("array(named_struct('source_id', 's', 'start', 0, 'end', 2, 'quote', repeat('q', 300), 'quote_sha256', cast(null as string), 'length', cast(null as int), 'redacted', false))"))
    sources = spark.createDataFrame([("s", "file", "/home/x", "x", "https://y")], "id string, kind string, locator string, canonical_locator string, notes string")
    built = spark.createDataFrame([("a.html", b"1"), ("a.html", b"1"), ("b.html", None)], "path string, content binary")
    e = Engine(spark, claims=rows, sources=sources, plan=spark.createDataFrame([], "ord int, claim_ids array<string>"))
    watch = gates.Watch()
    good = gates.notes(gates.confidence(rows, watch), watch)
    bad = good.withColumn("errors", F.lit(1).cast("long"))
    folder = str(tmp_path / "p")
    assert e.publish(folder, built, good, "why?", "now", public=True) == 1 and e.publish(folder, built, bad, "why?", "now") == 2
    store = Store(spark, folder)
    first, second = ({n: store.read(n, v).collect() for n in store.manifest(v)} for v in (1, 2))
    assert first["evidence"][0].redacted and first["evidence"][0].length == 300 and first["summary"][0].redacted_quotes == 1 and first["summary"][0].visibility == "public"
    assert second["evidence"][0].quote == "q" * 300 and second["summary"][0].redacted_quotes == 0 and len(first["report"]) == 1 and second["report"] == []
    assert first["provenance"][0].locator is None and second["provenance"][0].locator == "/home/x" and not hasattr(first["provenance"][0], "notes")
    assert [r.path for r in first["checksums"]] == ["a.html", "b.html"]


# -------------------------------------------------------------------------- history


def test_history_is_walking_it(spark):
    rng = random.Random(8)
    actions = ["failed", "failed", "failed", "passed", "unblock", "advance", "odd", None]
    events = [(rng.choice([None, "hot", "hot", "hot", *"abc"]), i, rng.choice(actions), rng.choice(["PLAN", "GROUND"])) for i in range(400)]
    want, counts = {}, {}
    for w, seq, action, to in events:
        r = counts.get(w, 0)
        after = min(3, r + 1) if action == "failed" else 0 if action in ("passed", "unblock") else r
        state = "BLOCKED" if after >= 3 else {"failed": "REVISE", "unblock": "REVISE", "passed": "VERIFY", "advance": to}.get(action)
        code = "E-STATE-BLOCKED" if action == "advance" and r >= 3 else "E-UNBLOCK-IDLE" if action == "unblock" and r < 3 else "E-ACTION-UNKNOWN" if action in (None, "odd") else None
        want[seq], counts[w] = (w, r, after, state, code), after
    df = spark.createDataFrame(rng.sample(events, len(events)), "workspace string, seq int, action string, to_state string").repartition(5)
    for parts in (1, 11):
        got = {r.seq: (r.workspace, r.revise_before, r.revise_after, r.state, r.code) for r in publishing.history_states(df, parts).collect()}
        assert got == want
    assert publishing.history_states(df.limit(0)).count() == 0
