import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking, claims, contradictions, gates, publishing, retrieval
from evidentia.operators.lint import lint
from evidentia.operators.schema_rules import validate
from evidentia.sources import files, pages

CLAIM = "id string, topic_key string, text string, kind string, confidence string, status string, volatile boolean, as_of string, recheck string, contradicts array<string>, superseded_by string, evidence array<struct<source_id:string,start:int,end:int,quote:string,quote_sha256:string,length:int,redacted:boolean>>"
BASE = dict(topic_key="t", text="It is so.", kind="statement", confidence="reported", status="active", volatile=False, as_of=None, recheck=None, contradicts=[], superseded_by=None, evidence=[])


def ledger(spark, *rows):
    return spark.createDataFrame([{**BASE, **r} for r in rows], CLAIM)


def ev(source="s1", start=0, end=5, quote="Hello", sha=None, redacted=False):
    return dict(source_id=source, start=start, end=end, quote=quote, quote_sha256=sha, length=None, redacted=redacted)


def codes(df):
    return sorted((r.code, r.subject) for r in df.collect())


def test_bm25_by_hand(spark):
    import math

    chunks = spark.createDataFrame([("a#c0000", "a", "cat dog cat"), ("b#c0000", "b", "dog"), ("c#c0000", "c", "")], "chunk_id string, source_id string, text string")
    index = retrieval.build_index(chunks)
    got = {r.chunk_id: r.score for r in retrieval.bm25(index, "cat cat dog").collect()}
    avg = round(4 / 3, 4)
    part = lambda tf, dl, df: math.log((3 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got["a#c0000"] == pytest.approx(2 * part(2, 3, 1) + part(1, 3, 2)) and got["b#c0000"] == pytest.approx(part(1, 1, 2)) and len(got) == 2
    assert [r.chunk_id for r in retrieval.bm25(index, "dog", "b#").collect()] == ["b#c0000"]
    assert [(r.rank, r.chunk_id) for r in retrieval.search(index, chunks, "cat dog").collect()] == [(1, "a#c0000"), (2, "b#c0000")]


def test_find_and_quote(spark):
    texts = spark.createDataFrame([("s", "Hello  big world. Hello"), ("t", "none")], "source_id string, text string")
    got = sorted((r.source_id, r.status, r.span_start, r.span_end) for r in retrieval.find(texts, "Hello", every=True).filter("status <> 'nomatch'").collect())
    assert got == [("s", "exact", 0, 5), ("s", "exact", 18, 23)]
    assert {(r.source_id, r.status, r.span_start) for r in retrieval.find(texts, "big world.").collect()} == {("s", "exact", 7), ("t", "nomatch", None)}
    assert [r.status for r in retrieval.find(texts, "Hello big").orderBy("source_id").collect()] == ["inexact", "nomatch"]
    assert [(r.quote, r.in_range) for r in retrieval.quote(texts, F.lit(0), F.lit(5)).orderBy("source_id").collect()] == [("Hello", True), (None, False)]


def test_find_passages_meets_the_nested_loop(spark):
    rng = random.Random(0)
    words = ["the", "of", "cat", "x", "dog", "bird", "ab"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    passages = [(i, t[1][a : a + rng.randint(1, 25)]) for i, t in enumerate(texts[:40]) for a in [rng.randint(0, 20)]]
    got = {(r.source_id, r.passage_id, r.span_start) for r in retrieval.find_passages(spark.createDataFrame(texts, "source_id int, text string"), spark.createDataFrame(passages, "passage_id int, text string")).collect()}
    assert got == {(s, p, t.find(q)) for s, t in texts for p, q in passages if q and q in t}


def test_chunks_cover_and_pack():
    rng = random.Random(1)
    for _ in range(200):
        parts = [rng.choice(["# Head\n", "## Sub one\n", "### Deep\n", "\n\n", "\n", "Sentence here. ", "word " * rng.randint(1, 60), "x" * rng.randint(1, 300)]) for _ in range(rng.randint(0, 25))]
        text = "".join(parts)
        found = chunking.chunk_text(text, target=200, overlap=40)
        if not text:
            assert found == []
            continue
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(b[0] <= a[1] for a, b in zip(found, found[1:])) and all(a < b for a, b, _ in found)
    text = "# A\n\npara one.\n\n## B\n\n" + "s. " * 100
    assert [h for _, _, h in chunking.chunk_text(text)] == [["A"], ["A", "B"]]


def test_uncovered(spark):
    texts = spark.createDataFrame([("a", "0123456789"), ("b", "xyz"), ("c", "")], "source_id string, text string")
    chunks = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 5, 10), ("b", 0, 0, 3)], "source_id string, ordinal int, span_start int, span_end int")
    assert [r.source_id for r in chunking.uncovered(chunks, texts).collect()] == ["a"]
    assert chunking.uncovered(chunking.chunk(texts), texts).count() == 0


def test_quote_gate(spark):
    import hashlib

    texts = spark.createDataFrame([("s1", "Hello world")], "source_id string, text string")
    sha = hashlib.sha256(b"Hello").hexdigest()
    rows = ledger(
        spark, dict(id="ok", evidence=[ev(), ev(quote=None, sha=sha, redacted=True), ev(quote=None, sha=sha)]), dict(id="changed", evidence=[ev(quote="Hellp")], status="retracted"), dict(id="range", evidence=[ev(end=99)]),
        dict(id="gone", evidence=[ev(source="s9")]), dict(id="hash", evidence=[ev(quote=None, sha="0", redacted=True)]),
    )
    assert codes(gates.quotes(rows, texts)) == [("E-QUOTE-MISMATCH", "changed"), ("E-QUOTE-MISMATCH", "hash"), ("E-QUOTE-MISSING-SOURCE", "gone"), ("E-QUOTE-RANGE", "range")]


def test_ledger_gates(spark):
    rows = ledger(
        spark, dict(id="a", confidence="inferred", evidence=[ev()]), dict(id="b", confidence="verified"), dict(id="c", confidence="unsupported"), dict(id="d", confidence="verified", evidence=[ev("sD")]),
        dict(id="e", confidence="verified", kind="number", evidence=[ev("sC")]), dict(id="f", confidence="verified", kind="number", evidence=[ev("sC"), ev("sA")]), dict(id="g", volatile=True, recheck="javascript:x", evidence=[ev("sA")]), dict(id="h", confidence="verified", evidence=[ev("unknown")]),
    )
    sources = spark.createDataFrame([("sA", "A", " "), ("sC", "C", None), ("sD", "D", "weak blog")], "id string, tier string, tier_reason string")
    assert codes(gates.confidence(rows)) == [("E-CONF-MISMATCH", "a"), ("E-CONF-MISMATCH", "b"), ("E-UNSUPPORTED", "c")]
    assert codes(gates.tiers(rows, sources)) == [("E-TIER-D", "d"), ("E-TIER-D", "h"), ("E-TIER-REASON", "sA"), ("E-TIER-WEAK", "e")]
    assert codes(gates.volatility(rows)) == [("E-RECHECK-SCHEME", "g"), ("E-VOLATILE-UNDATED", "g")]
    placed = spark.createDataFrame([("s", "a"), ("s", "zz")], "section string, id string")
    hidden = ledger(spark, dict(id="a", status="superseded"), dict(id="q", confidence="contested"))
    assert codes(gates.plan(hidden, placed)) == [("E-CONTESTED-HIDDEN", "q"), ("E-PLAN-ORPHAN", "a"), ("E-PLAN-ORPHAN", "zz")]
    assert gates.verdict(gates.confidence(rows), 2).first().asDict() == {"pass": False, "errors": 3, "revise_count": 3, "state": "BLOCKED"}
    assert gates.verdict(gates.confidence(rows.limit(0)), 2).first()["pass"]


def test_normalizer_gate(spark):
    import hashlib

    texts = spark.createDataFrame([("a", "x\n"), ("b", "x\n"), ("c", "x\n")], "source_id string, text string")
    good = hashlib.sha256(b"x\n").hexdigest()
    sources = spark.createDataFrame([("a", "ready", 1, good), ("b", "ready", 1, "0"), ("c", "ready", 2, good), ("d", "ready", 1, good), ("e", "pending", 1, None)], "id string, status string, normalizer_version int, normalized_sha256 string")
    assert codes(gates.normalizer(sources, texts)) == [("E-NORM-DRIFT", "b"), ("E-NORM-DRIFT", "c"), ("E-NORM-MISSING", "d")]


def pairwise(rows):
    """Conflicts by comparing all pairs."""
    import datetime
    import re

    hit = {}
    day = lambda x: datetime.date.fromisoformat(x) if x else None
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["topic_key"] != b["topic_key"]:
                continue
            why = set()
            if a["kind"] == b["kind"] == "number" and a["n"] is not None and b["n"] is not None and abs(a["n"] - b["n"]) / (max(abs(a["n"]), abs(b["n"])) or 1) > 0.05:
                why.add("numeric")
            if a["kind"] == b["kind"] == "date" and a["d"] and b["d"] and a["d"] != b["d"]:
                why.add("date")
            if (" not " in a["text"]) != (" not " in b["text"]):
                why.add("polarity")
            if a["volatile"] and b["volatile"] and a["as_of"] and b["as_of"] and abs((day(a["as_of"]) - day(b["as_of"])).days) > 180:
                why.add("recency")
            if b["id"] in a["contradicts"] or a["id"] in b["contradicts"]:
                why.add("explicit")
            for x in (a, b) if why else ():
                hit.setdefault(a["topic_key"], [set(), set()])[0].add(x["id"])
            if why:
                hit[a["topic_key"]][1].update(why)
    return {k: (sorted(a), sorted(b)) for k, (a, b) in hit.items()}


def test_detectors_find_what_all_pairs_find(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        kind = rng.choice(["number", "date", "statement"])
        n, d = rng.choice([None, -10, 0, 100, 104, 105.1, 1000]), rng.choice([[], ["2024-01-01"], ["2024-01-01", "2024-02-02"]])
        said = "it is" + rng.choice([" not ", " so "]) + (f"{n} units" if kind == "number" and n is not None else " ".join(d) if kind == "date" else "")
        rows.append({**BASE, "id": f"c{i:03d}", "topic_key": f"t{rng.randrange(120)}", "kind": kind, "text": said, "n": n if kind == "number" else None, "d": d if kind == "date" else [], "volatile": rng.random() < 0.4, "as_of": rng.choice([None, "2024-01-01", "2024-06-29", "2024-06-30"])})
    for r in rows[::9]:
        r["contradicts"] = [rng.choice(rows)["id"]]
    rows = [{**r, "contradicts": [c for c in r["contradicts"] if c != r["id"]]} for r in rows]
    df = spark.createDataFrame([{k: v for k, v in r.items() if k not in "nd"} for r in rows], CLAIM)
    got = {r.topic_key: (list(r.claim_ids), list(r.detectors)) for r in contradictions.detect(df).collect()}
    assert got == pairwise(rows)


def test_adjudication(spark):
    rows = ledger(spark, *(dict(id=i, topic_key=t, kind="number", text=f"{n} units") for i, t, n in [("a", "t", 1), ("b", "t", 2), ("c", "t", 3), ("d", "u", 1), ("e", "u", 9), ("f", "v", 1), ("g", "v", 5)]))
    found = {r.topic_key: r.cluster_id for r in contradictions.detect(rows).collect()}
    adj = spark.createDataFrame([(found["t"], "supersede", "a", ["a", "b"]), (found["u"], "both_stand", None, ["d", "e"]), (found["v"], "supersede", None, ["f", "g"])], "cluster_id string, outcome string, winner string, claim_ids array<string>")
    state = {r.topic_key: (r.status, list(r.unadjudicated_claim_ids)) for r in contradictions.detect(rows, adj).collect()}
    assert state == {"t": ("OPEN", ["c"]), "u": ("RESOLVED", []), "v": ("RESOLVED", [])}
    done = contradictions.apply_outcomes(rows, adj)
    assert {r.id: (r.status, r.confidence, r.superseded_by) for r in done.collect() if r.id in "abcde"} == {
        "a": ("active", "reported", None), "b": ("superseded", "reported", "a"), "c": ("active", "reported", None), "d": ("active", "contested", None), "e": ("active", "contested", None),
    }
    assert contradictions.unapplied(done, adj).count() == 0
    assert [c for c, _ in codes(gates.clusters(rows, adj))] == ["E-ADJ-NOWINNER"] + ["E-ADJ-UNAPPLIED"] * 3 + ["E-CLUSTER-OPEN"]


def test_ordinals_and_budget(spark):
    rows = ledger(spark, dict(id="z"), dict(id="y"), dict(id="x", confidence="inferred"), dict(id="w"), dict(id="v", status="retracted"))
    plan = spark.createDataFrame([(0, ["y", "x"]), (1, ["z", "y"])], "ord int, claim_ids array<string>")
    ords = claims.ordinals(rows, claims.placements(plan))
    assert {r.id: r.ordinal for r in ords.collect()} == {"y": 1, "z": 2, "w": 3}
    q = [("s", 0, 1, "w " * 26), ("s", 1, 2, "a" * 201), ("s", 2, 3, "b" * 200), ("s", 3, 4, "c" * 199), ("s", 4, 5, "d" * 150), ("s", 5, 6, "e" * 100), ("s", 6, 7, "f"), ("s", 2, 3, "b" * 200), ("r", 0, 1, "")]
    df = spark.createDataFrame([(i, *x, False) for i, x in enumerate(q)], "ord int, source_id string, start int, end int, quote string, redacted boolean")
    assert {r.ord: r.granted for r in claims.budget(df).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}
    red = {r.ord: (r.quote, r.length) for r in claims.redact(df.withColumn("quote_sha256", F.lit(None).cast("string"))).collect()}
    assert red[5] == ("e" * 100, None) and red[4] == (None, 150)


def test_renderings(spark):
    rows = claims.normalize_claims(ledger(spark, dict(id=None, text="A <b>", recheck="javascript:1", evidence=[ev()]), dict(id=None, text="thin", confidence="inferred")))
    plan = spark.createDataFrame([], "ord int, claim_ids array<string>")
    full = claims.resolved(rows, claims.ordinals(rows, claims.placements(plan)))
    sources = spark.createDataFrame([("s1", "T", "P", "B", "https://x/y", "why", "2024")], "id string, title string, publisher string, tier string, locator string, tier_reason string, retrieved_at string")
    granted = claims.budget(claims.evidence_rows(full).withColumn("ord", F.lit(1)))
    html = {r.ordinal: r.body for r in claims.render_html(full, sources, granted).collect()}
    assert "A &lt;b&gt;" in html[1] and "withheld; not an http(s)" in html[1] and '<q class="ledger-quote">Hello</q>' in html[1] and "m-thin" in html[None]
    assert '"Hello"' in claims.render_markdown(full, sources, granted).first().body
    lines = claims.ledger_lines(claims.ledger_pieces(full, sources, granted, "json"), "json")
    read = json.loads(claims.whole(lines).first().body)
    assert [(c["ordinal"], c["text"]) for c in read["ledger"]] == [(1, "A <b>"), (None, "thin")] and read["schema_version"] == 1
    assert claims.source_listing(sources, rows).first().n_claims == 1
    page = spark.createDataFrame([("x<!--a-->old<!--b-->y",), ("none",), ("x<!--a-->y",), ("<!--b--><!--a-->o<!--b-->",)], "p string").select(claims.inject(F.col("p"), F.lit("NEW\n\n"), "<!--a-->", "<!--b-->").alias("o")).collect()
    assert [r.o for r in page] == ["x<!--a-->\nNEW\n<!--b-->y", None, "x<!--a-->\nNEW\n<!--b-->y", "<!--b--><!--a-->\nNEW\n<!--b-->"]


def test_schema_rules(spark):
    schema = {"type": "object", "required": ["id", "n"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^c_", "minLength": 4}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 5}, "k": {"enum": ["a", "b"]}, "v": {"const": 1}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "format": "date"}}}}
    rows = ['{"id":"c_ab","n":2}', '{"id":"x","n":9}', '{"n":true}', '{"id":"c_ab","n":null,"k":"c","v":2,"z":1}', '{"id":"c_ab","n":1,"tags":[]}', '{"id":"c_ab","n":1,"tags":["2024-01-01",5,"x"]}', "[1]", "{"]
    got = {}
    for r in validate(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "subject int, json string"), schema).collect():
        got.setdefault(r.subject, []).append(r.pointer)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["/id", "/id", "/n"], 2: ["", "/n"], 3: ["/k", "/v", "/z"], 4: ["/tags"], 5: ["/tags", "/tags/1", "/tags/2"], 6: [""], 7: [""]}


def test_dialogue_and_licenses(spark):
    lines = spark.createDataFrame([(1, "A", "x", "Hi", "factual", []), (2, "A", "x", "So.", "aside", ["c1"]), (3, "A", "x", "And", "aside", ["zz"]), (4, "B", "x", "Q", "aside", []), (5, "B", "y", "End", "aside", [])], "n int, speaker string, segment string, text string, kind string, claims array<string>")
    assert [r.pause_after_ms for r in publishing.dialogue_plan(lines).orderBy("segment_id").collect()] == [0, 180, 320, 600, 600]
    speakers = spark.createDataFrame([("A", "low")], "name string, voice_hint string")
    assert [c for c, _ in codes(gates.dialogue(lines, speakers, ledger(spark, dict(id="c1", status="retracted"))))] == ["E-POD-CLAIM-STALE", "E-POD-CLAIM-UNKNOWN", "E-POD-SPEAKER", "E-POD-SPEAKER", "E-POD-UNCITED"]
    html = spark.createDataFrame([(1, '<p>by Ann</p><img src="a.png"><img src="b.png"><img src="gen.png">')], "doc_id long, html string")
    credits = spark.createDataFrame([("a.png", "sourced", "u", "Ann", "CC BY 4.0", None, None, None), ("b.png", "sourced", "u", "Bob", "CC BY-NC-SA 4.0", None, None, "1"), ("gen.png", "generated", None, None, None, "m", None, None), ("odd.png", "found", None, None, None, None, None, None)], "name string, origin string, source string, credit string, license string, generator string, prompt string, sha256 string")
    at_hand = spark.createDataFrame([("b.png", "2")], "name string, sha256 string")
    got = codes(publishing.licenses(pages.dom_nodes(html), pages.page_texts(html), credits.filter("name <> 'a.png'"), at_hand))
    assert got == [("E-IMG-ATTRIB", "b.png"), ("E-IMG-FIELDS", "gen.png"), ("E-IMG-FIELDS", "odd.png"), ("E-IMG-HASH", "b.png"), ("E-IMG-LICENSE", "b.png"), ("E-IMG-UNCREDITED", "a.png"), ("E-IMG-UNLABELED", "gen.png"), ("W-IMG-SHAREALIKE", "b.png")]


def test_package_and_state(spark):
    files_ = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    listed = publishing.checksums(files_)
    changed = files_.filter("path = 'a'").select("path", F.lit(b"x").alias("content"))
    texts = spark.createDataFrame([("s1", "Hello")], "source_id string, text string")
    assert codes(publishing.verify_package(listed, changed, ledger(spark, dict(id="c", evidence=[ev(quote="Hullo")])), texts)) == [("E-PKG-CHECKSUM", "a"), ("E-PKG-MISSING", "b"), ("E-QUOTE-MISMATCH", "c")]
    zero = dict(revise_count=0, n_blockers=0, n_sources=1, n_unsettled=0, n_ready=1, n_chunked=1, has_index=True, has_plan=True, n_claims=1, n_open=0, n_artifacts=1, n_injected=1, has_provenance=True, stored_state="X")
    for change, want in ((dict(), "DONE"), (dict(n_sources=0), "INIT"), (dict(n_unsettled=1), "COLLECT"), (dict(n_chunked=0), "EXTRACT"), (dict(has_index=False), "CHUNK"), (dict(has_plan=False), "INDEX"), (dict(n_claims=0), "PLAN"), (dict(n_open=2), "GROUND"), (dict(n_artifacts=0), "ADJUDICATE"), (dict(n_injected=0), "COMPOSE"), (dict(has_provenance=False), "RENDER"), (dict(has_provenance=False, stored_state="VERIFY"), "VERIFY"), (dict(revise_count=3), "BLOCKED")):
        assert publishing.state(spark.createDataFrame([{**zero, **change}])).first().state == want


def test_sources(spark):
    raw = spark.createDataFrame([(bytearray("é".encode("cp1252")), "cp1252"), (bytearray(b'<meta charset="windows-1252">\xe9'), None), (bytearray(b"\xef\xbb\xbfx"), None), (bytearray(b"\xff"), None)], "b binary, c string")
    assert [r.t for r in raw.select(files.decode("b", "c").alias("t")).collect()] == ["é", '<meta charset="windows-1252">é', "x", "�"]
    urls = ["http://example.com/a", "ftp://x", "http://u:p@x/", "http://127.0.0.1/", "http://[::1]/", "http://10.1.2.3:80/", "http://169.254.1.1", "https://localhost/", "http:///x", "http://[::ffff:10.0.0.1]/", "http://8.8.8.8/"]
    got = [r.w for r in spark.createDataFrame([(u,) for u in urls], "u string").select(files.refusal(F.col("u")).alias("w")).collect()]
    assert [x is None for x in got] == [True] + [False] * 9 + [True]


def test_markdown():
    html = '<html><head><title>T &amp; U</title><meta name="author" content="Ann"></head><body><nav>skip</nav><article>' + "<h2>Head</h2><p>One <b>two</b> <a href='/x'>link</a></p><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table><blockquote><p>q</p></blockquote><pre>x\n y</pre>" + "<p>" + "long " * 60 + "</p></article></body></html>"
    md, title, author, *_ = pages.read_markdown(html, "https://s/")
    for part in ("## Head", "One **two** [link](https://s/x)", "- a", "  - b", "| h |\n| --- |\n| c |", "> q", "```\nx\n y\n```"):
        assert part in md
    assert "skip" not in md and (title, author) == ("T & U", "Ann")


SLOP = """<html lang="en"><head><title>t</title><meta name="viewport" content="x"><style>
:root{--a:#7c3aed;--b:var(--a)}
.h{background:linear-gradient(90deg,#7c3aed,#a855f7);-webkit-background-clip:text;background-clip:text}
.s{border-left:4px solid var(--b)} .r{border-radius:32px} .g{border:1px solid #eee;box-shadow:0 8px 24px rgba(0,0,0,.2)}
body{background:#f7f1e3;color:#999;font-size:16px} .big{font-size:clamp(2rem,8vw,9rem);letter-spacing:-0.06em}
.k{text-transform:uppercase;letter-spacing:.1em;font-size:12px} a{outline:none;height:30px} .z{z-index:9999;transition:all 1s}
.x{opacity:0} .x.on{opacity:1} .w{max-width:800px} .ww{width:clamp(1px,2vw,1000px)} .st{background:repeating-linear-gradient(1px,2px)} h2{font-size:20px} h3{font-size:22px}
@media (min-width:1px){ .m{font-family:Inter, sans-serif} } @import url("https://c.d/e.css");
</style></head><body><p class="k">One</p><p class="k">Two</p><p class="k">Three</p><div>01</div><div>02</div><div>03</div><h2>Big grey</h2>
<section><div class="c"><b>x</b><i>y</i></div><div class="c"><b>x</b><i>y</i></div><div class="c"><b>x</b><i>y</i></div><div class="c"><b>x</b><i>y</i></div></section>
<p>We leverage — security theater</p><img src="https://a.b/c.png"><script>el.classList.add('on')</script></body></html>"""
CLEAN = """<html lang="en"><head><title>t</title><meta name="viewport" content="x"><style>body{background:#fff;color:#111;font-size:16px}
h1{font-size:40px} a:focus-visible{outline:2px solid #111}</style></head><body><h1>Plain</h1><p>Text.</p><img src="a.png" alt="a"></body></html>"""


def test_every_rule_fires_and_a_clean_page_is_silent(spark):
    from evidentia.operators.lint import RULES

    bare = "<body><style>p{color:cyan} body{background:#000}</style><p>x</p></body>"
    out = lint(spark.createDataFrame([(1, SLOP), (2, CLEAN), (3, bare)], "doc_id long, html string"), {"copy.em-dash": "house style", "slop.hero-shout": "no"}).collect()
    assert not [r for r in out if r.doc_id == 2]
    assert {r.rule for r in out if r.doc_id == 1} == set(RULES) - {"a11y.lang-title"}
    assert {r.rule for r in out if r.waived} == {"copy.em-dash"}
    assert sorted(r.detail for r in out if r.doc_id == 3 and r.rule == "a11y.lang-title") == ["missing <title>", "missing lang attribute", "missing viewport meta"]
    assert [r.rule for r in out if r.doc_id == 3 and r.rule == "slop.ai-palette"] == ["slop.ai-palette"]


def test_html_gate(spark):
    page = '<div class="mark-legend"></div><p data-claim="a"><span class="mark m-reported">x</span><sup class="ref"><a href="#c-a">1</a></sup><span data-claim="b"><i class="m-moving"></i></span></p><p data-claim="zz old"></p><a href="#c-q"></a><li id="c-a"></li><li id="c-c"></li><li id="c-i"></li><div data-claim="i"><em><img data-origin="generated" src="g.png"></em><sup class="ref"></sup></div>'
    html = spark.createDataFrame([(1, page)], "doc_id long, html string")
    rows = ledger(spark, dict(id="a"), dict(id="b", volatile=True, as_of="2024-01-01"), dict(id="old", status="retracted"), dict(id="c"), dict(id="i", confidence="inferred"), dict(id="h", confidence="contested"))
    got = codes(gates.html(rows, pages.dom_nodes(html), pages.page_texts(html)))
    assert got == [("E-ASOF-MISSING", "b"), ("E-CITE-INFERRED", "i"), ("E-CLAIM-UNKNOWN", "old"), ("E-CLAIM-UNKNOWN", "zz"), ("E-CONTESTED-HIDDEN", "h"), ("E-IMG-EVIDENCE", "g.png"), ("E-LEDGER-ORPHAN", "c"), ("E-MARK-WRONG", "b"), ("E-MARK-WRONG", "i"), ("E-REF-DANGLING", "q")]


def test_engine_from_text_to_verdict(spark):
    from evidentia.engine import Engine

    texts = spark.createDataFrame([("s1", "Hello world. The cat sat.\n")], "source_id string, text string")
    sources = spark.createDataFrame([("s1", "T", "P", "B", "https://x", "why", "2024", "ready", 1, None)], "id string, title string, publisher string, tier string, locator string, tier_reason string, retrieved_at string, status string, normalizer_version int, normalized_sha256 string")
    e = Engine(spark, texts=texts, sources=sources, plan=spark.createDataFrame([(0, ["x"])], "ord int, claim_ids array<string>"))
    assert e.chunk().count() == 1 and e.search(e.index(), "cat").first().source_id == "s1"
    e.claim_add(ledger(spark, dict(id=None, text="It said hello", evidence=[ev()]), dict(id=None, topic_key="n", kind="number", text="1 m", evidence=[ev(quote="Wrong")]), dict(id=None, topic_key="n", kind="number", text="2 m", evidence=[ev()])))
    cluster = e.contradictions().first()
    e.adjudicate(spark.createDataFrame([(cluster.cluster_id, "both_stand", None, list(cluster.claim_ids))], "cluster_id string, outcome string, winner string, claim_ids array<string>"), apply=True)
    found = [r.code for r in e.verify().collect()]
    assert found.count("E-SCHEMA") and sorted(c for c in found if c != "E-SCHEMA") == ["E-CONTESTED-HIDDEN", "E-CONTESTED-HIDDEN", "E-PLAN-ORPHAN", "E-QUOTE-MISMATCH"]
    assert all(e.ledger(f).count() >= 1 for f in ("html", "md", "json", "sources"))
    assert sum(r.redacted for r in e.package(public=True)[1].collect()) == 0
    e.register()
    assert spark.sql("select count(*) n from claims").first().n == 3


def test_schema_gate_and_extra_checks(spark):
    import json

    good = dict(id="clm_" + "0" * 12, text="abc", topic_key="a.b", kind="fact", confidence="reported", evidence=[dict(source_id="src_" + "a" * 12, start=0, end=2)], status="active")
    rows = [("ok", good), ("bad", {**good, "kind": "x", "evidence": [dict(source_id="s", start=-1, end=2, more=1)]}), ("none", {})]
    df = spark.createDataFrame([(s, json.dumps(r)) for s, r in rows], "subject string, json string")
    got = [(r.code, r.subject) for r in gates.ordered(gates.schemas(df, "claim")).collect()]
    assert got == [("E-SCHEMA", "bad")] * 4 + [("E-SCHEMA", "none")] * 7
    sources = spark.createDataFrame([("s1", "A"), ("s2", "C")], "id string, tier string")
    thin = gates.thin_topics(ledger(spark, dict(id="a", evidence=[ev("s1"), ev("s2")])), sources).first()
    assert (thin.subject, thin.detail, thin.severity) == ("t", "1 strong sources", "warn")


def test_captures_are_routed(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\r\n\r\ntext  \r\n")
    (tmp_path / "b.html").write_text("<body><p>" + "word " * 60 + "</p></body>")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.pdf").write_bytes(b"%PDF broken")
    got = {r.path[-4:]: (r.status, r.text) for r in files.route(files.captures(spark, str(tmp_path))).collect()}
    large = {r.path[-4:]: r.status for r in files.route(files.captures(spark, str(tmp_path), 10)).collect()}
    assert large == {"a.md": "failed", "html": "failed", ".bin": "needs_extraction", ".pdf": "failed"}
    assert got["a.md"[-4:]] == ("ready", "# T\n\ntext\n") and got["html"][0] == "ready" and got[".bin"] == ("needs_extraction", None) and got[".pdf"][0] == "needs_extraction"


def test_css_variables():
    from evidentia.sources.pages import resolve, style_rules

    props = {"--a": "1px", "--b": "var(--a)", "--c": "var(--b)"}
    assert [resolve(v, props) for v in ("var(--a)", "var(--b) solid", "var(--c)", "var(--z, 3px)", "var(--z)", "plain")] == ["1px", "1px solid", None, "3px", None, "plain"]
    css = "/* x */ a{b:c;d:url(x;y)}\n@media print{e{f:g}}\n@keyframes k{from{a:b}}\n@font-face{src:x}"
    assert [(s, d, at, n) for s, d, at, n in style_rules(css)] == [("a", {"b": "c", "d": "url(x;y)"}, None, 1), ("e", {"f": "g"}, "@media print", 2), ("@keyframes k", {}, "@keyframes k", 3), ("@font-face", {"src": "x"}, None, 4)]


def test_html_gate_judges_each_page_by_itself(spark):
    legend = '<div class="mark-legend"></div>'
    html = spark.createDataFrame([(1, legend + '<a href="#c-a"></a><p data-claim="a" class="m-reported">x</p>'), (2, legend * 2 + '<li id="c-a"></li><p>quoted words here</p>')], "doc_id long, html string")
    rows = ledger(spark, dict(id="a", evidence=[ev(quote="quoted words here", start=i) for i in range(4)]))
    assert codes(gates.html(rows, pages.dom_nodes(html), pages.page_texts(html))) == [("E-LEDGER-ORPHAN", "a"), ("E-LEGEND", "2"), ("E-QUOTE-BUDGET", "s1"), ("E-REF-DANGLING", "a")]


def test_findings_of_rules_come_errors_first(spark):
    out = lint(spark.createDataFrame([(2, SLOP), (1, SLOP)], "doc_id long, html string")).collect()
    assert [r.severity for r in out] == sorted(r.severity for r in out) and out[0].doc_id == 1


def test_whole_ledgers_are_injected(spark):
    from evidentia.engine import Engine

    rows = claims.normalize_claims(ledger(spark, dict(id=None, text="A"), dict(id=None, text="B", confidence="inferred")))
    sources = spark.createDataFrame([], "id string, title string, publisher string, tier string, locator string, tier_reason string, retrieved_at string")
    pages_ = spark.createDataFrame([(1, "<p>x</p><!-- LEDGER -->"), (2, "no marker")], "doc_id long, html string")
    e = Engine(spark, claims=rows, sources=sources, pages=pages_, plan=spark.createDataFrame([], "ord int, claim_ids array<string>"))
    out = e.inject(e.ledger("html")).select("doc_id", "html", publishing.injected(F.col("html"), "<!-- LEDGER -->", "<!-- /LEDGER -->").alias("there")).orderBy("doc_id").collect()
    assert out[0].there and '<ol class="ledger">' in out[0].html and '<ul class="ledger ledger-thin">' in out[0].html and out[1].html is None
    assert claims.whole(e.ledger("md")).first().body.startswith("# Ledger\n\n1. **A**")
