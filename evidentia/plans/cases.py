"""Queries whose cases are made from whole tables by arithmetic on their keys, so that plain SQL knows the answers.

A case is written twice and in different terms: the query builds pages, claims or records from a key ``k`` (and a
size ``s``) and runs the operator over them, the twin says for which keys there is what finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import color, css, text
from ..operators import chunking, claims, contradictions, gates, lint, publishing, retrieval, schema_rules
from ..sources import files, pages
from ..streaming import windows


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("s"))


_PARTS = "p AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS s FROM part)"

# ------------------------------------------------------------------------ page rules
# (rule, severity, style and body of the page in Spark SQL, when it is found in plain SQL)

SURFACES = (
    ("slop.gradient-text", "error", "concat('.g{background-clip:text;background:', if(s % 2 = 0, 'linear-gradient(red,blue)', 'red'), '}')", "''", "s % 2 = 0"),
    ("slop.side-stripe", "error", "concat('.b{border-left:', s % 6, 'px solid ', if(k % 3 = 0, 'red', '#888'), '}')", "''", "s % 6 >= 2 AND k % 3 = 0"),
    ("slop.over-round", "error", "concat('.r{border-radius:', s, if(k % 7 = 0, '%', 'px'), '}')", "''", "s >= 24 AND k % 7 <> 0"),
    ("slop.ghost-card", "error", "concat('.c{border:', 1 + k % 2, 'px solid #ccc;box-shadow:0 2px ', s, 'px #0003}')", "''", "k % 2 = 0 AND s >= 16"),
    ("slop.stripe-bg", "error", "if(k % 5 = 0, '.s{background:repeating-linear-gradient(45deg,#eee,#fff)}', '')", "''", "k % 5 = 0"),
    ("slop.hero-shout", "error", "concat('.h{font-size:clamp(2rem,5vw,', s * 3, 'px)}')", "''", "s * 3 > 96"),
    ("slop.tracking-floor", "error", "concat('.t{font-size:40px;letter-spacing:-0.0', s % 10, 'em}')", "''", "s % 10 >= 5"),
    ("a11y.tap-target", "warn", "concat('a.btn{height:', s * 2, 'px}')", "''", "s * 2 < 44"),
    ("a11y.focus-visible", "error", "concat('.f{outline:none}', if(k % 2 = 0, '.f:focus-visible{outline:2px solid}', ''))", "''", "k % 2 = 1"),
    ("a11y.reduced-motion", "error", "concat('.m{transition:all 1s}', if(k % 4 = 0, '', '@media (prefers-reduced-motion: reduce){.m{transition:none}}'))", "''", "k % 4 = 0"),
    ("struct.zindex-arbitrary", "warn", "concat('.z{z-index:', s * 4, '}')", "''", "s * 4 >= 100"),
    ("struct.overflow-risk", "warn", "concat('.o{max-width:600px}.p{width:clamp(100px,50%,', s * 20, 'px)}')", "''", "s * 20 > 600"),
)
_RATIO = "1.05 / (CASE WHEN s * 5 / 255.0 <= 0.04045 THEN s * 5 / 255.0 / 12.92 ELSE ((s * 5 / 255.0 + 0.055) / 1.055) ** 2.4 END + 0.05)"
COLORS = (
    ("a11y.contrast-body", "error", "concat('body{background:#fff}.x{color:rgb(', s * 5, ',', s * 5, ',', s * 5, ');font-size:', if(k % 2 = 0, 16, 24), 'px}')", "'<p class=\"x\">Text</p>'", f"k % 2 = 0 AND {_RATIO} < 4.5"),
    ("a11y.contrast-large", "error", "''", "''", f"k % 2 = 1 AND {_RATIO} < 3"),
    ("slop.cream-band", "error", "concat('.page{background:oklch(0.9 0.03 ', s * 5 + 2, ')}')", "''", "s * 5 + 2 BETWEEN 40 AND 100"),
    ("slop.ai-palette", "error", "concat('.i{border-image:linear-gradient(oklch(0.6 0.08 ', s * 7 + 2, '),oklch(0.65 0.08 ', s * 7 + 2, '))}')", "''", "s * 7 + 2 BETWEEN 255 AND 330"),
    ("slop.sole-overused-font", "warn", "concat('.y{font-family:Inter', if(k % 2 = 0, '', ',Georgia'), ',sans-serif}')", "''", "k % 2 = 0"),
)
WORDS = (
    ("slop.eyebrow-reflex", "error", "'.e{text-transform:uppercase;letter-spacing:0.1em;font-size:12px}'", "repeat('<span class=\"e\">x</span>', s % 5)", "s % 5 >= 3"),
    ("slop.flat-scale", "warn", "concat('h1{font-size:16px}h2{font-size:', 12 + s, 'px}')", "''", "s < 8 AND s <> 4"),
    ("slop.numbered-scaffold", "warn", "''", "repeat('<p>01</p>', s % 7)", "s % 7 >= 3"),
    ("slop.card-grid-clone", "warn", "''", "concat('<div>', repeat('<div class=\"card\"><h3>a</h3><p>b</p></div>', s % 6), '</div>')", "s % 6 >= 4"),
    ("copy.em-dash", "warn", "''", "if(k % 2 = 0, '<p>This — that</p>', '<p>This, that</p>')", "k % 2 = 0"),
    ("copy.buzzword", "warn", "''", "if(k % 3 = 0, '<p>We leverage it</p>', '<p>We use levers</p>')", "k % 3 = 0"),
    ("copy.meta-phrase", "warn", "''", "if(k % 5 = 0, '<p> This is actually so</p>', '<p> It is so</p>')", "k % 5 = 0"),
    ("a11y.reveal-gate", "error", "'.v{opacity:0}.v.on{opacity:1}'", "if(k % 4 = 0, '<script>el.classList.add(\"on\")</script>', '')", "k % 4 = 0"),
    ("a11y.img-alt", "error", "''", "concat('<img src=\"a.png\"', if(k % 2 = 0, ' alt=\"a\"', ''), '>')", "k % 2 = 1"),
    ("struct.external-ref", "error", "''", "if(k % 3 = 1, '<script src=\"https://x.example/a.js\"></script>', '')", "k % 3 = 1"),
)


def _linted(spark, d, cases):
    style, body = (F.concat(*(F.expr(case[i]) for case in cases)) for i in (2, 3))
    html = F.concat(F.lit("<html><head><style>"), style, F.lit("</style></head><body>"), body, F.lit("</body></html>"))
    found = lint.lint(_parts(spark, d).select(F.col("k").alias("doc_id"), html.alias("html")), rules=[case[0] for case in cases])
    return found.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


def _expected(cases) -> str:
    return f"WITH {_PARTS} " + " UNION ALL ".join(f"SELECT k AS doc_id, '{c[0]}' AS rule, '{c[1]}' AS severity, 1::BIGINT AS n FROM p WHERE {c[4]}" for c in cases)


def lint_surfaces(spark, d):
    return _linted(spark, d, SURFACES)


def lint_colors(spark, d):
    return _linted(spark, d, COLORS)


def lint_words(spark, d):
    return _linted(spark, d, WORDS)


def lint_cyan_and_imports(spark, d):
    """Cyan on dark pages; style sheets and pictures that styles load from outside."""
    style = F.expr("concat('body{background:', if(k % 2 = 0, '#000', '#fff'), '}.q{color:', if(k % 3 = 0, 'cyan', 'red'), '}.u{background-image:url(', if(k % 5 = 0, 'https://x.example/', ''), 'a.png)}', if(k % 4 = 0, '@import \"//x.example/y.css\";', ''))")
    html = F.concat(F.lit("<html><head><style>"), style, F.lit("</style></head><body></body></html>"))
    found = lint.lint(_parts(spark, d).select(F.col("k").alias("doc_id"), html.alias("html")), rules=["slop.ai-palette", "struct.external-ref"])
    return found.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


def subtree_text(spark, d):
    """The characters of text below every element of pages made from keys, and how many elements those are."""
    html = F.expr("concat('<html><body><div>', repeat('<p>xx</p>', s % 5), '<section>', repeat('y', cast(k % 7 as int)), '<b>z<i>u</i></b></section></div><ul>', repeat('<li>o<br></li>', cast(k % 3 as int)), '</ul></body></html>')")
    nodes = pages.dom_nodes(_parts(spark, d).select(F.col("k").alias("doc_id"), html.alias("html")))
    sums = pages.subtree_sums(nodes, {"chars": F.length("own_text").cast("long"), "elements": (~F.col("tag").startswith("#")).cast("long")})
    return sums.filter("tag not like '#%'").groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("elements").alias("elements"))


def color_spaces(spark, d):
    rows = _parts(spark, d).selectExpr("k", "s * 5 AS r", "k * 7 % 256 AS g", "k * 13 % 256 AS b")
    written = F.when(F.col("k") % 2 == 0, F.format_string("#%02x%02x%02x", "r", F.col("g").cast("int"), F.col("b").cast("int"))).otherwise(F.format_string("rgb(%d, %d, %d)", "r", "g", "b"))
    white = color.parse_color(F.lit("white"))
    got = rows.select("k", color.parse_color(written).alias("c"), white.alias("w"))
    return got.select("k", F.round("c.l", 4).alias("light"), F.round("c.c", 4).alias("chroma"), F.round(color.contrast_ratio(F.col("c"), F.col("w")), 3).alias("contrast"), color.is_neutral(F.col("c")).alias("neutral"))


def css_values(spark, d):
    units = F.array(*map(F.lit, ("px", "rem", "em", "pt", "cm", "mm", "in", "Q", "vw")))
    size = F.concat(F.col("s").cast("string"), F.get(units, (F.col("k") % 9).cast("int")))
    bounds = css.clamp_bounds(F.format_string("clamp(1rem, 2vw + 1px, %dpx)", "s"))
    weight = css.specificity(F.expr("concat(repeat('#a', cast(k % 3 as int)), repeat('.b', s % 4), ' p > span')"))
    got = _parts(spark, d).select("k", F.round(css.length_px(size), 4).alias("px"), bounds.alias("b"), weight.alias("w"))
    return got.select("k", "px", "b.low", "b.high", *(F.col(f"w.{c}").cast("long").alias(c) for c in ("ids", "classes", "tags")))


# ------------------------------------------------------------- gates over rendered pages


def _counted(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "subject").agg(F.count("*").alias("n"))


def _findings(rows: str, cases: tuple[tuple[str, str, str], ...]) -> str:
    """Counts by code and subject of (code, subject, when)."""
    each = " UNION ALL ".join(f"SELECT '{code}' AS code, {subject} AS subject FROM p WHERE {when}" for code, subject, when in cases)
    return f"WITH {rows}, f AS ({each}) SELECT code, subject, count(*) AS n FROM f GROUP BY code, subject"


def html_gate(spark, d):
    """A claim block, a reference, a ledger entry and legends before each page."""
    rendered = t(spark, d, "pages").withColumn("k", F.col("page_id")).select(F.col("k").alias("doc_id"), F.expr("""concat(
        '<div', if(k % 17 = 0, '', concat(' data-claim="c', k, '"')), '><span class="mark m-checked">x</span>', if(k % 3 = 1, '<i class="m-moving">m</i>', ''), if(k % 5 = 0, '<sup class="ref">1</sup>', ''),
        if(k % 7 = 0, ' 1871-02-03 ', ''), if(k % 6 = 0, concat('<img data-origin="generated" src="p', k, '.png">'), ''), if(k % 8 = 0, repeat(concat('stated', k, ' '), 26), ''), '</div>',
        if(k % 3 <> 0, concat('<a href="#c-c', k, '">1</a>'), ''), if(k % 4 <> 0, concat('<li id="c-c', k, '">e</li>'), ''), repeat('<b class="mark-legend">l</b>', cast(k % 3 as int)), html)""").alias("html"))
    held = t(spark, d, "pages").withColumn("k", F.col("page_id")).filter("k % 13 <> 0").select(
        F.expr("concat('c', k)").alias("id"), F.expr("if(k % 11 = 0, 'retracted', 'active')").alias("status"), F.expr("k % 2 = 0").alias("volatile"), F.lit("1871-02-03").alias("as_of"),
        F.expr("get(array('verified', 'reported', 'contested', 'inferred'), cast(k % 4 as int))").alias("confidence"),
        F.expr("array(named_struct('source_id', concat('s', k % 9), 'start', cast(k as int), 'end', cast(k + 1 as int), 'quote', trim(repeat(concat('stated', k, ' '), 26)), 'quote_sha256', cast(null as string), 'redacted', false))").alias("evidence"))
    parsed = pages.Parsed(rendered, "nodes", "texts")
    return _counted(gates.html(held, parsed.nodes, parsed.texts))


_LIVE = "k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0"
_HTML = (
    ("E-REF-DANGLING", "'c' || k", "k % 3 <> 0 AND k % 4 = 0"), ("E-LEDGER-ORPHAN", "'c' || k", "k % 3 = 0 AND k % 4 <> 0 AND (k % 4 <> 3 OR k % 13 = 0)"),
    ("E-CLAIM-UNKNOWN", "'c' || k", "k % 17 <> 0 AND (k % 13 = 0 OR k % 11 = 0)"), ("E-MARK-WRONG", "'c' || k", f"{_LIVE} AND k % 4 <> 0"), ("E-MARK-WRONG", "'c' || k", f"{_LIVE} AND k % 2 = 0 AND k % 3 <> 1"),
    ("E-CITE-INFERRED", "'c' || k", f"{_LIVE} AND k % 4 = 3 AND k % 5 = 0"), ("E-ASOF-MISSING", "'c' || k", f"{_LIVE} AND k % 2 = 0 AND k % 7 <> 0"),
    ("E-CONTESTED-HIDDEN", "'c' || k", "k % 13 <> 0 AND k % 11 <> 0 AND k % 4 = 2 AND k % 17 = 0"), ("E-LEGEND", "CAST(k AS VARCHAR)", "k % 3 <> 1"),
    ("E-IMG-EVIDENCE", "'p' || k || '.png'", "k % 6 = 0 AND k % 17 <> 0"), ("E-QUOTE-BUDGET", "'c' || k", "k % 8 = 0 AND k % 13 <> 0"),
)


def license_gate(spark, d):
    """An image with its credit and label before each page."""
    rows = t(spark, d, "pages").withColumn("k", F.col("page_id"))
    shown = rows.select(F.col("k").alias("doc_id"), F.expr("concat('<p>', if(k % 2 = 0, concat('Photo by P', k), ''), if(k % 8 < 4, ' Generated illustration', ''), '</p><img src=\"img', k, '.png\">', html)").alias("html"))
    credits = rows.filter("k % 10 <> 9").select(
        F.expr("concat('img', k, '.png')").alias("name"), F.expr("get(array('sourced', 'generated', 'found'), cast(k % 3 as int))").alias("origin"), F.lit("u").alias("source"), F.expr("if(k % 7 = 0, null, concat('Photo by P', k))").alias("credit"),
        F.expr("get(array('CC BY 4.0', 'CC BY-NC 4.0', 'CC0', 'CC BY-SA 4.0', 'Foo'), cast(k % 5 as int))").alias("license"), F.expr("if(k % 4 = 0, null, 'm')").alias("generator"), F.lit("x").alias("prompt"), F.expr("if(k % 6 = 0, repeat('a', 64), null)").alias("sha256"))
    at_hand = rows.select(F.expr("concat('img', k, '.png')").alias("name"), F.expr("repeat(if(k % 12 = 0, 'b', 'a'), 64)").alias("sha256"))
    parsed = pages.Parsed(shown, "nodes", "texts")
    return _counted(publishing.licenses(parsed.nodes, parsed.texts, credits, at_hand))


_IMG, _SOURCED = "'img' || k || '.png'", "k % 10 <> 9 AND k % 3 = 0"
_LICENSES = (
    ("E-IMG-UNCREDITED", _IMG, "k % 10 = 9"), ("E-IMG-FIELDS", _IMG, f"{_SOURCED} AND k % 7 = 0"), ("E-IMG-FIELDS", _IMG, "k % 10 <> 9 AND k % 3 = 1 AND k % 4 = 0"), ("E-IMG-FIELDS", _IMG, "k % 10 <> 9 AND k % 3 = 2"),
    ("E-IMG-LICENSE", _IMG, f"{_SOURCED} AND k % 5 IN (1, 4)"), ("E-IMG-ATTRIB", _IMG, f"{_SOURCED} AND k % 5 IN (0, 1, 3) AND k % 7 <> 0 AND k % 2 = 1"), ("W-IMG-SHAREALIKE", _IMG, f"{_SOURCED} AND k % 5 = 3"),
    ("E-IMG-UNLABELED", _IMG, "k % 10 <> 9 AND k % 3 = 1 AND k % 8 >= 4"), ("E-IMG-HASH", _IMG, "k % 10 <> 9 AND k % 12 = 0"),
)

# ------------------------------------------------------------------ gates over the ledger


def dialogue_gate(spark, d):
    lines = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("int").alias("n"), F.col("o_orderpriority").alias("speaker"), F.expr("if(o_orderstatus = 'F', 'factual', 'aside')").alias("kind"), F.expr("if(o_orderkey % 3 = 0, array(), array(cast(o_custkey as string)))").alias("claims"))
    speakers = t(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).filter("name <> '5-LOW'").distinct()
    held = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"), F.expr("if(c_mktsegment = 'BUILDING', 'retracted', 'active')").alias("status"))
    return _counted(gates.dialogue(lines, speakers, held))


def normalizer_gate(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    sources = rows.select(F.col("k").alias("id"), F.expr("if(k % 3 = 0, 'pending', 'ready')").alias("status"), F.expr("if(k % 5 = 0, repeat('0', 64), sha2(text, 256))").alias("normalized_sha256"), F.expr("if(k % 7 = 0, 0, 1)").alias("normalizer_version"))
    return _counted(gates.normalizer(sources, rows.filter("k % 11 <> 0").select(F.col("k").alias("source_id"), "text")))


def confidence_gate(spark, d):
    held = t(spark, d, "orders").withColumn("k", F.col("o_orderkey")).select(
        F.col("k").alias("id"), F.expr("if(k % 3 = 0, 'retracted', 'active')").alias("status"), F.expr("get(array('verified', 'inferred', 'unsupported', 'reported'), cast(k % 4 as int))").alias("confidence"),
        F.expr(f"if(k % 5 = 0, cast(array() as array<{claims.EVIDENCE}>), array(cast(null as {claims.EVIDENCE})))").alias("evidence"))
    return _counted(gates.confidence(held))


def topic_dates(spark, d):
    due = F.expr("concat('Due on ', date_format(o_orderdate, 'yyyy-MM-dd'), if(o_orderkey % 2 = 0, ' or on 1999-01-01', ''))")
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("topic_key"), due.alias("text"), F.lit("date").alias("kind"), F.lit(None).cast("double").alias("number"),
        F.lit(False).alias("volatile"), F.lit(None).cast("string").alias("as_of"), F.lit("active").alias("status"))
    return contradictions.flags(rows).filter("is_date").select("topic_key", "id")


def topic_explicit(spark, d):
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 3).cast("string").alias("topic_key"), F.lit("x").alias("text"), F.lit("statement").alias("kind"), F.lit(False).alias("volatile"),
        F.lit(None).cast("string").alias("as_of"), F.expr("if(o_orderstatus = 'P', 'retracted', 'active')").alias("status"), F.array((F.col("o_orderkey") + 1).cast("string"), F.lit("nobody")).alias("contradicts"))
    return contradictions.flags(rows).filter("is_explicit").select("topic_key", "id")


def adjudications_recorded(spark, d):
    """Every third customer's adjudication is recorded anew, and some are new."""
    known = t(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("cluster_id"), F.lit("retract").alias("outcome"))
    new = t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cluster_id"), F.lit("both_stand").alias("outcome"))
    return Engine(spark, adjudications=known).adjudicate(new)


def quote_budget_spans(spark, d):
    quotes = t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + 10).cast("int").alias("end"),
        F.expr("repeat('x', cast(l_quantity * 6 as int))").alias("quote"), F.lit(False).alias("redacted"), F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as int)").alias("ord"))
    return claims.budget(quotes).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("granted").alias("granted"))


def claim_defaults(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_name").alias("text"), F.expr("if(c_custkey % 2 = 0, 'retracted', null)").alias("status"), F.expr("if(c_custkey % 3 = 0, true, null)").alias("volatile"))
    return claims.normalize_claims(rows).select("id", "status", "volatile", F.size("contradicts").cast("long").alias("links"), "notes")


def plan_contested(spark, d):
    """Contested claims that a plan leaves out."""
    held = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("if(c_custkey % 7 = 0, 'retracted', 'active')").alias("status"), F.expr("if(c_custkey % 4 = 0, 'contested', 'verified')").alias("confidence"))
    return _counted(gates.plan(held, held.filter("id % 3 = 0").select(F.lit("s").alias("section"), "id")))


def late_members(spark, d):
    """Conflicts whose adjudications name all members, or only the first: those are open again, and say for whom."""
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("topic_key"), F.lit("").alias("text"), F.lit("number").alias("kind"), (F.col("o_orderkey") * F.col("o_orderkey")).cast("double").alias("number"),
        F.lit(False).alias("volatile"), F.lit(None).cast("string").alias("as_of"), F.lit("active").alias("status"), F.lit("reported").alias("confidence"))
    found = contradictions.detect(rows)
    settled = found.filter("cast(topic_key as long) % 5 <> 0").select("cluster_id", F.lit("both_stand").alias("outcome"), F.expr("if(cast(topic_key as long) % 3 = 0, array(array_min(claim_ids)), claim_ids)").alias("claim_ids"))
    return contradictions.detect(rows, settled).select("topic_key", "status", F.size("claim_ids").cast("long").alias("n"), F.array_join("unadjudicated_claim_ids", " ").alias("late"))


def quote_excess(spark, d):
    """Pages that print some quotes of one source: more than three, or too many characters, are found by page and source."""
    pages_ = t(spark, d, "pages").withColumn("k", F.col("page_id"))
    made = F.expr("transform(sequence(0, 5), i -> concat('wq', k, 'x', i, ' ', repeat('z', cast(k % 3 * 70 as int))))")
    rows = pages_.select("k", "html", made.alias("said"))
    rendered = rows.select(F.col("k").alias("doc_id"), F.concat(F.lit("<p>"), F.array_join(F.slice("said", 1, (F.col("k") % 7).cast("int")), " | "), F.lit('</p><i class="mark-legend">m</i>'), "html").alias("html"))
    held = rows.select(F.posexplode("said").alias("i", "quote"), "k").select(
        F.format_string("c%d-%d", "k", "i").alias("id"), F.lit("active").alias("status"), F.lit("verified").alias("confidence"), F.lit(False).alias("volatile"), F.lit(None).cast("string").alias("as_of"),
        F.expr("array(named_struct('source_id', concat('s', k), 'start', i, 'end', i + 1, 'quote', quote, 'quote_sha256', cast(null as string), 'redacted', false))").alias("evidence"))
    parsed = pages.Parsed(rendered, "nodes", "texts")
    return _counted(gates.html(held, parsed.nodes, parsed.texts).filter("code = 'E-QUOTE-BUDGET'"))


def cascade(spark, d):
    """Up to five declarations compete for the colour of one paragraph: by inline style, id, later and earlier class, and name."""
    light, dark = "color:#ccc", "color:#000"
    style = F.expr(f"concat('body{{background:#fff}}', if(k % 7 = 0, '#y{{{dark}}}', ''), if(k % 3 = 0, '.x{{{dark}}}', ''), if(k % 5 = 0, '.z{{{light}}}', ''), if(k % 2 = 0, 'p{{{light}}}', ''))")
    body = F.expr(f"concat('<p id=\"y\" class=\"x z\"', if(k % 11 = 0, ' style=\"{light}\"', ''), '>Text</p>')")
    html = F.concat(F.lit("<html><head><style>"), style, F.lit("</style></head><body>"), body, F.lit("</body></html>"))
    return lint.lint(_parts(spark, d).select(F.col("k").alias("doc_id"), html.alias("html")), rules=["a11y.contrast-body"]).select("doc_id", "snippet")


def chunk_edges(spark, d):
    """Chunks of texts made from keys: paragraphs under a heading for even keys, one long paragraph of sentences for odd ones."""
    even = "concat('# H', k, '\\n', repeat(concat(repeat('wwwwwwwww ', 40), '\\n\\n'), cast(k % 13 + 1 as int)))"
    odd = "concat(repeat(concat(repeat('a', 98), '. '), cast(k % 37 + 1 as int)), '\\n')"
    made = _parts(spark, d).select(F.col("k").alias("source_id"), F.expr(f"if(k % 2 = 0, {even}, {odd})").alias("text"))
    cuts = chunking.chunk(made)
    return cuts.select(F.col("source_id").cast("long").alias("k"), F.col("ordinal").cast("long").alias("ordinal"), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), F.array_join("heading_path", "/").alias("heads"))


def history_states(spark, d):
    """All orders as events of their customers' workspaces."""
    rows = t(spark, d, "orders").selectExpr("if(o_custkey % 3 = 0, 0, o_custkey) workspace", "o_orderkey seq", "get(array('failed', 'failed', 'advance', 'failed', 'advance', 'passed', 'failed', 'unblock', 'failed', 'advance', 'odd'), cast(o_orderkey % 11 as int)) action", "'COMPOSE' to_state")
    return publishing.history_states(rows).select("workspace", "seq", "revise_before", "revise_after", "state", "code")


# ----------------------------------------------------------------------- whole ledgers


def _book(spark, d) -> Engine:
    rows = t(spark, d, "customer").withColumn("k", F.col("c_custkey")).withColumn("cited", F.expr("k % 4 <> 2"))
    evidence = F.expr("""if(cited, array(named_struct('source_id', concat('s', c_nationkey), 'start', cast(k as int), 'end', cast(k + 9 as int), 'quote', if(k % 5 = 0, concat('said <', k, '>'), ''), 'quote_sha256', cast(null as string), 'length', cast(null as int), 'redacted', false)), array())""")
    held = rows.select(
        F.format_string("c%06d", "k").alias("id"), F.concat("c_name", F.lit(" & co")).alias("text"), F.lit("t").alias("topic_key"), F.lit("fact").alias("kind"), F.expr("k % 2 = 0").alias("volatile"),
        F.expr("get(array('verified', 'reported', 'inferred', 'contested'), cast(k % 4 as int))").alias("confidence"), F.expr("if(k % 9 = 0, 'retracted', 'active')").alias("status"), F.expr("if(k % 2 = 0, '2024-01-01', null)").alias("as_of"),
        F.expr("get(array('https://x/y', 'ftp://x', null), cast(k % 3 as int))").alias("recheck"), evidence.cast(f"array<{claims.EVIDENCE}>").alias("evidence"))
    sources = t(spark, d, "nation").select(
        F.expr("concat('s', n_nationkey)").alias("id"), F.col("n_name").alias("title"), F.lit("P").alias("publisher"), F.expr("get(array('A', 'B', 'C', 'D'), cast(n_nationkey % 4 as int))").alias("tier"),
        F.expr("if(n_nationkey % 2 = 0, concat('https://n/', n_nationkey), 'file.txt')").alias("locator"), F.lit("why").alias("tier_reason"), F.lit("2024").alias("retrieved_at"))
    plan = rows.filter("k % 3 = 0").agg(F.lit(0).alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.format_string("c%06d", "k").alias("id")))), lambda x: x["id"]).alias("claim_ids"))
    return Engine(spark, claims=held, sources=sources, plan=plan)


def ledger_markdown(spark, d):
    return _book(spark, d).ledger("md")


def ledger_html(spark, d):
    return _book(spark, d).ledger("html")


def ledger_json(spark, d):
    entry = "struct<id:string,ordinal:int,marks:array<string>>"
    lines = _book(spark, d).ledger("json").filter(F.col("line").rlike('^,?[{]"') & ~F.col("line").startswith('{"schema_version"'))
    body = lines.select((F.col("place") - 2).alias("place"), "offset", F.from_json(F.regexp_replace("line", "^,", ""), entry).alias("e"))
    return body.select("place", "e.id", F.col("e.ordinal").cast("long").alias("ordinal"), F.array_join("e.marks", " ").alias("marks"))


def ledger_sources(spark, d):
    return _book(spark, d).ledger("sources").select("tier", "title", "id", F.col("n_claims").cast("long").alias("n_claims"))


def pages_injected(spark, d):
    """The ledger goes between markers; the end marker is missing on some pages, both on others."""
    marked = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.expr("concat(html, get(array('<!-- LEDGER -->old<!-- /LEDGER -->z', '<!-- LEDGER -->z', ''), cast(page_id % 3 as int)))").alias("html"))
    ledger = spark.range(1).select(F.lit('<ol class="ledger"></ol>\n').alias("body"))
    done = Engine(spark, pages=marked).inject(ledger)
    return done.select("doc_id", "html", publishing.injected(F.col("html"), "<!-- LEDGER -->", "<!-- /LEDGER -->").alias("injected"))


_BOOK = """b AS (SELECT c_custkey AS k, 'c' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS id, c_name || ' & co' AS text, c_nationkey AS nk, c_custkey % 4 = 2 AS inferred, c_custkey % 9 <> 0 AS active FROM customer),
o AS (SELECT *, row_number() OVER (ORDER BY k % 3 <> 0, CASE WHEN k % 3 = 0 THEN -k ELSE k END) AS ordinal FROM b WHERE active AND NOT inferred),
g AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY nk ORDER BY ordinal) AS r FROM o WHERE k % 5 = 0) WHERE r <= 3),
e AS (SELECT o.*, g.id IS NOT NULL AS shown, ['checked', 'reported', 'thin', 'contested'][k % 4 + 1] AS label, 'ABCD'[nk % 4 + 1] AS tier, n_name AS title FROM o LEFT JOIN g ON g.id = o.id JOIN nation ON n_nationkey = nk)"""
_MARK = "'<span class=\"mark m-' || label || '\">' || label || '</span>' || CASE WHEN k % 2 = 0 THEN ' <span class=\"mark m-moving\">moving</span>' ELSE '' END"

_LINES = "SELECT row_number() OVER w AS place, CAST(coalesce(sum(strlen(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", line FROM l WINDOW w AS (ORDER BY {})"

# ------------------------------------------------------------------- sources and packages


def find_inexact(spark, d):
    said = F.expr("concat(coalesce(text, ''), ' zqalpha', get(array(' ', '\\n\\t ', 'x'), cast(doc_id % 3 as int)), 'zqbeta.')")
    found = retrieval.find(t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), said.alias("text")), "zqalpha zqbeta")
    return found.select(F.col("source_id").alias("doc_id"), "status", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


def quote_slices(spark, d):
    texts = t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.quote(texts, F.lit(7), F.lit(40)).select(F.col("source_id").alias("doc_id"), "quote", "in_range")


def index_of_ready(spark, d):
    docs = t(spark, d, "documents")
    chunks = docs.select(F.format_string("src_%d#c0000", "doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    ready = docs.select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 3 = 0, 'failed', 'ready')").alias("status"))
    return retrieval.build_index(chunks, ready).stats.select("n_docs")


def package_verify(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.format_string("%d.md", "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    now = docs.filter("k % 7 <> 0").select("path", F.when(F.col("k") % 5 == 0, F.lit(b"changed")).otherwise(F.col("content")).alias("content"))
    none = spark.range(0).select(F.lit("").alias("id"), F.lit(None).cast(f"array<{claims.EVIDENCE}>").alias("evidence"))
    return _counted(publishing.verify_package(publishing.checksums(docs), now, none, spark.range(0).select(F.lit("").alias("source_id"), F.lit("").alias("text"))))


def provenance_public(spark, d):
    rows = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("url").alias("kind"), F.expr("if(page_id % 2 = 0, url, concat('/home/u/', page_id))").alias("locator"), F.lit("secret").alias("notes"))
    return publishing.provenance(rows)


def workspace_states(spark, d):
    rows = t(spark, d, "orders").withColumn("k", F.col("o_orderkey")).selectExpr(
        "k", "k % 5 AS revise_count", "0 AS n_blockers", "if(k % 7 = 0, 0, 3) AS n_sources", "if(k % 11 = 0, 1, 0) AS n_unsettled", "2 AS n_ready", "if(k % 13 = 0, 1, 2) AS n_chunked", "k % 17 <> 0 AS has_index", "true AS has_plan",
        "if(k % 19 = 0, 0, 1) AS n_claims", "if(k % 23 = 0, 1, 0) AS n_open", "1 AS n_artifacts", "if(k % 2 = 0, 0, 1) AS n_injected", "k % 3 = 0 AS has_provenance", "if(k % 4 < 2, 'VERIFY', 'RENDER') AS stored_state")
    return publishing.state(rows).select("k", "state")


def fetch_guard(spark, d):
    hosts = ("10.0.0.%d", "127.0.0.%d", "8.8.4.%d", "169.254.1.%d", "[::1]", "localhost", "site%d.example", "192.168.%d.1")
    host = F.get(F.array(*(F.format_string(h, "n_nationkey") for h in hosts)), (F.col("n_nationkey") % len(hosts)).cast("int"))
    return t(spark, d, "nation").select("n_nationkey", files.refusal(F.concat(F.lit("http://"), host, F.lit("/"))).alias("why"))


RECORD = {
    "type": "object", "required": ["id", "n"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^c_[0-9]+$", "minLength": 5}, "n": {"type": ["integer", "null"], "minimum": 3, "maximum": 9}, "kind": {"enum": ["a", "b"]}, "v": {"const": 1}, "at": {"type": "string", "format": "date"},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}},
    },
}


def record_rules(spark, d):
    made = F.expr("""concat('{"id":"', if(k % 2 = 0, 'c_', 'd_'), k, '"', if(k % 3 = 0, '', concat(',"n":', if(k % 4 = 0, 'null', cast(k % 12 as string)))), ',"kind":"', if(k % 5 = 0, 'z', 'a'), '","v":', k % 2, ',"at":"', if(k % 7 = 0, 'soon', '2024-01-01'),
        '","tags":[', array_join(array_repeat(if(k % 11 = 0, '5', '"x"'), cast(k % 4 as int)), ','), ']', if(k % 13 = 0, ',"more":1', ''), '}')""")
    rows = t(spark, d, "orders").withColumn("k", F.col("o_orderkey")).select(F.col("k").alias("subject"), made.alias("json"))
    return schema_rules.validate(rows, RECORD).groupBy("subject", "pointer").agg(F.count("*").alias("n"))


_RECORD = (
    ("/id", "k % 2 <> 0"), ("/id", "length('c_' || k) < 5"), ("", "k % 3 = 0"), ("/n", "k % 3 <> 0 AND k % 4 <> 0 AND k % 12 < 3"), ("/n", "k % 3 <> 0 AND k % 4 <> 0 AND k % 12 > 9"), ("/kind", "k % 5 = 0"),
    ("/v", "k % 2 = 0"), ("/at", "k % 7 = 0"), ("/tags", "k % 4 = 0 OR k % 4 = 3"), ("/tags/0", "k % 11 = 0 AND k % 4 > 0"), ("/tags/1", "k % 11 = 0 AND k % 4 > 1"), ("/tags/2", "k % 11 = 0 AND k % 4 > 2"), ("/more", "k % 13 = 0"),
)


def manifest_rules(spark, d):
    """Manifests and scripts made from keys, some of them against the rules."""
    made = F.expr("""concat('{"schema_version":1,"state":"', if(k % 3 = 0, 'LATER', 'PLAN'), '","created_at":"', if(k % 5 = 0, 'soon', '2024-01-01T10:00:00Z'), '","revise_count":', k % 4 - 1,
        ',"capabilities":{"web_fetch":"', if(k % 7 = 0, 'web', 'agent'), '","image_gen":"none"', if(k % 2 = 0, '', ',"tts":"none"'), '},"lint_waivers":{"a":"', if(k % 11 = 0, 'brief', 'long enough'), '"}', if(k % 13 = 0, '', ',"config":{"chunk_target":300}'),
        ',"history":[{"state":"INIT","at":"', if(k % 17 = 0, '2024-01-01', '2024-01-01T10:00:00.5+02:00'), '"}]}')""")
    script = F.expr("""concat('{"schema_version":1,"episode":"', if(k % 3 = 0, 'ab', 'abc'), '","speakers":[', if(k % 5 = 0, '', '{"name":"A"}'), '],"lines":[{"n":', k % 4, ',"speaker":"A","text":"', if(k % 7 = 0, '', 'x'), '","kind":"', if(k % 2 = 0, 'fact', 'banter'), '","claims":[]}]}')""")
    rows = t(spark, d, "orders").withColumn("k", F.col("o_orderkey")).select("k", made.alias("manifest"), script.alias("dialogue"))
    found = [gates.schemas(rows.select(F.col("k").alias("subject"), F.col(table).alias("json")), table).withColumn("table", F.lit(table)) for table in ("manifest", "dialogue")]
    both = found[0].unionByName(found[1])
    return both.groupBy("table", "subject", F.substring_index("detail", ":", 1).alias("pointer")).agg(F.count("*").alias("n"))


def event_sessions(spark, d):
    found = windows.sessions(t(spark, d, "events"), "ts", ["user_id"], "6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most"))


def events_in_ranges(spark, d):
    ranges = t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 37).alias("low"), (F.col("n_nationkey") * 37 + 90).alias("high"))
    return windows.range_join(t(spark, d, "events").select("event_id"), ranges, "event_id", "low", "high", 64).groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


QUERIES = {f.__name__: f for f in (
    lint_surfaces, lint_colors, lint_words, lint_cyan_and_imports, subtree_text, color_spaces, css_values, html_gate, license_gate, dialogue_gate, normalizer_gate, confidence_gate, topic_dates, topic_explicit, adjudications_recorded, quote_budget_spans,
    claim_defaults, plan_contested, late_members, quote_excess, cascade, chunk_edges, history_states, ledger_markdown, ledger_html, ledger_json, ledger_sources, pages_injected, find_inexact, quote_slices, index_of_ready, package_verify, provenance_public, workspace_states, fetch_guard, record_rules, manifest_rules,
    event_sessions, events_in_ranges,
)}

_LIN = lambda x: f"CASE WHEN {x} / 255.0 <= 0.04045 THEN {x} / 255.0 / 12.92 ELSE (({x} / 255.0 + 0.055) / 1.055) ** 2.4 END"

_MANIFESTS = (
    ("manifest", "/state", "k % 3 = 0"), ("manifest", "/created_at", "k % 5 = 0"), ("manifest", "/revise_count", "k % 4 = 0"), ("manifest", "/capabilities/web_fetch", "k % 7 = 0"), ("manifest", "/capabilities", "k % 2 = 0"),
    ("manifest", "/lint_waivers/a", "k % 11 = 0"), ("manifest", "", "k % 13 = 0"), ("manifest", "/history/0/at", "k % 17 = 0"), ("dialogue", "/episode", "k % 3 = 0"), ("dialogue", "/speakers", "k % 5 = 0"), ("dialogue", "/lines/0/n", "k % 4 = 0"),
    ("dialogue", "/lines/0/text", "k % 7 = 0"), ("dialogue", "/lines/0/kind", "k % 2 = 0"),
)

ORACLES = {
    "manifest_rules": "WITH p AS (SELECT o_orderkey AS k FROM orders), f AS (" + " UNION ALL ".join(f"SELECT '{name}' AS \"table\", CAST(k AS VARCHAR) AS subject, '{at}' AS pointer FROM p WHERE {when}" for name, at, when in _MANIFESTS) + ") SELECT \"table\", subject, pointer, count(*) AS n FROM f GROUP BY ALL",
    "lint_surfaces": _expected(SURFACES), "lint_colors": _expected(COLORS), "lint_words": _expected(WORDS),
    "lint_cyan_and_imports": f"""WITH {_PARTS} SELECT k AS doc_id, 'slop.ai-palette' AS rule, 'error' AS severity, 1::BIGINT AS n FROM p WHERE k % 6 = 0
UNION ALL SELECT k, 'struct.external-ref', 'error', (k % 5 = 0)::BIGINT + (k % 4 = 0)::BIGINT FROM p WHERE k % 5 = 0 OR k % 4 = 0""",
    "subtree_text": f"""WITH {_PARTS}, e AS (SELECT k, s % 5 AS ps, k % 7 AS ys, k % 3 AS ls FROM p), x AS (
SELECT k, 'html' AS tag, 1 AS n, 2 * ps + ys + 2 + ls AS chars, 7 + ps + 2 * ls AS elements FROM e UNION ALL SELECT k, 'body', 1, 2 * ps + ys + 2 + ls, 6 + ps + 2 * ls FROM e UNION ALL SELECT k, 'div', 1, 2 * ps + ys + 2, 4 + ps FROM e
UNION ALL SELECT k, 'p', ps, 2 * ps, ps FROM e WHERE ps > 0 UNION ALL SELECT k, 'section', 1, ys + 2, 3 FROM e UNION ALL SELECT k, 'b', 1, 2, 2 FROM e UNION ALL SELECT k, 'i', 1, 1, 1 FROM e
UNION ALL SELECT k, 'ul', 1, ls, 1 + 2 * ls FROM e UNION ALL SELECT k, 'li', ls, ls, 2 * ls FROM e WHERE ls > 0 UNION ALL SELECT k, 'br', ls, 0, ls FROM e WHERE ls > 0)
SELECT k AS doc_id, tag, CAST(n AS BIGINT) AS n, CAST(chars AS BIGINT) AS chars, CAST(elements AS BIGINT) AS elements FROM x""",
    "color_spaces": f"""WITH {_PARTS}, c AS (SELECT k, {_LIN('(s * 5)')} AS r, {_LIN('(k * 7 % 256)')} AS g, {_LIN('(k * 13 % 256)')} AS b FROM p),
m AS (SELECT *, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS x, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS y, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS z FROM c),
q AS (SELECT *, 0.2104542553 * x + 0.7936177850 * y - 0.0040720468 * z AS l, sqrt((1.9779984951 * x - 2.4285922050 * y + 0.4505937099 * z) ** 2 + (0.0259040371 * x + 0.7827717662 * y - 0.8086757660 * z) ** 2) AS ch FROM m)
SELECT k, round(l, 4) AS light, round(ch, 4) AS chroma, round(1.05 / (0.2126 * r + 0.7152 * g + 0.0722 * b + 0.05), 3) AS contrast, ch < 0.04 AS neutral FROM q""",
    "css_values": f"""WITH {_PARTS} SELECT k, round(s * CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN 96 / 72.0 WHEN 4 THEN 96 / 2.54 WHEN 5 THEN 96 / 25.4 WHEN 6 THEN 96 WHEN 7 THEN 96 / 101.6 END, 4)::DOUBLE AS px,
16.0::DOUBLE AS low, s::DOUBLE AS high, (k % 3)::BIGINT AS ids, (s % 4)::BIGINT AS classes, 2::BIGINT AS tags FROM p""",
    "html_gate": _findings("p AS (SELECT page_id AS k FROM pages)", _HTML), "license_gate": _findings("p AS (SELECT page_id AS k FROM pages)", _LICENSES),
    "dialogue_gate": """WITH l AS (SELECT 'line ' || o_orderkey AS subject, o_orderpriority AS sp, o_orderstatus = 'F' AS factual, o_orderkey % 3 = 0 AS bare, c_mktsegment AS seg FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey),
f AS (SELECT 'E-POD-SPEAKER' AS code, subject FROM l WHERE sp = '5-LOW' UNION ALL SELECT 'E-POD-UNCITED', subject FROM l WHERE factual AND bare UNION ALL SELECT 'E-POD-CLAIM-UNKNOWN', subject FROM l WHERE NOT bare AND seg IS NULL
UNION ALL SELECT 'E-POD-CLAIM-STALE', subject FROM l WHERE NOT bare AND seg = 'BUILDING') SELECT code, subject, count(*) AS n FROM f GROUP BY code, subject""",
    "normalizer_gate": _findings("p AS (SELECT doc_id AS k FROM documents)", (
        ("E-NORM-MISSING", "CAST(k AS VARCHAR)", "k % 3 <> 0 AND k % 11 = 0"), ("E-NORM-DRIFT", "CAST(k AS VARCHAR)", "k % 3 <> 0 AND k % 11 <> 0 AND (k % 5 = 0 OR k % 7 = 0)"))),
    "confidence_gate": _findings("p AS (SELECT o_orderkey AS k FROM orders)", (
        ("E-CONF-MISMATCH", "CAST(k AS VARCHAR)", "k % 4 = 1 AND k % 5 <> 0"), ("E-CONF-MISMATCH", "CAST(k AS VARCHAR)", "k % 4 IN (0, 3) AND k % 5 = 0"), ("E-UNSUPPORTED", "CAST(k AS VARCHAR)", "k % 4 = 2 AND k % 3 <> 0"))),
    "topic_dates": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS topic_key, list_sort(list_distinct([strftime(o_orderdate, '%Y-%m-%d')] || CASE WHEN o_orderkey % 2 = 0 THEN ['1999-01-01'] ELSE [] END)) AS x FROM orders)
SELECT DISTINCT a.topic_key, a.id FROM o a JOIN o b ON a.topic_key = b.topic_key AND a.x <> b.x""",
    "topic_explicit": """WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey % 3 AS VARCHAR) AS topic_key FROM orders WHERE o_orderstatus <> 'P'), e AS (SELECT a.topic_key, a.k AS x, b.k AS y FROM o a JOIN o b ON b.k = a.k + 1 AND a.topic_key = b.topic_key)
SELECT topic_key, CAST(x AS VARCHAR) AS id FROM e UNION SELECT topic_key, CAST(y AS VARCHAR) FROM e""",
    "adjudications_recorded": "SELECT c_custkey AS cluster_id, CASE WHEN c_custkey % 3 = 0 THEN 'both_stand' ELSE 'retract' END AS outcome FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0",
    "quote_budget_spans": """WITH RECURSIVE q AS (SELECT l_suppkey AS source_id, l_partkey % 40 AS span, CAST(l_quantity * 6 AS INT) AS size, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS INT) AS ord FROM lineitem),
f AS (SELECT source_id, span, arg_min(size, ord) AS size, min(ord) AS ord, count(*) AS n FROM q GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS k FROM f WHERE size BETWEEN 1 AND 200),
z AS (SELECT DISTINCT source_id, 0::BIGINT AS k, 0::BIGINT AS c, 0::BIGINT AS chars, 0::BIGINT AS granted FROM q
 UNION ALL SELECT z.source_id, a.k, c + (c < 3 AND chars + size <= 500)::INT, chars + CASE WHEN c < 3 AND chars + size <= 500 THEN size ELSE 0 END, granted + CASE WHEN c < 3 AND chars + size <= 500 THEN n ELSE 0 END FROM z JOIN a ON a.source_id = z.source_id AND a.k = z.k + 1)
SELECT source_id, any_value(n) AS n, max(granted) AS granted FROM z JOIN (SELECT source_id, count(*) AS n FROM q GROUP BY 1) USING (source_id) GROUP BY source_id""",
    "plan_contested": _findings("p AS (SELECT c_custkey AS k FROM customer)", (
        ("E-PLAN-ORPHAN", "CAST(k AS VARCHAR)", "k % 3 = 0 AND k % 7 = 0"), ("E-CONTESTED-HIDDEN", "CAST(k AS VARCHAR)", "k % 7 <> 0 AND k % 4 = 0 AND k % 3 <> 0"))),
    "late_members": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS c, CAST(o_orderkey AS DOUBLE) * o_orderkey AS x FROM orders),
p AS (SELECT DISTINCT a.c, a.id FROM o a JOIN o b ON a.c = b.c AND a.id <> b.id AND abs(a.x - b.x) / greatest(abs(a.x), abs(b.x)) > 0.05),
m AS (SELECT c, list(id ORDER BY id) AS ids FROM p GROUP BY c)
SELECT CAST(c AS VARCHAR) AS topic_key, CASE WHEN c % 5 = 0 OR c % 3 = 0 THEN 'OPEN' ELSE 'RESOLVED' END AS status, CAST(len(ids) AS BIGINT) AS n, CASE WHEN c % 5 <> 0 AND c % 3 = 0 THEN array_to_string(ids[2:], ' ') ELSE '' END AS late FROM m""",
    "quote_excess": """WITH p AS (SELECT page_id AS k, page_id % 7 AS shown FROM pages), q AS (SELECT k, shown, i, length('wq' || k || 'x' || i || ' ') + k % 3 * 70 AS n FROM p, range(6) r(i)),
s AS (SELECT k, count(*) AS n, sum(n) AS chars FROM q WHERE i < shown GROUP BY k)
SELECT 'E-QUOTE-BUDGET' AS code, 's' || k AS subject, 1::BIGINT AS n FROM s WHERE n > 3 OR chars > 500""",
    "cascade": f"WITH {_PARTS} SELECT k AS doc_id, '#cccccc on #ffffff' AS snippet FROM p WHERE k % 11 = 0 OR (k % 7 <> 0 AND (k % 5 = 0 OR (k % 3 <> 0 AND k % 2 = 0)))",
    "chunk_edges": f"""WITH {_PARTS}, e AS (SELECT k, 4 + length(CAST(k AS VARCHAR)) AS h, k % 13 + 1 AS n FROM p WHERE k % 2 = 0), o AS (SELECT k, k % 37 + 1 AS s FROM p WHERE k % 2 = 1),
c AS (SELECT k, h, n, unnest(range((n + 2) // 3)) AS i FROM e), g AS (SELECT k, s, s // 10 + CASE WHEN s % 10 >= 6 THEN 1 ELSE 0 END AS m FROM o WHERE s > 15), f AS (SELECT k, s, m, unnest(range(m)) AS i FROM g)
SELECT k, i AS ordinal, CASE WHEN i = 0 THEN 0 ELSE h + 1206 * i - 2 END AS span_start, CASE WHEN 3 * (i + 1) >= n THEN h + 402 * n ELSE h + 1206 * (i + 1) END AS span_end, 'H' || k AS heads FROM c
UNION ALL SELECT k, 0, 0, 100 * s + 1, '' FROM o WHERE s <= 15
UNION ALL SELECT k, i, 1000 * i, CASE WHEN i = m - 1 THEN 100 * s + 1 ELSE 1000 * (i + 1) END, '' FROM f""",
    "history_states": """WITH e AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS workspace, o_orderkey AS seq, ['failed', 'failed', 'advance', 'failed', 'advance', 'passed', 'failed', 'unblock', 'failed', 'advance', 'odd'][o_orderkey % 11 + 1] AS action FROM orders),
r AS (SELECT *, count(*) FILTER (action IN ('passed', 'unblock')) OVER (PARTITION BY workspace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM e),
b AS (SELECT *, CAST(least(3, count(*) FILTER (action = 'failed') OVER (PARTITION BY workspace, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS INTEGER) AS revise_before FROM r),
a AS (SELECT *, CAST(CASE WHEN action = 'failed' THEN least(3, revise_before + 1) WHEN action IN ('passed', 'unblock') THEN 0 ELSE revise_before END AS INTEGER) AS revise_after FROM b)
SELECT workspace, seq, revise_before, revise_after, CASE WHEN revise_after >= 3 THEN 'BLOCKED' WHEN action IN ('failed', 'unblock') THEN 'REVISE' WHEN action = 'passed' THEN 'VERIFY' WHEN action = 'advance' THEN 'COMPOSE' END AS state,
CASE WHEN action = 'advance' AND revise_before >= 3 THEN 'E-STATE-BLOCKED' WHEN action = 'unblock' AND revise_before < 3 THEN 'E-UNBLOCK-IDLE' WHEN action = 'odd' THEN 'E-ACTION-UNKNOWN' END AS code FROM a""",
    "claim_defaults": """SELECT 'clm_' || substr(sha256(lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g')))), 1, 12) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'retracted' ELSE 'active' END AS status, c_custkey % 3 = 0 AS volatile, 0::BIGINT AS links, '' AS notes FROM customer""",
    "ledger_markdown": f"""WITH {_BOOK}, l AS (SELECT 0 AS o, '# Ledger' || chr(10) AS line UNION ALL
SELECT ordinal, CASE WHEN ordinal > 1 THEN chr(10) ELSE '' END || ordinal || '. **' || text || '**  ' || chr(10) || '   `' || label || CASE WHEN k % 2 = 0 THEN ' moving' ELSE '' END || '`' || CASE WHEN k % 2 = 0 THEN ' · as of 2024-01-01' ELSE '' END
|| CASE k % 3 WHEN 0 THEN ' · [recheck](https://x/y)' WHEN 1 THEN ' · recheck URL withheld; not an http(s) address: ftp://x' ELSE '' END || chr(10) || '   - tier ' || tier || ' · ' || title || ' · '
|| CASE WHEN shown THEN '"said <' || k || '>"' ELSE 'chars ' || k || '-' || (k + 9) END FROM e)
{_LINES.format('o')}""",
    "ledger_html": f"""WITH {_BOOK}, thin AS (SELECT id, '<li class="ledger-entry" id="c-' || id || '"><p class="ledger-claim">' || replace(text, '&', '&amp;') || '</p><p class="ledger-meta"><span class="mark m-thin">thin</span>'
|| CASE WHEN k % 2 = 0 THEN ' <span class="mark m-moving">moving</span><span class="as-of">as of 2024-01-01</span>' ELSE '' END || CASE k % 3 WHEN 0 THEN '<a class="recheck" href="https://x/y" rel="nofollow noopener">recheck</a>' WHEN 1 THEN '<span class="recheck">recheck URL withheld; not an http(s) address: ftp://x</span>' ELSE '' END
|| '</p><p class="ledger-source"><span class="tier tier-none">no source</span> author''s inference; weigh it as opinion.</p></li>' AS t FROM b WHERE active AND inferred),
l AS (SELECT 0 AS block, 0 AS ordinal, '' AS id, '<ol class="ledger">' AS line UNION ALL SELECT 2, 0, '', '</ol>' UNION ALL
SELECT 3, 0, '', '<ul class="ledger ledger-thin">' || chr(10) || '<li class="ledger-note">Inferences of the author. They are recorded and cited nowhere, since no source stands behind them.</li>' UNION ALL SELECT 4, 0, id, t FROM thin UNION ALL SELECT 5, 0, '', '</ul>' UNION ALL
SELECT 1, ordinal, id, '<li class="ledger-entry" id="c-' || id || '" value="' || ordinal || '"><p class="ledger-claim">' || replace(text, '&', '&amp;') || '</p><p class="ledger-meta">' || {_MARK}
|| CASE WHEN k % 2 = 0 THEN '<span class="as-of">as of 2024-01-01</span>' ELSE '' END || CASE k % 3 WHEN 0 THEN '<a class="recheck" href="https://x/y" rel="nofollow noopener">recheck</a>' WHEN 1 THEN '<span class="recheck">recheck URL withheld; not an http(s) address: ftp://x</span>' ELSE '' END
|| '</p><p class="ledger-source"><span class="tier tier-' || tier || '">tier ' || tier || '</span> ' || CASE WHEN nk % 2 = 0 THEN '<a href="https://n/' || nk || '" rel="nofollow noopener">' || title || ' &middot; P</a>' ELSE title || ' &middot; P' END
|| CASE WHEN shown THEN '<q class="ledger-quote">said &lt;' || k || '&gt;</q>' ELSE '<span class="ledger-span">quote withheld under the quote budget; chars ' || k || '&ndash;' || (k + 9) || ' of the source</span>' END || '</p></li>' FROM e)
{_LINES.format('block, ordinal, id')}""",
    "ledger_json": f"""WITH {_BOOK}, w AS (SELECT id, ordinal, k FROM o UNION ALL SELECT id, NULL, k FROM b WHERE active AND inferred)
SELECT row_number() OVER (ORDER BY ordinal IS NULL, ordinal, id) - 1 AS place, id, ordinal, ['m-checked', 'm-reported', 'm-thin', 'm-contested'][k % 4 + 1] || CASE WHEN k % 2 = 0 THEN ' m-moving' ELSE '' END AS marks FROM w""",
    "ledger_sources": "SELECT 'ABCD'[n_nationkey % 4 + 1] AS tier, n_name AS title, 's' || n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 4 <> 2) AS n_claims FROM nation",
    "pages_injected": """SELECT page_id AS doc_id, CASE WHEN page_id % 3 < 2 THEN html || '<!-- LEDGER -->' || chr(10) || '<ol class="ledger"></ol>' || chr(10) || '<!-- /LEDGER -->z' END AS html, CASE WHEN page_id % 3 < 2 THEN true END AS injected FROM pages""",
    "find_inexact": """SELECT doc_id, ['exact', 'inexact', 'nomatch'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 3 < 2 THEN length(coalesce(text, '')) + 1 END AS span_start, CASE doc_id % 3 WHEN 0 THEN length(coalesce(text, '')) + 15 WHEN 1 THEN length(coalesce(text, '')) + 17 END AS span_end FROM documents""",
    "quote_slices": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 40 THEN substr(text, 8, 33) END AS quote, length(coalesce(text, '')) >= 40 AS in_range FROM documents",
    "index_of_ready": "SELECT count(*) AS n_docs FROM documents WHERE doc_id % 3 <> 0",
    "package_verify": _findings("p AS (SELECT doc_id AS k FROM documents)", (("E-PKG-MISSING", "k || '.md'", "k % 7 = 0"), ("E-PKG-CHECKSUM", "k || '.md'", "k % 7 <> 0 AND k % 5 = 0"))),
    "provenance_public": "SELECT page_id AS id, 'url' AS kind, CASE WHEN page_id % 2 = 0 AND regexp_matches(lower(url), '^https?://') THEN url END AS locator FROM pages",
    "workspace_states": """SELECT o_orderkey AS k, CASE WHEN k % 5 >= 3 THEN 'BLOCKED' WHEN k % 7 = 0 THEN 'INIT' WHEN k % 11 = 0 THEN 'COLLECT' WHEN k % 13 = 0 THEN 'EXTRACT' WHEN k % 17 = 0 THEN 'CHUNK' WHEN k % 19 = 0 THEN 'PLAN' WHEN k % 23 = 0 THEN 'GROUND'
WHEN k % 2 = 0 THEN 'COMPOSE' WHEN k % 3 = 0 THEN 'DONE' WHEN k % 4 < 2 THEN 'VERIFY' ELSE 'RENDER' END AS state FROM orders""",
    "fetch_guard": "SELECT n_nationkey, ['private', 'loopback', NULL, 'link-local', 'loopback', 'loopback', NULL, 'private'][n_nationkey % 8 + 1] AS why FROM nation",
    "record_rules": "WITH p AS (SELECT o_orderkey AS k FROM orders), f AS (" + " UNION ALL ".join(f"SELECT k AS subject, '{at}' AS pointer FROM p WHERE {when}" for at, when in _RECORD) + ") SELECT subject, pointer, count(*) AS n FROM f GROUP BY 1, 2",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS most FROM n GROUP BY 1""",
    "events_in_ranges": "SELECT n_nationkey, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM nation JOIN events ON event_id >= n_nationkey * 37 AND event_id < n_nationkey * 37 + 90 GROUP BY 1",
}
