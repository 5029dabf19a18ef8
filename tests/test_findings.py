"""Inputs on which queries once differed from their SQL, or plans that once grew faster than their input."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.functions import text
from evidentia.operators import chunking, lint, retrieval, schema_rules
from evidentia.plans import catalog, kept

from .test_catalog import rows
from .test_functions import column

#: Words beside letters, digits and blanks that not every engine takes for such.
ODD = ("van noñad", "sin noñar", "it is no", "İno", "faİls to run", "lacKs", "non-é", "non-x", "٣ and 4 k", "7ké 5", "é2024-01-02 and 2024-01-03é", "a b c d", "x1 2.5 BN.", "", None)


def twins(spark, folder, name, table):
    got, want = catalog.QUERIES[name](spark, str(folder)).toPandas(), table.execute(catalog.ORACLES[name]).fetchdf()
    assert len(want) > 0 and rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_negation_of_ascii_words(spark):
    said = ["van noñad", "noñ", "NO.", "knot", "non-x", "non- x", "can't", None]
    assert column(spark, said, lambda x: text.negated(x, ascii=True)) == [True, True, True, False, True, False, True, None]
    assert column(spark, said, text.negated) == [False, False, True, False, True, False, True, None]


@pytest.mark.parametrize("name", ["numbers_and_dates", "topic_polarity", "topic_all_detectors"])
def test_odd_words_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    said = [(i, turn, x) for i, a in enumerate(ODD) for turn, x in enumerate((a, "plain", "plain"))] + [(0, 0, ODD[0])]
    spark.createDataFrame(said, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations", "orders"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    twins(spark, tmp_path, name, con)


@pytest.mark.parametrize("name", ["cascade", "lint_colors", "subtree_text"])
def test_parsed_pages_are_not_broadcast(spark, name):
    """Their files are small, so Spark once sent whole tables of nodes and rules through the driver."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_rules_read_the_tables_that_are_named(spark):
    """Each rule runs on a site of its own tables alone."""
    page = spark.createDataFrame([(1, "<html><head><style>p{color:#ccc}</style></head><body><p>x</p></body></html>")], "doc_id long, html string")
    sites = {}
    for name, (_, rule) in lint.RULES.items():
        tables = lint.READS[name]
        sites[tables] = sites.get(tables) or lint.Site(page, tables)
        rule(sites[tables])


def test_python_workers_are_handed_few_rows_at_once(spark):
    """Catalog queries bound the rows of a batch; others get what the session had, and a smaller bound of its own stays."""
    key, entry = "spark.sql.execution.arrow.maxRecordsPerBatch", __spark_entry__._run
    had, seen = spark.conf.get(key), lambda s, d: s.conf.get(key)
    assert entry(seen, 500)(spark, "") == "500" and entry(seen)(spark, "") == had and entry(seen, 10**9)(spark, "") == had


@pytest.mark.parametrize("few", [0, 100_000])
def test_quotes_without_a_term_meet_few_texts(spark, monkeypatch, few):
    """Keys share their runs of three characters, so each quote once met a hundredth of all pages."""
    monkeypatch.setattr(retrieval, "FEW_GRAMS", few)
    said = {(k, i): f"wq{k}x{i} {'z' * (k % 3 * 20)}" for k in range(1000, 1400) for i in range(3)}
    texts = spark.createDataFrame([(k, " | ".join(said[k, i] for i in range(3))) for k in range(1000, 1400)], "source_id int, text string")
    passages = spark.createDataFrame([(k * 10 + i, x) for (k, i), x in said.items()], "passage_id int, text string")
    _, pairs = retrieval._by_grams(texts, passages)
    assert pairs.count() <= 1.2 * len(said)
    found = retrieval.find_passages(texts, passages).collect()
    assert sorted((r.source_id, r.passage_id) for r in found) == sorted((k, k * 10 + i) for k, i in said)


@pytest.mark.parametrize("few", [0, 100_000])
def test_needles_of_all_sizes_are_found(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_GRAMS", few)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("a .漢é😀") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(100, None)]
    needles = [(n, t[a : a + rng.randint(0, 30)]) for n, (_, t) in enumerate(texts * 3) if t for a in [rng.randint(0, len(t))]]
    found = retrieval.find_passages(spark.createDataFrame(texts, "source_id int, text string"), spark.createDataFrame(needles, "passage_id int, text string"))
    want = {(s, p, t.find(n), t.find(n) + len(n)) for s, t in texts if t for p, n in needles if n and n in t}
    assert sorted(map(tuple, found.select("source_id", "passage_id", "span_start", "span_end").collect())) == sorted(want)


def test_an_index_for_one_query_shuffles_no_posting(spark):
    """Every query of one kind once waited for an index of all terms, shuffled twice."""
    said = ["Cat dog cat", "dog é ﬁsh ﬁsh", "", None, "the of a", "CAT x1 x1 İstanbul straße"]
    chunks = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(said)], "chunk_id string, text string")
    whole, held = retrieval.build_index(chunks), retrieval.index_for(chunks, "cat cat fish strasse nowhere")
    assert "Exchange" not in whole.postings._jdf.queryExecution().toString()
    counted = chunks.select("chunk_id", F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("term", "chunk_id").count()
    assert sorted(map(tuple, whole.postings.collect())) == sorted(map(tuple, counted.collect()))
    scores = [sorted(map(tuple, retrieval.bm25(i, "cat cat fish strasse nowhere").collect())) for i in (whole, held)]
    assert scores[0] == scores[1] and len(scores[0]) == 3 and {r.term for r in held.postings.collect()} == {"cat", "fish", "strasse"}
    assert sorted(map(tuple, whole.doclen.collect())) == sorted(map(tuple, held.doclen.collect())) and whole.stats.collect() == held.stats.collect()


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_restricted", "bm25_per_source_topk", "search_hits"])
def test_ranking_keeps_no_texts(spark, monkeypatch, name):
    monkeypatch.setattr(kept, "kept_chunks", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_chunks_are_cut_where_their_texts_lie(spark):
    """Whole texts once met their chunks by a join, and their terms were counted by a shuffle."""
    said = ["# A\n\nOne. " * 300, "word " * 900, "", None, "é漢😀 \n\n" * 500]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "source_id int, text string")
    plain, here = chunking.chunk_texts(chunking.chunk(texts), texts), chunking.chunk_and_texts(texts)
    assert here.schema.names == plain.schema.names and here.count() > 5
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, plain.filter("text is not null").collect()))
    assert "Exchange" not in catalog.QUERIES["chunk_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_rules_over_single_style_rules_take_one_pass(spark):
    """Each of them once read the whole table of style rules for itself."""
    css = ".a{border-radius:30px;z-index:100}.b{background:repeating-linear-gradient(red,blue);background-image:repeating-linear-gradient(red,blue)}.c{border-left:3px solid red;border-right-width:4px;border-right-color:red}.d{border-right:9px solid var(--x);border-right-width:4px;border-right-color:red}"
    page = spark.createDataFrame([(1, f"<style>{css}</style>"), (2, "<style>.e{margin:0}</style>"), (3, None)], "doc_id long, html string")
    asked = sorted(lint.ROWS)
    found = lint.lint(page, {"struct.zindex-arbitrary": "why"}, asked)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r.rule, r.severity, r.snippet, r.waived) for r in found.collect()] == [
        ("slop.over-round", "error", ".a", False), ("slop.stripe-bg", "error", ".b", False), ("slop.stripe-bg", "error", ".b", False), ("struct.zindex-arbitrary", "warn", ".a", True)]
    site = lint.Site(page, ("rules",))
    alone = [r for name in asked for r in lint.RULES[name][1](site).collect()]
    assert sorted((r.doc_id, r.line, r.snippet, r.detail) for r in alone) == sorted((r.doc_id, r.line, r.snippet, r.detail) for r in found.collect())
    assert sorted(r.snippet for r in lint.side_stripe(site).collect()) == [".c { border-left }", ".c { border-right }"]


def test_a_value_is_found_once_however_many_checks_read_it(spark):
    """Every check of a value once looked for it, for its kind and for all members of its object anew, in two passes over the records."""
    schema = {"type": "object", "required": ["a", "it's"], "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "it's": {"type": "string"}, "o": {"type": "object", "required": ["x"], "additionalProperties": False}, "l": {"type": "array", "items": {"type": "object", "required": ["y"]}}}}
    said = ['{"a": null, "it\'s": "x"}', '{"a": 1}', "[1]", "{broken", None, '{"a": 3, "it\'s": null, "o": {"z": 1}, "l": [{"y": null}, {}, 5, null]}', "null", '{"a": 2, "it\'s": "", "o": [], "l": {}}']
    found = schema_rules.validate(spark.createDataFrame(list(enumerate(said)), "subject int, json string"), schema)
    assert sorted((r.subject, r.pointer, r.message) for r in found.collect()) == [
        (1, "", "missing 'it's'"), (1, "/a", "beyond the minimum 2"), (2, "", "expected object"), (3, "", "not JSON"), (4, "", "not JSON"), (5, "/it's", "expected string"), (5, "/l/1", "missing 'y'"), (5, "/l/2", "expected object"),
        (5, "/l/3", "expected object"), (5, "/o", "missing 'x'"), (5, "/o/z", "unexpected property"), (6, "", "expected object"), (7, "/l", "expected array"), (7, "/o", "expected object")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("schema_of_variant") <= 8


def test_short_needles_need_no_terms(spark):
    """Needles of four to six characters once met whole texts by a join, and all terms of the texts were shuffled."""
    found = retrieval.find_passages(spark.createDataFrame([(1, "a cat, the dog"), (2, "cats")], "source_id int, text string"), spark.createDataFrame([(1, "t, the"), (2, " cat"), (3, "cats")], "passage_id int, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.select("source_id", "passage_id", "span_start").collect())) == [(1, 1, 4), (1, 2, 1), (2, 3, 0)]
    assert "regexp_extract_all" not in plan and plan.count("Join") == 1 and "dog" not in plan
