"""One object with the toolkit's verbs. Tables are DataFrames by name; every verb returns a DataFrame, and an empty
findings table stands for success.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, claims, contradictions, extraction, gates, lint, merge, publishing, retrieval, schema_rules
from .sources import files, snapshots
from .sources.store import Store, cut


class Engine:
    """Tables: sources, texts, chunks, claims, adjudications, plan, credits, lines, speakers, pages (doc_id, html), history."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark, self.tables = spark, dict(tables)
        self._parsed: lint.Site | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def register(self) -> None:
        """Makes the tables views of their names, so that ``spark.sql`` reads them."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    # collecting and indexing

    def add(self, new: DataFrame, order: str = "seq") -> DataFrame:
        """Takes in sources in the order of a column; returns an outcome a row."""
        known = self.tables.get("sources", new.drop(order).limit(0))
        self.tables["sources"], outcomes = merge.merge_sources(known, new, order)
        return outcomes

    def extract(self, captured: DataFrame, force: Column | bool = False) -> DataFrame:
        """Brings ``texts`` in step with captures; returns an outcome a source."""
        held = ("source_id", "text", "raw_sha256", "normalized_sha256", "normalizer_version")
        known = self.tables.get("texts", self.spark.createDataFrame([], "source_id string, text string, raw_sha256 string, normalized_sha256 string, normalizer_version int"))
        done = cut(extraction.extract(captured, known, force))
        self.tables["texts"] = done.filter("text is not null").select(*held)
        return done

    def freeze(self, folder: str) -> str:
        """Keeps sources and texts as a seed; returns its id."""
        return snapshots.freeze(Store(self.spark, folder), self["sources"].withColumnRenamed("id", "source_id"), self["texts"])

    def seed(self, folder: str, seed: str) -> DataFrame:
        """Begins with a seed's sources and texts; returns them with what is wrong with them."""
        found = snapshots.thaw(self.spark, Store(self.spark, folder), seed)
        self.tables["sources"] = found.drop("text", "code", "digest").withColumnRenamed("source_id", "id")
        self.tables["texts"] = found.filter("text is not null").select("source_id", "text")
        return found

    def chunk(self, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> DataFrame:
        spans = chunking.chunk(self["texts"], target, overlap)
        self.tables["spans"], self.tables["chunks"] = spans, chunking.chunk_texts(spans, self["texts"])
        return spans

    def index(self, folder: str | None = None) -> retrieval.Index:
        built = retrieval.build_index(self["chunks"], self.tables.get("sources"))
        if folder:
            built.write(folder)
            built = retrieval.Index.read(self.spark, folder)
        return built

    def search(self, index: retrieval.Index, query: str, k: int = 8, source: str | None = None) -> DataFrame:
        return retrieval.search(index, self["chunks"], query, k, source)

    def find(self, source: str, needle: str, every: bool = False) -> DataFrame:
        return retrieval.find(self["texts"].filter(F.col("source_id") == source), needle, every)

    def quote(self, source: str, start: int, end: int) -> DataFrame:
        return retrieval.quote(self["texts"].filter(F.col("source_id") == source), F.lit(start), F.lit(end))

    # the ledger

    def claim_add(self, new: DataFrame, order: str = "seq") -> DataFrame:
        """Takes in claims in the order of a column, the last one of a text counts; returns an outcome a row."""
        new = claims.normalize_claims(new)
        empty = F.when(F.col("text").isNull(), "no text")
        self.tables["claims"], outcomes = merge.merge(self.tables.get("claims", new.drop(order).limit(0)), new, "id", order, empty)
        return outcomes

    def claim_set(self, changes: DataFrame) -> DataFrame:
        self.tables["claims"] = claims.set_fields(self["claims"], changes)
        return self["claims"]

    def contradictions(self) -> DataFrame:
        return contradictions.detect(self["claims"], self.tables.get("adjudications"))

    def adjudicate(self, new: DataFrame, apply: bool = False, order: str = "seq") -> DataFrame:
        """Records adjudications in the order of a column; the last one of a cluster counts."""
        self.tables["adjudications"], _ = merge.merge(self.tables.get("adjudications", new.drop(order).limit(0)), new, "cluster_id", order)
        if apply:
            self.tables["claims"] = contradictions.apply_outcomes(self["claims"], self["adjudications"])
        return self["adjudications"]

    def ordinals(self) -> DataFrame:
        return claims.ordinals(self["claims"], claims.placements(self["plan"]))

    def ledger(self, form: str = "json") -> DataFrame:
        """``form``: html, md or json as (place, offset, line), or sources."""
        if form == "sources":
            return claims.source_listing(self["sources"], self["claims"])
        full = claims.resolved(self["claims"], self.ordinals())
        ordered = claims.evidence_rows(full).join(full.select(F.col("id").alias("claim_id"), "ordinal"), "claim_id").withColumn("ord", F.struct("ordinal", "claim_id", "position"))
        granted = claims.budget(ordered.filter("ordinal is not null"))
        return claims.ledger_lines(claims.ledger_pieces(full, self["sources"], granted, form), form)

    def write_ledger(self, folder: str, form: str = "json") -> list[dict]:
        """Writes a ledger as part files; returns the list of them."""
        return files.write_lines(self.ledger(form), folder)

    def inject(self, ledger: DataFrame, begin: str = "<!-- LEDGER -->", end: str = "<!-- /LEDGER -->") -> DataFrame:
        """Pages with the ledger (its lines, or one row ``body``) between their markers; ``html`` is null where the first marker is missing."""
        ledger = claims.whole(ledger) if "line" in ledger.columns else ledger
        return self["pages"].crossJoin(F.broadcast(ledger.select("body"))).withColumn("html", claims.inject(F.col("html"), F.col("body"), begin, end)).drop("body")  # one row

    # gates and publishing

    def _site(self) -> lint.Site:
        """The parsed pages, for as long as the pages are the same."""
        if self._parsed is None or self._parsed.pages is not self["pages"]:
            self._parsed = lint.Site(self["pages"])
        return self._parsed

    def lint(self, waivers: dict[str, str] | None = None) -> DataFrame:
        return lint.lint(self["pages"], waivers, site=self._site())

    def licenses(self, strict: bool = False) -> DataFrame:
        return publishing.licenses(self._site().nodes, self._site().texts, self["credits"], strict=strict)

    def validate(self, records: DataFrame, schema: dict) -> DataFrame:
        return schema_rules.validate(records, schema)

    def verify(self, waivers: dict[str, str] | None = None, expect_page: bool = False, expect_dialogue: bool = False) -> DataFrame:
        """Findings of every gate whose tables are there, in one table; a page or dialogue that is expected and isn't there is a finding."""
        have, rows = self.tables, self["claims"]
        found = [gates.confidence(rows), gates.volatility(rows)]
        for name, table, key in (("sources", "source", "id"), ("claims", "claim", "id"), ("adjudications", "adjudication", "cluster_id"), ("plan", "section", "id"), ("credits", "credit", "name")):
            if name in have and key in have[name].columns:
                found.append(gates.record_schemas(have[name], table, key))
        if "texts" in have:
            found.append(gates.quotes(rows, self["texts"]))
        if "sources" in have:
            found.append(gates.tiers(rows, self["sources"]))
            if "texts" in have:
                found.append(gates.normalizer(self["sources"], self["texts"]))
        if "adjudications" in have:
            found.append(gates.clusters(rows, self["adjudications"]))
        if "plan" in have:
            found.append(gates.plan(rows, claims.placements(self["plan"])))
        if "pages" in have:
            found.append(gates.html(rows, self._site().nodes, self._site().texts))
            open_ = self.lint(waivers).filter("not waived")
            found.append(gates.finding(open_, "lint", F.col("rule"), F.format_string("%d:%d", "doc_id", "line"), F.col("detail")))
        if "credits" in have and "pages" in have:
            found.append(self.licenses(strict=True))
        if "lines" in have:
            found.append(gates.dialogue(self["lines"], self["speakers"], rows))
        if expect_page and "pages" not in have:
            found.append(gates.missing(self.spark, "html", "E-HTML-MISSING", "page"))
        if expect_dialogue and "lines" not in have:
            found.append(gates.missing(self.spark, "podcast", "E-PODCAST-MISSING", "script"))
        return reduce(DataFrame.unionByName, found)

    def report(self, findings: DataFrame, revise_count: int = 0) -> DataFrame:
        return gates.verdict(findings, revise_count)

    def tts_plan(self) -> DataFrame:
        return publishing.dialogue_plan(self["lines"])

    def package(self, public: bool = False) -> tuple[DataFrame, DataFrame]:
        """(provenance, evidence); in public form quotes beyond the budget are redacted."""
        evidence = claims.evidence_rows(self["claims"])
        if public:
            ords = self.ordinals().withColumnRenamed("id", "claim_id")
            evidence = claims.redact(evidence.join(ords, "claim_id", "left").withColumn("ord", F.struct(F.coalesce("ordinal", F.lit(2**31 - 1)).alias("o"), "claim_id", "position")))
        return publishing.provenance(self["sources"], public), evidence

    def publish(self, folder: str, files: DataFrame, notes: DataFrame, question: str, at: str, public: bool = False) -> int:
        """Writes a package as a version under a folder; returns its number."""
        return publishing.package(Store(self.spark, folder), self["sources"], self["claims"], files, notes, question, at, self.ordinals() if public else None)

    def status(self, counts: DataFrame) -> DataFrame:
        return publishing.state(counts)

    def unblock(self, reason: str, at: str) -> DataFrame:
        self.tables["history"] = publishing.append_history(self["history"], "REVISE", at, f"unblocked: {reason}")
        return self["history"]
