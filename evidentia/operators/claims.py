"""The claim table: defaults, ordinals, marks, quote budgets and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import claim_id
from ..functions.text import escape_html, is_http_url, word_count
from .ranges import numbered, running

# The budget of verbatim quotation.
MAX_QUOTE_WORDS, MAX_QUOTE_CHARS, MAX_QUOTES_PER_SOURCE, MAX_CHARS_PER_SOURCE = 25, 200, 3, 500
# The mark of each confidence, and what a reader sees.
MARKS = {"verified": "m-checked", "reported": "m-reported", "contested": "m-contested", "inferred": "m-thin", "unsupported": "m-thin"}
LABELS = {"m-checked": "checked", "m-reported": "reported", "m-contested": "contested", "m-moving": "moving", "m-thin": "thin"}
EVIDENCE = "struct<source_id:string,start:int,end:int,quote:string,quote_sha256:string,length:int,redacted:boolean>"
#: Columns that a claim may lack, and what stands for them.
DEFAULTS = {"volatile": "false", "as_of": "cast(null as string)", "recheck": "cast(null as string)", "contradicts": "cast(array() as array<string>)", "status": "'active'", "superseded_by": "cast(null as string)", "notes": "''", "evidence": f"cast(array() as array<{EVIDENCE}>)"}


def normalize_claims(claims: DataFrame) -> DataFrame:
    """Ids from the texts, and defaults for what is missing."""
    have = set(claims.columns)
    filled = {c: F.coalesce(F.col(c), F.expr(d)) if c in have else F.expr(d) for c, d in DEFAULTS.items()}
    return claims.withColumns(filled).withColumn("id", claim_id(F.col("text")))


def set_fields(claims: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Non-null columns of ``changes`` overwrite those of the claims with the same id."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    return claims.join(renamed, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else c for c in claims.columns))


def citable(status: Column, confidence: Column) -> Column:
    return (status == "active") & (confidence != "inferred")


def marks(confidence: Column, volatile: Column) -> Column:
    mark = F.coalesce(F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))[confidence], F.lit("m-thin"))
    return F.when(F.coalesce(volatile, F.lit(False)), F.array(mark, F.lit("m-moving"))).otherwise(F.array(mark))


def placements(plan: DataFrame) -> DataFrame:
    """(section, position, id) from sections (ord, claim_ids)."""
    return plan.select(F.col("ord").alias("section"), F.posexplode("claim_ids").alias("position", "id"))


def ordinals(claims: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, ordinal) of citable claims: by first place in the plan, the unplaced ones after, by id; numbered by ranges."""
    first = placed.groupBy("id").agg(F.min(F.struct("section", "position")).alias("at"))
    cited = claims.filter(citable(F.col("status"), F.col("confidence"))).select("id").join(first, "id", "left")
    order = [F.asc_nulls_last("section"), F.asc_nulls_last("position"), "id"]
    return numbered(cited.select("id", F.col("at.section").alias("section"), F.col("at.position").alias("position")), order, "ordinal").select("id", "ordinal")


def evidence_rows(claims: DataFrame) -> DataFrame:
    """(claim_id, position, source_id, start, end, quote, quote_sha256, redacted)."""
    exploded = claims.select(F.col("id").alias("claim_id"), F.posexplode("evidence").alias("position", "e"))
    return exploded.select("claim_id", "position", *(F.col(f"e.{c}").alias(c) for c in ("source_id", "start", "end", "quote", "quote_sha256", "redacted")))


def budget(quotes: DataFrame, distinct_spans: bool = True) -> DataFrame:
    """Which quotes may be printed. ``quotes``: (source_id, start, end, quote, redacted) and ``ord``, the order of printing.

    Greedy within a source: a quote that is refused uses up nothing, so a later, shorter one may still fit.
    The fold looks at three quotes of each size at most, whatever a source holds. With ``distinct_spans`` a span is decided once, at its first place.
    """
    quote = F.coalesce("quote", F.lit(""))
    fits = (F.length(quote) > 0) & (F.length(quote) <= MAX_QUOTE_CHARS) & (word_count(quote) <= MAX_QUOTE_WORDS) & ~F.coalesce("redacted", F.lit(False))
    rows = quotes.withColumn("size", F.when(fits, F.length(quote)))
    if distinct_spans:
        first = F.row_number().over(Window.partitionBy("source_id", "start", "end").orderBy("ord"))
        rows = rows.withColumn("nth", first)
    else:
        rows = rows.withColumn("nth", F.lit(1))
    able = rows.filter((F.col("nth") == 1) & F.col("size").isNotNull())
    # of quotes of one size only the first few can be granted: a later one would fit only if those had, which fills the budget
    alike = F.row_number().over(Window.partitionBy("source_id", "size").orderBy("ord"))
    able = able.withColumn("alike", alike).filter(F.col("alike") <= MAX_QUOTES_PER_SOURCE)
    ordered = able.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "size"))).alias("in_order"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast(f"array<{dict(rows.dtypes)['ord']}>").alias("granted"))

    def step(state: Column, x: Column) -> Column:
        ok = (state["n"] < MAX_QUOTES_PER_SOURCE) & (state["chars"] + x["size"] <= MAX_CHARS_PER_SOURCE)
        granted = F.when(ok, F.array_append(state["granted"], x["ord"])).otherwise(state["granted"])
        return F.struct((state["n"] + ok.cast("int")).alias("n"), (state["chars"] + F.when(ok, x["size"]).otherwise(0)).alias("chars"), granted.alias("granted"))

    granted = ordered.select("source_id", F.explode(F.aggregate("in_order", start, step)["granted"]).alias("ord")).withColumn("granted", F.lit(True))
    decided = rows.join(granted, ["source_id", "ord"], "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
    if distinct_spans:
        decided = decided.withColumn("granted", F.max("granted").over(Window.partitionBy("source_id", "start", "end")))
    return decided.drop("size", "nth")


def redact(evidence: DataFrame) -> DataFrame:
    """Public form: quotes beyond the budget give way to their hash and length; a stored hash stays when no quote is held."""
    kept = F.col("granted")
    bare = F.coalesce(F.length("quote"), F.lit(0)) == 0
    return budget(evidence, distinct_spans=False).withColumns({
        "quote_sha256": F.when(kept, F.col("quote_sha256")).when(bare & F.col("quote_sha256").isNotNull(), F.col("quote_sha256")).otherwise(F.sha2(F.coalesce("quote", F.lit("")), 256)),
        "length": F.when(~kept, F.length(F.coalesce("quote", F.lit("")))), "redacted": ~kept, "quote": F.when(kept, F.col("quote")),
    })


def resolved(claims: DataFrame, ords: DataFrame) -> DataFrame:
    """Claims with ordinal and marks: the citable ones, and the active inferred ones without an ordinal."""
    thin = (F.col("status") == "active") & (F.col("confidence") == "inferred")
    return claims.join(ords, "id", "left").filter(F.col("ordinal").isNotNull() | thin).withColumn("marks", marks(F.col("confidence"), F.col("volatile")))


def _printed(ledger: DataFrame, sources: DataFrame, granted: DataFrame) -> DataFrame:
    """A row for each claim and piece of evidence (or none), with source and granted quote."""
    ev = evidence_rows(ledger).join(sources.select(F.col("id").alias("source_id"), "title", "publisher", "tier", "locator"), "source_id", "left")
    shown = granted.filter("granted").select("source_id", "start", "end", F.col("quote").alias("shown")).distinct()
    return ev.join(shown, ["source_id", "start", "end"], "left")


def render_markdown(ledger: DataFrame, sources: DataFrame, granted: DataFrame) -> DataFrame:
    """(ordinal, body): an entry of the Markdown ledger for each citable claim."""
    snippet = F.when(F.col("shown").isNotNull(), F.concat(F.lit('"'), "shown", F.lit('"'))).otherwise(F.format_string("chars %d-%d", "start", "end"))
    line = F.concat(F.lit("   - tier "), F.coalesce("tier", F.lit("?")), F.lit(" · "), F.coalesce(F.nullif("title", F.lit("")), "source_id"), F.lit(" · "), snippet)
    lines = _printed(ledger, sources, granted).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    labels = F.array_join(F.transform("marks", lambda m: F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[m]), " ")
    recheck = F.when(is_http_url(F.col("recheck")), F.concat(F.lit(" · [recheck]("), "recheck", F.lit(")"))).when(F.length("recheck") > 0, F.concat(F.lit(" · recheck URL withheld; not an http(s) address: "), "recheck")).otherwise("")
    as_of = F.when(F.length("as_of") > 0, F.concat(F.lit(" · as of "), "as_of")).otherwise("")
    body = F.concat(F.col("ordinal").cast("string"), F.lit(". **"), "text", F.lit("**  \n   `"), labels, F.lit("`"), as_of, recheck, F.lit("\n"), F.coalesce("lines", F.lit("   - no source; author's inference")), F.lit("\n"))
    return ledger.filter("ordinal is not null").join(lines, ledger["id"] == lines["claim_id"], "left").select("ordinal", body.alias("body"))


def render_html(ledger: DataFrame, sources: DataFrame, granted: DataFrame) -> DataFrame:
    """(ordinal, id, body): a list item of the HTML ledger for each resolved claim; thin ones have no ordinal."""
    # The fragments of HTML below, which other tools read.
    esc = lambda c: escape_html(F.coalesce(c, F.lit("")))
    name = F.concat(esc(F.coalesce(F.nullif("title", F.lit("")), "source_id")), F.when(F.length("publisher") > 0, F.concat(F.lit(" &middot; "), esc(F.col("publisher")))).otherwise(""))
    linked = F.when(F.col("locator").startswith("http"), F.concat(F.lit('<a href="'), esc(F.col("locator")), F.lit('" rel="nofollow noopener">'), name, F.lit("</a>"))).otherwise(name)
    tier = esc(F.coalesce("tier", F.lit("?")))
    said = F.when(F.col("shown").isNotNull(), F.concat(F.lit('<q class="ledger-quote">'), esc(F.col("shown")), F.lit("</q>"))).otherwise(F.format_string('<span class="ledger-span">quote withheld under the quote budget; chars %d&ndash;%d of the source</span>', "start", "end"))
    line = F.concat(F.lit('<p class="ledger-source"><span class="tier tier-'), tier, F.lit('">tier '), tier, F.lit("</span> "), linked, said, F.lit("</p>"))
    lines = _printed(ledger, sources, granted).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    badge = F.array_join(F.transform("marks", lambda m: F.concat(F.lit('<span class="mark '), m, F.lit('">'), F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[m], F.lit("</span>"))), " ")
    recheck = F.when(is_http_url(F.col("recheck")), F.concat(F.lit('<a class="recheck" href="'), esc(F.col("recheck")), F.lit('" rel="nofollow noopener">recheck</a>'))).when(F.length("recheck") > 0, F.concat(F.lit('<span class="recheck">recheck URL withheld; not an http(s) address: '), esc(F.col("recheck")), F.lit("</span>"))).otherwise("")
    as_of = F.when(F.length("as_of") > 0, F.concat(F.lit('<span class="as-of">as of '), esc(F.col("as_of")), F.lit("</span>"))).otherwise("")
    value = F.when(F.col("ordinal").isNotNull(), F.concat(F.lit(' value="'), F.col("ordinal").cast("string"), F.lit('"'))).otherwise("")
    none = F.lit('<p class="ledger-source"><span class="tier tier-none">no source</span> author\'s inference; weigh it as opinion.</p>')
    body = F.concat(F.lit('<li class="ledger-entry" id="c-'), "id", F.lit('"'), value, F.lit('><p class="ledger-claim">'), esc(F.col("text")), F.lit('</p><p class="ledger-meta">'), badge, as_of, recheck, F.lit("</p>"), F.coalesce("lines", none), F.lit("</li>"))
    return ledger.join(lines, ledger["id"] == lines["claim_id"], "left").select("ordinal", "id", body.alias("body"))


def _fixed(spark: SparkSession, *pieces: tuple[int, str]) -> DataFrame:
    """Lines around the entries, as many as there are kinds of them."""
    return spark.createDataFrame([(at, None, None, line) for at, line in pieces], "block int, ordinal long, id string, line string")


def ledger_pieces(ledger: DataFrame, sources: DataFrame, granted: DataFrame, form: str) -> DataFrame:
    """(block, ordinal, id, line): the lines of a whole ledger as ``json``, ``md`` or ``html``; the first three columns are their order.

    HTML has the cited claims in an ordered list and then the thin ones, if there are any.
    """
    spark = ledger.sparkSession
    thin = F.col("ordinal").isNull()
    columns = ["block", F.col("ordinal").cast("long").alias("ordinal"), F.col("id").cast("string").alias("id"), "line"]
    if form == "json":
        entries = ledger.select(F.when(thin, 2).otherwise(1).alias("block"), "ordinal", "id", F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"}).alias("line"))
        return entries.select(*columns).unionByName(_fixed(spark, (0, '{"schema_version":1,"ledger":['), (3, "]}")))
    if form == "md":
        gap = F.when(F.col("ordinal") > 1, "\n").otherwise("")
        entries = render_markdown(ledger, sources, granted).select(F.lit(1).alias("block"), "ordinal", F.lit("").alias("id"), F.concat(gap, F.regexp_replace("body", r"\n\z", "")).alias("line"))
        return entries.select(*columns).unionByName(_fixed(spark, (0, "# Ledger\n")))
    items = render_html(ledger, sources, granted).select(F.when(thin, 4).otherwise(1).alias("block"), "ordinal", "id", F.col("body").alias("line"))
    note = '<li class="ledger-note">Inferences of the author. They are recorded and cited nowhere, since no source stands behind them.</li>'
    around = _fixed(spark, (3, f'<ul class="ledger ledger-thin">\n{note}'), (5, "</ul>"))
    around = around.crossJoin(F.broadcast(ledger.filter(thin).select(F.lit(1).alias("one")).limit(1))).drop("one")  # one row or none
    return items.select(*columns).unionByName(_fixed(spark, (0, '<ol class="ledger">'), (2, "</ol>"))).unionByName(around)


def ledger_lines(pieces: DataFrame, form: str, parts: int | None = None) -> DataFrame:
    """(place, offset, line): every line of a ledger, its place from 1 and the byte that it begins at; the file is these lines, each with a line break."""
    order = ["block", F.asc_nulls_first("ordinal"), F.asc_nulls_first("id")]
    placed = running(pieces, order, {"place": F.lit(1).cast("long"), "offset": F.octet_length("line").cast("long") + 1}, parts)
    if form == "json":  # entries but the first begin with a comma
        comma = F.when(F.col("block").isin(1, 2) & (F.col("place") > 1), ",").otherwise("")
        placed = placed.withColumns({"line": F.concat(comma, "line"), "offset": F.col("offset") + F.greatest(F.lit(0), F.col("place") - 2)})
    return placed.select((F.col("place") + 1).alias("place"), "offset", "line")


def whole(lines: DataFrame) -> DataFrame:
    """(body,): lines as one text, for a page that is to hold them all; a page is one cell anyhow."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("body"))


def source_listing(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(tier, title, id, locator, tier_reason, retrieved_at, n_claims) by tier and title."""
    used = evidence_rows(claims).groupBy("source_id").agg(F.countDistinct("claim_id").alias("n_claims"))
    joined = sources.join(used, sources["id"] == used["source_id"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), "id")
    return joined.select(F.coalesce("tier", F.lit("?")).alias("tier"), title.alias("title"), "id", "locator", "tier_reason", "retrieved_at", F.coalesce("n_claims", F.lit(0)).alias("n_claims")).orderBy(F.when(F.col("tier") == "?", "Z").otherwise(F.col("tier")), "title")


def inject(page: Column, ledger: Column, begin: str, end: str) -> Column:
    """Replaces what stands between two markers, or inserts and closes where only the first one stands; null without it."""
    after = page.substr(F.position(F.lit(begin), page) + len(begin), F.length(page))
    tail = F.when(after.contains(end), after.substr(F.position(F.lit(end), after) + len(end), F.length(after))).otherwise(after)
    return F.when(page.contains(begin), F.concat(F.substring_index(page, begin, 1), F.lit(begin + "\n"), F.regexp_replace(ledger, r"\n+$", ""), F.lit("\n" + end), tail))
