"""File sources: raw captures, JSON records, decoding by declared charset, and which addresses may be fetched."""

from __future__ import annotations

import codecs
import io
import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.ids import canonical_locator, source_id
from ..functions.text import normalize
from .store import Files, Store

MEDIA = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "json": "application/json", "csv": "text/csv"}


def captures(spark: SparkSession, path: str, most: int = 25 << 20) -> DataFrame:
    """(path, media_type, content, raw_sha256, status, error) of the files under a path; those larger than ``most`` bytes fail unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = lambda df, content, error: df.select(
        "path", media_type(F.col("path")).alias("media_type"), content.alias("content"), F.sha2(content, 256).alias("raw_sha256"), F.when(error.isNull(), "pending").otherwise("failed").alias("status"), error.alias("error"))
    none, large = F.lit(None).cast("string"), F.format_string("%d bytes are more than the limit of %d", "length", F.lit(most))
    return found(files.filter(F.col("length") <= most), F.col("content"), none).unionByName(found(files.filter(F.col("length") > most), F.lit(None).cast("binary"), large))


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))[suffix], F.lit("application/octet-stream"))


def json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records with an explicit schema; what can't be parsed keeps its text in ``_corrupt_record`` and has status ``failed``."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", str(not lines)).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("status", F.when(F.col("_corrupt_record").isNotNull(), "failed").otherwise(F.col("status"))) if "status" in rows.columns else rows


def source_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records ``path/<id>/source.json``; one that can't be read is a failed source with the id of its folder."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(f"{path}/*/source.json").withColumn("__id", F.element_at(F.split("_metadata.file_path", "/"), -2))
    broken = F.col("_corrupt_record").isNotNull()
    as_failed = {"id": F.when(broken, F.col("__id")).otherwise(F.col("id")), "status": F.when(broken, "failed").otherwise(F.col("status")), "error": F.when(broken, "source.json cannot be read").otherwise(F.col("error"))}
    return rows.withColumns(as_failed).drop("__id", "_corrupt_record")


def records_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``json_records``; a path that isn't there is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return json_records(spark, path, schema)


def write_records(df: DataFrame, path: str, key: str) -> int:
    """JSON lines in the order of a key, as a new version of what stands under a path: readers see the old records or the new ones."""
    return Store(df.sparkSession, path).publish({"records": df}, order={"records": [key]}, form="json")


def read_records(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """What ``write_records`` has written last, or as a version."""
    return Store(spark, path).read("records", version)


def write_lines(lines: DataFrame, path: str) -> list[dict]:
    """Writes (offset, line) as part files and ``parts.json``: [{name, offset, bytes}] of the files that make the whole, in order.

    A task writes a range of lines. The list is written last, so that it names whole files only.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "offset").sortWithinPartitions("offset").select("line").write.text(f"{path}/parts")
    at, out, found = 0, [], Files(spark, path)
    for f in sorted(found.fs.listStatus(found.path("parts")), key=lambda f: f.getPath().getName()):  # a file a range
        if f.getPath().getName().startswith("part-") and f.getLen():
            out.append({"name": f.getPath().getName(), "offset": at, "bytes": f.getLen()})
            at += f.getLen()
    found.write_new("parts.json", json.dumps(out))
    return out


_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_META = re.compile(rb"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""")


def declared_charset(raw: bytes) -> str | None:
    """By a byte-order mark or a meta element near the beginning; nothing is guessed."""
    mark = next((name for bom, name in _MARKS if raw.startswith(bom)), None)
    meta = None if mark else _META.search(raw[:4096])
    return mark or (meta.group(1).decode().lower() if meta else None)


def decode_text(raw: bytes, charset: str | None) -> str:
    for name in filter(None, (charset, "utf-8")):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("utf-8", "replace")


@pandas_udf(T.StringType())
def sniff(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else declared_charset(bytes(b)))


@pandas_udf(T.StringType())
def decode(content: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_text(bytes(b), c or declared_charset(bytes(b))) for b, c in zip(content, charset)])


def canonical_texts(raw: DataFrame) -> DataFrame:
    """(source_id, text, text_len, sha256) of raw (kind, locator, text)."""
    text = normalize(F.col("text"))
    rows = raw.select(source_id(canonical_locator(F.col("kind"), F.col("locator")), F.sha2("text", 256)).alias("source_id"), text.alias("text"))
    return rows.select("source_id", "text", F.length("text").alias("text_len"), F.sha2("text", 256).alias("sha256"))


@pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The text of PDFs, where a reader is installed and finds 40 characters and more; else null."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pd.Series([None] * len(content), dtype=object)

    def read(raw: bytes) -> str | None:
        try:
            text = "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)
        except Exception:  # a broken file waits for another extractor
            return None
        return text if len(text.strip()) >= 40 else None

    return content.map(lambda b: None if b is None else read(bytes(b)))


def route(captured: DataFrame, *carry: str) -> DataFrame:
    """(path, status, text) by media type, and the columns ``carry``: text and Markdown as they are, HTML and PDF through
    their readers; what has none waits for an extractor.
    """
    from .pages import html_to_markdown

    text = decode(F.col("content"), F.lit(None).cast("string"))
    rows = captured.withColumn("decoded", text).withColumn("md", html_to_markdown(F.when(F.col("media_type") == "text/html", F.col("decoded")), F.lit("")))
    rows = rows.withColumn("pdf", pdf_text(F.when(F.col("media_type") == "application/pdf", F.col("content"))))
    kind = F.col("media_type")
    failed = F.col("status") == "failed" if "status" in captured.columns else F.lit(False)
    body = F.when(failed, None).when(kind == "text/html", F.col("md.md")).when(kind.startswith("text/"), F.col("decoded")).when(kind == "application/pdf", F.col("pdf"))
    return rows.select("path", F.when(failed, "failed").when(body.isNotNull(), "ready").otherwise("needs_extraction").alias("status"), normalize(body).alias("text"), *carry)


def blocked_address(address: str) -> str | None:
    """Why an IP address may not be fetched from, or None."""
    try:
        ip = ipaddress.ip_address(address.strip("[]").split("%")[0])
    except ValueError:
        return "not an address"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    names = ("loopback", "link_local", "private", "multicast", "reserved", "unspecified")
    return next((n.replace("_", "-") for n in names if getattr(ip, f"is_{n}")), None if ip.is_global else "not global")


@pandas_udf(T.StringType())
def _blocked(hosts: pd.Series) -> pd.Series:
    literal = re.compile(r"\[.*\]|[0-9.]+|[0-9a-fA-F:]*:[0-9a-fA-F:.%]+")
    return hosts.map(lambda h: blocked_address(h) if h and literal.fullmatch(h) else "loopback" if h and h.lower().rstrip(".").endswith("localhost") else None)


def refusal(url: Column) -> Column:
    """Why a URL may not be fetched: scheme, credentials, no host, or the class of an address that it spells out; null if it may."""
    scheme, authority = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.when(~scheme.isin("http", "https"), "scheme").when(authority.contains("@"), "credentials").when(host == "", "no host").otherwise(_blocked(host))
