"""Identifiers that are pure functions of content, and canonical locators."""

from __future__ import annotations

from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import is_http_url, norm_ws, strip

# Query parameters that only track a visitor.
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|mc_[ce]id|ref|si|igshid)$"


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def _short(prefix: str, x: Column, n: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256(x), 1, n))


def source_id(locator: Column, raw_sha256: Column) -> Column:
    return _short("src_", F.concat(locator, F.lit("\n"), raw_sha256))


def chunk_id(source: Column, ordinal: Column) -> Column:
    return F.format_string("%s#c%04d", source, ordinal)


def claim_id(text: Column) -> Column:
    return _short("clm_", F.lower(norm_ws(text)))


def cluster_id(topic: Column) -> Column:
    return _short("cls_", topic)


def paste_locator(text: Column) -> Column:
    return _short("paste:", norm_ws(text), 16)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, parameters sorted by key and value.

    A percent sign that begins no escape stands for itself.
    """
    url = strip(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"#.*$", "")
    authority = F.regexp_extract(rest, r"^//([^/?]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?]*", ""), r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    decode = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(p.contains("="), F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    encode = lambda x: F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~"))
    encode_all = lambda x: F.replace(encode(x), F.lit("*"), F.lit("%2A"))
    written = F.array_join(F.transform(kept, lambda p: F.concat(encode_all(p["k"]), F.lit("="), encode_all(p["v"]))), "&")
    return F.concat(
        scheme, F.when(scheme != "", F.lit("://")).otherwise(""), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host,
        F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(path == "/", F.lit("")).otherwise(path), F.when(written != "", F.concat(F.lit("?"), written)).otherwise(""),
    )


def folded_path(path: Column) -> Column:
    """A path without empty and ``.`` steps; ``..`` takes back the step before it. Above the beginning, relative paths keep it and absolute ones lose it."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    absolute = path.startswith("/")

    def take(kept: Column, step: Column) -> Column:
        back = (F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("")), kept), -1) != "..")
        return F.when(step != "..", F.array_append(kept, step)).when(back, F.slice(kept, 1, F.size(kept) - 1)).when(absolute, kept).otherwise(F.array_append(kept, step))

    walked = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), take), "/")
    return F.concat(F.when(absolute, "/").otherwise(""), walked)


def canonical_locator(kind: Column, locator: Column, root: str | None = None) -> Column:
    """By kind: url, paste, or a path, relative to the workspace ``root`` if it lies in it; paths outside stay as they are."""
    posix = F.replace(locator, F.lit("\\"), F.lit("/"))
    path = folded_path(posix)
    if root is not None:
        top = root.rstrip("/") + "/"
        path = F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)
    path = F.when(path.startswith("..") | path.startswith("/"), posix).otherwise(path)
    return F.when(kind == "url", canonical_url(locator)).when(kind == "paste", paste_locator(locator)).otherwise(path)


@pandas_udf(T.BinaryType())
def percent_decode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unquote_to_bytes(x))


def data_uri_asset(src: Column) -> Column:
    """A name for an inlined image: the digest of its decoded bytes."""
    payload = F.when(src.contains(","), F.regexp_extract(src, r"(?s)^[^,]*,(.*)$", 1)).otherwise("")
    raw = F.when(F.lower(F.substring_index(src, ",", 1)).contains(";base64"), F.coalesce(F.try_to_binary(payload, F.lit("base64")), F.encode(src, "UTF-8"))).otherwise(percent_decode(payload))
    return F.concat(F.lit("data:sha256:"), F.substring(F.sha2(raw, 256), 1, 16))


def asset_name(src: Column, declared: Column) -> Column:
    """The credits key of an image: its declared asset name, the digest of a data URI, or the last part of its path."""
    declared = F.nullif(F.trim(F.coalesce(declared, F.lit(""))), F.lit(""))
    return F.coalesce(declared, F.when(src.startswith("data:"), data_uri_asset(src)).otherwise(F.element_at(F.split(F.try_url_decode(F.replace(src, F.lit("+"), F.lit("%2B"))), "/"), -1)))
