"""Urls and file names as column expressions.  Hosts and path shapes are parameters."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

from corpusloom.functions.text import squeeze, strip

URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, URL, 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(c, URL, 2)


def path(c: Column) -> Column:
    return F.regexp_extract(c, URL, 3)


def query_value(c: Column, name: str) -> Column:
    found = F.regexp_extract(F.regexp_extract(c, URL, 4), f"(?:^|&){name}=([^&]+)", 1)
    return F.nullif(found, F.lit(""))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(authority(c)), r"^www\.", "")


def is_valid(c: Column, schemes=("http", "https")) -> Column:
    return scheme(c).isin(*schemes) & (authority(c) != "")


def last_part(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(c), "^/+|/+$", ""), r"([^/]*)$", 1)


def name_of(c: Column) -> Column:
    return F.coalesce(F.nullif(last_part(c), F.lit("")), F.nullif(authority(c), F.lit("")), F.lit("item"))


def title_of(c: Column, default: str = "Public Link") -> Column:
    where = F.coalesce(F.nullif(authority(c), F.lit("")), F.lit(default))
    return F.when(last_part(c) != "", F.concat(where, F.lit("/"), last_part(c))).otherwise(where)


def item_id(c: Column, hosts: list[str], shape: str, parameter: str = "id") -> Column:
    """Id of a file or folder on one of the hosts: from the path shape, else from a query parameter."""
    found = F.coalesce(F.nullif(F.regexp_extract(path(c), shape, 1), F.lit("")), query_value(c, parameter))
    return F.when(host(c).isin(*hosts), found)


def download_url(c: Column, hosts: list[str], shape: str, target: str) -> Column:
    """Direct download address of hosted files; other addresses stay."""
    found = item_id(c, hosts, shape)
    return F.when(found.isNotNull(), F.concat(F.lit(target), found)).otherwise(c)


def redacted(c: Column) -> Column:
    """Password of a connection url masked."""
    return F.regexp_replace(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:@]*):[^/?#@]+@", "$1:****@")


def connection_label(c: Column) -> Column:
    where = F.regexp_replace(F.regexp_replace(authority(c), "^.*@", ""), r":\d+$", "")
    return F.concat(where, F.lit("/"), F.coalesce(F.nullif(F.regexp_replace(path(c), "^/+", ""), F.lit("")), F.lit("database")))


def header_filename(c: Column) -> Column:
    """File name of a content-disposition header: the encoded form first."""
    encoded = F.trim(F.regexp_extract(c, r"(?i)filename\*=UTF-8''([^;]+)", 1))
    plain = F.trim(F.regexp_extract(c, r'(?i)filename="?([^";]+)"?', 1))
    decoded = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.nullif(decoded, F.lit("")), F.nullif(plain, F.lit("")))


def safe_name(candidate: Column, fallback: Column, suffix: str = ".pdf") -> Column:
    """Last path part with unusual characters replaced and the suffix forced."""
    base = F.regexp_extract(F.regexp_replace(F.trim(candidate), "/+$", ""), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._ -]", "_"), r"^[ ._]+|[ ._]+$", "")
    return (
        F.when(candidate.isNull() | (clean == ""), F.concat(fallback, F.lit(suffix)))
        .when(F.lower(clean).endswith(suffix), clean)
        .otherwise(F.concat(clean, F.lit(suffix)))
    )


def squeezed_title(c: Column, limit: int = 150) -> Column:
    return F.nullif(F.substring(strip(squeeze(c)), 1, limit), F.lit(""))


def kind_of(content_type: Column, name: Column) -> Column:
    """pdf, text or null by media type and suffix."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    media = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(media.contains("pdf") | (suffix == ".pdf"), "pdf").when(
        media.startswith("text/") | suffix.isin(".txt", ".md", ".log"), "text"
    )


def unescaped(c: Column) -> Column:
    """Html entities resolved."""

    def body(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: html.unescape(x) if x is not None else None)

    return F.pandas_udf(body, "string")(c)
