"""Secrets in the queries of URLs, inside any text, as Column expressions.

A URL runs from its scheme to the next white space, quote or angle bracket. Its query is taken apart at `&` and the first `=`, form
decoding is undone and done again for every part, and the values of secret keys become `***`. The rest of the text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that name a secret, and endings that do.
SECRET_KEYS = ("api_key", "apikey", "authorization", "credential", "password", "secret", "token", "cookie")
SECRET_ENDS = ("_api_key", "_apikey", "_authorization", "_credential", "_credentials", "_password", "_secret", "_token", "_cookie")
URL = r"https?://[^\s\"'<>]+"


def is_secret(key: Column) -> Column:
    plain = F.translate(F.lower(key), "-", "_")
    return plain.isin(*SECRET_KEYS) | plain.rlike(f"({'|'.join(SECRET_ENDS)})$")


def _decoded(part: Column) -> Column:
    """Form decoding; a percent sign without two digits stands for itself."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(part: Column) -> Column:
    at = F.locate("=", part)
    key = _decoded(F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part))
    value = _decoded(F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise(""))
    return F.concat(_encoded(key), F.lit("="), _encoded(F.when(is_secret(key), "***").otherwise(value)))


def scrub_url(url: Column) -> Column:
    """One URL."""
    whole = F.split(url, "#", 2)
    front = F.split(whole[0], r"\?", 2)
    query = F.array_join(F.transform(F.filter(F.split(F.get(front, F.lit(1)), "&", -1), lambda x: x != ""), _pair), "&")
    head = F.when(F.coalesce(query, F.lit("")) == "", front[0]).otherwise(F.concat(front[0], F.lit("?"), query))
    tail = F.coalesce(F.get(whole, F.lit(1)), F.lit(""))
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit("#"), tail))


def scrub_urls_in(text: Column) -> Column:
    """All URLs of a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1)), scrub_url)
    between = F.split(text, URL, -1)
    return F.when(text.rlike(URL), F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(found, i), F.lit("")))), "")).otherwise(text)
