"""WARC records, and resolution of not-modified revisits.

A revisit record says that the server answered 304 to a conditional request. It stands for the latest earlier full response
with the same canonical URL (as-of join; at equal times the smaller record id came first), if the validators agree: the
entity tag (compared weakly, without `W/`) where the revisit has one, else the modification date. The resolved record has the earlier payload, and its
headers where the revisit doesn't replace them; a 304 may replace only PERMITTED ones.

The as-of join runs over narrow rows (no payload), in two steps so that one URL with a third of all records is not one task:
time is cut at quantiles into slices; the latest response of each URL and slice is aggregated, carried over to later slices,
and then looked for inside each slice. The payload is joined afterwards by record id, one row for each resolved record.

Nulls: a record without a URL or time, or a revisit without any validator, resolves to nothing (`unresolved`). Records that
repeat an id are resolved one by one, and of several responses of one id the smallest payload counts. Empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, spread_join, table

#: Header fields that a 304 response may update (RFC 9111, section 3.2, and RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICES = 64
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical(url: Column) -> Column:
    """No scheme, fragment, default port, leading www., tracking parameters or trailing slash; the host in lower case."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"(?s)^.*?://([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"(?s)^.*?://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, r"(?s)\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), f"&(?:{TRACKING})=[^&]*", ""), "^&", "")
    return F.when(plain.contains("://"), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _slices(records: DataFrame, slices: int) -> list:
    """Times that cut the records into slices of about equal number."""
    if not records.schema["at"].dataType.simpleString() in ("bigint", "int", "double"):
        raise ValueError("`at` must be a number")
    cuts = records.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 1000)).first()[0]
    return sorted(set(cuts or []))


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Of records (record_id, url, at, kind 'response' or 'revisit', headers map<string,string> with lower-case names) one row
    each: record_id, canonical_url, kind, source_id (the record that holds the payload), state, headers as merged."""
    narrow = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "at", "kind", "headers")
    cuts = _slices(narrow, slices)
    cut = F.size(F.filter(F.lit(cuts), lambda x: x <= F.col("at"))) if cuts else F.lit(0)
    narrow = materialise(narrow.withColumn("slice", F.coalesce(cut, F.lit(0))))
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    mark = F.when((F.col("kind") == "response") & usable, F.struct("at", F.col("record_id").alias("id"), "headers"))
    order = lambda c: F.struct(c["at"].alias("at"), c["id"].alias("id"))
    last = narrow.where(usable & (F.col("kind") == "response")).groupBy("canonical_url", "slice").agg(F.max_by(F.struct("at", F.col("record_id").alias("id"), "headers"), F.struct("at", "record_id")).alias("m"))
    wanted = narrow.where(usable & (F.col("kind") == "revisit")).select("canonical_url", "slice").distinct()
    both = wanted.join(last, ["canonical_url", "slice"], "full")
    earlier = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = both.select("canonical_url", "slice", F.last("m", ignorenulls=True).over(earlier).alias("carried"))
    inside = W.partitionBy("canonical_url", "slice").orderBy("at", "record_id", F.xxhash64("kind")).rowsBetween(W.unboundedPreceding, -1)
    found = narrow.withColumn("m", F.when(usable, F.last(mark, ignorenulls=True).over(inside)))
    found = found.join(carried, ["canonical_url", "slice"], "left").withColumn("source", F.coalesce("m", "carried"))
    tag, theirs = F.regexp_replace(F.col("headers")["etag"], "^W/", ""), F.regexp_replace(F.col("source.headers")["etag"], "^W/", "")
    agrees = F.when(tag.isNotNull(), F.coalesce(tag == theirs, F.lit(False))).otherwise(F.coalesce(F.col("headers")["last-modified"] == F.col("source.headers")["last-modified"], F.lit(False)))
    state = F.when(F.col("kind") != "revisit", F.lit("response")).when(F.col("source").isNull(), "unresolved").when(agrees, "resolved").otherwise("mismatch")
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("source.headers", lambda k, v: ~F.map_contains_key(updates, k)), updates)
    return found.withColumn("state", state).select(
        "record_id", "canonical_url", "kind", F.when(F.col("state") == "response", F.col("record_id")).when(F.col("state") == "resolved", F.col("source.id")).alias("source_id"),
        "state", F.when(F.col("state") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """resolved with the payload of its source record."""
    held = records.where("kind = 'response'").groupBy(F.col("record_id").alias("source_id")).agg(F.min(payload).alias(payload))
    rest = [c for c in resolved.columns if c != payload]
    return spread_join(materialise(resolved.select(*rest)), held, "source_id", F.col("record_id"))


def encode_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record; a damaged one is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"cut record at byte {at}")
        yield fields, block
        at = end + 8 + n


def page_records(pages: DataFrame) -> DataFrame:
    """The records that op8 resolves: four fetches of each page, with record_id 4 * page_id + fetch, at the time 10^9 * fetch + page_id.

    Fetch 0 is a full response, but not where 7 divides page_id; fetch 1 a 304 with an entity tag; fetch 2 a new version where 3 divides
    page_id, else a 304 with a date; fetch 3 a 304 with the tag of the current version, or of an unknown one where 5 divides page_id.
    Validators follow from the canonical URL and the version."""
    n, page = F.col("fetch"), F.col("page_id")
    by = lambda k: F.pmod(page, F.lit(k)) == 0
    rows = pages.select("page_id", "url", "html", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("fetch"))
    response = ((n == 0) & ~by(7)) | ((n == 2) & by(3))
    version = F.when((n == 2) & by(3), "v1").when((n == 3) & by(5), "v9").when((n == 3) & by(3), "v1").otherwise("v0")
    rows = rows.withColumn("kind", F.when(response, "response").otherwise("revisit")).withColumn("version", version)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.concat_ws("|", canonical(F.col("url")), "version")), 1, 12), F.lit('"'))
    date, seen = F.concat(F.lit("day "), "version"), F.concat(F.lit("fetch "), n.cast("string"), F.lit(" of "), page.cast("string"))
    both = F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("date"), seen, F.lit("content-type"), F.lit("text/html"))
    headers = F.when(F.col("kind") == "response", both).when(n == 2, F.create_map(F.lit("last-modified"), date, F.lit("date"), seen))
    headers = headers.otherwise(F.create_map(F.lit("etag"), tag, F.lit("date"), seen, F.lit("content-type"), F.lit("text/plain")))
    payload = F.when(F.col("kind") == "response", F.concat("html", F.lit(" "), "version"))
    return rows.select((page * 4 + n).alias("record_id"), "url", (n * 1_000_000_000 + page).alias("at"), "kind", headers.alias("headers"), payload.alias("payload"))


def op8(spark, sf_dir: str) -> DataFrame:
    records = page_records(table(spark, sf_dir, "pages"))
    digests = records.select("record_id", "kind", F.md5("payload").alias("payload_md5"))
    out = with_payload(resolve(records.drop("payload")), digests, "payload_md5")
    return out.select("record_id", "canonical_url", "kind", "source_id", "state", F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"), "payload_md5")


ORACLE_SQL = f"""
WITH a AS (SELECT page_id, html, url, regexp_replace(url, '(?s)#.*$', '') AS p FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(p, '(?s)^.*?://([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
  regexp_replace(regexp_extract(p, '(?s)^.*?://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  regexp_replace(regexp_replace('&' || regexp_extract(p, '(?s)\\?(.*)$', 1), '&(?:{TRACKING})=[^&]*', '', 'g'), '^&', '') AS q FROM a),
c AS (SELECT page_id, html, CASE WHEN contains(p, '://') THEN host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical_url FROM b),
d AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM c),
e AS (SELECT 4 * page_id + k AS record_id, page_id, k, canonical_url, html, 1000000000 * k::BIGINT + page_id AS at,
  CASE WHEN (k = 0 AND page_id % 7 <> 0) OR (k = 2 AND page_id % 3 = 0) THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN k = 2 AND page_id % 3 = 0 THEN 'v1' WHEN k = 3 AND page_id % 5 = 0 THEN 'v9' WHEN k = 3 AND page_id % 3 = 0 THEN 'v1' ELSE 'v0' END AS version FROM d),
r AS (SELECT *, '"' || substr(md5(concat_ws('|', canonical_url, version)), 1, 12) || '"' AS tag FROM e),
m AS (SELECT v.*, f.record_id AS source, f.tag AS ftag, f.version AS fversion, f.html AS fhtml FROM r v ASOF LEFT JOIN (SELECT * FROM r WHERE kind = 'response') f ON v.canonical_url = f.canonical_url AND v.at > f.at),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN source IS NULL THEN 'unresolved'
  WHEN CASE WHEN k = 2 THEN version = fversion ELSE tag = ftag END THEN 'resolved' ELSE 'mismatch' END AS state FROM m)
SELECT record_id, canonical_url, kind, CASE state WHEN 'response' THEN record_id WHEN 'resolved' THEN source END AS source_id, state, 'fetch ' || k || ' of ' || page_id AS date,
  CASE WHEN state IN ('response', 'resolved') THEN 'text/html' WHEN k <> 2 THEN 'text/plain' END AS content_type,
  CASE state WHEN 'response' THEN md5(html || ' ' || version) WHEN 'resolved' THEN md5(fhtml || ' ' || fversion) END AS payload_md5 FROM s"""

QUERIES = {"op8_revisits": op8}
ORACLE = {"op8_revisits": ORACLE_SQL}
