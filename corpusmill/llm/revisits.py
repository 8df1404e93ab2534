"""WARC not-modified revisits: each is given the latest earlier full response of its canonical URL.

An as-of join by blocks of time: within a block, a running maximum over the records of one canonical URL carries the
latest earlier response, as a small struct without payload; each block's last response is carried to later blocks, so a
URL that holds most records is as many groups as it has blocks. The revisit's validators are then checked
(entity tags by weak comparison, else last-modified), and the headers that a 304 may carry replace the response's.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import arrow_map, batch

#: Header fields that a not-modified answer may bring up to date (all lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "set-cookie", "warning")
#: Status codes of full responses, and what names the profile of a not-modified revisit.
FULL = (200, 203)
NOT_MODIFIED = "server-not-modified"
#: Query parameters that do not name a resource.
TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Host in lower case and without www or default port, path without index file and last slash, sorted query without tracking parameters; scheme and fragment go. Null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/index\.[A-Za-z]+$", "/"), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, r"^W/", "")


DAY = 86_400_000_000


def resolved(records: DataFrame, block: int = DAY) -> DataFrame:
    """records: record_id, url, time (long), revisit (boolean), headers (map of lower-case names), and http_status (int) and
    profile, if they have them. A row for each revisit: record_id, url_key, source_id, status, headers.

    status: 'resolved' (validators agree), 'unvalidated' (they have none in common), 'changed' (they differ), 'orphan' (no
    earlier full response) or 'other_profile' (no not-modified revisit, as one by payload digest). Headers are the response's
    with the permitted ones of the revisit over them; for the last three they are the revisit's own. Only responses with a
    status of FULL are sources (all, if there is no http_status); a null profile is a not-modified one. Earlier is strictly less in time; of responses at one time the greatest record_id.
    block: length of a block in units of time (microseconds: a day). Null url or time: 'orphan'. Null headers: none. Repeated rows are records of their own. Empty table: no rows.
    """
    full = F.coalesce(F.col("http_status").isin(*FULL), F.lit(False)) if "http_status" in records.columns else F.lit(True)
    other = ~F.contains(F.coalesce("profile", F.lit(NOT_MODIFIED)), F.lit(NOT_MODIFIED)) if "profile" in records.columns else F.lit(False)
    r = records.select("record_id", canonical(F.col("url")).alias("url_key"), "time", F.coalesce("revisit", F.lit(False)).alias("revisit"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), full.alias("full"), other.alias("other"))
    known = F.col("url_key").isNotNull() & F.col("time").isNotNull()
    # Maps are not ordered types: only what is needed of them to choose takes part, and entries go along as an array.
    response = F.when(~F.col("revisit") & F.col("full"), F.struct("time", "record_id", F.map_entries("headers").alias("entries")))
    timed = r.where(known).withColumn("_block", F.floor(F.col("time") / block))
    last = timed.groupBy("url_key", "_block").agg(F.max(response).alias("_last"))
    earlier = W.partitionBy("url_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("url_key", "_block", F.max("_last").over(earlier).alias("_carried"))
    before = W.partitionBy("url_key", "_block").orderBy("time").rangeBetween(W.unboundedPreceding, -1)
    inside = timed.withColumn("_inside", F.max(response).over(before)).where("revisit")
    a = inside.join(carried, ["url_key", "_block"]).select(*r.columns, F.coalesce("_inside", "_carried").alias("source"))
    b = r.where(~known & F.col("revisit")).withColumn("source", F.lit(None).cast(a.schema["source"].dataType))
    a = a.unionByName(b).withColumn("old", F.map_from_entries("source.entries"))
    tag, old_tag = _tag(F.col("headers")["etag"]), _tag(F.col("old")["etag"])
    date, old_date = F.col("headers")["last-modified"], F.col("old")["last-modified"]
    status = (
        F.when(F.col("other"), "other_profile")
        .when(F.col("source").isNull(), "orphan")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "resolved").otherwise("changed"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    a = a.withColumn("status", status)
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stale = F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    merged = F.when(F.col("status").isin("resolved", "unvalidated"), F.map_concat(stale, fresh)).otherwise(F.col("headers"))
    return a.select("record_id", "url_key", F.when(F.col("status").isin("resolved", "unvalidated"), F.col("source.record_id")).alias("source_id"), "status", merged.alias("headers"))


_RECORD = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("time", pa.string()), ("revisit", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("http_status", pa.int32()), ("profile", pa.string())])
_START = re.compile(rb"(?:^|\n)(?=WARC/[0-9])")
_STATUS = re.compile(rb"HTTP/\S+[ \t]+([0-9]{3})(?![0-9])")


def parse_warc(raw: bytes) -> list[tuple]:
    """Response and revisit records of a WARC file (plain or gzip): record_id, url, time, revisit, headers, payload, http_status, profile.

    A cut last record is left out. So is a malformed one (no or a wrong length), and reading goes on at the next line that starts a record.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out, at = [], 0
    while raw.startswith(b"WARC/", at) or (start := _START.search(raw, max(0, at - 1))):
        at = at if raw.startswith(b"WARC/", at) else start.end()
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            break
        fields = _fields(raw[at:end])
        length = fields.get("content-length", "")
        n = int(length) if length.isascii() and length.isdigit() else len(raw)
        block, after = raw[end + 4 : end + 4 + n], end + 4 + n
        while raw.startswith(b"\r\n", after):
            after += 2
        if len(block) < n or after < len(raw) and after < end + 8 + n and not raw.startswith(b"WARC/", after):
            at += 5
            continue
        at = after
        kind = fields.get("warc-type")
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            url = fields.get("warc-target-uri", "").strip("<>")
            code = _STATUS.match(head)
            out.append((fields.get("warc-record-id"), url or None, fields.get("warc-date"), kind == "revisit", _fields(head), body if kind == "response" else None, int(code[1]) if code else None, fields.get("warc-profile")))
    return out


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark, path: str) -> DataFrame:
    """record_id, url, time (microseconds), revisit, headers, payload, http_status, profile of the WARC files below path."""

    def run(batches):
        for rb in batches:
            for raw in rb.column("content").to_pylist():
                rows = parse_warc(raw)
                for i in range(0, len(rows), 200):
                    cols = [list(c) for c in zip(*rows[i : i + 200])]
                    cols[4] = [list(h.items()) for h in cols[4]]
                    yield batch(_RECORD, cols)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    records = arrow_map(files, run, "record_id string, url string, time string, revisit boolean, headers map<string,string>, payload binary, http_status int, profile string")
    return records.withColumn("time", F.unix_micros(F.try_to_timestamp("time")))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records made of pages: page_id is the time, every other page is a not-modified answer; validators change every 500 pages of the id; numbers in the path count by their first digit, so that URLs recur."""
    url = F.regexp_replace("url", r"/([0-9])[0-9]*", "/$1")
    key = canonical(url)
    era = F.floor(F.col("page_id") / 500).cast("string")
    etag = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), F.substring(F.md5(F.concat(key, F.lit("/"), era)), 1, 8), F.lit('"'))
    headers = F.map_filter(
        F.create_map(
            F.lit("etag"), F.when(F.col("page_id") % 5 != 0, etag),
            F.lit("last-modified"), F.when(F.col("page_id") % 7 != 0, era),
            F.lit("date"), F.col("page_id").cast("string"),
            F.lit("content-length"), F.when(F.col("page_id") % 2 == 0, F.length("html").cast("string")).otherwise(F.lit("0")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return pages.select(F.col("page_id").cast("long").alias("record_id"), url.alias("url"), F.col("page_id").cast("long").alias("time"), (F.col("page_id") % 2 == 1).alias("revisit"), headers.alias("headers"))


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolved(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), block=1000)
    return out.select("record_id", "url_key", "source_id", "status", *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("etag", "last-modified", "date", "content-length")])


SQL = r"""
with u as (select page_id, html, regexp_replace(regexp_replace(trim(regexp_replace(url, '/([0-9])[0-9]*', '/\1', 'g')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
k as (
  select page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.[A-Za-z]+$', '/'), '/+$', '') as base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)'))), '&') as query from u
), c as (select page_id, html, case when query <> '' then base || '?' || query else base end as url_key, (page_id // 500)::varchar as era from k),
r as (
  select page_id as record_id, url_key, page_id % 2 = 1 as revisit,
    case when page_id % 5 <> 0 then (case when page_id % 3 = 0 then 'W/' else '' end) || '"' || substr(md5(url_key || '/' || era), 1, 8) || '"' end as etag,
    case when page_id % 7 <> 0 then era end as last_modified, page_id::varchar as date,
    case when page_id % 2 = 0 then length(html)::varchar else '0' end as content_length from c
), j as (
  select a.*, b.record_id as src, b.etag as b_etag, b.last_modified as b_lm, b.content_length as b_len
  from (select * from r where revisit) a asof left join (select * from r where not revisit) b on a.url_key = b.url_key and a.record_id > b.record_id
), s as (
  select *, case when src is null then 'orphan'
    when etag is not null and b_etag is not null then (case when regexp_replace(etag, '^W/', '') = regexp_replace(b_etag, '^W/', '') then 'resolved' else 'changed' end)
    when last_modified is not null and b_lm is not null then (case when last_modified = b_lm then 'resolved' else 'changed' end)
    else 'unvalidated' end as status from j
)
select record_id, url_key, case when status in ('resolved', 'unvalidated') then src end as source_id, status,
  case when status in ('resolved', 'unvalidated') then coalesce(etag, b_etag) else etag end as etag,
  case when status in ('resolved', 'unvalidated') then coalesce(last_modified, b_lm) else last_modified end as last_modified,
  date, case when status in ('resolved', 'unvalidated') then b_len else content_length end as content_length from s
"""
