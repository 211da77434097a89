"""Not-modified revisit records of web archives: reading, and resolution to the response they stand for.

A revisit is resolved by an as-of join: the latest full response of the same
canonical URL that was captured earlier.  Validators are checked (entity tag,
else last-modified, else payload digest); the response's stored headers are then
updated with those of the revisit that a 304 may change.

The join is a distributed scan over rows in (URL, time) order.  Rows are dealt
by ranges of (URL, time, id), so one URL with a third of all captures spreads
over many tasks; each task carries the last response along, and the little that
crosses a border (one response a task) is joined afterwards.

Defined cases.  Captures of equal time are ordered by record id; repeated rows
give equal results.  Null URL: a URL of its own, never resolved.  Null time
counts as the earliest, null id as the smallest, null headers as none.  Kinds
other than 'response' and 'revisit' are kept and not looked at.  Empty table: no
rows.  Extra columns stay; a column with the name of a result is replaced.
"""

from __future__ import annotations

import zlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import parts, stored

#: Fixed values (HTTP caching, RFC 9111 section 3.2, and hop-by-hop fields): a 304 may not change these.
KEPT_HEADERS = "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade".split()

_BASE = "struct<id: long, etag: string, last_modified: string, digest: string, headers: map<string, string>>"
_RESULTS = ("canonical_url", "status", "base_id", "validator", "merged_headers")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slash, parameters sorted, no scheme, fragment or campaign parameters."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "[?](.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host == "", u).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _plain(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _carried(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in order, with the last response of the same URL before each, and whether one may lie in an earlier task."""
    part, first, url, last, place = TaskContext.get().partitionId(), True, None, None, 0
    for batch in rows:
        base, open_, ends = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("url", "kind", "id", "etag", "last_modified", "digest", "headers")]
        for u, kind, i, etag, modified, digest, headers in zip(*columns, strict=True):
            if place and u != url:
                first = False
            if not place or u != url:
                url, last = u, None
            place += 1
            base.append(last if kind == "revisit" and u is not None else None)
            open_.append(first and last is None and kind == "revisit" and u is not None)
            if kind == "response":
                last = {"id": i, "etag": etag, "last_modified": modified, "digest": digest, "headers": headers}
            ends.append(last)
        struct = pa.struct([("id", pa.int64()), ("etag", pa.string()), ("last_modified", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place - n, place), pa.int64()), pa.array(base, struct), pa.array(open_, pa.bool_()), pa.array([None] * (n - 1) + [ends[-1]], struct) if n else pa.array([], struct)],
            names=[*batch.schema.names, "part", "place", "base", "open", "end"],
        )


def resolve(records: DataFrame) -> DataFrame:
    """The records with canonical_url, status, base_id, validator and merged_headers.

    Records have record_id (long), url, captured_at (any type that sorts), kind,
    etag, last_modified, digest (strings) and headers (map of strings, names in
    lower case).  Status: 'response', 'resolved', 'validator_mismatch',
    'no_validator', 'no_earlier_response', or 'other'.
    """
    names = [c for c in records.columns if c not in _RESULTS]
    lean = records.select(
        F.col("record_id").cast("long").alias("id"),
        canonical_url(F.col("url")).alias("url"),
        F.col("captured_at").alias("at"),
        *[F.col(c) for c in ("kind", "etag", "last_modified", "digest")],
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
    )
    lean = stored(lean, "captures")
    n = parts(lean, 8 << 20, least=16)
    order = ["url", "at", "id"]
    ordered = lean.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields)
    scanned = stored(ordered.mapInArrow(_carried, f"{schema}, part int, place long, base {_BASE}, open boolean, end {_BASE}"), "scanned")

    # what crosses a border: for the first URL of a task, the last response of the nearest earlier task that ends with that URL; a row a task
    borders = scanned.groupBy("part").agg(F.min_by("url", "place").alias("first"), F.max("place").alias("rows"))
    ends = scanned.join(F.broadcast(borders.select("part", F.col("rows").alias("place"))), ["part", "place"], "left_semi").select("part", F.col("url").alias("last"), F.col("end").alias("response"))
    crossing = borders.select("part", "first").join(F.broadcast(ends.select(F.col("part").alias("p"), "last", "response").where("response is not null")), (F.col("p") < F.col("part")) & (F.col("last") == F.col("first")))
    carry = crossing.groupBy("part").agg(F.max_by("response", "p").alias("carry"))
    joined = scanned.join(F.broadcast(carry), "part", "left")

    base = F.when(F.col("open"), F.col("carry")).otherwise(F.col("base"))
    rows = joined.withColumn("b", base)
    comparable = F.when(F.col("etag").isNotNull() & F.col("b.etag").isNotNull(), F.lit("etag"))
    comparable = comparable.when(F.col("last_modified").isNotNull() & F.col("b.last_modified").isNotNull(), F.lit("last_modified"))
    comparable = comparable.when(F.col("digest").isNotNull() & F.col("b.digest").isNotNull(), F.lit("digest"))
    rows = rows.withColumn("v", comparable)
    same = F.when(F.col("v") == "etag", _plain(F.col("etag")) == _plain(F.col("b.etag"))).when(F.col("v") == "last_modified", F.col("last_modified") == F.col("b.last_modified")).otherwise(F.col("digest") == F.col("b.digest"))
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), "other")
        .when(F.col("b").isNull(), "no_earlier_response")
        .when(F.col("v").isNull(), "no_validator")
        .when(same, "resolved")
        .otherwise("validator_mismatch")
    )
    rows = rows.withColumn("s", status)
    update = F.map_filter("headers", lambda k, _: ~k.isin(KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("b.headers", lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return rows.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        F.col("url").alias("canonical_url"),
        F.col("s").alias("status"),
        F.when(F.col("s") == "response", F.col("id")).when(F.col("s") == "resolved", F.col("b.id")).alias("base_id"),
        F.when(F.col("kind") == "revisit", F.col("v")).alias("validator"),
        F.when(F.col("s") == "resolved", merged).otherwise(F.col("headers")).alias("merged_headers"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved records joined with what payloads (record_id, payload) has for the response they stand for."""
    return resolved.join(payloads.select(F.col("record_id").alias("base_id"), "payload"), "base_id", "left")


def header_text(headers: Column) -> Column:
    """Headers as sorted 'name: value' lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def _inflated(raw: bytes) -> bytes:
    """All gzip members up to the first that is broken or cut, of which what can be read."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(raw))
        except zlib.error:
            break
        raw = member.unused_data
    return b"".join(out)


def parse_warc(raw: bytes) -> Iterator[dict]:
    """Records of one file, plain or gzip (all members): type, url, date, digest, HTTP headers and payload.  Stops at broken data; a record cut short is left out."""
    raw = _inflated(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while (m := _HEAD.search(raw, at)) is not None:
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in m.group(1).decode("utf-8", "replace").split("\r\n"))}
        try:
            size = int(fields.get("content-length", "0"))
        except ValueError:
            return
        if size < 0 or m.end() + size > len(raw):
            return
        body, at = raw[m.end() : m.end() + size], m.end() + size
        head, _, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        headers = {k.strip().lower(): v.strip() for k, s, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:]) if s}
        yield {"kind": fields.get("warc-type"), "warc_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "captured_at": fields.get("warc-date"), "digest": fields.get("warc-payload-digest"), "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "headers": headers, "payload": payload}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below a path; record_id is a hash of the record's own id, or of the file and the record's place in it.

    A task reads one file whole, as a compressed file can't be split.
    """
    schema = "kind string, warc_id string, url string, captured_at string, digest string, etag string, last_modified string, headers map<string,string>, payload binary, own string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in rows:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [r | {"own": r["warc_id"] or f"{path}#{i}"} for i, r in enumerate(parse_warc(raw))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], types.get(c, pa.string())) for c in names], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema).withColumn("record_id", F.xxhash64("own")).drop("own")


SECTION = "^([A-Za-z]+://[^/?#]*/[^/?#]*).*$"


def capture_log(pages: DataFrame) -> DataFrame:
    """The pages table as a log of captures of each page's section (host and first folder of its URL).

    Every third page is a revisit; validators and headers follow from the row.
    """
    pages = pages.withColumn("url", F.regexp_replace("url", SECTION, "$1"))
    canon = canonical_url(F.col("url"))
    revisit = F.col("page_id") % 3 == 2
    at = F.col("page_id") * 60
    etag = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.coalesce(canon, F.lit("")), F.lit("-"), (F.floor(F.col("page_id") / 400) % 2).cast("string"))), 1, 8), F.lit('"')))
    modified = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("day "), F.floor(F.col("page_id") / 1000).cast("string")))
    digest = F.md5(F.coalesce("html", F.lit("")))
    own = F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 5).cast("string")), F.lit("date"), at.cast("string"))
    extra = F.when(revisit, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close"), F.lit("x-cache"), F.lit("hit"))).otherwise(
        F.create_map(F.lit("content-length"), F.length("html").cast("string"), F.lit("content-type"), F.lit("text/html"))
    )
    return pages.select(F.col("page_id").alias("record_id"), "url", at.alias("captured_at"), F.when(revisit, "revisit").otherwise("response").alias("kind"), etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), F.map_concat(own, extra).alias("headers"))


ORACLE = """
with c as (
  select page_id, page_id * 60 as ts, page_id % 3 = 2 as revisit, html,
    regexp_replace(trim(regexp_replace(url, '^([A-Za-z]+://[^/?#]*/[^/?#]*).*$', '\\1')), '#.*$', '') as u from pages
), h as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*[.]', '') as host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))), '&') as query
  from c
), r as (
  select page_id, ts, revisit, case when host = '' then u else host || path || case when query <> '' then '?' || query else '' end end as canon, md5(coalesce(html, '')) as digest, length(html) as size from h
), v as (
  select *, case when page_id % 7 <> 0 then '"' || substr(md5(coalesce(canon, '') || '-' || cast((page_id // 400) % 2 as varchar)), 1, 8) || '"' end as etag,
    case when page_id % 5 <> 0 then 'day ' || cast(page_id // 1000 as varchar) end as modified from r
), j as (
  select v.*, b.page_id as b_id, b.etag as b_etag, b.modified as b_modified, b.digest as b_digest, b.size as b_size
  from v left join (select *, lead(page_id) over (partition by canon order by page_id) as upto from v where not revisit) b
    on v.revisit and b.canon = v.canon and b.page_id < v.page_id and (b.upto is null or b.upto > v.page_id)
), s as (
  select *, case when not revisit or b_id is null then null when etag is not null and b_etag is not null then 'etag' when modified is not null and b_modified is not null then 'last_modified' else 'digest' end as validator from j
), t as (
  select *, case when not revisit then 'response' when b_id is null then 'no_earlier_response'
    when (validator = 'etag' and etag = b_etag) or (validator = 'last_modified' and modified = b_modified) or (validator = 'digest' and digest = b_digest) then 'resolved' else 'validator_mismatch' end as status from s
)
select page_id as record_id, canon as canonical_url, status, case status when 'response' then page_id when 'resolved' then b_id end as base_id, validator,
  case status when 'resolved' then 'cache-control: max-age=' || (page_id % 5) || chr(10) || 'content-length: ' || b_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'x-cache: hit'
  when 'response' then 'cache-control: max-age=' || (page_id % 5) || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts
  else 'cache-control: max-age=' || (page_id % 5) || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'x-cache: hit' end as headers
from t
"""
