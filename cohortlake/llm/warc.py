"""Operator 10, WARC: resolution of not-modified revisits.

A crawler that asks again for a page it has may get "304 Not Modified"; the
archive then keeps a ``revisit`` record with headers and no body.  Each
revisit is joined, as of its date, to the latest earlier full response for
the same canonical URL: one of status 200 (or whose status line is missing)
that isn't truncated.  Validators must agree: entity tags (compared
weakly), last-modified dates and payload digests, each where both records
have it, and at least one must be on both.  A 304 may update only some
headers of the stored response; these are merged.

The as-of join is a union and a window in two steps.  Records of a URL are
cut into time blocks by approximate quantiles of the date (equal dates stay
together), each of bounded size; a window within (URL, block)
finds the latest response there, and one over the blocks' last responses
carries it into later blocks.  One URL with a third of all records is
thus worked on by many tasks.  Bodies take no part in sorting: they are
reduced to digest and length before.

Defined cases: records without URL or date can't be joined (``no_response``
for a revisit) and are spread over the tasks; a null header block has no headers; of records with equal
date the smaller id is the earlier one; repeated rows are resolved each;
other columns are ignored; an empty table gives no rows; long bodies are
digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Headers that a 304 response may update in a stored one.
MERGED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Records in one time block of a URL, about.
BLOCK_ROWS = 20_000

# Query parameters that name a referrer or campaign, no content.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path, and sorted query without tracking parameters; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    place = F.regexp_extract(rest, r"^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i:{'|'.join(TRACKING)})(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def header_pairs(block: Column) -> Column:
    """Header lines as (name in lower case, value); lines without a colon don't count."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def with_headers(df: DataFrame, blocks: dict[str, str]) -> DataFrame:
    """Maps of header blocks (new column: block column); of a repeated name the first counts.

    Pairs and names are columns of their own, so each is made once for a row.
    """
    df = df.withColumns({f"__pairs_{k}": header_pairs(F.col(c)) for k, c in blocks.items()})
    df = df.withColumns({f"__names_{k}": F.transform(f"__pairs_{k}", lambda p: p["name"]) for k in blocks})

    def first(k: str) -> Column:
        names = F.col(f"__names_{k}")
        return F.map_from_entries(F.filter(f"__pairs_{k}", lambda p, i: F.array_position(names, p["name"]) == i + 1))

    return df.withColumns({k: first(k) for k in blocks}).drop(*[f"__{x}_{k}" for x in ("pairs", "names") for k in blocks])


def status_code(block: Column) -> Column:
    """The code of a header block's status line; null without one."""
    return F.nullif(F.regexp_extract(F.substring(block, 1, 64), r"^\s*HTTP/\S+[ \t]+(\d+)", 1), F.lit(""))


def parse_records(raw: DataFrame, id_col: str = "record_id", head_col: str = "head", http_col: str = "http", body_col: str = "body") -> DataFrame:
    """WARC header block, HTTP header block and body of each record to the columns that are resolved here."""
    blocks = raw.select(F.col(id_col).cast("long").alias("record_id"), F.col(head_col).alias("__b0"), F.col(http_col).alias("__b1"), status_code(F.col(http_col)).alias("__code"), F.octet_length(F.col(body_col).cast("string")).cast("long").alias("length"))
    head, is_ok = F.col("__head"), F.coalesce(F.col("__code") == "200", F.lit(True))
    return with_headers(blocks, {"__head": "__b0", "headers": "__b1"}) \
        .select("record_id", head["warc-type"].alias("type"), head["warc-target-uri"].alias("url"), F.try_to_timestamp(head["warc-date"]).alias("date"),
                head["warc-payload-digest"].alias("digest"), "headers", "length", (is_ok & head["warc-truncated"].isNull()).alias("full"))


def _entity_tag(h: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(h["etag"]), "^W/", "")


def with_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` (canonical, micros) with ``block``, the time block within a URL of many records, else null; and whether there is such a URL."""
    timed = rows.where("micros is not null").select("canonical", "micros")
    large = cut(timed.groupBy("canonical").agg(F.count("*").alias("n")).where(F.col("n") > block_rows))
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return rows.withColumn("block", F.lit(None).cast("int")), False
    parts = -(-most // block_rows)
    splits = timed.join(large.select("canonical"), "canonical").groupBy("canonical").agg(F.percentile_approx("micros", [i / parts for i in range(1, parts)], 100 * parts).alias("splits"))
    block = F.when(F.col("micros").isNotNull() & F.col("splits").isNotNull(), F.size(F.filter("splits", lambda x: x < F.col("micros"))))
    return rows.join(splits, "canonical", "left").withColumn("block", block).drop("splits"), True


def resolve_revisits(records: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every record, with what it resolves to.

    ``records``: record_id, type ("response", "revisit"), url, date, digest, headers, length, full (whether a response is whole and of status 200).
    Adds canonical, refers_to (the response), status ("response", "resolved", "no_response",
    "no_validator", "mismatch"; null for other types), resolved_digest, resolved_length and
    merged_headers (own headers of a response, null where a revisit isn't resolved).
    """
    rows = records.select("record_id", "type", "date", "digest", "headers", "length", "full", canonical_url(F.col("url")).alias("canonical"))
    rows = rows.withColumn("micros", F.when(F.col("canonical").isNotNull(), F.unix_micros("date")))
    response = F.when((F.col("type") == "response") & F.col("full") & F.col("micros").isNotNull(), F.struct(F.col("record_id").alias("id"), "digest", "headers", "length"))
    blocked, large = with_blocks(rows, block_rows)
    # rows that can't be joined aren't gathered in one window
    blocked = blocked.withColumn("response", response).withColumn("apart", F.when(F.col("micros").isNull(), F.xxhash64("record_id", "digest", "length")))
    # in a block, then carried from block to block
    before = Window.partitionBy("canonical", "block", "apart").orderBy(F.col("micros").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.withColumn("here", F.last("response", ignorenulls=True).over(before))
    latest = F.col("here")
    if large:
        earlier = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocked.where("block is not null").groupBy("canonical", "block").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("micros", "record_id"))).alias("last")) \
            .select("canonical", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
        joined, latest = joined.join(carried, ["canonical", "block"], "left"), F.coalesce("here", "carried")
    joined = joined.withColumn("found", F.when((F.col("type") == "revisit") & F.col("micros").isNotNull(), latest))
    pairs = [(_entity_tag(F.col("headers")), _entity_tag(F.col("found.headers"))), (F.col("headers")["last-modified"], F.col("found.headers")["last-modified"]), (F.col("digest"), F.col("found.digest"))]
    differ, agree = F.lit(False), F.lit(False)
    for own, other in pairs:
        differ = differ | F.coalesce(own != other, F.lit(False))
        agree = agree | F.coalesce(own == other, F.lit(False))
    status = F.when(F.col("type") == "response", "response").when(F.col("type") == "revisit", F.when(F.col("found").isNull(), "no_response").when(differ, "mismatch").when(agree, "resolved").otherwise("no_validator"))
    judged = joined.withColumn("status", status)
    update = F.map_filter("headers", lambda k, _: k.isin(*MERGED_HEADERS))
    kept = F.map_filter("found.headers", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(update), k), F.lit(False)))
    resolved, own = F.col("status") == "resolved", F.col("status") == "response"
    return judged.select("record_id", "type", "canonical", "status", F.when(F.col("type") == "revisit", F.col("found.id")).alias("refers_to"),
                         F.when(resolved, F.col("found.digest")).when(own, F.col("digest")).alias("resolved_digest"),
                         F.when(resolved, F.col("found.length")).when(own, F.col("length")).alias("resolved_length"),
                         F.when(resolved, F.map_concat(kept, update)).when(own, F.col("headers")).alias("merged_headers"))


def header_lines(h: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(h), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two archive records of each page row, as header blocks: its capture, and a later or earlier answer 304 that refers to it.

    The 304 asks for a variant of the URL, with the page's entity tag, after a delay that differs from page to page and may be negative.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("md5", F.md5("html"))
    date = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    lines = lambda *x: F.concat_ws("\r\n", *x)
    taken = F.col("page_id") * 60 + 1_704_067_200
    asked = taken + F.pmod(F.col("page_id") * 7919, F.lit(2_000_003)) - 200_000
    capture = F.struct((F.col("page_id") * 2).alias("record_id"),
                       lines(F.lit("WARC-Type: response"), line("WARC-Target-URI", F.col("url")), line("WARC-Date", date(taken)), line("WARC-Payload-Digest", F.concat(F.lit("md5:"), "md5"))).alias("head"),
                       lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html"), line("ETag", F.concat(F.lit('"'), "md5", F.lit('"'))), line("Content-Length", F.octet_length("html").cast("string")),
                             line("Date", date(taken)), F.lit("Cache-Control: max-age=60")).alias("http"), F.col("html").alias("body"))
    answer = F.struct((F.col("page_id") * 2 + 1).alias("record_id"),
                      lines(F.lit("WARC-Type: revisit"), line("WARC-Target-URI", F.concat("url", F.lit("#again"))), line("WARC-Date", date(asked))).alias("head"),
                      lines(F.lit("HTTP/1.1 304 Not Modified"), line("ETag", F.concat(F.lit('W/"'), "md5", F.lit('"'))), line("Date", date(asked)), F.lit("Cache-Control: max-age=120"), F.lit("Content-Length: 0")).alias("http"),
                      F.lit("").alias("body"))
    return p.select(F.explode(F.array(capture, answer)).alias("r")).select("r.*")


_CANONICAL = r"""regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '')
  || CASE WHEN len(query) > 0 THEN '?' || array_to_string(list_sort(query), '&') ELSE '' END"""

#: The query over ``pages`` in SQL, from the same derived captures.
ORACLE = rf"""
WITH p AS (SELECT CAST(page_id AS BIGINT) page_id, coalesce(html, '') html, md5(coalesce(html, '')) m, regexp_replace(regexp_replace(trim(url, ' '), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') rest FROM pages),
u AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) place,
  list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?i:{'|'.join(TRACKING)})(=|$)')) query FROM p),
c AS (SELECT *, {_CANONICAL} canonical, page_id * 60 + 1704067200 taken, page_id * 60 + 1704067200 + (page_id * 7919) % 2000003 - 200000 asked FROM u),
r AS (SELECT c.page_id, max_by(o.page_id, (o.taken, o.page_id)) ref FROM c JOIN c o ON c.canonical = o.canonical AND (o.taken < c.asked OR (o.taken = c.asked AND 2 * o.page_id < 2 * c.page_id + 1)) GROUP BY c.page_id),
j AS (SELECT c.*, o.page_id ref, o.m om, octet_length(encode(o.html)) olen FROM c LEFT JOIN r ON c.page_id = r.page_id LEFT JOIN c o ON o.page_id = r.ref),
s AS (SELECT *, CASE WHEN ref IS NULL THEN 'no_response' WHEN om = m THEN 'resolved' ELSE 'mismatch' END status FROM j),
t AS (SELECT *, strftime(make_timestamp(taken * 1000000), '%Y-%m-%dT%H:%M:%SZ') td, strftime(make_timestamp(asked * 1000000), '%Y-%m-%dT%H:%M:%SZ') ad FROM s)
SELECT 2 * page_id record_id, 'response' AS type, canonical, 'response' AS status, CAST(NULL AS BIGINT) refers_to, 'md5:' || m resolved_digest, CAST(octet_length(encode(html)) AS BIGINT) resolved_length,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || octet_length(encode(html)) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || td || chr(10) || 'etag: "' || m || '"' merged FROM t
UNION ALL
SELECT 2 * page_id + 1, 'revisit', canonical, status, 2 * ref, CASE WHEN status = 'resolved' THEN 'md5:' || om END, CASE WHEN status = 'resolved' THEN CAST(olen AS BIGINT) END,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || olen || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ad || chr(10) || 'etag: W/"' || m || '"' END FROM t
"""
