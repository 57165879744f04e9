"""WARC derivatives: responses become linked metadata and plain-text conversion records.

``responses`` gives each page a response record (WARC 1.1): an HTTP head and the page. ``derivatives`` makes two
records of each response: a metadata record (title, language, links and sizes, as warc-fields) and a conversion
record (the page's text). Both name the response in WARC-Refers-To, keep its target URI, date and the source
headers, and carry digests of their own block; the response's payload digest is kept beside them. ``write_warc``
writes records as gzip WARC files, ``read_warc`` reads such files again.

Record identifiers are name-based: a digest of the record's kind, page_id and payload, so a rebuilt file is the
same. A null url becomes ``urn:page:<page_id>``; a null or empty html is an empty payload with an empty
text. Repeated rows give equal records; a null page_id is passed through and named ``null``. A page of any length
is one row. Only page_id, url and html are read. Records of any WARC version are read, in one gzip member each or
in one for all.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table

#: The date of records whose source has none (fixed value).
DATE = "1970-01-01T00:00:00Z"
#: Entities that are decoded in text (fixed values); &amp; comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
CRLF = "\r\n"
RECORD = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", "block"]


def _sha(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def _uuid(x: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    h = F.sha2(x.cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("8"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """One response record for each page, with its HTTP head and payload."""
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    df = pages.select("page_id", name.alias("name"), F.coalesce("url", F.concat(F.lit("urn:page:"), name)).alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    df = df.withColumns({"http_head": head, "payload_digest": _sha(F.col("payload"))})
    df = df.withColumn("record_id", _uuid(F.concat_ws("|", F.lit("response"), "name", "target_uri", "payload_digest")))
    block = F.concat("http_head", "payload")
    return df.withColumns({
        "record_type": F.lit("response"), "refers_to": F.lit(None).cast("string"), "warc_date": F.lit(DATE), "content_type": F.lit("application/http; msgtype=response"),
        "block": block, "block_digest": _sha(block), "content_length": F.octet_length(block).cast("bigint"),
    }).select(*RECORD, "http_head", "payload")


def plain_text(html: Column) -> Column:
    """The visible text: no scripts, styles or tags, a line for each block, entities decoded, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|head)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|body))\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r" *\n *", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, "\n+", "\n"), " +", " "), F.lit(" \n"))


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record (columns of ``responses``)."""
    first = lambda pattern: F.regexp_extract("payload", pattern, 1)
    records = records.withColumns({
        "text": plain_text(F.col("payload")), "title": first(r"(?is)<title[^>]*>(.*?)</title"), "language": first(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']([^\"'>]*)"),
    })
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    found = lambda name: F.when(F.col(name) != "", line(name, F.regexp_replace(name, r"[\r\n]+", " ")))
    links = F.regexp_extract_all("payload", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'>]*)"), 1)
    source = F.filter(F.split(F.regexp_replace("http_head", "\r", ""), "\n"), lambda x: x.contains(": "))
    fields = F.concat_ws(
        "",
        found("title"),
        found("language"),
        F.array_join(F.transform(source, lambda x: line("source-header", x)), ""),
        line("source-payload-digest", F.col("payload_digest")),
        line("source-payload-length", F.octet_length("payload").cast("string")),
        line("text-digest", _sha(F.col("text"))),
        F.array_join(F.transform(links, lambda x: line("outlink", F.regexp_replace(x, r"[\r\n]+", " "))), ""),
    )
    made = lambda kind, content_type, block: F.struct(F.lit(kind).alias("record_type"), F.lit(content_type).alias("content_type"), block.alias("block"))
    both = F.array(made("metadata", "application/warc-fields", fields), made("conversion", "text/plain; charset=utf-8", F.col("text")))
    # one pass over a page makes both of its records
    rows = records.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.explode(both).alias("made"))
    rows = rows.select("*", "made.*").withColumns({
        "record_id": _uuid(F.concat_ws("|", "record_type", "refers_to")), "block_digest": _sha(F.col("block")), "content_length": F.octet_length("block").cast("bigint"),
    })
    return rows.select(*RECORD)


def record_text() -> Column:
    """A record as it stands in a WARC file: version, headers, block, two line ends."""
    header = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.concat_ws("", *[header(n, c) for n, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))]),
        F.lit(CRLF),
        F.col("block"),
        F.lit(CRLF * 2),
    )


def _member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x.as_py(), mtime=0) for x in b.column(0)], pa.binary())], ["value"])


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip WARC files, one for each partition; each record is a gzip member, and an empty member divides two."""
    members = records.select(record_text().cast("binary").alias("value")).mapInArrow(_member, "value binary")
    # a binary column cast to text is written as it is; one byte is one character of ISO-8859-1
    divider = gzip.compress(b"", mtime=0).decode("iso-8859-1")
    members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", divider).text(path)


def _text(content: bytes) -> str | None:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"warc-type": 0, "warc-record-id": 1, "warc-refers-to": 2, "warc-target-uri": 3, "warc-date": 4, "content-type": 5, "warc-block-digest": 6, "warc-payload-digest": 7}
    schema = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest")] + [("content_length", pa.int64()), ("block", pa.string()), ("content", pa.binary())])
    for b in batches:
        for content in b.column(0):
            f = gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))
            rows: list[list] = []
            while line := f.readline():  # between records, blank lines
                if not line.startswith(b"WARC/"):
                    continue
                row: list = [None] * 11
                while (line := f.readline()) not in (b"\r\n", b""):
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    if name.lower() in names:
                        row[names[name.lower()]] = value.strip()
                    elif name.lower() == "content-length":
                        row[8] = int(value)
                row[10] = f.read(row[8] or 0)
                row[9] = _text(row[10])
                rows.append(row)
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip WARC files; each file is read by one task, member after member.

    ``content`` is a record's block as it stands, which its digest fits; ``block`` is its text, null where that isn't UTF-8.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length bigint, block string, content binary")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


_ID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>'"


def _sql_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<head\\b.*?</head\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x20\\x09-\\x0D]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|body))\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace({x}, ' *' || chr(10) || ' *', chr(10), 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, chr(10) || '+', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10))"


def _sql_field(name: str, value: str) -> str:
    return f"case when coalesce({value}, '') <> '' then '{name}: ' || regexp_replace({value}, '[\\r\\n]+', ' ', 'g') || n else '' end"


OP8_SQL = f"""
with p as (select page_id, coalesce(page_id::varchar, 'null') as name, coalesce(url, 'urn:page:' || coalesce(page_id::varchar, 'null')) as target_uri, coalesce(html, '') as payload, chr(13) || chr(10) as n from pages),
r0 as (select *, 'sha256:' || sha256(payload) as payload_digest, strlen(payload)::varchar as size, {_sql_text("payload")} as text from p),
r1 as (select *, sha256('response|' || name || '|' || target_uri || '|' || payload_digest) as h from r0),
r as (select * exclude (h), {_ID} as response_id from r1),
b as (
  select page_id, 'metadata' as record_type, response_id, target_uri, payload_digest, 'application/warc-fields' as content_type,
    {_sql_field("title", "regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)")} || {_sql_field("language", "regexp_extract(payload, '(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"'']([^\"''>]*)', 1)")}
    || 'source-header: Content-Type: text/html; charset=utf-8' || n || 'source-header: Content-Length: ' || size || n
    || 'source-payload-digest: ' || payload_digest || n || 'source-payload-length: ' || size || n || 'text-digest: sha256:' || sha256(text) || n
    || array_to_string(list_transform(regexp_extract_all(payload, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"''>]*)', 1), lambda x: 'outlink: ' || regexp_replace(x, '[\\r\\n]+', ' ', 'g') || n), '') as block
  from r
  union all
  select page_id, 'conversion', response_id, target_uri, payload_digest, 'text/plain; charset=utf-8', text from r),
d as (select *, sha256(record_type || '|' || response_id) as h from b)
select page_id, record_type, {_ID} as record_id, response_id as refers_to, target_uri, '{DATE}' as warc_date, content_type,
  'sha256:' || sha256(block) as block_digest, payload_digest, strlen(block)::bigint as content_length, block
from d
"""
