"""WARC derivatives: each response becomes a linked metadata record and a plain-text conversion record.

Responses come as rows (record id, target, date, HTTP header block, body). Derived records keep what ties them to their
source: WARC-Refers-To names the response's record, WARC-Target-URI and WARC-Date repeat its own, the metadata record
lists its HTTP headers and digests, and every record has its block's digest and length. Record ids are name-based, so
that a run on the same responses gives the same records, whichever executor makes them. Control characters and blanks of
a target are percent-encoded and those of other header values removed, so that no value can add a header line.
write_records writes the records into WARC files, one for each task, and returns where each record lies.

Defined cases: a null body is empty, and so is its text; a null url is the empty target, which is left out of the record;
a null header block is empty; very long bodies are converted whole; repeated rows give repeated records, with one id,
since they are one record; an empty table gives no records; other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tramline.llm.common import stored, table
from tramline.llm.wrappers import INLINE

#: The day that tables without a crawl date are taken to be fetched.
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n"
# A no-break space becomes a blank.
BLANK = re.compile(r"&(?:nbsp|#0*160|#[xX]0*[aA]0)(?:;|(?![0-9A-Za-z;]))")
#: Tags that are no break of a line; br is one.
INSIDE = "|".join(sorted(INLINE - {"br"}))


def uuid_of(name: Column) -> Column:
    """A record id from the digest of a name."""
    h = F.sha2(name, 256)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def safe_target(url: Column) -> Column:
    """url with each control character or blank as %XX."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(coded, "")).otherwise(url)


def safe_value(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]+", "")


def responses(pages: DataFrame) -> DataFrame:
    """Responses from page_id, url and html, with the headers that a server would have sent."""
    body = F.coalesce("html", F.lit(""))
    before, after = HTTP.split("{}")
    return pages.select(
        F.col("page_id").alias("source_id"),
        uuid_of(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(body.cast("binary"), 256))).alias("record_id"),
        safe_target(F.coalesce("url", F.lit(""))).alias("target"),
        F.lit(DATE).alias("date"),
        F.concat(F.lit(before), F.octet_length(body).cast("string"), F.lit(after)).alias("headers"),
        body.alias("body"),
    )


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """All named and numeric character references decoded, once."""
    return text.map(lambda t: markup.unescape(BLANK.sub(" ", t)) if t and "&" in t else t)


#: Put behind a page, so that no tag lacks its end and every pattern below passes a page once.
LAST = "\x01>"


def plain_text(html: Column) -> Column:
    """Text of html: comments, scripts, styles and tags go, references are decoded, every tag but the inline ones is a break.

    As browsers do, a tag that the page ends in is dropped, and a < that begins no tag is text.
    """
    text = F.regexp_replace(F.concat(html, F.lit(LAST)), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    text = F.regexp_replace(text, r"[ \t\r\n\f\v]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?!(?:{INSIDE})[\s/>])[a-z][^>]*>", "\n")
    text = F.regexp_replace(text, r"(?i)<(?:/?[a-z]|[!?/])[^>]*>", "")
    text = decoded(F.when(F.endswith(text, F.lit(LAST)), F.left(text, F.length(text) - len(LAST))).otherwise(text))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def _record(kind: str, content_type: str) -> Column:
    """The bytes of a record: header lines, an empty line, the block and two line ends."""
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Date: "), F.col("date"),
        F.when(F.col("target") != "", F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("target"))).otherwise(""),
        F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"),
        F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*lines).cast("binary")


def derive(found: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` and ``conversion``, with their bytes in ``record``."""
    payload = digest(F.col("body"))
    block = F.concat("headers", F.lit("\r\n"), "body")
    about = F.concat(
        F.lit("source-record: "), F.col("record_id"), F.lit("\r\nsource-block-digest: "), digest(block), F.lit("\r\nsource-payload-digest: "), payload,
        F.lit("\r\nsource-payload-length: "), F.octet_length("body").cast("string"), F.lit("\r\n"),
        F.regexp_replace(F.regexp_replace("headers", r"(?m)^(?=[^\r\n])", "source-http: "), r"\r\n$", ""), F.lit("\r\n"),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("body")).alias("block")),
    )
    own = found.withColumns({"record_id": safe_value(F.col("record_id")), "target": safe_target(F.col("target")), "date": safe_value(F.col("date"))})
    each = own.select("source_id", F.col("record_id").alias("refers_to"), "target", "date", F.explode(both).alias("d")).select(
        "source_id", "refers_to", "target", "date", "d.type", "d.content_type", "d.block",
        uuid_of(F.concat_ws("|", "d.type", F.col("refers_to"))).alias("record_id"), digest(F.col("d.block")).alias("block_digest"),
        F.octet_length("d.block").cast("long").alias("content_length"),
    )
    record = F.when(F.col("type") == "metadata", _record("metadata", "application/warc-fields")).otherwise(_record("conversion", "text/plain; charset=utf-8"))
    return each.withColumn("record", record)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed file, for readers and tests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers: dict[str, str] = {}
        for line in lines:
            name, value = line.split(": ", 1)
            if name in headers:
                raise ValueError(f"{name} stands twice in the record at {at}")
            headers[name] = value
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"derived-{task.partitionId():06d}.warc"
        files, root = fs.FileSystem.from_uri(folder)
        own, out, at = f"{root}/{name}.{task.taskAttemptId()}", None, 0
        for batch in batches:
            rows = []
            for record_id, record in zip(batch["record_id"], batch["record"], strict=True):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(own)
                out.write(record)
                rows.append((record_id, f"{folder}/{name}", at, len(record)))
                at += len(record)
            yield pd.DataFrame(rows, columns=["record_id", "file", "offset", "length"])
        if out is not None:
            out.close()
            files.move(own, f"{root}/{name}")

    return run


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Write records (record_id, record) into WARC files of a folder that all executors reach; record_id, file, offset and length.

    A file is written under the name of the task's attempt and then renamed, so an attempt that died leaves no file.
    """
    return stored(records.select("record_id", "record").mapInPandas(_write(folder), "record_id string, file string, offset long, length long"), "warc-index")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(responses(table(spark, sf_dir, "pages")))
    return found.select(
        F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", F.col("target").alias("target_uri"), "content_type", "content_length",
        "block_digest", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"),
    )
