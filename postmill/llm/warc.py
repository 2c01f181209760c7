"""WARC archives: writing captures and assembling them again.

Every capture becomes three records: a request, the response (or a revisit of
an earlier payload) and metadata. The request's id ties them together: the
other two name it in ``WARC-Concurrent-To``. Reading takes any direction of
these links: it parses the archives record by record, joins the records that
are linked, in a file and across files, and returns one nested row per capture.

Archives are gzip files of plain WARC/1.1 text, written by Spark's text
writer and read by its binary reader, so any store that Spark reaches will do.
Files of many gzip members, one for each record, are read as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import let_workers_import
from postmill.operators.graph import connected_components
from postmill.session import fresh_path, materialise

#: Captures in one archive file, at most.
FILE_CAPTURES = 2000
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, kind string, root string, abroad array<string>, target string, refers_to string, page_id long, digest string, http_length long, payload_bytes long, payload_sha1 string"
HTTP_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of a text's bytes in upper-case base32: each five hexadecimal digits are four of base 32."""
    digits = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def lines(*parts: Column) -> Column:
    return F.concat(*[x for p in parts for x in (p, F.lit(EOL))])


def header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def record(kind: Column | str, rid: Column, block: Column, media: str, *extra: Column) -> Column:
    """One record as text, its two closing line ends left to the writer."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    heads = [
        F.lit("WARC/1.1"), header("WARC-Type", kind), header("WARC-Record-ID", rid), F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.lit(f"Content-Type: {media}"), header("Content-Length", F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the headers that are null.
    return F.concat(F.concat_ws(EOL, *heads, *extra), F.lit(EOL + EOL), block)


def urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write captures of ``pages`` (page_id, url, html, ...) to ``path``.

    Of pages with equal payloads of at least ``revisit_from`` bytes the one
    with the largest page_id is the response and the others revisit it. The
    largest id per digest is combined on the map side; the join back to the
    pages is one that Spark splits where a payload is very frequent. A null
    html is empty, a null url is absent; of equal rows with the largest id
    all are responses; other columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    body = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), html.alias("html"), base32_sha1(html).alias("digest"))
    owners = (
        pages.select("page_id", html.alias("html")).where(F.octet_length("html") >= revisit_from)
        .select("page_id", base32_sha1(F.col("html")).alias("owned")).groupBy("owned").agg(F.max("page_id").alias("owner"))
    )
    joined = body.join(owners, body["digest"] == owners["owned"], "left")
    revisit = F.col("owner").isNotNull() & ((F.col("page_id") < F.col("owner")) | F.col("page_id").isNull()) & (F.octet_length("html") >= revisit_from)
    rows = joined.withColumn("revisit", revisit).withColumn("row", F.monotonically_increasing_id())
    request = urn(F.lit("request"), F.col("row"), F.col("page_id"), F.col("digest"))
    own = urn(F.lit("response"), F.col("page_id"), F.col("digest"))
    response = F.when(F.col("revisit"), urn(F.lit("revisit"), F.col("row"), F.col("page_id"), F.col("digest"))).otherwise(own)
    target = header("WARC-Target-URI", F.col("url"))
    together = header("WARC-Concurrent-To", request)
    digest = header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), header("Content-Length", F.octet_length("html").cast("string")), F.lit(""))
    refers = F.when(F.col("revisit"), header("WARC-Refers-To", urn(F.lit("response"), F.col("owner"), F.col("digest"))))
    records = F.array(
        record("request", request, lines(F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1")), F.lit("")), "application/http;msgtype=request", target),
        record(
            F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), response,
            F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))),
            "application/http;msgtype=response", target, together, digest, refers, F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        ),
        record(
            "metadata", urn(F.lit("metadata"), F.col("row"), F.col("page_id"), F.col("digest")),
            F.coalesce(header("page-id", F.col("page_id").cast("string")), F.lit("")),
            "application/warc-fields", target, together,
        ),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive.

    Repeated ``WARC-Concurrent-To`` headers are one, with spaces between the ids.
    """
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "surrogatepass").split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        heads: dict[str, str] = {}
        for line in rest:
            name, value = line.split(":", 1)
            name, value = name.strip().lower(), value.strip()
            heads[name] = f"{heads[name]} {value}" if name == "warc-concurrent-to" and name in heads else value
        size = int(heads["content-length"])
        yield heads, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def roots(links: list[tuple[str, list[str]]]) -> list[str]:
    """An id for each record (its id, the ids it names) that all linked records share.

    It is a named id, if there is one, and that of a record that names none.
    """
    named = {n for _, names in links for n in names}
    parent = {n: n for n in named}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # A record that nothing names is linked by its own names only: equal ids of such records don't tie them.
    groups = [names + [rid] * (rid in named) for rid, names in links]
    naming = {rid for rid, names in links if names}
    for group in groups:
        for other in group[1:]:
            a, b = sorted((find(group[0]), find(other)), key=lambda x: (x in naming, x))
            parent[b] = a
    return [find(group[0]) if group else rid for group, (rid, _) in zip(groups, links, strict=True)]


def parse_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    known = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    kinds = [known[c.split()[1]] for c in RECORD_SCHEMA.split(", ")]

    def rows(data: bytes) -> Iterator[list]:
        for heads, block in parse_records(data):
            kind = heads["warc-type"]
            if kind == "warcinfo":
                continue
            row = dict.fromkeys(names)
            row |= {"record_id": heads["warc-record-id"], "kind": kind, "abroad": heads.get("warc-concurrent-to", "").split(), "target": heads.get("warc-target-uri")}
            row |= {"refers_to": heads.get("warc-refers-to"), "digest": heads.get("warc-payload-digest", "").removeprefix("sha1:") or None}
            if kind == "metadata":
                fields = dict((line + ": ").split(": ", 1) for line in block.decode("utf-8", "replace").split(EOL))
                fields = {k: v.removesuffix(": ") for k, v in fields.items()}
                row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
            elif kind in ("response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                found = HTTP_LENGTH.search(head)
                row["http_length"] = int(found[1]) if found else None
                row["payload_bytes"] = len(body)
                row["payload_sha1"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
            yield [row[n] for n in names]

    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            data = gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data
            part = list(rows(data))
            rid, root, abroad = (names.index(n) for n in ("record_id", "root", "abroad"))
            here = {row[rid] for row in part}
            for row, found in zip(part, roots([(row[rid], row[abroad]) for row in part]), strict=True):
                row[root], row[abroad] = found, [n for n in row[abroad] if n not in here] or None
            for at in range(0, len(part), 10_000):
                columns = zip(*part[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture of the archives at ``path``.

    Returns capture_id and the structs request (record_id, target), response
    (record_id, kind, digest, refers_to, http_length, payload_bytes,
    payload_sha1) and metadata (record_id, page_id). Records
    that a chain of concurrent-to links ties, in whatever direction and
    through whatever files, are one capture; its id is that of a record they
    name, else its only record's own. A capture with a record missing has a null
    struct in its place; warcinfo records are left out. No archive gives an
    empty result.
    """
    let_workers_import(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialise(files.mapInArrow(parse_archives, RECORD_SCHEMA), "warc-records").withColumnRenamed("root", "capture_id")
    # Links inside a file are followed where it is parsed; here are those to records of other files.
    away = records.select(F.col("capture_id").alias("src"), F.explode("abroad").alias("dst"))
    if not away.isEmpty():
        named = records.select("record_id", F.col("capture_id").alias("src")).join(away.select("dst").distinct(), F.col("record_id") == F.col("dst"))
        merged = connected_components(away.union(named.select("src", "dst"))).withColumnRenamed("node", "capture_id")
        records = records.join(merged, "capture_id", "left").withColumn("capture_id", F.coalesce("component", "capture_id"))
    # The three kinds meet in one grouping by the id that the links lead to.
    pick = lambda test, *fields: F.max(F.when(test, F.struct(*fields)))
    kind = F.col("kind")
    return records.groupBy("capture_id").agg(
        pick(kind == "request", "record_id", "target").alias("request"),
        pick(kind.isin("response", "revisit"), "record_id", "kind", "digest", "refers_to", "http_length", "payload_bytes", "payload_sha1").alias("response"),
        pick(kind == "metadata", "record_id", "page_id").alias("metadata"),
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and summarise the captures read back.

    Returns page_id, payload_bytes, payload_digest, record_type and
    refers_to. A revisit stores no payload: the response that its
    WARC-Refers-To names gives the payload's size and digest and the page_id.
    A named record that is in no archive leaves refers_to null, and size and
    digest as the revisit's own headers state them.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    captures = materialise(read_captures(spark, path).select("response.*", "metadata.page_id"), "captures")
    # Equal rows are responses with one id; which of them is named does not matter.
    named = captures.where("kind = 'response'").groupBy(F.col("record_id").alias("named")).agg(
        F.max("page_id").alias("refers"), F.max("payload_bytes").alias("bytes"), F.max("payload_sha1").alias("sha1")
    )
    # A table of its own, so that Spark can split the join where one response is named very often.
    met = captures.join(materialise(named, "responses"), F.col("refers_to") == F.col("named"), "left")
    revisit = F.col("kind") == "revisit"
    return met.select(
        "page_id",
        F.when(revisit, F.coalesce("bytes", "http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("sha1", "digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers")).alias("refers_to"),
    )
