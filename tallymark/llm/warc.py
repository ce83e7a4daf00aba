"""WARC archives of pages, and an index of captures merged from sorted runs.

Writing: every capture becomes one WARC/1.1 record.  Of captures with equal
payloads of at least ``least_bytes`` bytes the one with the smallest identifier
is a ``response``, the others are ``revisit`` records that refer to it and hold
no payload; smaller payloads are always responses.  Archives are written by
Spark's own writer (a record ends with the two line breaks that the format asks
for), so that a lost task leaves no partial file and any store that Spark can
write will do.  Archives are gzip files of bounded size.

Reading: archives are read back record by record by their content lengths; each
payload is checked against its digest.

Index: the captures of each archive are a run sorted by URL key and timestamp.
Sampled splitters cut the key space, and each range merges its slices of all
runs with a loser tree, which gives a global order of capture histories.

Defined cases: a null payload is empty; a null URL gets an empty one.  A null
identifier is written as an empty name and read back as null; it is the
smallest, so such a capture is a response or, when there are several with one
payload, each of them is.  Repeated rows are written one by one; equal
identifiers and payloads are all responses or all revisits.  An empty table
gives an empty result.  Columns not named are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import fresh_path, stored

LEAST_BYTES = 100
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 16 << 20
#: Index rows that one merging task holds, about.
RANGE_ROWS = 100_000
_END = "\r\n"
_NAME = "urn:page:"
_TYPE = "application/http;msgtype=response"

CAPTURE = (
    "record_type string, id string, url string, url_key string, captured string, payload_digest string, "
    "payload_bytes long, refers_to string, archive string, at long, intact boolean"
)


def plan_records(
    pages: DataFrame, id_col: str, url_col: str, body_col: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """``id, url, body, digest, refers_to``, one partition per archive; ``refers_to`` is null for responses.

    Equal payloads meet as digests only. Bodies are shuffled once, by identifier, so copies of one payload spread evenly.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("body"),
    ).withColumn("digest", F.sha2(F.col("body"), 256))
    named = stored(rows.where(F.col("id").isNotNull() & (F.octet_length("body") >= least_bytes)).select("id", "digest"))
    first = named.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    again = named.distinct().join(first.select("digest", "first"), "digest").where("id <> first")
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    return (
        rows.repartition(archives, "id", "digest")
        .join(again, ["id", "digest"], "left")
        .select("id", "url", "body", "digest", F.col("first").alias("refers_to"))
    )


def write_archives(records: DataFrame, path: str, captured) -> None:
    """Write each partition of the planned records as an archive under the path. ``captured`` is a record's timestamp column."""
    name = F.concat(F.lit(_NAME), F.coalesce(F.col("id").cast("string"), F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    status = F.lit("HTTP/1.1 200 OK" + _END + "Content-Type: text/html; charset=utf-8" + _END + _END)

    def line(field, value):
        return F.concat(F.lit(field + ": "), value, F.lit(_END))

    header = F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(">"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit(f"<{_NAME}"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit(_TYPE)),
        line("Content-Length", (F.octet_length(status) + F.octet_length(body)).cast("string")),
        F.lit(_END),
    )
    archived = records.select(F.concat(header, status, body).alias("value"))
    archived.write.option("lineSep", _END + _END).option("compression", "gzip").text(path)


def _records(chunks: Iterable[bytes]) -> Iterator[tuple[int, dict, bytes]]:
    """Place, header fields and block of each record of an unpacked archive."""
    data, at = b"", 0
    chunks = iter(chunks)

    def grow(size):
        nonlocal data
        parts = [data]
        have = len(data)
        while have < size:
            more = next(chunks, None)
            if more is None:
                break
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        return have >= size

    while grow(1):
        while (cut := data.find(b"\r\n\r\n")) < 0:
            if not grow(len(data) + 1):
                raise ValueError("an archive ends within a header")
        fields = dict(f.split(": ", 1) for f in data[:cut].decode().split(_END)[1:])
        size = int(fields["Content-Length"])
        end = cut + 4 + size
        if not grow(end + 4):
            raise ValueError("an archive ends within a record")
        yield at, fields, data[cut + 4 : end]
        at += end + 4
        data = data[end + 4 :]


def _unpack(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    inflate = zlib.decompressobj(wbits=31)
    for i in range(0, len(content), step):
        yield inflate.decompress(content[i : i + step])
    yield inflate.flush()


def url_key(url: str) -> str:
    """The host's labels from the right, then the rest: captures of a site sort together."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)(.*)", url, re.S)
    host, rest = (m[1], m[2]) if m else ("", url)
    host = host.rpartition("@")[2].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under the path (columns of ``CAPTURE``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def read(batches):
        names = [f.split()[0] for f in CAPTURE.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, fields, block in _records(_unpack(content.as_py())):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = fields["WARC-Type"] == "response"
                    rows.append(
                        (
                            fields["WARC-Type"],
                            fields["WARC-Record-ID"][1 + len(_NAME) : -1] or None,
                            fields["WARC-Target-URI"],
                            url_key(fields["WARC-Target-URI"]),
                            fields["WARC-Date"],
                            digest,
                            len(payload) if full else None,
                            fields["WARC-Refers-To"][1 + len(_NAME) : -1] if "WARC-Refers-To" in fields else None,
                            name.as_py().rpartition("/")[2],
                            at,
                            not full or hashlib.sha256(payload).hexdigest() == digest,
                        )
                    )
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                types = [pa.int64() if n in ("payload_bytes", "at") else pa.bool_() if n == "intact" else pa.string() for n in names]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.mapInArrow(read, CAPTURE)


def merge_runs(runs: list[list]) -> Iterator:
    """All entries of sorted runs in order, by a loser tree: each entry costs one comparison per level."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k

    def before(a, b):
        """Whether the head of run a comes first; an ended run comes last."""
        if at[a] >= len(runs[a]):
            return False
        return at[b] >= len(runs[b]) or (runs[a][at[a]], a) < (runs[b][at[b]], b)

    winner = [0] * k + list(range(k))
    loser = [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if before(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while at[best] < len(runs[best]):
        yield runs[best][at[best]]
        at[best] += 1
        node = (best + k) // 2
        while node:
            if before(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in the global order of URL key and timestamp: ``span`` is the range, ``position`` the place in it."""
    order = ["url_key", "captured", "archive", "at"]
    names = captures.columns
    spans = max(1, -(-captures.count() // range_rows))
    # Within a range the runs follow each other, each in its own order.
    ranged = captures.repartitionByRange(spans, *order).sortWithinPartitions("archive", "url_key", "captured", "at")
    ranged = ranged.withColumn("span", F.spark_partition_id())
    keys = [names.index(c) for c in order]

    def merge(batches):
        runs: dict[str, list] = {}
        held = []
        for b, batch in enumerate(batches):
            held.append(batch)
            columns = [batch.column(i).to_pylist() for i in keys]
            for i, key in enumerate(zip(*columns, strict=True)):
                runs.setdefault(key[2], []).append((key, b, i))
        if not held:
            return
        table = pa.Table.from_batches(held)
        begin = [0]
        for batch in held:
            begin.append(begin[-1] + batch.num_rows)
        rows = [begin[b] + i for _, b, i in merge_runs(list(runs.values()))]
        ordered = table.take(pa.array(rows, pa.int64())).append_column("position", pa.array(range(len(rows)), pa.int64()))
        yield from ordered.to_batches(max_chunksize=10_000)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    return ranged.mapInArrow(merge, f"{fields}, position long")


def archive_and_index(
    pages: DataFrame,
    captured,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    path: str | None = None,
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write the pages' archives, read them back and return the merged index, revisits with the size of what they refer to."""
    spark = pages.sparkSession
    path = path or fresh_path(spark)
    write_archives(plan_records(pages, id_col, url_col, body_col, least_bytes), path, captured)
    captures = stored(read_archives(spark, path))
    referred = captures.where("record_type = 'response' and id is not null").groupBy("id", "payload_digest").agg(
        F.max("payload_bytes").alias("full_bytes")
    )
    sizes = captures.where("refers_to is not null").select("refers_to", "payload_digest").distinct().join(
        referred.withColumnRenamed("id", "refers_to"), ["refers_to", "payload_digest"]
    )
    whole = captures.join(sizes, ["refers_to", "payload_digest"], "left").select(
        *[c for c in captures.columns if c != "payload_bytes"], F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes")
    )
    return merged_index(whole)
