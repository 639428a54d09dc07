"""WARC archives through a chunked record table.

An oversized payload is rows of a record identifier, a chunk number and some
bytes, made one after the other, each with the digest of all bytes so far; the
chunks of a record are never put together again. In the archive a chunk is a
segment: the first is the record, the others are ``continuation`` records of
the format, so a reader, too, holds one chunk at a time.

Archives are written and read as text by Spark's own writers and readers, in
any store. What tells records apart is the version ``WARC/1.1`` and a line end;
payloads are cut so that it stands nowhere inside a segment, and a block whose
length isn't the one its header states is an error. Digests are written into
the records, and checked when these are read.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.llm.common import cut, removed, scratch, whole_text

#: Bytes to a chunk, at most; payloads of fewer bytes are never revisits.
CHUNK, LEAST_BYTES = 65_536, 0
VERSION, LINE = "WARC/1.1", "\r\n"
#: No segment may hold the version; a payload is cut after so much of it.
KEPT_TOGETHER = len("WARC")
#: Chunks leave a task in batches of about so many bytes.
BATCH = 4 << 20
#: Revisits known to a writing task are broadcast up to so many rows (under 200 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}{LINE}"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest given in hex whose bits are a multiple of 20."""
    def four(k: int) -> list[Column]:
        n = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[c for k in range(8) for c in four(k)])


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def chunk_table(rows: DataFrame, payload: str, keep: list[str], size: int = CHUNK) -> DataFrame:
    """``keep``, ``chunk_no``, ``last``, ``data``, ``bytes`` and ``digest`` (both of the payload up to the chunk's end): a row for each chunk.

    A null payload is one empty chunk. No chunk is longer than ``size`` bytes
    or holds the version that begins a record.
    """
    rows = rows.select(*keep, whole_text(payload).alias("_text"))
    whole = (F.octet_length("_text") <= size) & ~F.col("_text").contains(VERSION)
    one = rows.where(whole).select(*keep, F.lit(0).alias("chunk_no"), F.lit(True).alias("last"), F.col("_text").cast("binary").alias("data"), F.octet_length("_text").cast("long").alias("bytes"), base32(F.sha1(F.col("_text").cast("binary"))).alias("digest"))
    long = rows.where(~whole).select(*keep, F.col("_text").cast("binary").alias("data"))
    names = [*keep, "chunk_no", "last", "data", "bytes", "digest"]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string())
    version = re.compile(re.escape(VERSION.encode()))

    def each(batches):
        for b in batches:
            held: list[tuple] = []
            at: list[int] = []
            room = BATCH

            def batch(b=b) -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, k in zip(list(zip(*held)) or [()] * 5, kinds)]
                out = pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))], *columns], names=names)
                held.clear()
                at.clear()
                return out

            for i, value in enumerate(b.column(len(keep))):
                body = memoryview(value.as_buffer())
                sha, start, number = hashlib.sha1(), 0, 0
                while start < len(body) or not number:
                    end = min(start + size, len(body))
                    if inside := version.search(body, start, end):
                        end = inside.start() + KEPT_TOGETHER
                    sha.update(body[start:end])
                    at.append(i)
                    held.append((number, end == len(body), bytes(body[start:end]), end, b32encode(sha.digest()).decode()))
                    room -= end - start
                    start, number = end, number + 1
                    if room <= 0:
                        yield batch()
                        room = BATCH
            yield batch()

    return one.union(long.mapInArrow(each, f"{fields(rows, keep)}, chunk_no int, last boolean, data binary, bytes long, digest string"))


def digests(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks(keys, chunk_no, last, data, total, told)`` -> ``keys``, ``payload_bytes`` and ``payload_digest`` of each record; the first key tells records apart.

    Records of one chunk are digested where they are. The chunks of others come
    together in order, and a running digest is carried from one to the next. A
    chunk that is missing, and bytes or a digest other than those the last
    chunk tells, are errors.
    """
    alone = F.col("last") & (F.col("chunk_no") == 0)
    own = base32(F.sha1("data"))
    wrong = F.raise_error(F.lit("a record's digest isn't that of its payload")).cast("string")
    single = chunks.where(alone).select(*keys, F.octet_length("data").cast("long").alias("payload_bytes"), F.when(own == F.col("told"), own).otherwise(wrong).alias("payload_digest"))
    many = chunks.where(~alone).select(*keys, "chunk_no", "last", "data", "total", "told")
    n = len(keys)

    def each(batches):
        sha, size, seen, name, open_ = hashlib.sha1(), 0, 0, None, False
        for b in batches:
            rows: list[int] = []
            out: list[tuple[int, str]] = []
            who, numbers, lasts, totals, told = (b.column(k).to_pylist() for k in (0, n, n + 1, n + 3, n + 4))
            data = b.column(n + 2)
            for i in range(len(b)):
                if who[i] != name:
                    if open_:
                        raise ValueError(f"record {name} lacks its last chunk")
                    sha, size, seen, name, open_ = hashlib.sha1(), 0, 0, who[i], True
                if numbers[i] > seen:
                    raise ValueError(f"record {name} lacks chunk {seen}")
                if numbers[i] == seen:  # of a row that repeats, the same chunk comes again and is digested once
                    part = data[i].as_buffer()
                    sha.update(part)
                    size, seen = size + len(part), seen + 1
                if lasts[i]:
                    digest = b32encode(sha.digest()).decode()
                    if digest != told[i] or size != totals[i]:
                        raise ValueError(f"record {name} has {size} bytes of digest {digest}, not {totals[i]} of {told[i]}")
                    open_ = False
                    rows.append(i)
                    out.append((size, digest))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(n)], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=[*keys, "payload_bytes", "payload_digest"])
        if open_:
            raise ValueError(f"record {name} lacks its last chunk")

    ordered = many.repartition(keys[0]).sortWithinPartitions(keys[0], "chunk_no")
    return single.union(ordered.mapInArrow(each, f"{fields(many, keys)}, payload_bytes long, payload_digest string"))


def revisits(digested: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(rid, refers_rid, refers_to)`` of the records whose payload another one, of a larger page id, has too."""
    same = ["payload_digest", "payload_bytes"]
    first = digested.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max(F.struct("page_id", "rid")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(*same, F.col("m.rid").alias("refers_rid"), F.col("m.page_id").alias("refers_to"))
    return digested.join(first, same).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("rid", "refers_rid").distinct()


def header(lines: dict[str, Column]) -> Column:
    """The header lines whose value isn't null."""
    made = [F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(LINE)) for k, v in lines.items()]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in made])


def urn(rid: Column, chunk: Column) -> Column:
    """The identifier of a segment; that of the first is the record's own."""
    h = F.when(chunk == 0, rid).otherwise(F.md5(F.concat_ws("/", rid, chunk.cast("string"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(chunks: DataFrame, again: DataFrame) -> DataFrame:
    """One row ``value`` for each segment, as it stands in the archive but for its last line end."""
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    known = chunks.join(again, "rid", "left")
    revisit, first, last = F.col("refers_rid").isNotNull(), F.col("chunk_no") == 0, F.col("last")
    known = known.where(~revisit | first)
    many = ~(first & last) & ~revisit
    block = F.concat(F.when(first, F.lit(HTTP)).otherwise(F.lit("")), F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string")))
    head = header({
        "WARC-Type": F.when(revisit, "revisit").when(first, "response").otherwise("continuation"),
        "WARC-Record-ID": urn(F.col("rid"), F.col("chunk_no")),
        "WARC-Date": F.lit(DATE),
        "WARC-Target-URI": F.replace(F.regexp_replace("url", r"[\x00-\x20]", ""), F.lit(VERSION), F.lit(VERSION.replace("/", "%2F"))),
        "Content-Type": F.when(first, "application/http; msgtype=response"),
        "WARC-Profile": F.when(revisit, REVISIT_PROFILE),
        "WARC-Refers-To": F.when(revisit, urn(F.col("refers_rid"), F.lit(0))),
        "WARC-Payload-Digest": F.when(revisit, F.concat(F.lit("sha1:"), F.col("whole"))).when(last, F.concat(F.lit("sha1:"), F.col("digest"))),
        "WARC-Segment-Number": F.when(many, F.col("chunk_no") + 1),
        "WARC-Segment-Origin-ID": F.when(~first, urn(F.col("rid"), F.lit(0))),
        "WARC-Segment-Total-Length": F.when(many & last, F.col("bytes") + len(HTTP)),
        "X-Page-ID": F.col("page_id"),
        "Content-Length": F.octet_length(block),
    })
    return known.select(F.concat(F.lit(VERSION + LINE), head, F.lit(LINE), block, F.lit(LINE)).alias("value"))


def write(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", chunk: int = CHUNK, least_bytes: int = LEAST_BYTES, compression: str = "none") -> None:
    """Archives under ``path``: a record for each row, a revisit for each payload that a row of a larger page id has.

    A null payload is an empty one; a null page id is smaller than any other;
    of rows with the same payload and the same largest page id all are
    responses. Payloads of any length, and those that look like archives
    themselves, become as many segments as they need. Other columns are not
    written. An empty table gives an empty archive. Spark commits the files of
    a job by renaming them, so a lost executor leaves none behind that count.
    """
    text = whole_text(payload)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text.cast("binary")).alias("h"))
    rid = F.md5(F.concat_ws(LINE, F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "h", F.coalesce("url", F.lit(""))))
    rows = rows.select("page_id", "url", "payload", rid.alias("rid"), base32(F.col("h")).alias("whole"))
    told = cut(rows.select("rid", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("whole").alias("payload_digest")))
    chunks = chunk_table(rows, "payload", ["rid", "page_id", "url", "whole"], chunk)
    records(chunks, cut(revisits(told, least_bytes))).write.mode("error").option("compression", compression).text(path, lineSep=LINE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: ``rid``, ``page_id``, ``record_type``, ``refers_rid``, ``chunk_no``, ``last``, ``data`` (binary), ``total`` and ``told`` (bytes and digest of the payload, at its last chunk).

    A block of another length than its header says is an error, as is one that
    holds the line that begins a record, which :func:`write` never makes.
    """
    raw = spark.read.text(path, lineSep=VERSION + LINE).where("value <> ''")  # what stands before the first record of a file is empty
    parted = raw.select(F.col("value").cast("binary").alias("v"), F.substring_index("value", LINE + LINE, 1).alias("h"))
    head, skip = F.concat(F.lit(LINE), F.col("h"), F.lit(LINE)), F.octet_length("h") + 4
    field = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    num = lambda name, kind: F.when(field(name) != "", field(name)).cast(kind)
    urn_of = lambda name: F.when(field(name) != "", F.translate(F.regexp_extract(field(name), "<urn:uuid:([^>]*)>", 1), "-", ""))
    length = num("Content-Length", "int")
    short = F.raise_error(F.lit("a record's block is not as long as its header says")).cast("binary")
    block = F.when(F.octet_length("v") == skip + length + 4, F.substring("v", skip + 1, length)).otherwise(short)
    named = parted.select(
        urn_of("WARC-Record-ID").alias("own"), urn_of("WARC-Segment-Origin-ID").alias("origin"), num("X-Page-ID", "long").alias("page_id"), field("WARC-Type").alias("record_type"), urn_of("WARC-Refers-To").alias("refers_rid"),
        num("WARC-Segment-Number", "int").alias("segment"), num("WARC-Segment-Total-Length", "long").alias("length"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("told"), block.alias("block"),
    )
    http = F.when(F.col("record_type") == "continuation", F.lit(0)).otherwise(F.octet_length(F.substring_index(F.col("block").cast("string"), LINE + LINE, 1)) + 4)
    last = F.col("segment").isNull() | F.col("length").isNotNull()
    return named.withColumn("_skip", http).select(
        F.coalesce("origin", "own").alias("rid"), "page_id", "record_type", "refers_rid", (F.coalesce("segment", F.lit(1)) - 1).alias("chunk_no"), last.alias("last"),
        F.substring("block", F.col("_skip") + 1, F.greatest(F.octet_length("block") - F.col("_skip"), F.lit(0))).alias("data"), (F.col("length") - len(HTTP)).alias("total"), "told",
    )


def archived(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes the archives, reads them back, and returns for each record what its full payload is.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``; those of a revisit come from the
    response it refers to, and it is an error if there is none or its digest is
    another. See :func:`write` for odd rows. Archives are deleted in the end
    unless a ``path`` is given.
    """
    spark = pages.sparkSession
    at = path or scratch(spark, "warc")
    write(pages, at, **how)
    back = read(spark, at)
    own = cut(digests(back.where("record_type <> 'revisit'").select("rid", "page_id", "chunk_no", "last", "data", "total", "told"), ["rid", "page_id"]))
    asked = back.where("record_type = 'revisit'").select("page_id", F.col("refers_rid").alias("rid"), "told")
    payloads = own.select("rid", "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to")).dropDuplicates(["rid"])
    broken = F.raise_error(F.lit("a revisit refers to no record of its digest")).cast("string")
    told = F.when(F.col("payload_digest") == F.col("told"), F.col("payload_digest")).otherwise(broken)
    again = asked.join(payloads, "rid", "left").select("page_id", "payload_bytes", told.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    again = cut(again)
    if path is None:
        removed(spark, at)
    return own.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(again.schema["refers_to"].dataType).alias("refers_to")).union(again)
