"""WARC archives written and read index first.

Writing: every task streams its rows into one ``.warc.gz`` file (one gzip member
per record) in a shared folder and returns an index row per record: file,
offset, length, URL, digest. A file is named anew by every task attempt and only
the attempt that finished is in the checkpointed index, so a lost executor or a
speculative copy never leaves a torn or double record in it.

Reading: the index rows wanted are sorted by file and offset, neighbouring ranges
are coalesced into bounded reads, and the records are parsed from those.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.llm.files import file_system
from bindscape.session import cut_lineage, shared_dir

MIN_REVISIT_BYTES = 100
MAX_GAP = 1 << 16
MAX_READ = 8 << 20
#: Archive bytes that one reading task is given.
TASK_BYTES = 32 << 20
#: Tasks that the records of one digest, or the revisits of one response, meet their response in.
SPREAD = 16
#: A duplicate table up to this many bytes is broadcast, a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

INDEX = ("file string, offset long, length long, url string, digest string, record_id string, "
         "rec_id long, payload_bytes long, record_type string, refers_to long")


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(rec_id, url, payload, digest, refers_to)``. ``refers_to`` is the smallest id among
    records with the same payload of at least ``min_bytes`` bytes, null for that record itself
    (and for all with that id, if rows repeat) and for smaller payloads."""
    rows = pages.select(F.col(id_col).alias("rec_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= min_bytes
    first = (rows.where(long).groupBy("digest")
             .agg(F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
             .select(F.col("digest").alias("d"), "first"))
    first = cut_lineage(first)
    if first.count() * 128 <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(first), F.col("digest") == F.col("d"), "left")
    else:
        # short payloads go by their row, the copies of a long one to SPREAD tasks
        mark = F.xxhash64("rec_id", "url")
        rows = rows.withColumn("d", F.when(long, F.col("digest")).otherwise(mark.cast("string")))
        rows = rows.withColumn("s", F.pmod(mark, F.lit(SPREAD)).cast("int"))
        joined = rows.join(_spread(first), ["d", "s"], "left")
    other = F.col("rec_id").isNull() | (F.col("rec_id") != F.col("first"))
    return joined.select("rec_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` once for each number ``s`` below ``SPREAD``."""
    return rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def record_id(rec_id: int | None, digest: str) -> str:
    """A stable record id, so that a revisit can name its response before it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rec_id}:{digest}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def encode_record(rec_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its digest and refers-to headers name
    the response that holds the payload. The ids of the rows are headers too (``X-Row-Id``, empty if
    null, and ``X-Refers-To-Row-Id``), so the archives alone tell what the index tells."""
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(rec_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Row-Id: {'' if rec_id is None else rec_id}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Row-Id: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; raises if it is torn."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length does not match its header")
    return fields, rest[:size]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES,
                   date: str = "2024-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Write one record per row into ``folder`` (shared storage) and return the index, checkpointed.

    A null payload is empty; a null URL is written empty; null ids and repeated rows
    are records like others; an empty table writes none. Other columns are ignored."""

    def write(batches):
        fs, root = file_system(folder)
        name, out, at = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(name, compression=None)
                    data = encode_record(r["rec_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(data) + z.flush()
                    out.write(member)
                    rows.append((name, at, len(member), r["url"], r["digest"], record_id(r["rec_id"], r["digest"]),
                                 r["rec_id"], len(r["payload"]),
                                 "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                    at += len(member)
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(
                        zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                  pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()],
                        strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    planned = plan_revisits(pages, id_col, url_col, payload_col, min_bytes)
    return cut_lineage(planned.mapInArrow(write, INDEX))


def read_records(index: DataFrame, folder: str, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """``(rec_id, url, record_type, digest, refers_to_id, refers_to, payload)`` of the records in ``index``
    (any subset of its rows), all read from the records. Ranges of a file that lie within ``max_gap`` bytes are read together,
    up to ``max_read`` bytes at a time. ``payload`` is null for revisits."""
    out_schema = ("rec_id long, url string, record_type string, digest string, refers_to_id string, refers_to long, "
                  "payload binary")

    def number(value):
        return int(value) if value else None

    def read(batches):
        fs, _ = file_system(folder)
        name, handle = None, None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                i = 0
                while i < len(rows):
                    j, end = i + 1, rows[i]["offset"] + rows[i]["length"]
                    while (j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] - end <= max_gap
                           and rows[j]["offset"] + rows[j]["length"] - rows[i]["offset"] <= max_read):
                        end = max(end, rows[j]["offset"] + rows[j]["length"])
                        j += 1
                    if rows[i]["file"] != name:
                        if handle is not None:
                            handle.close()
                        name, handle = rows[i]["file"], fs.open_input_file(rows[i]["file"])
                    start = rows[i]["offset"]
                    data = memoryview(handle.read_at(end - start, start))
                    found = []
                    for r in rows[i:j]:
                        member = data[r["offset"] - start:r["offset"] - start + r["length"]]
                        fields, block = decode_record(zlib.decompress(member, 31))
                        kind = fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                        found.append((number(fields["x-row-id"]), fields["warc-target-uri"], kind, digest,
                                      fields.get("warc-refers-to"), number(fields.get("x-refers-to-row-id")),
                                      block if kind == "response" else None))
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)],
                        names=[x.split()[0] for x in out_schema.split(", ")])
                    i = j
        finally:
            if handle is not None:
                handle.close()

    wanted = index.select("file", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    # ranges of one file stay in runs: range-partitioned by the bytes of the archives, then read in order
    parts = max(1, -(-total // TASK_BYTES))
    return wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(
        read, out_schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: ``(id, payload_bytes, payload_digest,
    record_type, refers_to)`` per row, taken from the records read. A revisit's length is that
    which the index has for the response that its refers-to header names."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder, id_col, url_col, payload_col)
    mark = F.xxhash64("rec_id", "url")
    read = read_records(index, folder).select(
        "rec_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("n"),
        # responses go by their row, the revisits of one response meet it in SPREAD tasks
        F.coalesce("refers_to_id", mark.cast("string")).alias("named"), F.pmod(mark, F.lit(SPREAD)).cast("int").alias("s"))
    named = (index.where("record_type = 'response'").join(
        index.where("record_type = 'revisit'").select("digest").distinct(), "digest", "left_semi")
        .groupBy(F.col("record_id").alias("named")).agg(F.min("payload_bytes").alias("target_bytes")))
    return read.join(_spread(named), ["named", "s"], "left").select(
        F.col("rec_id").alias(id_col), F.coalesce("n", "target_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")
