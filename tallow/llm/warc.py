"""Dictionary-compressed WARC archives (.warc.zst).

Each archive begins with a skippable frame that holds a Zstandard dictionary
trained on records spread over it; every record is a frame of its own. Equal
payloads are stored once: the record with the smallest page_id is the response,
the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import shared_dir, stage

DICT_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20  # payload bytes of an archive
SAMPLE_BYTES = 2 << 20  # about the payload bytes of the records that the dictionary is trained on
DICT_BYTES = 64 << 10
MIN_REVISIT_BYTES = 100
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: str) -> str:
    return " ".join((value or "").split())


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None) -> bytes:
    """One WARC record. refers_to: for a revisit, a tuple of the page_id of its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest)}", f"X-Refers-To-Page: {'' if refers_to[0] is None else refers_to[0]}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from records; too few or too uniform ones for training serve as a raw dictionary themselves."""
    try:
        if len(samples) >= 16:
            return zstd.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstd.ZstdError:
        pass
    return b"".join(samples)[-size:]


def archive(records: Iterable[bytes]) -> bytes:
    """An archive of records."""
    records = list(records)
    step = -(-sum(map(len, records)) // SAMPLE_BYTES)
    words = train_dictionary([r[: SAMPLE_BYTES // 16] for r in records[:: max(step, 1)]])
    press = zstd.ZstdCompressor(level=6, dict_data=zstd.ZstdCompressionDict(words), write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(words)), words, *map(press.compress, records)])


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive: their headers, lower-cased, with block."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        frame = press.decompressobj()
        raw = frame.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        end = at + (1 << 16)
        while not frame.eof:
            raw += frame.decompress(data[end : end + (1 << 20)])
            end += 1 << 20
        at = min(end, len(data)) - len(frame.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        fields["block"] = rest[: int(fields["content-length"])]
        yield fields


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write pages to archives in a folder of the shared store; returns the folder and a frame of the archives (path, records).

    Null html is empty. Rows with equal payloads of min. 100 bytes are one response, that of the smallest
    page_id (null is largest; of equal rows the first), and revisits. The payload goes through one
    shuffle, by page; only digests meet by payload, and those of copied payloads are salted. A task writes
    archives under names that depend on its partition alone, so a repeated task replaces them. Empty payloads are
    responses; a very long one is an archive of its own. An empty table gives no archives. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "_order": F.coalesce("page_id", F.lit((1 << 63) - 1))})
    keys = p.where(F.length("payload") >= MIN_REVISIT_BYTES).select("page_id", "digest", "_order")
    firsts = keys.groupBy("digest").agg(F.min("_order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = keys.withColumn("salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    copies = copies.where(F.col("_order") != F.col("first")).select(F.col("_order").alias("_o"), F.col("digest").alias("_d"), "first").distinct()
    marked = p.join(copies, (p["_order"] == copies["_o"]) & (p["digest"] == copies["_d"]), "left").drop("_o", "_d")
    # The window brings equal rows together, whatever the join did.
    marked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_order", "digest").orderBy("url")))
    marked = marked.sortWithinPartitions("_order", "digest", "url").select("page_id", "url", "payload", "digest", "_order", "first", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, held = TaskContext.get().partitionId(), 0, 0, []
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)

        def put() -> pa.RecordBatch:
            path = f"{root}/part-{part:06d}-{number:05d}.warc.zst"
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary, compression=None) as out:
                out.write(archive(held))
            fs.move(temporary, path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for b in batches:
            for page_id, url, payload, digest, order, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = first
                if to is None and n > 1 and len(payload) >= MIN_REVISIT_BYTES:
                    to = order
                held.append(record(page_id, url, payload, digest, None if to is None else (None if to == (1 << 63) - 1 else to,)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    number, size, held = number + 1, 0, []
        if held:
            yield put()

    return folder, marked.mapInArrow(run, "path string, records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, record string, refers_record string"


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives (column path), one row each.

    payload_bytes and payload_digest are those of the stored payload, for a revisit those of its response's
    (null where that is lost); digest_ok: they are as the record's header says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(folder)
        number = lambda x: int(x) if x else None
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows = []
                for r in read_archive(data):
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    response, digest = r["warc-type"] == "response", r["warc-payload-digest"].removeprefix("sha256:")
                    told = int(http.decode().rsplit("Content-Length: ", 1)[1])
                    stored = (len(payload), hashlib.sha256(payload).hexdigest()) if response else (told, digest)
                    rows.append((number(r["x-page-id"]), r["warc-target-uri"], *stored, r["warc-type"], number(r.get("x-refers-to-page")), stored == (told, digest) if response else None, r["warc-record-id"], r.get("warc-refers-to")))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    read = stage(archives.select("path").mapInArrow(run, READ), "warc-read")
    revisits = read.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int"))
    asked = revisits.select(F.col("refers_record").alias("record")).distinct()
    firsts = read.where("record_type = 'response'").join(asked, "record", "left_semi").groupBy("record").agg(F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_sha"))
    firsts = firsts.select(F.col("record").alias("refers_record"), "_bytes", "_sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = revisits.join(firsts, ["refers_record", "salt"], "left")
    same = F.coalesce((F.col("_bytes") == F.col("payload_bytes")) & (F.col("_sha") == F.col("payload_digest")), F.lit(False))
    found = found.withColumn("digest_ok", same).withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_sha")})
    names = [x.split()[0] for x in READ.split(", ")][:-2]
    return read.where("record_type <> 'revisit'").select(*names).unionByName(found.select(*names))
