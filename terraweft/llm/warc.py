"""WARC archives compressed with Zstandard, one frame a record, with a dictionary in a leading skippable frame.

Writing: records are dealt to archives of bounded size; each archive is one file `<name>.warc.zst` that begins with a
skippable frame (magic DICTIONARY_MAGIC) holding the dictionary, which is trained on a bounded sample of the pages.
Files go to a folder that executors and driver share, under their final name only when complete, and the name follows
from the archive's number, so that a task that is run again writes the same file. Reading takes the archives with
Spark's binaryFile source (a row an archive, up to 2 GB), loads the dictionary from the leading frame, plain or compressed
(an archive without one has none), decodes one frame per record and validates the version line (1.0 or 1.1), the header
fields (names in any case), the block's length against Content-Length and the digests. Control characters of a URL are
percent-encoded, each byte as itself.

Of records with equal payloads of at least MIN_REVISIT bytes that with the largest page_id holds the payload, the others
are revisits of it. Defined results: null html is an empty payload; a null page_id takes part with an empty id and is
never referred to unless all its equals have none (then each is a response); repeated page_ids are written each, under
record ids of their own; an empty table writes no archive; a very long page is an archive of its own size. Columns other
than page_id, url and html are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.llm.common import bounded_sample, salted_lookup
from terraweft.session import settle, shared_folder

#: Fixed value: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
MIN_REVISIT = 1000
ARCHIVE_BYTES = 32_000_000
#: The dictionary's size, and how many pages of what length it is trained on at most.
DICTIONARY_BYTES, DICTIONARY_PAGES, DICTIONARY_CHARS = 65_536, 400, 40_000
LEVEL = 3
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def trained_dictionary(pages: DataFrame) -> bytes:
    """From a bounded sample; pages too few or too short to train on give an empty dictionary."""
    chosen = bounded_sample(pages.where(F.length("html") <= DICTIONARY_CHARS), "page_id", DICTIONARY_PAGES, "dictionary", pages.count()).select("html")
    samples = [r.html.encode("utf-8", "surrogatepass") for r in chosen.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """Of the copy-th record of a page with this payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, refers_to: int | None, block: bytes, copy: int = 0) -> bytes:
    safe = "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-Id", "" if page_id is None else str(page_id)), ("Payload-Length", str(length)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one decoded record; ValueError if it isn't valid."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"no header field: {line[:80]}")
        fields[name.strip().lower()] = value.strip(" \t")
    if missing := [k for k in _REQUIRED if not fields.get(k)]:
        raise ValueError(f"fields missing: {missing}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4}")
    block = rest[:size]
    # The block is the payload where Payload-Length says so; of other records the block's own digest is compared.
    if "payload-length" in fields and fields["warc-type"] == "response":
        if size != int(fields["payload-length"]) or not _has_digest(block, fields.get("warc-payload-digest", "")):
            raise ValueError("the payload doesn't have its digest")
    elif "warc-block-digest" in fields and not _has_digest(block, fields["warc-block-digest"]):
        raise ValueError("the block doesn't have its digest")
    return fields, block


def _has_digest(block: bytes, named: str) -> bool:
    """Whether a labelled SHA-1 digest, hexadecimal or base 32, is the block's; other algorithms are not judged."""
    kind, _, value = named.partition(":")
    if kind.lower() != "sha1":
        return bool(named)
    digest = hashlib.sha1(block).digest()
    return value.lower() == digest.hex() or value.upper() == base64.b32encode(digest).decode()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True, write_checksum=True)


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that every archive begins with."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded records of an archive, frame by frame."""
    dictionary, start = b"", 0
    if data[:4] != FRAME_MAGIC:
        magic, size = struct.unpack_from("<II", data)
        if magic != DICTIONARY_MAGIC or 8 + size > len(data):
            raise ValueError("neither a dictionary frame nor a record leads the archive")
        dictionary, start = bytes(data[8 : 8 + size]), 8 + size
        if dictionary[:4] == FRAME_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpress = zstandard.ZstdDecompressor(dict_data=held)
    rest = memoryview(data)[start:]
    while len(rest):
        window = 1 << 16
        one = unpress.decompressobj()
        parts, at = [], 0
        while not one.eof:
            if at >= len(rest):
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(rest[at : at + window]))
            at += window
        yield b"".join(parts)
        rest = rest[min(at, len(rest)) - len(one.unused_data) :]


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for a response)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    equal = held.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
    equal = equal.where("copies > 1 and original is not null").select("payload_digest", "original")
    found = salted_lookup(held, equal, "payload_digest", "page_id")
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("original")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes every page to archives in folder and returns (archive, records) of the files written.

    The partitions of the join by digest are sorted and streamed into archives of about ARCHIVE_BYTES, so that pages move
    once and a task holds one archive. Names follow from the partition and the order within it.
    """
    marked = with_revisits(pages).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        press = compressor(dictionary)
        held, size, number = [leading_frame(dictionary)], 0, 0
        last, copy = None, 0

        def written() -> pd.DataFrame:
            name, passing = f"{path}/part-{part:06d}-{number:04d}.warc.zst", f"{path}/.{part:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(passing) as out:
                for piece in held:
                    out.write(piece)
            store.move(passing, name)
            return pd.DataFrame({"archive": [name.rsplit("/", 1)[1]], "records": [len(held) - 1]})

        for b in batches:
            for r in b.itertuples(index=False):
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                block = b"" if refers is not None or not isinstance(r.html, str) else r.html.encode("utf-8", "surrogatepass")
                copy = copy + 1 if last == (page_id, r.payload_digest) else 0  # equal ones follow each other
                last = page_id, r.payload_digest
                held.append(press.compress(record("response" if refers is None else "revisit", page_id, r.url, r.payload_digest, int(r.payload_bytes), refers, block, copy)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield written()
                    held, size, number = held[:1], 0, number + 1
        if len(held) > 1:
            yield written()

    columns = ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    return settle(marked.select(*columns).sortWithinPartitions("page_id", "payload_digest").mapInPandas(run, "archive string, records long"), "archives")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: its fields and payload; an archive that isn't valid is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                rows = []
                for data in frames(content):
                    try:
                        f, block = parsed(data)
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                    revisit = f["warc-type"] == "revisit"
                    rows.append((
                        int(f["page-id"]) if f.get("page-id") else None, f.get("warc-target-uri"), int(f.get("payload-length", len(block))), f.get("warc-payload-digest", "").removeprefix("sha1:"),
                        f["warc-type"], int(f["refers-to-page"]) if revisit and f.get("refers-to-page") else None, None if revisit else block,
                    ))
                    if len(rows) >= 2000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    return files.mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/terraweft/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder, trained_dictionary(pages))
    if not written.take(1):
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_archives(spark, folder)
