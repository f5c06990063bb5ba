"""Media columns: content-addressed payloads in tar shards, read back by ranges.

Every text is stored as an 8-bit grey image, one sample for each byte: the payload's bytes, padded with 0 to a positive
multiple of 64, are the rows of a PNG 64 pixels wide, whose compression is lossless. Each task writes one tar shard with
a member for each payload that it meets, named by the payload's digest, so that equal payloads of a task are stored
once. Rows carry digest, shard, offset and length. Metadata (width, height, depth) come from a range read of the
member's first 33 bytes and fill columns of the index; the features of the same job come from the stored samples
themselves, checked against these columns and the digest. No row moves between tasks, and a task keeps no more than a
batch of rows and the places of its own payloads.

A shard is written under the name of the task's attempt and then renamed, so an attempt that died leaves no shard, and
one that ran twice leaves the same bytes. Rows with equal texts have equal values wherever they were stored, because
the stored form depends on the payload alone.

Defined cases: a null text is empty, and an empty payload is 64 bytes 0; very long texts are taller images; repeated
rows share a member; an empty table gives no rows and no shard; other columns of the input are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import shared_dir, stored, table

WIDTH = 64
#: Bytes of a PNG that hold its signature and its header chunk.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 5


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, 64 wide, each row with filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that to_png made."""
    width, height, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """An average hash: 64 bits, one for each column of the image, set where its mean is over that of all columns."""
    means = samples.sum(axis=0, dtype=np.int64)
    bits = means * WIDTH > means.sum()
    return np.packbits(bits).tobytes().hex()


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}.tar"
        files, root = fs.FileSystem.from_uri(folder)
        own = f"{root}/{name}.{task.taskAttemptId()}"
        places: dict[bytes, tuple[int, int]] = {}
        out, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload)
                key = digest.digest()
                if key not in places:
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(own)
                    member = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                    info.size = len(member)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + member + bytes(-len(member) % tarfile.BLOCKSIZE))
                    places[key] = at + len(head), len(member)
                    at += len(head) + len(member) + -len(member) % tarfile.BLOCKSIZE
                rows.append((doc_id, len(data), digest.hexdigest(), f"{folder}/{name}", *places[key]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"]).astype({"doc_id": batch["doc_id"].dtype})
        # Rows of a task that ends before this are thrown away with it.
        if out is not None:
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()
            files.move(own, f"{root}/{name}")

    return run


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of docs into tar shards of a folder that all executors reach; one row for each document."""
    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(whole.mapInPandas(_write(folder), schema), "media-index")


class Ranges:
    """Range reads of shards; the shard read last stays open."""

    def __init__(self) -> None:
        self.path, self.file = "", io.BytesIO()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.file.close()
            files, name = fs.FileSystem.from_uri(path)
            self.path, self.file = path, files.open_input_file(name)
        self.file.seek(offset)
        return self.file.read(length)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    ranges = Ranges()
    for batch in batches:
        found = [header(ranges.read(s, o, HEADER)) for s, o in zip(batch["shard"], batch["offset"], strict=True)]
        yield pd.concat([batch, pd.DataFrame(found, columns=["width", "height", "depth"], index=batch.index)], axis=1)


def metadata(index: DataFrame) -> DataFrame:
    """index with width, height and depth, from the members' headers alone."""
    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width long, height long, depth int"
    return index.mapInPandas(_headers, schema)


def _features(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    ranges, last, values = Ranges(), None, ()
    for batch in batches:
        rows = []
        for doc_id, n_bytes, digest, shard, offset, length, *head in batch.itertuples(index=False):
            if (shard, offset) != last:
                last = shard, offset
                data = ranges.read(shard, offset, length)
                samples = from_png(data)
                payload = samples.tobytes()
                read = hashlib.sha256(payload).hexdigest()
                if read != digest or samples.shape != (head[1], head[0]):
                    raise ValueError(f"{shard}: the member at {offset} isn't the payload {digest}")
                values = len(payload), read, zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)
            rows.append((doc_id, n_bytes, *values, *head))
        yield pd.DataFrame(rows, columns=FEATURES).astype({"doc_id": batch["doc_id"].dtype})


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"]


def features(described: DataFrame) -> DataFrame:
    """What the stored bytes of an index with metadata give, read back: digests, checksum and feature, beside its header fields."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, depth int"
    return described.mapInPandas(_features, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    return features(metadata(store(table(spark, sf_dir, "documents"), folder)))
