"""Line dedup: lines that stand in several documents stay in the first one only.

A line's key is the line without white space at its ends and with A-Z lower-cased. Two Bloom filters find suspects: the
first holds the hashes of all keys that were seen, the second those seen twice, each key once for each document. Tasks
send only their own places in the filters; the second filter, whose size is bounded, goes to every executor. Only the
keys that it holds are shuffled, as 128-bit BLAKE2b digests with their documents: grouped, they say exactly which keys
stand in two documents or more, and in which first. Texts without any suspect never move; those with one meet the
digests that they lose. Where there are more keys than the filters have bits for, more keys are suspects and are
shuffled, and the result is the same.

Defined cases: a null or empty text is one empty line, which stays; rows with one doc_id are one document; rows without
an id are one document behind all others; very long texts and lines are read whole; repeated rows lose the same lines;
an empty table gives no rows; other columns are kept as they are, but for ``text``, ``n_lines`` and ``n_dropped``, which
this operator fills. Two keys count as one if their digests agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from tramline.llm.common import stored, table
from tramline.llm.filters import PARTS, Seen, bits_for, holds, sent

#: Least code points of a key that is ever dropped.
LEAST = 10
#: Stands for a missing id, behind all others.
NO_ID = (1 << 63) - 1


def line_keys(text: str, least: int = LEAST) -> list[bytes]:
    """The key of each line, in UTF-8; empty for lines that are never dropped. Bytes know ASCII case and white space only."""
    keys = map(bytes.strip, text.encode().lower().split(b"\n"))
    return [k if len(k) >= 4 * least or len(k) >= least and len(k.decode()) >= least else b"" for k in keys]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _seen(bits: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        seen = Seen(bits)
        for batch in batches:
            for text in batch["text"]:
                yield from seen.add(_hashes({*line_keys(text, least)} - {b""}))
        yield seen.rest()

    return run


def _suspects(twice: Broadcast, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        """For each suspected key of a batch: its digest, its least and greatest document, and all of them with their texts' hashes."""
        for batch in batches:
            keys, owner = [], []
            for k, text in enumerate(batch["text"]):
                own = {*line_keys(text, least)} - {b""}
                keys += own
                owner += [k] * len(own)
            held, ids, names = {}, batch["id"].to_numpy(), batch["name"].to_numpy()
            for j in np.flatnonzero(holds(twice.value, _hashes(keys))):
                held.setdefault(keys[j], []).append(owner[j])
            rows = [(digest(key), ids[of].min(), ids[of].max(), ids[of], names[of]) for key, of in held.items()]
            yield pd.DataFrame(rows, columns=["digest", "first", "last", "ids", "names"])

    return run


def _flagged(twice: Broadcast, least: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """The batches, with a last column that is true where a text has a suspect."""
        for batch in batches:
            per_text = [{*line_keys(t or "", least)} - {b""} for t in batch.column(column).to_pylist()]
            found = holds(twice.value, _hashes(k for own in per_text for k in own))
            upto = np.concatenate([[0], np.cumsum(found)])
            edges = np.concatenate([[0], np.cumsum([len(own) for own in per_text], dtype=np.int64)])
            flags = upto[edges[1:]] > upto[edges[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "suspect"])

    return run


def kept_lines(text: str, gone: set[bytes], least: int = LEAST) -> tuple[str, int]:
    """text without the lines whose keys' digests are in gone, and the number of those lines."""
    lines = text.split("\n")
    kept = [line for line, key in zip(lines, line_keys(text, least), strict=True) if not key or digest(key) not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def _dropped(least: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """The batches, their last column, the digests, replaced by the text that stays and the number of lines that go."""
        for batch in batches:
            both = [kept_lines(t or "", {*(g or ())}, least) for t, g in zip(batch.column(column).to_pylist(), batch.columns[-1].to_pylist(), strict=True)]
            added = [pa.array([t for t, _ in both], pa.string()), pa.array([n for _, n in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "kept", "gone"])

    return run


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the lines that stay in ``text``, the lines before in ``n_lines`` and those that went in ``n_dropped``."""
    body = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("name"), body.alias("text")
    keyed = docs.select(*own)
    lines = keyed.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = bits_for(lines)
    twice = sent(keyed.select("text").mapInPandas(_seen(bits, least), PARTS), bits, twice=True)
    suspects = stored(keyed.mapInPandas(_suspects(twice, least), "digest binary, first long, last long, ids array<long>, names array<long>"), "suspects")
    repeats = stored(suspects.groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last").select("digest", "first"), "repeats")
    each = suspects.select("digest", "ids", "names").join(repeats, "digest").select("digest", "first", F.explode(F.arrays_zip("ids", "names")).alias("at"))
    losses = stored(each.filter(F.col("at.ids") > F.col("first")).groupBy(F.col("at.ids").alias("id"), F.col("at.names").alias("name")).agg(F.collect_set("digest").alias("digests")), "losses")
    # The row travels beside the operator's own columns, so that no name can clash.
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("row"), *own)
    flagged = rows.mapInArrow(_flagged(twice, least, "text"), StructType([*rows.schema.fields]).add("suspect", BooleanType()))
    count = F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")
    still = flagged.filter("NOT suspect").select("row.*", "text", count, F.lit(0).cast("long").alias("n_dropped"))
    met = flagged.filter("suspect").drop("suspect").join(losses, ["id", "name"], "left").select("row", "text", "digests")
    schema = StructType([met.schema["row"], met.schema["text"]]).add("kept", StringType()).add("gone", LongType())
    parted = met.mapInArrow(_dropped(least, "text"), schema).select("row.*", F.col("kept").alias("text"), count, F.col("gone").alias("n_dropped"))
    return still.union(parted)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
