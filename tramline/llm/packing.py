"""Packing documents into token sequences: shortest-pack-first over the length histogram.

A document becomes its token ids and one end id, cut into pieces of at most ``capacity`` ids. The lengths of all pieces
are counted; on that histogram, which has at most ``capacity`` rows whatever the number of documents, lengths are placed
longest first, each into the packs with the most room. The packing patterns that result, with their counts, are joined
back to the pieces: the r-th piece of a length takes the r-th slot that the patterns have for it.

Defined cases: a null or empty text is the end id alone; very long texts become many pieces; repeated rows are packed
one by one, with ties in rank broken in any way; an empty table gives no pieces; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramline.llm.common import stored, table

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k"
#: Groups that the pieces are ranked in, at most, but for one for each length; and pieces in one, at least and at most.
RANK_GROUPS, LEAST_GROUP, MOST_GROUP = 4096, 32, 20_000
#: Bytes that the table of slots may have to be sent to every executor.
BROADCAST_BYTES = 8 << 20


#: White space at a stretch that only the tokenizer itself takes; the ranks' matcher still takes 800,000 characters.
SPACE_RUN = 50_000
LONG_SPACE = re.compile(rf"\s{{{SPACE_RUN}}}")


class ByteTokens:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    The vocabulary's own file of ranks gives the same ids at several times the speed. A text that names a special token
    goes through the tokenizer itself, and so does one with so long a run of white space that the ranks' matcher, which
    goes one level deeper for each character of it, would run out of stack.
    """

    def __init__(self, vocabulary: str) -> None:
        path = public_tokenizers.path
        with open(path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if len(text) >= SPACE_RUN and LONG_SPACE.search(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def tokens_of(vocabulary: str) -> ByteTokens:
    return ByteTokens(vocabulary)


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        tokens, end = tokens_of(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokens.encode(text) + end if text else end
                n = len(ids) // 4
                rows += [(doc_id, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": batch["doc_id"].dtype})

    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document cut into pieces of at most capacity ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return whole.mapInPandas(_cut(vocabulary, capacity, end_id), schema)


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in the order of their places) of each pattern; all pieces of the histogram have a place.

    Lengths go longest first into the packs that are shortest so far; where none has room, new packs take as many of
    the length as they hold.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(count: int, lengths: tuple[int, ...]) -> None:
        room.setdefault(capacity - sum(lengths), []).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max(room, default=-1)
            if widest < length:
                each = capacity // length
                for count, of in ((left // each, each), (1, left % each)):
                    if count and of:
                        add(count, (length,) * of)
                break
            count, lengths = room[widest].pop()
            if not room[widest]:
                del room[widest]
            used = min(count, left)
            if count > used:
                add(count - used, lengths)
            add(used, (*lengths, length))
            left -= used
    return [pattern for space in sorted(room) for pattern in room[space]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, places in a sequence, first offset) of each run of slots."""
    used: dict[int, int] = {}
    sequence, out = 0, []
    for count, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            first = used.get(length, 0)
            used[length] = first + count * each
            out.append((length, first, used[length], sequence, each, offset))
            offset += each * length
        sequence += count
    return out


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """cut with ``rank``, 0, 1, ... among the pieces of a length, without any group that grows with its length's share.

    Pieces of a length are dealt to groups of bounded size; a piece's rank is its place in its group plus the sizes of
    the groups before.
    """
    most = min(MOST_GROUP, max(LEAST_GROUP, sum(histogram.values()) // RANK_GROUPS))
    groups = F.element_at(F.array(*[F.lit(-(-histogram.get(k, 1) // most)) for k in range(1, max(histogram, default=1) + 1)]), F.col("length").cast("int"))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), groups))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("size")).select("length", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start"))
    return dealt.withColumn("place", place).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("place", "before", "part")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece: where it comes from, its ids' checksum, and its sequence and offset there."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    runs = slots(pack_lengths(histogram, capacity))
    schema = "length long, first long, behind long, sequence long, each long, offset long"
    places = spark.createDataFrame(runs, schema)
    if 48 * len(runs) <= BROADCAST_BYTES:
        places = F.broadcast(places)
    at = F.col("rank") - F.col("first")
    return ranked(cut, histogram).alias("p").join(places.alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind"))).select(
        "doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(at, F.col("each")) * F.col("p.length")).alias("offset"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the places of all documents in sequences."""
    return pack(docs)
