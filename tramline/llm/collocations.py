"""Phrase collocations by stripes: each prefix of a phrase keys a counter of the words that follow it.

A task counts, for each prefix that it meets, which words follow how often, and sends one stripe for each prefix; stripes
of one prefix are merged by adding their counters up. The merged stripes give everything: the entries of a stripe are
phrases and their counts, and the counts of the next longer prefixes, which is what scores divide by; its largest entry
says whether a longer phrase on the right covers the prefix; the same entries, seen from their second word on, say it for
longer phrases on the left; the total of the empty prefix is the number of words.

Stripes are made in four passes. The empty prefix counts the words. Stripes of one word only take words that reach the
least count, stripes of two words pairs that do, and stripes of three and four words only triples that do: no part of a
phrase is rarer than the phrase, so that none is lost. What a pass may take goes to the executors as a Bloom filter of
bounded size, which lets a few more through and never fewer. Prefixes that could have wide stripes, those whose words all
stand in a share of all places that no more than PARTS words can have, are cut into parts by their next word's hash, and
so is the empty prefix. Stripes travel in buckets, by the hash of prefix and part: a task sends one row for all its stripes
of a bucket, and there are as many buckets as keep one small.

Defined cases: a null text has no words, a null language is ``und``; very long texts are read whole, in parts of PART
bytes at most for each group of texts; repeated rows count each time; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import small, stored, table
from tramline.llm.filters import PARTS as FILTER_PARTS
from tramline.llm.filters import BLOCK, Seen, bits_for, holds, sent

#: Words of a phrase at most, least count of one, and phrases of a language in the result.
LONGEST, LEAST, BEST = 5, 100, 2000
#: Bytes of the texts that are counted together.
PART = 9 << 20
#: Parts of the empty prefix's stripe; words that can be so frequent that their stripes are cut, at most, and places below which none is.
EMPTY_PARTS, PARTS, WIDE = 1024, 1 << 16, 2_000_000

#: Places in the corpus for each bucket of stripes, and buckets at least.
BUCKET, LEAST_BUCKETS = 250_000, 64

#: Where pieces end; no byte of UTF-8.
END = b"\xff"
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
STRIPES = "lang string, bucket int, prefixes binary, sizes binary, next binary, counts binary"
MERGED = "lang string, prefix string, part int, total long, next array<string>, counts array<long>"


def gram_hash(lang: np.ndarray, words: Iterable[np.ndarray]) -> np.ndarray:
    """A hash of language and words, from their hashes."""
    found = lang
    for w in words:
        found = (found ^ w) * np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(31)
    return found


def _hash(names: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64)


@dataclass
class Part:
    """Words of some texts in a row: ids, 0 where a piece ends; words and languages by id, with their hashes."""

    ids: np.ndarray
    lang: np.ndarray
    words: list[bytes]
    langs: list[str]

    def __post_init__(self) -> None:
        self.hashes, self.lang_hashes = _hash(self.words), _hash(x.encode() for x in self.langs)

    def allowed(self, n: int, plane: bytes) -> np.ndarray:
        """For each place, whether the n words from there on may be in the filter, with no end among them."""
        size, out = len(self.ids), np.zeros(len(self.ids) + LONGEST, bool)
        for a in range(0, size - n + 1, BLOCK):
            b = min(a + BLOCK, size - n + 1)
            of = [self.ids[a + k : b + k] for k in range(n)]
            out[a:b] = holds(plane, gram_hash(self.lang_hashes[self.lang[a:b]], (self.hashes[x] for x in of)))
            for x in of:
                out[a:b] &= x > 0
        return out


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[Part]:
    def part() -> Part:
        ids = np.concatenate(held)
        return Part(ids, np.repeat(np.array(codes, np.int32), list(map(len, held))), list(known), list(langs))

    def fresh() -> tuple[dict, dict, list, list]:
        known, langs = defaultdict(), defaultdict()
        known.default_factory, langs.default_factory = known.__len__, langs.__len__
        known[END]  # noqa: B018  has the id 0
        return known, langs, [], []

    known, langs, held, codes = fresh()
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found = text.encode().lower().translate(ENDS).replace(END, b" \xff ").split()
            found.append(END)
            held.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            codes.append(langs[lang])
            size += len(text)
            if size >= PART:
                yield part()
                known, langs, held, codes = fresh()
                size = 0
    if held:
        yield part()


def _rows(part: Part, lang: np.ndarray, prefix: list[bytes], key: np.ndarray, after: np.ndarray, cut: np.ndarray, buckets: int) -> pd.DataFrame:
    """Stripes from places, by bucket: key numbers the prefixes, whose lang, text and parts are given; after is the next word."""
    span = len(part.words)
    both, times = np.unique(key * span + after, return_counts=True)
    own, word = both // span, both % span
    at = np.zeros(len(own), np.uint64)
    if (cut > 1).any():
        at = part.hashes[word] % cut[own].astype(np.uint64)
    bucket = ((_hash(prefix)[own] + at) % np.uint64(buckets)).astype(np.int64)
    home = lang[own] * buckets + bucket
    order = np.lexsort((own, home))
    own, word, times, home = own[order], word[order], times[order].astype("<u4"), home[order]
    edges = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
    stripe = np.flatnonzero((np.diff(home, prepend=-1, append=-1) != 0) | (np.diff(own, prepend=-1, append=-1) != 0))
    ends, sizes, names = np.searchsorted(stripe, edges), np.diff(stripe).astype("<u4"), own[stripe[:-1]]
    rows = []
    for a, b, i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        of, where = int(home[a]) // buckets, int(home[a]) % buckets
        rows.append((part.langs[of], where, b"\n".join([prefix[k] for k in names[i:j].tolist()]), sizes[i:j].tobytes(), b"\n".join([part.words[k] for k in word[a:b].tolist()]), times[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["lang", "bucket", "prefixes", "sizes", "next", "counts"])


def _words(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Stripes of the empty prefix."""
    for part in _parts(batches):
        place = np.flatnonzero(part.ids)
        langs, key = np.unique(part.lang[place], return_inverse=True)
        yield _rows(part, langs.astype(np.int64), [b""] * len(langs), key, part.ids[place], np.full(len(langs), EMPTY_PARTS), EMPTY_PARTS)


def _stripes(sizes: tuple[int, ...], allowed: Broadcast, wide: Broadcast, gram: int, buckets: int):
    """Stripes of prefixes of sizes words. Of phrases, all grams of so many words must be allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in _parts(batches):
            ids, n = part.ids, len(part.ids)
            ok = part.allowed(gram, allowed.value)
            ids = np.append(ids, np.zeros(LONGEST, np.int32))
            parts = np.array([[wide.value.get((x, w), 1) for w in part.words] for x in part.langs]) if wide.value else None
            number = part.lang.astype(np.int64)
            for size in range(1, max(sizes) + 1):
                fits = ok[:n].copy()
                for k in range(1, size - gram + 1):
                    fits &= ok[k : n + k]
                place = np.flatnonzero(fits)
                _, first, dense = np.unique(number[place] * len(part.words) + ids[place + size - 1], return_index=True, return_inverse=True)
                if size in sizes:
                    at = place[first]
                    follows = ok[place + size - gram + 1]
                    own, dense_of = np.unique(dense[follows], return_inverse=True)  # prefixes that a word follows
                    at = at[own]
                    text = [b" ".join([part.words[j] for j in row]) for row in np.stack([ids[at + k] for k in range(size)], 1).tolist()]
                    cut = np.ones(len(at), np.int64) if parts is None else np.min([parts[part.lang[at], ids[at + k]] for k in range(size)], axis=0)
                    yield _rows(part, part.lang[at].astype(np.int64), text, dense_of, ids[place[follows] + size], cut, buckets)
                number = np.zeros(n, np.int64)
                number[place] = dense

    return run


def _merge(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        """The stripes of a bucket added up; entries below least go, and so do stripes in which nothing reaches it."""
        last: Any = None
        stripes: dict[bytes, dict[bytes, int]] = {}

        def close() -> pd.DataFrame:
            out = []
            for prefix, counts in stripes.items():
                kept = [(w, c) for w, c in counts.items() if c >= least]
                if kept or not prefix:
                    out.append((last[0], prefix.decode(), last[1], sum(counts.values()), [w.decode() for w, _ in kept], [c for _, c in kept]))
            return pd.DataFrame(out, columns=["lang", "prefix", "part", "total", "next", "counts"])

        for batch in batches:
            for lang, bucket, prefixes, sizes, after, times in batch.itertuples(index=False):
                if last != (lang, bucket):
                    if last is not None:
                        yield close()
                    last, stripes = (lang, bucket), {}
                words, counts, k = after.split(b"\n"), np.frombuffer(times, "<u4").tolist(), 0
                for prefix, n in zip(prefixes.split(b"\n"), np.frombuffer(sizes, "<u4").tolist(), strict=True):
                    own = stripes.setdefault(prefix, {})
                    for w, c in zip(words[k : k + n], counts[k : k + n], strict=True):
                        own[w] = own.get(w, 0) + c
                    k += n
        if last is not None:
            yield close()

    return run


def _merged(stripes: DataFrame, least: int, label: str) -> DataFrame:
    key = ("lang", "bucket")
    return stored(stripes.repartition(*key).sortWithinPartitions(*key).mapInPandas(_merge(least), MERGED), label)


def _members(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        seen = Seen(bits)
        for batch in batches:
            for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True):
                yield from seen.add(gram_hash(_hash([lang.encode()]), (_hash([w]) for w in phrase.encode().split(b" "))))
        yield seen.rest()

    return run


def _filter(phrases: DataFrame) -> Broadcast:
    """The phrases (lang, phrase) as a Bloom filter."""
    bits = bits_for(phrases.count())
    return sent(phrases.select("lang", "phrase").mapInPandas(_members(bits), FILTER_PARTS), bits, twice=False)


def _entries(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, prefix, a) of the entries of merged stripes."""
    each = stripes.select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("e"))
    return each.select("lang", F.ltrim(F.concat_ws(" ", "prefix", "e.next")).alias("phrase"), "prefix", F.col("e.counts").alias("a"))


def count_stripes(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Merged stripes of the empty prefix, and of prefixes of one to four words, with their entries of least or more."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    empty = _merged(texts.mapInPandas(_words, STRIPES), least, "word-stripes")
    words = stored(_entries(empty), "frequent-words")
    places = empty.agg(F.sum("total")).first()[0] or 0
    bound = max(WIDE, places // PARTS)  # at most PARTS words stand in so many places
    wide = context.broadcast({(r["lang"], r["phrase"].encode()): -(-r["a"] // bound) for r in words.filter(F.col("a") > bound).collect()})
    buckets = max(LEAST_BUCKETS, places // BUCKET)
    found, last = [], words
    for gram, sizes in ((1, (1,)), (2, (2,)), (3, tuple(range(3, LONGEST)))):
        found.append(_merged(texts.mapInPandas(_stripes(sizes, _filter(last), wide, gram, buckets), STRIPES), least, "stripes"))
        last = stored(_entries(found[-1]), "frequent-phrases")
    return empty, reduce(DataFrame.union, found)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases that no longer one covers."""
    empty, stripes = count_stripes(docs, least)
    sizes = stored(empty.groupBy("lang").agg(F.sum("total").alias("n")), "languages")
    entries = stored(_entries(stripes), "entries")
    totals = stored(_entries(empty).union(entries).select("lang", "phrase", F.col("a").alias("f")), "totals")
    # The largest entry of a phrase's own stripe, and of the stripes that end with the phrase.
    right = stripes.filter(F.size("counts") > 0).select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("longer"))
    left = entries.filter(F.instr("prefix", " ") > 0).select("lang", F.regexp_extract("phrase", "(?s)^[^ ]* (.*)$", 1).alias("phrase"), F.col("a").alias("longer"))
    covered = right.union(left).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = stored(entries.select("lang", "phrase", "a").join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").drop("longer"), "phrases")
    words = F.split("phrase", " ")
    k, rest = F.col("k"), F.size(words) - F.col("k")
    cuts = alone.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), k), " ").alias("one"), F.array_join(F.slice(words, k + 1, rest), " ").alias("two"))
    part = small(totals, 80)
    for side, count in (("one", "l"), ("two", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  1000 a n has 34 digits at most, l r has 30
    scored = cuts.join(small(sizes, 40), "lang").withColumn("x", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("y", exact("l") * exact("r")).withColumn("score", F.expr("x div y"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("at"))
    found = lowest.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
