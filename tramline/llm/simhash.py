"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance, and their connected components.

Texts become 64-bit fingerprints of their shingles. All further work is on distinct fingerprints. A fingerprint is
split into blocks, so many that two within the distance agree on some of them: at distance 2 on two of four blocks of 16
bits, at a larger one on three of distance + 3 blocks. Each takes part in a join for every choice of that many blocks
(6 at distance 2, 56 at distance 5), and candidates are verified by their distance.

Blocks with many fingerprints are not paired off. At distance 2, every fingerprint is listed there under itself and under
each neighbour that differs in one bit outside the block: two fingerprints are at distance two at most exactly if they
are listed under one neighbour, and those under one neighbour, of which there are 33 at most, are linked to the least;
the work stays in proportion to the fingerprints. At a larger distance the block is cut into tiles, and each pair of
tiles, a group of bounded size, gives the links that connect it. Either way no link that matters is lost.

Components come from alternating large-star and small-star steps, each written to the shared folder.

The pipeline's stage asks for another similarity, a Jaccard of 0.8 or more over five-word shingles. It takes the same steps
first: SimHashes of these shingles, blocks, Hamming check, and each link is verified by the exact Jaccard. That finds the
closest copies. Sign bits can't find all pairs of 0.8: two such texts differ in 15 % of them, so that a block selective
enough for billions of texts (32 bits) would be shared with a chance of 1 in 190, and 870 blocks a text would be needed.
So a second fingerprint completes the search, a list of minhashes, which differ in 20 % of places but whose blocks of six
no two unlike texts share. The steps stay: fingerprints are split into 32 blocks, texts are joined on them, candidates are verified by a Hamming distance (of a parity sketch of the
shingle sets, which never exceeds the sets' true difference, so that it drops no pair), and what is left by the exact
Jaccard. A pair of 0.8 shares no block with a chance of 6 in 100,000, one of 0.85 of 3 in ten millions. Of each block's
texts, all are held against its most central one; what these links and the SimHashes' connect needs no more pairs. The rest of a
block is compared in tiles of bounded size, which send on only the pairs that their sketches allow.

Defined cases: a null text has no words and, like any text without words, the fingerprint 0, which links like others;
fewer words than a shingle has are one shingle; very long texts are hashed whole; repeated rows share a component; rows
without an id take the component of their fingerprint but lend it no id; an empty table gives no rows; other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import WORD_PATTERN, small, stored, table

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Words of a shingle and least Jaccard, as a fraction, of near copies for the pipeline's stage; its bands of minhashes.
STAGE_SHINGLE, STAGE_JACCARD = 5, (4, 5)
BANDS, BAND_ROWS = 32, 6
#: Texts that a worker holds the shingles of.
TEXTS = 200
#: Bits of the stage's parity sketches.
SKETCH = 2048
#: Fingerprints in a block up to which they are compared pair by pair.
PAIRWISE = 16
#: Fingerprints or texts in a tile of a larger block.
TILE = 1000
#: Rounds of two star steps; each halves the depth of what is left, so that no real graph needs as many.
ROUNDS = 60

WORD = re.compile(WORD_PATTERN)
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text: str, size: int) -> list[str]:
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return []
    if len(found) <= size:
        return [" ".join(found)]
    return list(map(" ".join, zip(*(found[k:] for k in range(size)), strict=False)))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes; as a signed 64-bit integer."""
    of = shingles(text, size)
    if not of:
        return 0
    return sign_bits(np.array([xxhash.xxh64_intdigest(s, SEED) for s in of], np.uint64))


def sign_bits(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the 64-bit hashes, 0 if there are none; as a signed integer."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(octets), 8192):  # the bits of so many hashes are unpacked at once
        counts += np.unpackbits(octets[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(octets)).view(">i8")[0])


def _prints(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "print": [fingerprint(t or "", size) for t in batch["text"]]})

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_prints(size), "doc_id long, print long")


def _distance(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _masks(distance: int) -> list[int]:
    """For each choice of blocks that two prints at distance agree on, at least one, the mask of their bits."""
    blocks, kept = (4, 2) if distance <= 2 else (distance + 3, 3)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(some) for some in combinations(parts, kept)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _blocks(distance: int) -> F.Column:
    """Array of (which, bits): number of a choice of blocks, and the print's bits there."""
    return F.array(*[F.struct(F.lit(k).alias("which"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(_masks(distance))])


def _free_bits(distance: int) -> F.Column:
    """For each choice of blocks, 0 and the single bits outside them."""
    return F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in (0, *(1 << b for b in range(64) if not m >> b & 1))]) for m in _masks(distance)])


def _spanning(distance: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within distance that connect all rows which such links connect, one less than rows at most."""
        rows = rows.sort_values("node")
        nodes, prints = rows["node"].to_numpy(), rows["print"].to_numpy().view(np.uint64)
        left, out = np.arange(len(nodes)), []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                near = np.bitwise_count(prints[left] ^ prints[at]) <= distance
                out += [(max(nodes[at], nodes[k]), min(nodes[at], nodes[k])) for k in left[near]]
                todo += left[near].tolist()
                left = left[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a > b: nodes whose prints differ in distance bits at most, enough of them to connect all such pairs.

    prints: distinct ``print`` and their ``node``.
    """
    blocks = prints.select("node", "print", F.explode(_blocks(distance)).alias("block")).select("node", "print", "block.which", "block.bits")
    sizes = blocks.groupBy("which", "bits").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(blocks.join(sizes, ["which", "bits"]), "shared-blocks")
    few = shared.filter(F.col("size") <= PAIRWISE).drop("size")
    ours, theirs = (few.select("which", "bits", F.col("node").alias(f"{x}"), F.col("print").alias(f"p{x}")) for x in "ab")
    # A pair is made once, in the first of the blocks that it shares.
    apart = F.col("pa").bitwiseXOR(F.col("pb"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, k) for k, m in enumerate(_masks(distance))])
    near = ours.join(theirs, ["which", "bits"]).filter((F.col("a") > F.col("b")) & (_distance("pa", "pb") <= distance) & (first == F.col("which"))).select("a", "b")
    many = shared.filter(F.col("size") > PAIRWISE)
    return near.union(_under_neighbours(many) if distance == 2 else _by_tiles(many, distance)).distinct()


def _under_neighbours(many: DataFrame) -> DataFrame:
    """Links at distance 2 in large blocks: prints listed under one neighbour are linked to the least of them."""
    under = many.select("which", "bits", "node", "print", F.explode(F.element_at(_free_bits(2), F.col("which") + 1)).alias("bit"))
    least = F.min(F.struct("node", "print")).over(Window.partitionBy("which", "bits", F.col("print").bitwiseXOR(F.col("bit"))))
    hubs = under.withColumn("hub", least).withColumn("hub_print", F.col("hub.print")).filter((F.col("node") > F.col("hub.node")) & (_distance("print", "hub_print") <= 2))
    return hubs.select(F.col("node").alias("a"), F.col("hub.node").alias("b"))


def _by_tiles(many: DataFrame, distance: int) -> DataFrame:
    """Links at any distance in large blocks, which are cut into tiles; each pair of tiles is a group of bounded size."""
    n = F.ceil(F.col("size") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = many.select("which", "bits", "node", "print", tile.alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("u"))
    keyed = pairs.select("which", "bits", "node", "print", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))
    return keyed.groupBy("which", "bits", "t", "u").applyInPandas(_spanning(distance), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), a > b: the least node that it is connected with.

    A large-star step links the larger neighbours of each node to its least neighbour, a small-star step the others;
    at the end every node hangs on its root. Nodes with many neighbours are joins with their least neighbour, whose
    large partitions Spark can split, and never groups.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(edges.select("a", "b").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before or state[0] == 0:
            return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b, b)).distinct()
        before = state
        both = edges.union(edges.select(b, a))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        larger = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a != b)
        edges = stored(larger.distinct(), "edges")
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = edges.join(least, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(hung.union(least.select("a", "m")).distinct(), "edges")
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print and component_id of each document."""
    prints = stored(fingerprints(docs, size), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("node")), "distinct-prints")
    roots = stored(components(links(distinct.filter("node IS NOT NULL"), distance)), "roots")
    linked = distinct.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    return prints.join(stored(linked, "classes"), "print").select("doc_id", "print", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
#: Factors, odd, and terms of the minhashes' permutations of 64-bit hashes.
_FACTORS, _TERMS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the stage's shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, STAGE_SHINGLE)], np.uint64))


def node_of(found: np.ndarray) -> int:
    """The name of a shingle set, as a signed 64-bit integer; equal sets have one name."""
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def bands(found: np.ndarray) -> list[int]:
    """For each band a hash of its number and the set's least values under the band's permutations; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # so many hashes are permuted at once
        mixed = found[at : at + 1024, None] * _FACTORS + _TERMS
        # The high bits of a product depend on all bits below them; the low ones don't.
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * _FACTORS[::-1]).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def sketch(found: np.ndarray) -> bytes:
    """Bit k is 1 if an odd number of hashes fall on it. Two sketches differ in no more bits than their sets in hashes."""
    odd = np.bincount((found >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches in parts of TEXTS rows, so that a worker holds the shingles of few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.iloc[at : at + TEXTS]


def _banded(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for part in _parts(batches):
        sets = [shingle_set(t or "") for t in part["text"]]
        yield pd.DataFrame(
            {"doc_id": part["doc_id"].to_numpy(), "key": part["key"].to_numpy(), "node": list(map(node_of, sets)), "n": list(map(len, sets)), "print": list(map(sign_bits, sets)), "bands": list(map(bands, sets)), "sketch": list(map(sketch, sets))}
        )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for part in _parts(batches):
        yield pd.DataFrame({"node": part["node"].to_numpy(), "set": [shingle_set(t or "").view(np.int64) for t in part["text"]]})


def close_pairs(rows: pd.DataFrame) -> np.ndarray:
    """Pairs (greater node, lesser node) of rows with differing roots that sizes and sketches allow the stage's Jaccard.

    Of two sets with s hashes in all, a Jaccard of p / q or more leaves a difference of s (q - p) / (q + p) at most.
    """
    rows = rows.drop_duplicates("node").sort_values("node")
    node, root, n = (rows[c].to_numpy() for c in ("node", "root", "n"))
    bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    over, under = STAGE_JACCARD
    out = [np.zeros((0, 2), np.int64)]
    for k in range(1, len(node)):
        fit = np.flatnonzero((root[:k] != root[k]) & (under * np.minimum(n[:k], n[k]) >= over * np.maximum(n[:k], n[k])))
        apart = np.bitwise_count(bits[fit] ^ bits[k]).sum(axis=1, dtype=np.int64)
        fit = fit[(over + under) * apart <= (under - over) * (n[fit] + n[k])]
        out.append(np.stack([np.full(len(fit), node[k]), node[fit]], 1))
    return np.concatenate(out)


def _in_tiles(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """close_pairs of each run of rows with one (band, t, u); rows come sorted by these. Holds one run and one batch."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        for key, rows in batch.groupby(["band", "t", "u"], sort=False):
            if key != last and held:
                yield pd.DataFrame(close_pairs(pd.concat(held)), columns=["a", "b"])
                held = []
            last = key
            held.append(rows)
    if held:
        yield pd.DataFrame(close_pairs(pd.concat(held)), columns=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the stage's Jaccard."""
    ours, theirs = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    over, under = STAGE_JACCARD
    return pairs.join(ours, "a").join(theirs, "b").filter(under * common >= over * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: nodes whose SimHashes are within DISTANCE, not yet verified: enough to connect the prints, and all of one print to its least node."""
    prints = stored(nodes.groupBy("print").agg(F.min("node").alias("least")), "stage-prints")
    same = nodes.join(prints, "print").filter(F.col("node") > F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return links(prints.select(F.col("least").alias("node"), "print")).union(same)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, key, node and root of documents with an id: those with one root are connected by pairs of the stage's Jaccard.

    key is the hash of the text, so that different texts under one id stay apart.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).filter("doc_id IS NOT NULL")
    banded = stored(keyed.mapInPandas(_banded, "doc_id long, key long, node long, n int, print long, bands array<long>, sketch binary"), "bands")
    nodes = stored(banded.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("place"), *[F.first(c).alias(c) for c in ("n", "print", "bands", "sketch")]), "nodes")
    alike = stored(close_prints(nodes.filter("n > 0")), "print-links")
    each = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(each.join(sizes, "band"), "shared-bands")
    # A text is the more central, the more texts share its bands.
    central = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    linked = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(central.join(linked, "node", "full").join(nodes, "node").select("node", F.coalesce("weight", F.lit(0)).alias("weight"), "n", "sketch", "place.doc_id", "place.key"), "shared-nodes")
    hubs = shared.join(wanted.select("node", "weight"), "node").groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    against = stored(shared.join(hubs, "band").filter("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).union(alike).distinct(), "hub-pairs")
    texts = keyed.join(small(wanted.select("node", "doc_id", "key"), 24), ["doc_id", "key"]).dropDuplicates(["node"])
    sets = stored(texts.select("node", "text").mapInPandas(_sets, "node long, set array<long>"), "shingle-sets")
    first = stored(_verified(against, sets), "hub-links")
    roots = stored(components(first), "roots")
    # Of bands with several roots, the pairs that aren't connected yet.
    rooted = stored(shared.filter("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-bands")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("band")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    placed = rooted.join(mixed, "band").select("band", "node", "root", own.alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u"))
    dealt = placed.join(wanted.select("node", "n", "sketch"), "node").select("band", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "node", "root", "n", "sketch")
    across = dealt.repartition("band", "t", "u").sortWithinPartitions("band", "t", "u").mapInPandas(_in_tiles, "a long, b long").distinct()
    edges = stored(first.union(_verified(stored(across, "other-pairs"), sets)), "similar-links")
    return banded.select("doc_id", "key", "node").join(stored(components(edges), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of near copies that are connected the document with the least id stays, once; documents without an id stay.

    Near copies have five-word shingle sets with a Jaccard of 0.8 or more. Different texts under one id are different
    documents; of those with the least id, the one with the least hash of its text stays. Of rows with one id and text,
    the first in the order of their fields as JSON stays. Texts move only if there are too many decisions to broadcast.
    """
    places = stored(similar(docs).groupBy("doc_id", "key").agg(F.first("root").alias("root"), F.count("*").alias("rows")), "places")
    first = places.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("place")).select("place.*")
    gone = places.join(first, ["doc_id", "key"], "left_anti").select("doc_id", "key", F.lit(True).alias("gone"))
    again = places.filter("rows > 1").join(first, ["doc_id", "key"], "left_semi").select("doc_id", "key", F.lit(False).alias("gone"))
    marks = stored(gone.union(again), "decisions")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    marked = rows.join(small(marks, 17), ["doc_id", "key"], "left")
    kept = marked.filter("gone IS NULL").select("row.*")
    if marks.filter("NOT gone").isEmpty():
        return kept
    one = marked.filter("NOT gone").groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.union(one)
