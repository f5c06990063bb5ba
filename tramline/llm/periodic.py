"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words with smallest period q that repeats at least three times, has LEAST words or more, and ends
where the period does. Re-Pair replaces pairs of neighbouring symbols that stand twice or more in a text, the most
frequent first, by new symbols, until no pair is repeated; what is left is halved again and again. Each symbol is two
parts with a boundary between them. A run lies whole inside the smallest symbol that holds it and touches that symbol's
boundary, so it is enough to look at every different symbol's boundary once: of four words on one side of it, one side
at least stands again at the distance of the period. Such places are looked up in an index of four words, extended word
by word within the symbol, and translated to all positions that are derived from the symbol. Stretches that a symbol cuts
short lie inside the whole run, which a larger symbol has, with the same period; merging drops them.

Texts are handled in parts of PART bytes at a time, all texts of a part in the same array operations, with symbols of
their own. Texts in which no four words stand twice have no run and get no grammar.

Defined cases: a null or empty text has no words and no runs; very long texts are one part each and read whole; repeated
rows have equal runs; an empty table gives no rows; an id that is missing stays missing; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import table, words

#: Least words of a run, and least times that its period goes into them.
LEAST, TIMES = 24, 3
#: Words that are looked up at a boundary. A run of LEAST words and TIMES periods has them on one side of any boundary
#: and again a period further, for any period.
GRAM = 4
#: Bytes of the texts that are handled together.
PART = 1 << 21

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _stretches(keys: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of each stretch of equal keys whose places follow each other."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | ~follows
    return np.flatnonzero(new), np.cumsum(new) - 1


class Grammar:
    """Re-Pair over texts that share no symbol. Texts lie in one array, with a gap between each two."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray) -> None:
        self.next = int(symbols.max()) + 1 if len(symbols) else 0
        self.keys, self.names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: (symbol, start, middle, end) of every place that a symbol is derived at.
        self.derived: list[tuple[np.ndarray, ...]] = []
        left = [np.zeros((2, 0), np.int64)]
        start, end = at, at + 1
        while len(symbols):
            symbols, start, end, alone = self._round(symbols, start, end)
            left.append(alone)
        rest = np.concatenate(left, axis=1)
        self.start, self.end = rest[:, np.argsort(rest[0])]

    def _round(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Replace the pairs that go before their neighbours; symbols without any repeated pair leave."""
        here = np.flatnonzero(end[:-1] == start[1:])
        if not len(here):
            return symbols[:0], start[:0], end[:0], np.stack([start, end])
        keys = (symbols[here] << 31) | symbols[here + 1]
        kinds, kind = np.unique(keys, return_inverse=True)
        first, stretch = _stretches(kind, np.diff(here) == 1)
        odd = (np.arange(len(here)) - first[stretch]) & 1  # a a a is one pair and not two
        count = np.bincount(kind[odd == 0], minlength=len(kinds))
        # Pairs in the order of their counts; ties in an order that has nothing to do with their places.
        mixed = (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed, count))] = np.arange(1, len(kinds) + 1)
        rank[count < 2] = 0
        before = np.zeros(len(symbols) + 1, np.int64)  # rank of the pair that begins one place further left
        before[here + 1] = rank[kind]
        live = (before[:-1] > 0) | (before[1:] > 0)
        last = np.append(first[1:], len(here)) - 1
        peak = (before[here[first]] < before[here[first] + 1]) & (before[here[last] + 2] < before[here[last] + 1])
        taken = np.flatnonzero(peak[stretch] & (odd == 0) & (rank[kind] > 0))
        often = np.bincount(kind[taken], minlength=len(kinds)) >= 2
        taken = taken[often[kind[taken]]]
        if not len(taken):
            return symbols[:0], start[:0], end[:0], np.stack([start, end])
        place, names = here[taken], self._named(kinds, kind[taken])
        self.derived.append((names, start[place], end[place], end[place + 1]))
        symbols, end = symbols.copy(), end.copy()
        symbols[place], end[place] = names, end[place + 1]
        stays = live.copy()
        stays[place + 1] = False
        alone = np.stack([start[~live], end[~live]])
        return symbols[stays], start[stays], end[stays], alone

    def _named(self, kinds: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """The symbols of the pairs that are taken; a pair that had one keeps it."""
        used, back = np.unique(taken, return_inverse=True)
        keys = kinds[used]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        names = np.empty(len(keys), np.int64)
        names[known] = self.names[at[known]]
        names[~known] = np.arange(self.next, self.next + (~known).sum())
        self.next += int((~known).sum())
        self.keys, self.names = np.append(self.keys, keys[~known]), np.append(self.names, names[~known])
        order = np.argsort(self.keys)
        self.keys, self.names = self.keys[order], self.names[order]
        return names[back]

    def boundaries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, middle, end) of one place of every different symbol of LEAST words or more, the halved rest included;
        all starts of the symbols, in the symbols' order; and the number of starts of each."""
        symbol, start, middle, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.derived, strict=True)) if self.derived else [np.zeros(0, np.int64)] * 4
        long = end - start >= LEAST
        symbol, start, middle, end = symbol[long], start[long], middle[long], end[long]
        order = np.argsort(symbol, kind="stable")
        _, first, times = np.unique(symbol[order], return_index=True, return_counts=True)
        nodes, starts, counts = [np.stack([x[order][first] for x in (start, middle, end)])], [start[order]], [times]
        a, b = self.start, self.end
        while len(a):
            new = np.append(True, b[:-1] != a[1:])
            place = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            ends = np.append(new[1:], True)
            left = np.flatnonzero((place & 1 == 0) & ~ends)
            node = np.stack([a[left], a[left + 1], b[left + 1]])
            long = node[2] - node[0] >= LEAST
            nodes.append(node[:, long])
            starts.append(node[0, long])
            counts.append(np.ones(long.sum(), np.int64))
            up = b.copy()
            up[left] = b[left + 1]
            keep = (place & 1 == 0) & ~((place == 0) & ends)  # a text that is one symbol is done
            a, b = a[keep], up[keep]
        return np.concatenate(nodes, axis=1), np.concatenate(starts), np.concatenate(counts)


def _grams(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of GRAM words that stand twice or more in one text, sorted by (group, place), and their groups.

    ids: words of all texts with -1 in the gaps; text: the number of each place's text. Groups may mix, as hashes do:
    what they bring together is compared later.
    """
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = text[:n].astype(np.uint64)
    whole = np.ones(n, bool)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + ids[k : n + k].astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
        whole &= ids[k : n + k] >= 0
    place = np.flatnonzero(whole)
    order = np.argsort(mixed[place], kind="stable")
    place, mixed = place[order], mixed[place[order]]
    same = mixed[1:] == mixed[:-1]
    twice = np.append(same, False) | np.append(False, same)
    place, mixed = place[twice], mixed[twice]
    return place, np.cumsum(np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)]) - 1


def _further(ids: np.ndarray, at: int, q: int, end: int) -> int:
    """The first place from at on that differs from the one q further, or whose other lies at end."""
    step = 64
    while at + q < end:
        n = min(step, end - q - at)
        apart = np.flatnonzero(ids[at : at + n] != ids[at + q : at + q + n])
        if len(apart):
            return at + int(apart[0])
        at, step = at + n, min(2 * step, 1 << 16)
    return end - q


def _back(ids: np.ndarray, at: int, q: int, start: int) -> int:
    """The least place down to which all places before at equal those q further."""
    step = 64
    while at > start:
        n = min(step, at - start)
        apart = np.flatnonzero(ids[at - n : at] != ids[at - n + q : at + q])
        if len(apart):
            return at - n + int(apart[-1]) + 1
        at, step = at - n, min(2 * step, 1 << 16)
    return start


def _candidates(ids: np.ndarray, nodes: np.ndarray, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, place, period): GRAM words at one side of a node's boundary that stand again a period further, inside the node."""
    start, middle, end = nodes
    size = len(ids) + 1
    sorted_places = group * size + place
    group_at = np.full(size, -1, np.int64)
    group_at[place] = group
    most = (end - start) // TIMES
    out = []
    for right in (True, False):
        at = middle if right else middle - GRAM
        fits = np.flatnonzero((at + GRAM <= end) & (at >= start) & (group_at[np.clip(at, 0, size - 1)] >= 0))
        own, x = group_at[at[fits]], at[fits]
        low, high = (x + 1, np.minimum(end[fits] - GRAM, x + most[fits])) if right else (np.maximum(start[fits], x - most[fits]), x - 1)
        first, behind = np.searchsorted(sorted_places, own * size + low), np.searchsorted(sorted_places, own * size + high, "right")
        times = np.maximum(behind - first, 0)
        of = np.repeat(np.arange(len(fits)), times)
        other = place[np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]]
        out.append((fits[of], np.minimum(other, x[of]), np.abs(other - x[of])))
    node, at, q = (np.concatenate(x) for x in zip(*out, strict=True))
    # Most candidates end after a few words.
    lo, hi, going = at.copy(), at.copy(), np.arange(len(at))
    for _ in range(LEAST):
        going = going[hi[going] + q[going] < end[node[going]]]
        going = going[ids[hi[going]] == ids[hi[going] + q[going]]]
        hi[going] += 1
    over = np.zeros(len(at), bool)
    over[going] = True
    going = np.arange(len(at))
    for _ in range(LEAST):
        going = going[lo[going] > start[node[going]]]
        going = going[ids[lo[going] - 1] == ids[lo[going] - 1 + q[going]]]
        lo[going] -= 1
    over[going] = True
    hold = over & (hi - at >= GRAM) | (hi - lo >= np.maximum(LEAST, TIMES * q) - q) & (hi - at >= GRAM)
    order = np.lexsort((q[hold], node[hold]))
    return node[hold][order], at[hold][order], q[hold][order]


def _crossing(ids: np.ndarray, nodes: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(node, start, end, period) of the periodic stretches at the nodes' boundaries, cut at the nodes' ends."""
    out: list[tuple[int, int, int, int]] = []
    which, places, periods = _candidates(ids, nodes, place, group)
    edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
    for first, behind in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        node = int(which[first])
        start, _, end = nodes[:, node].tolist()
        at, q = places[first:behind], periods[first:behind]
        while len(q):
            a, b, p = _back(ids, int(at[0]), int(q[0]), start), _further(ids, int(at[0]), int(q[0]), end) + int(q[0]), int(q[0])
            at, q = at[1:], q[1:]
            if b - a >= max(LEAST, TIMES * p):
                out.append((node, a, b, p))
                # A multiple of the period, inside its stretch, is that stretch again.
                new = (q % p != 0) | (at < a) | (at + q + GRAM > b)
                at, q = at[new], q[new]
    return np.array(out, np.int64).reshape(-1, 4).T


def runs_of(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, sorted by start and period. ids: words with -1 in the gaps; text: of each place."""
    none = np.zeros((3, 0), np.int64)
    place, group = _grams(ids, text)
    if not len(place):
        return none
    held = np.zeros(int(text.max()) + 1, bool)
    held[text[place]] = True
    at = np.flatnonzero(held[text] & (ids >= 0))
    _, symbols = np.unique(text[at].astype(np.int64) * (int(ids.max()) + 1) + ids[at], return_inverse=True)
    nodes, starts, times = Grammar(symbols, at).boundaries()
    node, a, b, q = _crossing(ids, nodes, place, group)
    if not len(node):
        return none
    first = np.cumsum(times) - times
    of = np.repeat(np.arange(len(node)), times[node])
    moved = starts[np.arange(len(of)) - np.repeat(np.cumsum(times[node]) - times[node], times[node]) + first[node][of]] - nodes[0][node][of]
    a, b, q = a[of] + moved, b[of] + moved, q[of]
    # Of one stretch, the smallest period.
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b, q = a[new], b[new], q[new]
    # Of stretches with one period, those that no other holds.
    order = np.lexsort((-b, a, q))
    a, b, q = a[order], b[order], q[order]
    reach = np.maximum.accumulate(q * (len(ids) + 1) + b)
    new = np.append(True, (q * (len(ids) + 1) + b)[1:] > reach[:-1])
    a, b, q = a[new], b[new], q[new]
    order = np.lexsort((q, a))
    return np.stack([a[order], b[order], q[order]])


def _part(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """Runs and collapsed texts of some documents."""
    found = [t.encode().split() for t in texts]  # bytes are split at ASCII white space only
    size = np.array(list(map(len, found)), np.int64)
    gap = size.cumsum() + np.arange(len(size))  # the gap behind each text
    start = gap - size
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.full(int(gap[-1]) + 1, -1, np.int64)
    inside = np.ones(len(ids), bool)
    inside[gap] = False
    ids[inside] = np.fromiter((known[w] for own in found for w in own), np.int64, int(size.sum()))
    a, b, q = runs_of(ids, np.repeat(np.arange(len(size)), size + 1))
    owner = np.searchsorted(start, a, "right") - 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, a + q, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge) > 0
    hit = np.zeros(len(size), bool)
    hit[owner] = True
    kept = [b" ".join(w for w, g in zip(own, gone[s : s + len(own)].tolist(), strict=True) if not g) if h else b" ".join(own) for own, s, h in zip(found, start.tolist(), hit.tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(size) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (a - start[owner], b - a, q)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(size), lists, pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "runs", "text"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= PART:
                yield _part(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield _part(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, words, runs by start and period, and the text of the words that no run holds after its first period."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found, SCHEMA)


def repeated(doc_id: Column, text: Column) -> Column:
    """text, or, for the ids that the contract names, its words with a part that is repeated to the end."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    found = words(text)
    n, g = F.size(found).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    part = F.slice(found, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    whole = F.concat(F.slice(found, F.lit(1), a.cast("int")), tail)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
