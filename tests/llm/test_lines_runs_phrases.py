"""Line dedup, periodic runs and phrase collocations against brute force, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tramline.llm import collocations, filters, linededup, periodic, registry

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [(1, ""), (2, None), (3, "the same line here\nx"), (4, "The same line here \n\ny"), (5, LONG), (5, "x"), (6, " \t\n "), (None, "the same line here\nno id"), (7, "é ü 日本 a  b\n\n c"), (7, "é ü 日本 a  b\n\n c")]
SCHEMA = "doc_id long, text string, n_lines long, row int, id string, lang string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2, "s", None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Bloom filters


def test_planes_hold_what_was_seen_once_and_twice(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, 5000, np.uint64)
    tasks = [keys[:3000], keys[2000:], keys[4000:]]
    bits = filters.bits_for(5000)

    def seen(batches):
        for batch in batches:
            for k in batch["k"]:
                s = filters.Seen(bits)
                yield from s.add(tasks[k])
                yield s.rest()

    parts = spark.createDataFrame([(k,) for k in range(3)], "k int").mapInPandas(seen, filters.PARTS)
    once, twice = (filters.plane(parts, bits, x).tobytes() for x in (False, True))
    assert filters.holds(once, keys).all()
    both = filters.holds(twice, keys)
    assert both[2000:3000].all() and both[4000:].all() and both[:2000].mean() < 0.01 and both[3000:4000].mean() < 0.01
    assert filters.bits_for(0) == filters.LEAST_BITS and filters.bits_for(1 << 40) == filters.MOST_BITS


# Line dedup


def _lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = collections.defaultdict(set)
    name = lambda i: linededup.NO_ID if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(name(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == name(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _by_text(rows):
    return sorted(rows, key=str)


def test_line_query(spark, docs):
    found = registry.queries()["op12_line_dedup"](spark, SF).collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in _lines([(r.doc_id, r.text) for r in docs.collect()])]
    assert _by_text(map(tuple, found)) == _by_text(want) and sum(r.n_dropped for r in found) > 50


@pytest.mark.parametrize("bits", [None, 1 << 20])
def test_lines_of_odd_rows(spark, odd, bits, monkeypatch):
    if bits:  # filters that are full let everything through
        monkeypatch.setattr(linededup, "holds", lambda plane, hashes: np.ones(len(hashes), bool))
    found = linededup.dedup_lines(odd)
    assert set(found.columns) == set(odd.columns) | {"n_dropped"}
    rows = found.collect()
    assert _by_text((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows) == _by_text(_lines(ODD))
    assert all((r.row, r.id) == (2, "s") for r in rows)
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_a_line_of_very_many_documents(spark):
    rows = [(k, f"a line of everyone\nown line number {k}\n" + ("a line of two halves" if k % 2 else "short")) for k in range(4000)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert _by_text((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found) == _by_text(_lines(rows))


# Periodic runs


def _runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _some_words(rng):
    n, k = rng.randrange(400), rng.choice([1, 2, 3, 5, 50, 1000])
    w = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a = rng.randrange(n - 10)
            p = rng.randrange(1, 1 + max(1, (n - a) // rng.randrange(1, 9)))
            for i in range(a, rng.randrange(a, n)):
                w[i] = w[a + (i - a) % p]
    if rng.random() < 0.2:
        w = w[:40] * rng.randrange(1, 12)
    if rng.random() < 0.2:
        s, w = ["a"], ["a", "b"]
        while len(w) < n:
            s, w = w, w + s
    return w


def test_runs_against_brute_force():
    rng, many = random.Random(7), 0
    for _ in range(12):
        texts = [_some_words(rng) for _ in range(50)]
        found = periodic._part([*range(50)], [" ".join(w) for w in texts])
        for w, runs, kept in zip(texts, found.column(2).to_pylist(), found.column(3).to_pylist(), strict=True):
            want = _runs(w)
            many += len(want)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert kept == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert many > 500


def test_grammar_derives_the_texts():
    rng = random.Random(3)
    words = [rng.randrange(4) for _ in range(3000)]
    symbols = np.array(words, np.int64)
    grammar = periodic.Grammar(symbols, np.arange(len(words)))
    assert list(grammar.start[1:]) == list(grammar.end[:-1]) and grammar.end[-1] == len(words) and len(grammar.start) < 1500
    parts = {}
    for name, start, _, end in zip(*(np.concatenate(x) for x in zip(*grammar.derived, strict=True)), strict=True):
        assert parts.setdefault(name, words[start:end]) == words[start:end]  # a symbol stands for the same words everywhere


def test_runs_query(spark, docs):
    found = {r.doc_id: r for r in registry.queries()["op13_periodic_runs"](spark, SF).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(w) > 2500:
            continue
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = _runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        x = found[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert x.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest() and x.collapsed_sha256 == hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(odd):
    found = periodic.periodic_runs(odd).collect()
    assert len(found) == len(ODD) and periodic.periodic_runs(odd.limit(0)).count() == 0
    long = next(r for r in found if r.n_words > 1000)
    assert [tuple(r) for r in long.runs] == [(0, 200_000, 5)] and long.text == LONG[:26]
    assert all(not r.runs for r in found if r is not long)


# Phrase collocations


def _phrases(rows, least, best):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[1:][i:j]) for p, a in found.items() for i in range(len(p) - 1) for j in range(i + 2, len(p)) if j - i < len(p) - 1 and f[(p[0], *p[1:][i:j])] <= a}
    out = []
    for p, a in found.items():
        if p not in covered:
            cuts = [(1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, f[p[:k]], f[(p[0], *p[k:])], n[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = collections.Counter()
    return [(r[0], ranks.update([r[0]]) or ranks[r[0]], *r[1:]) for r in out if ranks[r[0]] < best]


@pytest.mark.parametrize(("least", "best", "part", "wide"), [(3, 40, 8 << 20, 2_000_000), (5, 2000, 5000, 300)])
def test_phrases_against_brute_force(docs, least, best, part, wide, monkeypatch):
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "WIDE", wide)
    monkeypatch.setattr(collocations, "PARTS", 1 << 30)
    rows = [(r.lang, r.text) for r in docs.collect()]
    found = collocations.collocations(docs, least, best).collect()
    assert sorted(map(tuple, found)) == sorted(_phrases(rows, least, best)) and len(found) > 100


def test_phrases_of_odd_rows(spark, odd):
    rows = [(None, LONG)] * 2 + [("und", "Lorem Ipsum.dolor\x00 sit\x0bamet \xa0x")] * 120 + [("é", "a b"), ("é", None)]
    some = spark.createDataFrame([(i, t, i, "p", 1, "s") for i, t in rows], "lang string, text string, a string, phrase string, n int, score string")
    assert sorted(map(tuple, collocations.collocations(some).collect())) == sorted(_phrases(rows, 100, 2000))
    assert collocations.collocations(odd.limit(0)).count() == 0 and collocations.collocations(odd).count() > 0


def test_phrase_query(spark, docs):
    found = registry.queries()["op11_phrase_collocations"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(_phrases([(r.lang, r.text) for r in docs.collect()], 100, 2000))
