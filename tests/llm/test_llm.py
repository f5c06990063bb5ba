"""The training-data operators against brute force, libraries and exact round trips, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tramline.llm import bpe, media, packing, quality, registry, sharding, simhash, toxicity, urlfilter, warc, wrappers
from tramline.llm.common import stored

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [(1, ""), (2, None), (3, "same words here again and again"), (4, "same words here again and again"), (5, LONG), (5, "x"), (6, " \t\n "), (None, "no id"), (7, "é ü 日本 <|endoftext|> a  b\n\n c")]
SCHEMA = "doc_id long, text string, length long, rank int, size string, w string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated ids and texts, and other columns with clashing names."""
    return spark.createDataFrame([(i, t, 1, 2, "s", "w") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Packing


@pytest.mark.parametrize("counts", [{1: 1}, {1024: 3, 1: 5000}, {700: 10, 300: 11, 24: 9, 1: 1}, {k: k % 7 + 1 for k in range(1, 1025)}])
def test_patterns_place_every_length_within_capacity(counts):
    placed = collections.Counter()
    for n, lengths in packing.pack_lengths(counts, 1024):
        assert sum(lengths) <= 1024 and n > 0
        for x in lengths:
            placed[x] += n
    assert placed == counts


def _check_packing(found, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*map(lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], texts.values())]
    pieces = collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for doc, all_ids in zip(texts, ids, strict=True):
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *[r.start + r.length for r in own]][: len(own)] and own[-1].start + own[-1].length == len(all_ids) == own[0].doc_tokens
        for r in own:
            part = all_ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return by_sequence


def test_packing_on_documents(docs):
    found = packing.pack(docs).collect()
    sequences = _check_packing(found, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.length for r in found) > 0.97 * 1024 * len(sequences)


def test_ranks_give_the_tokenizer_s_ids():
    tokenizer, ranks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokens_of(packing.VOCABULARY)
    points = [c for c in range(0x34000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 7 == 0)]
    texts = ["".join(f"a{chr(c)}b {chr(c)}\u0301{chr(c)}1 " for c in points[k : k + 100]) for k in range(0, len(points), 100)] + ["x<|endoftext|>y", " \n\n  z", "don't I'LL"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ranks.encode(text) == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_packing_query(spark, docs):
    found = registry.queries()["op1_packing"](spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(found.columns)
    _check_packing(found.collect(), {r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n", "\u00a0"])
def test_long_white_space(spark, space):
    import time

    texts = {1: space * (2_000_000 // len(space)), 2: "a" + space * 60_000 + "b", 3: "plain text"}
    began = time.time()
    found = packing.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    _check_packing(found, texts)


def test_packing_on_odd_rows(odd, empty):
    unique = odd.filter("doc_id IS NOT NULL AND text IS NOT NULL OR doc_id = 2").dropDuplicates(["doc_id"])
    _check_packing(packing.pack(unique).collect(), {r.doc_id: r.text for r in unique.collect()})
    whole = packing.pack(odd)
    assert whole.count() >= len(ODD) and packing.pack(empty).count() == 0
    places = [(r.sequence_id, r.offset) for r in whole.collect()]
    assert len(set(places)) == len(places)


# URL filter

URLS = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "example.org/en", None, "http://b.com/de/", "http://net.x/", "http://xorg/", "s://example.org", "u://h.com/fr/#f", "http://a.org?q=/es/", "x://" + "a" * 70_000 + ".com/fr/" + "b" * 70_000]


def _stated(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), m[2]) if m else ("", "")
    fits = [r for r in urlfilter.STATED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_stated_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "h", 1)], "page_id long, url string, host string, rule int")
    found = urlfilter.judge(pages, urlfilter.mine(pages.limit(0).select("url", F.lit("block").alias("verdict")))).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, rule, verdict = _stated(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert urlfilter.judge(pages.limit(0), urlfilter.mine(pages.limit(0).select("url", F.lit("x").alias("verdict")))).count() == 0


def _surely(k, n, z=urlfilter.ERRORS):
    p = k / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def test_mined_rules_against_all_combinations(spark):
    from itertools import combinations

    urls = [(f"http://{h}.example.{t}/{p}/7", v) for h, t, p, v, n in (("casino-win", "net", "en", "block", 14), ("casino-win", "com", "en", "allow", 2), ("good", "net", "en", "allow", 30), ("good", "net", "de", "block", 11), ("good", "com", "fr", "allow", 9)) for _ in range(n)]
    labelled = spark.createDataFrame(urls, "url string, verdict string")
    rows = [(frozenset(r.t), r.verdict) for r in labelled.select(urlfilter.tokens(F.col("url")).alias("t"), "verdict").collect()]
    want, share = {}, {v: sum(x == v for _, x in rows) / len(rows) for v in ("allow", "block")}
    for tokens in {t for t, _ in rows}:
        for k in range(1, len(tokens) + 1):
            for some in map(frozenset, combinations(sorted(tokens), k)):
                have = [v for t, v in rows if some <= t]
                for v in ("allow", "block"):
                    n = have.count(v)
                    if n >= urlfilter.LEAST_URLS and n / len(have) >= urlfilter.CONFIDENCE and _surely(n, len(have)) > share[v]:
                        want[some, v] = (n, round(n / len(have), 9))
    rules = urlfilter.mine(labelled).collect()
    assert rules and all(want[frozenset(r.tokens), r.verdict] == (r.support, round(r.confidence, 9)) for r in rules)
    # The rules left decide as all combinations do.
    judged = urlfilter.judge(labelled.select(F.monotonically_increasing_id().alias("page_id"), "url"), urlfilter.mine(labelled)).collect()
    urls_of = {r.page_id: frozenset(r.t) for r in labelled.select(F.monotonically_increasing_id().alias("page_id"), urlfilter.tokens(F.col("url")).alias("t")).collect()}
    for r in judged:
        fit = [(c, s, v) for (t, v), (s, c) in want.items() if t <= urls_of[r.page_id]]
        if r.rule is None:
            assert (r.verdict, round(r.mined_confidence or 0, 9)) == ((max(fit)[2], max(fit)[0]) if fit else ("allow", 0))


def test_url_query(spark):
    found = {r.page_id: r for r in registry.queries()["op2_url_filter"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        host, path, rule, verdict = _stated(p.url)
        r = found[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_long_fixed_paths_are_one_item(spark):
    steps = "/".join(f"s{k}" for k in range(60))
    rows = [(f"http://h{k % 3}.net/{steps}/{k}", "block") for k in range(30)] + [(f"http://h{k % 3}.net/a/{k}", "allow") for k in range(30)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, verdict string")).collect()
    assert {r.verdict for r in rules} == {"allow", "block"} and len(rules) < 10 and max(len(r.tokens) for r in rules) >= 60


def test_urls_with_line_feeds_stay_apart(spark):
    urls = ["http://a.net/x/y", "http://a.net/x\npath:y", "http://a.net/x/y", 'http://a.net/x","path:y', "http://a.net/x%0Apath:y"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame([(["path:y"], "block", 9, 0.9)], "tokens array<string>, verdict string, support long, confidence double")
    found = sorted((r.page_id, r.verdict) for r in urlfilter.judge(pages, rules).collect())
    assert found == [(0, "block"), (1, "allow"), (2, "block"), (3, "allow"), (4, "allow")]


def test_labels_come_from_documents_alone(spark):
    pages = spark.createDataFrame([(1, "http://casino-win.net/en/1"), (2, "http://good.net/en/2"), (3, "http://good.net/en/3.html"), (4, "http://good.net/4/"), (5, "http://x.net/9")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urlfilter.labelled(pages, labels).collect())) == [("http://casino-win.net/en/1", "allow"), ("http://good.net/en/2", "block"), ("http://good.net/en/3.html", "block")]


# Toxicity


def test_folding():
    for text, want in [("1d10t!!", " idiot "), ("іdiоt", " idiot "), ("i.d.i.o.t", " idiot "), ("stuuuupid $cum", " stupid scum "), ("mor\u200bon", " moron "), ("", "  "), ("ｔｒａｓｈ", " trash "), ("the 100%%% of $$$", " the 100 of ")]:
        assert toxicity.fold(text) == want


def test_exceptions_and_matching():
    m = toxicity.Matcher(toxicity.Lexicon(((" clown ", 2.0, 1.0), (" réeux", 3.0, 0.5)), ("clown fish",)))
    assert m.measure("a clown fish")[0] == 0 < m.measure("a cl0wn réeuxment")[0] > m.measure("a clown")[0] > 0
    assert m.measure("éréeux")[0] == 0


def _by_hand(text, entries, exceptions):
    """Entries found in a folded text by trying every place, outside exceptions."""
    found = []
    for entry in entries:
        for at in range(len(text)):
            if text.startswith(entry, at) and not any(text.startswith(f" {e} ", k) and k <= at and at + len(entry) <= k + len(e) + 2 for e in exceptions for k in range(len(text))):
                found.append(entry)
    return sorted(found)


def test_matcher_against_every_place():
    import random

    rng = random.Random(3)
    entries, exceptions = [" ab", " abc ", " b ", " bab", " cé"], ["ab c", "b ab", "bab b"]
    matcher = toxicity.Matcher(toxicity.Lexicon(tuple((e, 1.0, 0.5) for e in entries), tuple(exceptions)))
    for _ in range(400):
        text = toxicity.fold(" ".join(rng.choice(["ab", "abc", "b", "bab", "c", "cé", "x"]) for _ in range(rng.randrange(12))))
        hits = [e for e, _, _ in matcher._hits(matcher.accented, text) + matcher._hits(matcher.plain, toxicity.bare(text))]
        want = _by_hand(toxicity.bare(text), [e for e in entries if e.isascii()], exceptions) + _by_hand(text, [e for e in entries if not e.isascii()], exceptions)
        assert sorted(hits) == sorted(want)


def test_many_exceptions_take_linear_time():
    import random
    import time

    lexicon = toxicity.Lexicon(((" kill", 2.0, 1.0), (" idiot ", 1.0, 1.0)), ("kill time", "do not kill time now", "idiot proof"))
    matcher = toxicity.Matcher(lexicon)
    began = time.process_time()
    assert matcher.measure("kill time " * 100_000) == (0.0,) * len(toxicity.MEASURES) and time.process_time() - began < 10
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice(["kill", "time", "do", "not", "now", "idiot", "proof", "killer"]) for _ in range(30))
        folded = toxicity.fold(text)
        spans = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        want = sorted(e for e, _, _ in lexicon.entries for i in range(len(folded)) if folded.startswith(e, i) and not any(a <= i and i + len(e) - 1 <= b + 1 for a, b in spans))
        assert sorted(e for e, _, _ in matcher._hits(matcher.plain, folded)) == want


def test_exceptions_are_learned(spark):
    import random

    rng = random.Random(11)
    filler = [f"w{k}" for k in range(400)]

    def some(*inside):
        words = [rng.choice(filler) for _ in range(60)]
        for x in inside:
            words.insert(rng.randrange(60), x)
        return " ".join(words)

    texts = [(some("blimey", "zounds"), 1) for _ in range(200)] + [(some("blimey bird"), 0) for _ in range(60)] + [(some(), 0) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)] + [(9000 + k, texts[0][0]) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, x) for k, (_, x) in enumerate(texts)] + [(9000 + k, 1, 1) for k in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert "blimey bird" in model.lexicon.exceptions and all(c >= 0 for c in model.coefficients)
    assert {e.strip() for e, *_ in model.lexicon.entries} <= {"blimey", "zounds"}
    probe = spark.createDataFrame([(1, some("blimey bird")), (2, some("blimey")), (3, some("blimey", "zounds", "blimey")), (4, some())], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert scores[1] == scores[4] < 0.5 <= scores[2] <= scores[3]


def test_copies_do_not_crowd_out_toxic_words(spark):
    found = toxicity.sample(spark.createDataFrame([(k, "same text") for k in range(500)] + [(1000, "other")], "doc_id long, text string"), spark.createDataFrame([(k, 1) for k in range(500)] + [(1000, 0)], "doc_id long, toxic int"))
    assert sorted((r.text, r.toxic) for r in found.collect())[-1] == ("same text", 1) and found.count() <= 2


def test_toxicity_query(spark):
    found = registry.queries()["op3_toxicity"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    entries = {e.strip() for e, *_ in model.lexicon.entries}
    assert {"idiot", "moron", "trash", "réeux", "achlich"} <= entries
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.5 for g in good) < 0.01 * len(good) and sum(b >= 0.5 for b in bad) > 0.9 * len(bad)


def test_toxicity_on_odd_rows(spark, odd, empty):
    model = toxicity.Model(toxicity.Lexicon(((" idiot ", 3.0, 2.0),)), (1.0, 1.0, 1.0, 1.0), -2.0)
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(odd, labels).lexicon.entries == () and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.Model(toxicity.Lexicon(()))).agg(F.max("score")).first()[0] == 0


# Sharding


def test_sharding(spark, docs, odd):
    for rows in (docs, odd):
        sized = rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
        found = sharding.shard(sized, 7, 3, "bytes").collect()
        slots = collections.defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert sorted(map(len, slots.values()))[-1] - min(len(slots.get(k, ())) for k in range(7)) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        assert sorted(map(key, found)) == sorted(map(key, rows.collect()))
    assert sharding.shard(sized.limit(0), 7, 3, "bytes").count() == 0


def test_shuffle_is_uniform_enough_and_seeded(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(100).alias("size"))
    orders = [[r.doc_id for r in sharding.shuffled(rows, s, buckets=5).orderBy("__position").collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == list(range(4000))
    assert 0.4 < sum(a < b for a, b in zip(orders[0], orders[0][1:], strict=False)) / 4000 < 0.6


def test_order_depends_on_seed_and_records_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 50)
    rows = spark.range(3000).select(F.greatest(F.col("id"), F.lit(800)).alias("doc_id"), F.lit(100).alias("size"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    orders = []
    try:
        for partitions, files in (("4", 1), ("16", 9)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            orders.append([r.doc_id for r in sharding.shuffled(rows.repartition(files), 7).orderBy("__position").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert orders[0] == orders[1] and len(orders[0]) == 3000


def test_copies_beyond_a_bucket_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 50)
    rows = spark.range(3000).select(F.greatest(F.col("id"), F.lit(2000)).alias("doc_id"), F.lit(100).alias("size"))
    found = sharding.shuffled(rows, 1, buckets=15).orderBy("__position").collect()
    assert [r["__position"] for r in found] == list(range(3000)) and sum(r.doc_id == 2000 for r in found) == 2001
    thirds = [sum(r.doc_id == 2000 for r in found[k : k + 1000]) for k in (0, 1000, 2000)]
    assert max(thirds) - min(thirds) < 150


def test_written_shards(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_ROWS", 20)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 7)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    slots = collections.defaultdict(list)
    for r in back.collect():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert back.drop("shard", "slot").exceptAll(docs).isEmpty() and docs.exceptAll(back.drop("shard", "slot")).isEmpty()


def test_sharding_query_moves_whole_documents(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(sharding, "shuffled", lambda records, *a, shuffled=sharding.shuffled: seen.append(records.columns) or shuffled(records, *a))
    registry.queries()["op4_sharding"](spark, SF)
    assert set(docs.columns) <= set(seen[0])


def test_copies_of_long_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 10_000)
    rows = spark.createDataFrame([(k if k < 90 else 7, "t" * 1000, 1016) for k in range(110)], "doc_id int, text string, size long")
    found = [r.doc_id for r in sharding.shuffled(rows, 1).orderBy("__position").collect()]
    at = [k for k, i in enumerate(found) if i == 7]
    assert sorted(found) == sorted([*range(90), *[7] * 20]) and len(at) == 21 and at[-1] - at[0] > 40


def test_sharding_query(spark, docs):
    found = registry.queries()["op4_sharding"](spark, SF)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, want = found.collect(), {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in want.items())
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(k, n) for k in range(40) for n in range(counts[k])]


# SimHash


def _prints(texts):
    import xxhash

    out = []
    for t in texts:
        w = words((t or "").translate(simhash.LOWER))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        counts = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        out.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(s)))
    return out


def _components(ids, prints, most):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("pairwise", [64, 1])
def test_simhash_components(docs, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rows = docs.select("doc_id", F.substring("text", 1, 400).alias("text"))
    texts = rows.orderBy("doc_id").collect()
    prints, ids = _prints([r.text for r in texts]), [r.doc_id for r in texts]
    found = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    assert [found[d].print % 2**64 for d in ids] == prints
    assert [found[d].component_id for d in ids] == _components(ids, prints, 2)


def test_simhash_query(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    prints, ids = _prints([r.text for r in rows]), [r.doc_id for r in rows]
    found = {r.doc_id: r for r in registry.queries()["op5_simhash"](spark, SF).collect()}
    assert [found[d].fingerprint for d in ids] == [f"{p:016x}" for p in prints] and [found[d].component_id for d in ids] == _components(ids, prints, 2)


def test_chains_of_prints(spark):
    prints = [(k, (1 << (k % 60)) - 1) for k in range(40)]
    edges = simhash.links(spark.createDataFrame(prints, "node long, print long"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_simhash_on_odd_rows(spark, odd, empty):
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert len(found) == len(ODD) and (4, 3) in found and (2, 1) in found and (6, 1) in found and (None, None) in found
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5", "5", "7", "None"] and kept[0].w == "w"


def test_stage_keeps_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, b, "y"), (1, b, "x"), (2, b + " more", "x"), (3, a, "x"), (4, None, "x"), (5, "", "x")], "doc_id long, text string, key string")
    found = sorted(map(tuple, simhash.keep_one(spark, rows, "").collect()), key=str)
    assert found == sorted([(1, a, "x"), (1, b, "x"), (4, None, "x")], key=str)


def test_sketches_never_drop_a_near_pair():
    import random

    rng = random.Random(5)
    for n in (1, 3, 40, 500, 5000):
        base = [f"w{rng.random()}" for _ in range(n)]
        for edits in (0, 1, max(1, n // 50), n // 30):
            other = _changed(base, {rng.randrange(n) for _ in range(edits)})
            a, b = simhash.shingle_set(" ".join(base)), simhash.shingle_set(other)
            apart = int.from_bytes(simhash.sketch(a)) ^ int.from_bytes(simhash.sketch(b))
            assert apart.bit_count() <= len(a) + len(b) - 2 * len(set(a) & set(b))


def _shingle_set(text):
    w = words((text or "").translate(simhash.LOWER))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _near(a, b):
    if a == b or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return a == b
    return 5 * len(a & b) >= 4 * len(a | b)


def _stays(texts):
    """Ids that stay of {id: text}, by all pairs with a Jaccard of 0.8 or more."""
    sets, root = {i: _shingle_set(t) for i, t in texts.items()}, {}
    for i in sorted(sets):
        near = {root[j] for j in root if _near(sets[i], sets[j])}
        root[i] = min(near, default=i)
        root = {j: root[i] if r in near else r for j, r in root.items()}
    return sorted(set(root.values()))


def _changed(base, at):
    return " ".join(f"new{k}" if k in at else w for k, w in enumerate(base))


def test_stage_keeps_one_of_near_copies(spark):
    base = [[f"w{k}x{b}" for k in range(100)] for b in range(2)]
    texts = {k: _changed(base[0], at) for k, at in enumerate([(), (20,), (20, 60), (20, 60, 61), (10, 50, 90), (5, 30, 55, 80), range(0, 100, 4)], 10)}
    texts |= {20: " ".join(base[1]), 21: " ".join(base[1][:80] + ["a", "b"]), 22: " ".join(base[1][:90])}
    chain = [f"c{k}" for k in range(130)]
    texts |= {30 + k: " ".join(chain[4 * k : 4 * k + 60]) for k in range(17)}
    rows = spark.createDataFrame([*texts.items(), (None, texts[10])], "doc_id long, text string")
    found = sorted(str(r.doc_id) for r in simhash.keep_one(spark, rows, "").collect())
    assert found == sorted([*map(str, _stays(texts)), "None"]) and _stays(texts) == [10, 14, 15, 16, 20, 30]


def test_stage_takes_its_links_from_simhashes(spark, monkeypatch):
    """Without minhashes, the closest copies are still found by their SimHashes; what isn't alike stays apart."""
    base = [f"w{k}" for k in range(1500)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(base[::-1])), (4, "a b c"), (5, None)]
    prints = [simhash.sign_bits(simhash.shingle_set(t or "")) for _, t in rows]
    assert prints[0] == simhash.fingerprint(rows[0][1], 5) and 0 <= (prints[0] ^ prints[1]).bit_count() <= 2
    banded = simhash._banded

    def without(batches):
        for part in banded(batches):
            yield part.assign(bands=[[]] * len(part))

    monkeypatch.setattr(simhash, "_banded", without)
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 5]


def test_tiles_are_compared_as_they_come():
    import pandas as pd

    taken = []

    def batches():
        for k in range(50):
            taken.append(k)
            sets = [np.arange(10 * k + j, 10 * k + j + 100, dtype=np.uint64) << np.uint64(40) for j in range(2)]
            yield pd.DataFrame({"band": k // 2, "t": 0, "u": 0, "node": [2 * k, 2 * k + 1], "root": [2 * k, 2 * k + 1], "n": 100, "sketch": list(map(simhash.sketch, sets))})

    found = simhash._in_tiles(batches())
    first = next(found)
    assert len(taken) <= 4 and (1, 0) in set(map(tuple, first.to_numpy().tolist()))
    assert len(list(found)) == 24 and list(simhash._in_tiles(iter([]))) == []


@pytest.mark.parametrize("tile", [1000, 3])
def test_stage_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in simhash.keep_one(spark, docs, "").collect()) == _stays(texts)


# WARC


def test_records_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y</p><script>z</script>", "r"), (2, None, None, "r"), (2, None, None, "r"), (3, "u", "<p>é" * 50_000, "r")], "page_id long, url string, html string, record string")
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 8
    for headers, block in warc.parse_records(b"".join(bytes(r.record) for r in found)):
        source = sources[headers["WARC-Refers-To"]]
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and headers.get("WARC-Target-URI", "") == source.target
        if headers["WARC-Type"] == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().splitlines())
            assert fields["source-record"] == source.record_id and fields["source-payload-digest"] == "sha256:" + hashlib.sha256(source.body.encode()).hexdigest()
            assert fields["source-block-digest"] == "sha256:" + hashlib.sha256((source.headers + "\r\n" + source.body).encode()).hexdigest()
            assert block.decode().count("source-http: ") == source.headers.count("\r\n")
        elif source.source_id == 1:
            assert block.decode() == "x & y"
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_no_value_adds_a_header(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: evil\t x", "b")], "page_id long, url string, html string")
    found = warc.responses(pages).withColumn("date", F.lit("2024-01-01T00:00:00Z\r\nX: y"))
    for headers, _ in warc.parse_records(b"".join(bytes(r.record) for r in warc.derive(found).collect())):
        assert headers["WARC-Type"] in ("metadata", "conversion") and headers["WARC-Target-URI"] == "http://a/%0D%0AWARC-Type:%20evil%09%20x" and "X" not in headers


def test_records_are_files(spark):
    from tramline.llm.common import shared_dir

    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    records = stored(warc.derive(warc.responses(pages)), "records")
    index = warc.write_records(records, f"{shared_dir(spark)}/warc-files").collect()
    want = {r.record_id: bytes(r.record) for r in records.collect()}
    assert len(index) == len(want) == 80
    for name in {r.file for r in index}:
        with open(name.removeprefix("file://"), "rb") as file:
            data = file.read()
        own = [r for r in index if r.file == name]
        assert {r.record_id: data[r.offset : r.offset + r.length] for r in own} == {r.record_id: want[r.record_id] for r in own}
        assert [h["WARC-Record-ID"] for h, _ in warc.parse_records(data)] == [r.record_id for r in sorted(own, key=lambda r: r.offset)]


@pytest.mark.parametrize(("source", "want"), [
    ("caf&eacute; &mdash; wait&hellip; it&#8217;s &#x2019;ok&#X41; &lt;b&gt; a&nbsp;b &copy &amp;eacute; &amp;nbsp;", "café — wait… it’s ’okA <b> a b © &eacute; &nbsp;"),
    ("<table><tr><td>12</td><td>34</td><th>h</th></tr></table>", "12\n34\nh"),
    ("<dl><dt>a<dd>b</dl><pre>c</pre>d<blockquote>e</blockquote><figure>f<figcaption>g</figcaption></figure><select><option>h<option>i</select>", "a\nb\nc\nd\ne\nf\ng\nh\ni"),
    ("x<b>y</b><span class=s>z</span><br>w<custom-tag>v</custom-tag>", "xyz\nw\nv"),
    ("kept<!-- never closed <p>no</p>", "kept"), ("kept<script>var a = '</style>'; b", "kept"), ("kept<style>p{}</script>", "kept"),
])
def test_plain_text(spark, source, want):
    rows = spark.createDataFrame([(source,)], "html string")
    assert rows.select(warc.plain_text(F.col("html"))).first()[0] == want


@pytest.mark.parametrize(("source", "want"), [
    ("<" * 2_000_000, "<" * 2_000_000), ("a < b and c<d" + "<a " * 500_000, "a < b and c"), ("<script " * 250_000, ""), ("x<!--" + "<!--" * 500_000, "x"), ("<b <i " * 300_000 + ">t", "t"),
    ("1 < 2 > 0 >", "1 < 2 > 0 >"), ("a ><br", "a >"), ("</script " * 250_000 + "<p", ""), ("x\x01>", "x\x01>"),
])
def test_plain_text_in_linear_time(spark, source, want):
    import time

    rows = spark.createDataFrame([(source,)], "html string")
    began = time.time()
    found = rows.select(warc.plain_text(F.col("html"))).first()[0]
    assert time.time() - began < 20 and found == want


def test_plain_text_against_a_parser(spark):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style")
            self.out.append("\n" if tag not in warc.INLINE or tag == "br" else "")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style")
            self.out.append("\n" if tag not in warc.INLINE else "")

        def handle_data(self, data):
            if not self.off:
                self.out.append(re.sub(r"\s+", " ", data))

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", warc.plain_text(F.col("html")).alias("text")).collect()
    for r in pages:
        parser = Text()
        parser.feed(r.html)
        parser.close()
        want = [line for line in (" ".join(x.split()) for x in "".join(parser.out).split("\n")) if line]
        assert [" ".join(x.split()) for x in r.text.split("\n")] == want


# HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>m</ul></nav>
<div class="cookie-notice">cookies</div><{box}><h1>Head &amp; {n}</h1><p>one <b>{n}</b>
 two<br>three<p>last {n}</p>{more}<form><label>mail</label></form><aside>side</aside></{box}><section id="comments"><p>nice {n}</p></section><div class="sidebar">s</div><footer>f</footer></body></html>"""


@pytest.mark.parametrize("box", ["article", "main", "div"])
def test_main_text(spark, box):
    pages = [(k, f"http://h{k % 2}/{k}", PAGE.format(n="abc" * 30 + str(k), box=box, more="<ul><li>x<li>y</ul>" * (k % 3))) for k in range(8)]
    found = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, _, _ in pages:
        n = "abc" * 30 + str(k)
        want = "\n".join([f"Head & {n}", f"one {n} two three", f"last {n}", *["x", "y"] * (k % 3)])
        assert found[k].text == want and found[k].n_chars == len(want)


def test_main_text_of_the_tables(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search("(?s)<article>(.*)</article>", r.html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert texts[r.page_id] == "\n".join(filter(None, blocks))


def test_html_query(spark):
    found = registry.queries()["op7_html_text"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.url for r in found} == urls and all(r.n_chars == len(r.text) for r in found) and len(found) == len(urls)


@pytest.mark.parametrize(("source", "want"), [
    ('<body><nav>m</nav><div class="content-sidebar-wrap"><p>one</p><p>two&nbsp; three</p></div></body>', "one\ntwo three"),
    ('<article><div class="article-header"><h1>T</h1></div><p>x<span>y</span> z</p><div class="share">s</div><button>b</button></article><p>out</p>', "T\nxy z"),
    ('<div class="a"><p>menu</p></div><div class="b"><h2>t</h2><p>' + "word " * 40 + "</p><p>&lt;more&gt;</p></div>", "t\n" + ("word " * 40).strip() + "\n<more>"),
    ('<main><article>a<article class="comment">c</article></article></main><div role="complementary">r</div>', "a"),
    ("<p title='<x>'>a<!-- <p>no</p> --> b</p><style>p</style>", "a b"),
])
def test_single_pages(source, want):
    assert wrappers.extract(source, None) == want


INSIDE = [
    '<section id="discussion">{}</section>', '<h2 id="related-work">{}</h2>', '<h2 id="header">{}</h2>', '<p class="side-effects">{}</p>', '<table class="search-complexity"><tr><td>{}</table>',
    '<div class="ad-hoc-network">{}</div>', '<p data-id="comment-5">{}</p>', '<p title="class=menu x">{}</p>', "<p data-class='menu'>{}</p>", '<p class="related-findings notice-period">{}</p>', '<p class=x class=menu>{}</p>',
]


@pytest.mark.parametrize("box", ["article", "div"])
def test_names_do_not_drop_text_of_the_article(spark, box):
    pages = [(f"http://{k}/", f"<body><nav>m</nav><{box}><h1>T</h1><p>{'story ' * 40}</p>{part.format('kept ' * 5)}</{box}></body>") for k, part in enumerate(INSIDE)]
    assert _main_texts(spark, pages) == [f"T\n{('story ' * 40).strip()}\n{('kept ' * 5).strip()}"] * len(INSIDE)


def test_hosts_decide_what_pages_alone_get_wrong(spark):
    """Furniture without any telling tag, class or id; and telling names that stand on one page only."""
    text = lambda k: f"{'story ' * 40}{k}"
    plain = [("http://plain/", f"<body><div><p>Read us every day</p></div><h1>T{k}</h1><section><p>{text(k)}</p></section><ul><li>Home</li><li>Contact</li></ul></body>") for k in range(12)]
    assert _main_texts(spark, plain) == [f"T{k}\n{text(k)}" for k in range(12)]
    assert all(wrappers.extract(source, None) != f"T{k}\n{text(k)}" for k, (_, source) in enumerate(plain))
    # A class that names adverts is one where the host repeats it, and not where one page has it.
    named = [("http://named/", f"<article><h1>T{k}</h1><p>{text(k)}</p><div class=share>Share {k}</div>{'<p class=menu>soup</p>' if k == 5 else ''}</article>") for k in range(12)]
    assert _main_texts(spark, named) == [f"T{k}\n{text(k)}" + "\nsoup" * (k == 5) for k in range(12)]
    assert "soup" not in wrappers.extract(named[5][1], None)


def _main_texts(spark, pages):
    rows = [(k, u, h) for k, (u, h) in enumerate(pages)]
    return [r.text for r in sorted(wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_text_that_never_varies_goes_beside_the_article_and_stays_inside(spark):
    pages = [("http://h/", f"<body><h1>Weekly notes</h1><div><p>We use cookies</p></div><section><p>{'story ' * 40}{k}</p><blockquote>Fixed motto</blockquote></section></body>") for k in range(12)]
    assert _main_texts(spark, pages) == [f"Weekly notes\n{'story ' * 40}{k}\nFixed motto" for k in range(12)]
    named = [("http://h/", f"<article><h1>Weekly notes</h1><p>{'story ' * 40}{k}</p><blockquote>Fixed motto</blockquote></article>") for k in range(12)]
    assert _main_texts(spark, named) == [f"Weekly notes\n{'story ' * 40}{k}\nFixed motto" for k in range(12)]


def test_wrappers_find_the_article_under_any_name(spark):
    import html

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = collections.Counter(re.match("[^:]*://([^/]*)", r.url)[1] for r in rows)
    names = {h: f'div class="box{chr(97 + k % 26)}"' if k % 2 else "section" for k, h in enumerate(hosts)}
    pages, want = [], []
    for r in rows:
        name = names[re.match("[^:]*://([^/]*)", r.url)[1]]
        pages.append((r.url, r.html.replace("<article>", f"<{name}>").replace("</article>", f"</{name.split()[0]}>")))
        inside = re.search("(?s)<article>(.*)</article>", r.html)[1].replace("<br>", " ")
        want.append("\n".join(filter(None, (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)))))
    assert _main_texts(spark, pages) == want


@pytest.mark.parametrize(("source", "want"), [
    ("<div>" * 100_000 + "text" + "</x>" * 100_000 + "</div>" * 100_000 + "<p>more", "text\nmore"),
    ("<p>x</p>" + "<a " * 350_000, "x\n" + ("<a " * 350_000).strip()),
    ("<p>x</p>" + '<a href="' * 100_000 + ">y", None),
    ("<p>x</p><h2>y</h2>" * 20_000, "\n".join(["x", "y"] * 20_000)),
    ("".join(f"<x{k}>t{k}</x{k}>" for k in range(5000)), "\n".join(f"t{k}" for k in range(5000))),
    ("<script>" + "</script " * 200_000, ""),
    ("<nav>" + "<div>" * 300 + "<nav>menu</nav>no" + "</div>" * 300 + "</nav><p>yes<div>" + "<div>" * 300 + "deep<nav>menu</nav>", "yes\ndeep"),
])
def test_pages_without_bounds_take_linear_time(source, want):
    import time

    began = time.process_time()
    found = wrappers.extract(source, wrappers.rules_of(wrappers.align(wrappers.page_expression(source), wrappers.page_expression(source))))
    assert time.process_time() - began < 30 and (want is None or found == want)


def test_wrappers_stay_small(spark):
    pages = [("http://h/", f"<body><div class='{chr(97 + k % 26)}{chr(97 + k // 26)}x'><p>{'story ' * 40}{k}</p></div><div class=ad>buy</div></body>") for k in range(200)]
    assert _main_texts(spark, pages) == [f"{'story ' * 40}{k}" for k in range(200)]
    wrapper = None
    for _, source in pages:
        found = wrappers.page_expression(source)
        wrapper = found if wrapper is None else wrappers.align(wrapper, found)

    def parts(x):
        return 1 + sum(map(parts, x[6]))

    assert parts(wrapper) < 4 * wrappers.MOST_PARTS


def test_no_group_is_lost_beyond_the_most_parts(spark):
    """More different parts than a wrapper tells apart: an article among unknown tags, hints, and template text."""
    text = lambda k: f"{'story ' * 40}{k}"
    other = "".join(f"<x-{'a' * k}>other {k}</x-{'a' * k}>" for k in range(1, 80))
    pages = [("http://tags/", f"<body>{other}<y-body><article><h1>T{k}</h1><p>{text(k)}</p></article></y-body></body>") for k in range(6)]
    assert _main_texts(spark, pages) == [f"T{k}\n{text(k)}" for k in range(6)]
    many = "".join(f'<div class="{chr(97 + j % 26) * (2 + j // 26)}"><p>part {j}</p></div>' for j in range(80))
    parts = "\n".join(f"part {j}" for j in range(80))
    pages = [("http://hints/", f"<article><h1>T{k}</h1>{many}<div class=share>Share {k}</div></article>") for k in range(6)]
    assert _main_texts(spark, pages) == [f"T{k}\n{parts}" for k in range(6)]
    classes = lambda k: "".join(f'<div class="{chr(97 + j % 26) * (2 + j // 26)}"><p>part {j} of the story {k}</p></div>' for j in range(80))
    pages = [("http://fixed/", f"<body><h1>T{k}</h1><section><p>Read us every day</p></section>{classes(k)}</body>") for k in range(6)]
    assert _main_texts(spark, pages) == ["\n".join([f"T{k}", *(f"part {j} of the story {k}" for j in range(80))]) for k in range(6)]


def test_text_of_copies_stays(spark):
    own = "<article><h1>Head {k}</h1><p>" + "story{k} " * 60 + "</p>{more}</article>"
    copied = own.format(k="c", more="<blockquote>quoted</blockquote>")
    pages = [(k, "http://copies/", copied) for k in range(9)]
    pages += [(10 + k, "http://large/", copied + f"<footer>{k}</footer>") for k in range(9)]
    pages += [(100 + k, "http://large/", own.format(k=k, more="")) for k in range(30)]
    pages += [(200 + k, "http://some/", own.format(k=k, more="<h2>Sources</h2>" if k < 9 else "")) for k in range(30)]
    found = {r.page_id: r.text.split("\n") for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[k][0] == "Head c" and found[k][-1] == "quoted" for k in [*range(9), *range(10, 19)])
    assert all(found[200 + k][-1] == "Sources" for k in range(9)) and all(len(found[100 + k]) == 2 for k in range(30))


def test_title_and_intro_beside_the_text(spark):
    page = "<html><head><title>t</title></head><body><div class=tagline>The same</div><h1>T{k}</h1><div class=intro>{a}</div><div class=text><p>{b}</p></div></body></html>"
    teaser = "<body><article class=teaser><p>short {k}</p></article><article class=post><h1>T{k}</h1><p>{b}</p></article></body>"
    unheaded = "<body><div class=menu>home</div><div class=wrap><div class=intro>{a}</div><div class=text><p>{b}</p></div></div></body>"
    pages = [(100 * n + k, f"http://{n}/", x.format(k=k, a=f"intro{k} " * 35, b=f"text{k} " * 65)) for n, x in enumerate((page, teaser, unheaded)) for k in range(12)]
    pages.append((999, "http://one/", page.format(k="x", a="introx " * 35, b="textx " * 65)))
    found = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(12):
        intro, text = (f"intro{k} " * 35).strip(), (f"text{k} " * 65).strip()
        assert f"T{k}\n{intro}\n{text}" in found[k] and found[100 + k] == f"T{k}\n{text}" and found[200 + k] == f"{intro}\n{text}"
    assert "Tx\nintrox" in found[999] and found[999].endswith("textx")


def test_wrapper_groups():
    a, b = (wrappers.page_expression(f"<body><div><p>{x}</p>{y}</div></body>") for x, y in (("one", "<p>two</p>"), ("three", "<table></table>")))
    body = wrappers.align(a, b)[6][0]
    div = body[6][0]
    assert [(x[0], x[1]) for x in div[6]] == [("p", "+"), ("table", "?")] and div[6][0][5] == ""


def test_main_text_on_odd_pages(spark):
    rows = [(1, None, None, "t"), (2, "x", "", "t"), (3, "http://h/", "no tags &lt;", "t"), (4, "http://h/", "<p>a<p" + "b" * 10, "t"), (4, "http://h/", "<article>" + "<p>word</p>" * 50_000, "t"), (5, "http://h/", "<script>x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = wrappers.main_text(pages).collect()
    assert len(found) == len(rows) and {r.page_id: r.text for r in found if r.page_id in (1, 2, 5)} == {1: "", 2: "", 5: ""}
    assert max(r.n_chars for r in found) == 5 * 50_000 - 1 and wrappers.main_text(pages.limit(0)).count() == 0


# Media columns


def test_media_round_trip(spark, odd, empty):
    from tramline.llm.common import shared_dir

    index = media.store(odd, f"{shared_dir(spark)}/media-test")
    found = media.features(media.metadata(index)).collect()
    assert len(found) == len(ODD)
    want = collections.Counter()
    for i, t in ODD:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want[i if i is not None else None, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) // 64] += 1
    assert collections.Counter((None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.height) for r in found) == want
    heads = media.metadata(index).collect()
    assert all(r.width == 64 and r.depth == 8 for r in heads)
    same = {(r.media_sha256, r.feature) for r in found if r.doc_id in (3, 4)}
    assert len(same) == 1
    assert media.features(media.metadata(media.store(empty, f"{shared_dir(spark)}/media-none"))).count() == 0


def test_media_query(spark, docs):
    found = {r.doc_id: r for r in registry.queries()["op8_media"](spark, SF).collect()}
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert set(found) == set(want)
    for i, data in want.items():
        payload, r = media.padded(data), found[i]
        png = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), media.feature(media.from_png(png))) and (r.width, r.height, r.depth) == (64, len(payload) // 64, 8)


def test_shards_are_tar_files(spark, docs):
    import tarfile

    from tramline.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/media-tar"
    index = media.store(docs, folder).collect()
    for shard in {r.shard for r in index}:
        with tarfile.open(shard.removeprefix("file://")) as tar:
            members = {m.name: m for m in tar.getmembers()}
        for r in index:
            if r.shard == shard:
                m = members[f"{r.digest}.png"]
                assert (m.offset_data, m.size) == (r.offset, r.length)


# BPE

TEXTS = ["", " a", "<|endoftext|>x<|startoftext|> ", "don't WE'LL 12345 ... ΑΣ ΣΑΣ. ﬁ ½ İstanbul", "a\x1cb c\x85d　e", "日本語 한국어 😀", "aaaaaaaa abababab", "ǅ ß ẞ"]


def test_bpe_is_the_library_s(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    texts = TEXTS + [r.text for r in docs.limit(60).collect()]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in registry.queries()["op9_bpe"](spark, SF).collect()}
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_on_all_code_points():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c % 257 == 0)]
    texts = ["".join(f"a{chr(c)}b {chr(c)}\u0301{chr(c)}1 " for c in points[k : k + 100]) for k in range(0, len(points), 100)]
    for text, ids, want in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, text


def test_bpe_on_odd_rows(odd, empty):
    found = bpe.encode(odd, with_ids=True).collect()
    assert len(found) == len(ODD) and bpe.encode(empty).count() == 0
    for r in found:
        assert r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


# Quality rules


def _measures(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    found = quality.measure(docs).unionByName(quality.measure(odd)).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=key) == sorted(((i, *_measures(t)) for i, t in rows), key=key)
    assert quality.ledger(empty).count() == 0


def test_policies_and_ablation(docs):
    book = quality.ledger(docs).cache()
    rows = quality.apply_policies(book, quality.BASE, quality.CURRENT).withColumn("only", quality.only_failure(quality.CURRENT)).collect()
    names = [n for n, _ in quality.rules()]
    for r in rows:
        failed = {n for k, n in enumerate(names) if r.failed >> k & 1}
        assert r.kept_base == (not failed & set(quality.BASE.rejects)) and r["kept_2"] == (not failed) and r.only == (failed.copy().pop() if len(failed) == 1 else None)
    for r in quality.ablation(book, quality.CURRENT).collect():
        bit = 1 << names.index(r.rule)
        assert r.fails == sum(bool(x.failed & bit) for x in rows) and r.only == sum(x.failed == bit for x in rows)


# Pipeline and registry


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = [i for i, s in scores.items() if s < 0.5]
    clean = {r.doc_id for r in quality.ledger(docs).collect() if r.failed == 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (sorted(kept), sorted(set(kept) & clean), None, None), strict=True):
        at = stored(stage(spark, at, SF), name)
        if want is not None:
            assert sorted(r.doc_id for r in at.collect()) == want and at.columns == docs.columns
            before = want
        elif name == "simhash_near_dedup":
            last = sorted(r.doc_id for r in at.collect())
            assert last == _stays({i: texts[i] for i in before}) and at.columns == docs.columns
    assert {r.doc_id for r in at.collect()} == set(last)


def test_pipeline_on_odd_rows(spark, odd, empty):
    for rows in (odd, empty):
        at = rows
        for _, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, SF), "odd")
        assert at.count() >= 0


def test_every_query_is_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and set(registry.oracle_sql()) <= names
