"""Toxicity by a weighted lexicon.

Texts are folded (letters that look like Latin ones, digits and signs that stand for letters, spelled-out and stretched
words), then matched by one Aho-Corasick automaton of all lexicon entries and exception phrases. An entry is a word or
the beginning of words. Entries inside an exception phrase don't count. The weights of what is left, normalised by the
length of the text, give the score by a logistic curve.

The lexicon comes from labelled rows that aren't held out. At most TOXIC_ROWS and CLEAN_ROWS of their distinct texts are
used, chosen by the texts' hash; all else covers every row. A word or beginning enters if its documents, and then also the
different pairs of words around it, are toxic far more often than the rest; the second test keeps the words of a text
that was merely copied with changes out. A phrase of an entry and its neighbour is an exception if clean texts have it in
many places and toxic texts never; entries are weighed without their exceptions. No measure of toxic words can lower a
score: the curve's coefficients are bounded from below by 0.

Defined cases: a null or empty text has no match and the score of the curve's foot; very long texts are matched whole;
repeated rows have equal scores; an empty table gives no rows; without toxic or without clean labels the lexicon is
empty and every score is 0; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import held_out, stored, table

#: Labelled rows of either kind that the lexicon and the curve are learned from, at most (about: chosen by hash).
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Letters of a beginning.
STEMS = range(3, 9)
#: Texts whose words, beginnings and contexts a worker holds at a time.
SLICE = 100
#: Least log-likelihood ratio and log of rates of an entry.
LEAST_RATIO, LEAST_WEIGHT = 30.0, 1.0
#: The same ratio for a phrase that makes an entry harmless, and the different places in clean texts that it must have.
LEAST_EXCEPTION, LEAST_PLACES = 15.0, 5

# Characters that look like Latin letters.
CYRILLIC, AS_LATIN = "аеорсухкмнтвізѕјԁԛԝһ", "aeopcyxkmhtbizsjdqwh"
GREEK, AS_LATIN_2 = "αβεικνορτυχωϲϳ", "abeiknoptuxwcj"
OTHERS, AS_LATIN_3 = "ıɑɡɩɪʟɴʀʏꜱᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ", "iagiilnrysacdejkmoptuvwz"
DIGITS, SIGNED = "013457@$!|", "oieastasii"

LOOKS = str.maketrans(CYRILLIC + GREEK + OTHERS, AS_LATIN + AS_LATIN_2 + AS_LATIN_3)
LOOKALIKES = frozenset(CYRILLIC + GREEK + OTHERS)
#: What a text is judged by, in the order that Matcher.measure has them.
MEASURES = ("total", "density", "variety", "purity")

LEET = str.maketrans(DIGITS, SIGNED)
HIDDEN = re.compile("[­​-‏⁠﻿]")
LEET_WORD = re.compile(r"(?<![^\W_])[^\W\d_]*(?:[0-9]|[@$!|](?=[^\W_]))(?:\w|[@$!|](?=[^\W_]))*")
SPELLED = re.compile(r"(?<![^\W_])[^\W_]([.\-*_ ])(?:[^\W_]\1){2,}[^\W_](?![^\W_])")
SEPARATORS = re.compile(r"[.\-*_ ]")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
WORD = re.compile(r"[^\W_]+")


def _leet(match: re.Match) -> str:
    word = match[0]
    return word.translate(LEET) if any(map(str.isalpha, word)) else word


def fold(text: str) -> str:
    """The words of text as they are matched, with a blank before, between and behind them."""
    text = text.lower()
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
        if not LOOKALIKES.isdisjoint(text):
            text = text.translate(LOOKS)
    if not set(DIGITS).isdisjoint(text):
        text = LEET_WORD.sub(_leet, text)
    text = SPELLED.sub(lambda m: SEPARATORS.sub("", m[0]), text)
    text = STRETCHED.sub(r"\1", text)
    return f" {' '.join(WORD.findall(text))} "


def bare(folded: str) -> str:
    """folded without accents."""
    return folded if folded.isascii() else "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Lexicon:
    """entries: text, starting with a blank, ending with one too if it is a whole word; weight; and purity.

    The weight is the log of how much more often toxic texts have the entry, the purity the log odds that a text with it
    is toxic.
    """

    entries: tuple[tuple[str, float, float], ...]
    exceptions: tuple[str, ...] = ()


class Matcher:
    """Sums of weights that a folded text holds."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.plain, self.accented = (self._automaton(lexicon, ascii_only) for ascii_only in (True, False))

    @staticmethod
    def _automaton(lexicon: Lexicon, ascii_only: bool) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for text, weight, purity in lexicon.entries:
            if text.isascii() == ascii_only:
                found.add_word(text, (weight, purity, text))
        for phrase in lexicon.exceptions:
            text = f" {phrase.strip()} "
            text = bare(text) if ascii_only else text
            found.add_word(text, (0.0, 0.0, text))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def _hits(self, automaton: ahocorasick.Automaton | None, text: str) -> list[tuple[str, float, float]]:
        if automaton is None:
            return []
        hits, harmless = [], []
        for end, (weight, purity, entry) in automaton.iter(text):
            start = end - len(entry) + 1
            if weight:
                hits.append((start, end, entry, weight, purity))
            else:
                harmless.append((start, end))
        # Of the exceptions that begin no later than a hit, the one that reaches furthest decides.
        harmless.sort()
        hits.sort()
        out, k, reach = [], 0, -2
        for start, end, entry, weight, purity in hits:
            while k < len(harmless) and harmless[k][0] <= start:
                reach = max(reach, harmless[k][1])
                k += 1
            if end > reach + 1:
                out.append((entry, weight, purity))
        return out

    def measure(self, text: str) -> tuple[float, ...]:
        """Log of the sum of weights; of that sum by words of text; of the number of different entries; the best purity."""
        folded = fold(text)
        hits = self._hits(self.accented, folded) + self._hits(self.plain, bare(folded))
        if not hits:
            return (0.0,) * len(MEASURES)
        total = sum(w for _, w, _ in hits)
        n = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / (n + 20)), math.log1p(len({e for e, _, _ in hits})), max(0.0, *(p for _, _, p in hits))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """How many toxic and clean texts have each word and beginning, summed over SLICE texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at : at + SLICE]
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                found = set()
                for w in set(fold(text or "").split()):
                    found.add(f" {w} ")
                    found.update(f" {w[:n]}" for n in STEMS if n < len(w))
                counts[1 if toxic else 0].update(found)
            every = list(set(counts[0]) | set(counts[1]))
            yield pd.DataFrame({"entry": every, "toxic": [counts[1][e] for e in every], "clean": [counts[0][e] for e in every]})


def _contexts(entries: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                rows = set()
                for text, toxic in zip(part["text"], part["toxic"], strict=True):
                    words = ["", *fold(text or "").split(), ""]
                    for before, w, after in zip(words, words[1:], words[2:], strict=False):
                        for entry in (f" {w} ", *(f" {w[:n]}" for n in STEMS if n < len(w))):
                            if entry in entries:
                                rows.add((entry, before, w, after, int(toxic)))
                yield pd.DataFrame(rows, columns=["entry", "before", "word", "after", "toxic"])

    return run


def _log(x: float) -> float:
    return math.log(x) if x > 0 else 0.0


def ratio(a: float, b: float, m: float, n: float) -> float:
    """Log-likelihood ratio of a of m against b of n; negative if the first share is the smaller."""
    p, q, r = a / m, b / n, (a + b) / (m + n)
    value = 2 * (a * (_log(p) - _log(r)) + b * (_log(q) - _log(r)))
    return value if p > q else -value


def _weight(a: float, b: float, m: float, n: float) -> float:
    return math.log((a + 0.5) / m) - math.log((b + 0.5) / n)


def _without_kin(rows: list[tuple[float, str, float, float]]) -> list[tuple[str, float, float]]:
    """The best of entries that begin one another; of equals the longest."""
    out: list[tuple[str, float, float]] = []
    kept, beginnings = set(), set()
    for _, entry, weight, purity in sorted(rows, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        own = {entry[:n] for n in range(1, len(entry) + 1)}
        if entry not in beginnings and kept.isdisjoint(own):
            out.append((entry, weight, purity))
            kept.add(entry)
            beginnings |= own
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and weight of distinct labelled texts to learn from: none that is held out, and bounded in number.

    A text that several documents have is toxic if one of them is labelled so.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    texts = stored(keyed.join(known, "doc_id").groupBy("key").agg(F.min("doc_id").alias("__id"), F.max("toxic").alias("toxic")), "labelled-texts")
    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    share = {k: min(1.0, most / max(1, counts.get(k, 0))) for k, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))}
    part = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    drawn = texts.filter(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1_000_000)) < part * 1_000_000)
    chosen = stored(drawn.select("__id", F.col("key").alias("__key"), "toxic", (1 / part).alias("weight")), "labels")
    # Its size is bounded by the two constants above, give or take the chance of a hash.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")))
    return stored(found.dropDuplicates(["__key"]).select("text", "toxic", "weight"), "sample")


def _places(rows: DataFrame, by: list[str]) -> DataFrame:
    """Different pairs of neighbours in toxic texts (a) and in clean ones (b)."""
    around = F.struct("before", "after")
    return rows.groupBy(*by).agg(F.countDistinct(F.when(F.col("toxic") == 1, around)).alias("a"), F.countDistinct(F.when(F.col("toxic") == 0, around)).alias("b"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """rows: text and toxic of a bounded sample, which also bounds what is gathered here of its words."""
    texts = rows.select("text", "toxic").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon(())
    sums = texts.mapInPandas(_candidates, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    m1, m0 = float(n[1]), float(n[0])
    p, q, r = F.col("a") / m1, F.col("b") / m0, (F.col("a") + F.col("b")) / (m1 + m0)
    likely = 2 * (F.col("a") * F.log(p / r) + F.when(q > 0, F.col("b") * F.log(q / r)).otherwise(0))
    docs = {x["entry"]: (x["a"], x["b"]) for x in sums.filter((p > q) & (likely > LEAST_RATIO)).collect()}
    if not docs:
        return Lexicon(())
    seen = texts.mapInPandas(_contexts(set(docs)), "entry string, before string, word string, after string, toxic int").distinct()
    around = stored(seen, "contexts")
    totals = {x["toxic"]: x["n"] for x in texts.withColumn("words", F.size(F.split("text", r"\s+"))).groupBy("toxic").agg(F.sum("words").alias("n")).collect()}
    t1, t0 = float(totals[1] or 1), float(totals[0] or 1)
    own = {x["entry"]: (x["a"], x["b"]) for x in _places(around, ["entry"]).collect()}
    # Phrases of an entry and a neighbour that clean texts have in many places, far more often than the entry as a whole, and toxic texts
    # never; of entries that are toxic to some degree even with such phrases.
    hopeful = [(e,) for e, (a, b) in own.items() if ratio(a, b, t1, t0) >= LEAST_RATIO / 2]
    if not hopeful:
        return Lexicon(())
    around = around.join(F.broadcast(rows.sparkSession.createDataFrame(hopeful, "entry string")), "entry", "left_semi")
    own = {e: own[e] for (e,) in hopeful}
    phrases = around.select("entry", "toxic", "before", "after", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"))
    tallied = _places(phrases, ["entry", "phrase"]).filter((F.col("a") == 0) & (F.col("b") >= LEAST_PLACES) & F.trim("phrase").contains(" ")).collect()
    harmless = {(x["entry"], x["phrase"].strip()) for x in tallied if ratio(x["b"], 0, max(1, own[x["entry"]][1]), max(1, own[x["entry"]][0])) >= LEAST_EXCEPTION}
    if harmless:
        spared = rows.sparkSession.createDataFrame(sorted(harmless), "entry string, phrase string")
        phrase = F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after")))
        covered = around.select("*", phrase.alias("phrase")).join(F.broadcast(spared), ["entry", "phrase"], "left_semi").drop("phrase").distinct()
        own = {x["entry"]: (x["a"], x["b"]) for x in _places(around.exceptAll(covered), ["entry"]).collect()}
    excepted = {e for e, _ in harmless}
    purity = {e: math.log((a + 0.5) / ((own[e][1] if e in excepted else b) + 0.5)) for e, (a, b) in docs.items() if e in own}
    scored = [(ratio(a, b, t1, t0), e, _weight(a, b, t1, t0), purity[e]) for e, (a, b) in own.items() if e in purity]
    kept = _without_kin([s for s in scored if s[0] >= LEAST_RATIO and s[2] >= LEAST_WEIGHT])
    names = {e for e, *_ in kept}
    return Lexicon(tuple(kept), tuple(sorted({p for e, p in harmless if e in names})))


def measured(text: F.Column, lexicon: Lexicon) -> F.Column:
    """A struct of MEASURES; only the text goes to Python, the rest of a row stays where it is."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for texts in batches:
            yield pd.DataFrame([matcher.measure(t or "") for t in texts], columns=list(MEASURES))

    # Called non-deterministic so that Spark doesn't copy the call into each use of a field.
    return F.pandas_udf(run, ", ".join(f"{m} double" for m in MEASURES)).asNondeterministic()(text)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...] = ()
    intercept: float = 0.0

    def score(self, found: str) -> F.Column:
        """Score from the column that holds measured()."""
        return 1 / (1 + F.exp(-sum((F.col(found)[m] * c for m, c in zip(MEASURES, self.coefficients, strict=True)), F.lit(self.intercept))))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)
    lexicon = learn_lexicon(rows)
    if not lexicon.entries:
        return Model(lexicon)
    points = stored(rows.select("toxic", "weight", measured(F.col("text"), lexicon).alias("m")).select("toxic", "weight", "m.*"), "points")
    ready = VectorAssembler(inputCols=list(MEASURES), outputCol="features").transform(points)
    least = Matrices.dense(1, len(MEASURES), [0.0] * len(MEASURES))
    fitted = LogisticRegression(labelCol="toxic", weightCol="weight", regParam=1e-4, maxIter=50, family="binomial", lowerBoundsOnCoefficients=least).fit(ready)
    return Model(lexicon, tuple(map(float, fitted.coefficients)), float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each whole text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not model.lexicon.entries:
        return own.select("doc_id", F.lit(0.0).alias("score"))
    return own.select("doc_id", measured(F.col("text"), model.lexicon).alias("m")).select("doc_id", model.score("m").alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go; the columns of the others stay as they are."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    if not model.lexicon.entries:
        return docs
    found = docs.select(F.struct("*").alias("row"), measured(F.col("text"), model.lexicon).alias("measures"))
    return found.filter(model.score("measures") < 0.5).select("row.*")
