"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule, so that a
policy is only a mask over stored bits: a new policy, or the ablation of a rule, never reads the texts again.

Defined cases: a null or empty text has no words, measures 0 everywhere and fails ``few_words``; very long texts are
measured whole, in time n log n; repeated rows are judged one by one; an empty table gives an empty ledger; other
columns of the input, whatever their names, are not read. Repeated windows are told apart by their 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import SPACES, WORD_PATTERN, table, words

SYMBOLS = r"[#*$%&|<>]"


def _share(numerator: str, denominator: str, percent: int) -> Column:
    return 100 * F.col(numerator) > percent * F.col(denominator)


def rules() -> tuple[tuple[str, Column], ...]:
    """Name of each rule and when a document fails it, bit by bit. Append only: bits are stored."""
    return (
        ("few_words", F.col("n_words") < 50),
        ("repeated_words", _share("n_repeat_words", "n_words", 50)),
        ("symbols", _share("n_symbols", "n_words", 30)),
        ("duplicate_lines", (F.col("n_dup_lines") >= 3) & _share("n_dup_lines", "n_lines", 30)),
        ("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        ("long_words", F.col("word_chars") > 15 * F.col("n_words")),
        ("shouting", _share("n_upper", "word_chars", 40)),
    )


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: documents that fail any of the named rules."""

    version: str
    rejects: tuple[str, ...]

    def mask(self) -> int:
        names = [name for name, _ in rules()]
        return sum(1 << names.index(name) for name in self.rejects)


BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and the measurements of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_PATTERN))
    read = docs.select(
        *keep,
        words(text).alias("w"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, r"\p{Lu}").alias("n_upper"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("l"),
    )
    n = F.size("w")
    hashed = read.withColumn(
        "h",
        F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    counted = hashed.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        # Windows in hash order, only where any two are equal.
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("o"),
    )
    # Neighbours in that order with one hash are repeats; both of their positions count.
    at = F.filter(F.sequence(F.lit(1), F.size("o") - 1), lambda k: F.element_at("o", k)["h"] == F.element_at("o", k + 1)["h"])
    twice = counted.withColumn("o", F.when(F.col("o").isNotNull(), F.array_distinct(F.flatten(F.transform(at, lambda k: F.array(F.element_at("o", k)["i"], F.element_at("o", k + 1)["i"]))))))
    covered = F.array_distinct(F.flatten(F.transform("o", lambda i: F.array(i, i + 1, i + 2))))
    return twice.select("*", F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words")).withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long"))).drop("o")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the measurements and ``failed``, a long with bit k set if rule k failed."""
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, failed) in enumerate(rules())]
    return measure(docs, keep).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask()).cast("long")) != 0


def apply_policies(book: DataFrame, *policies: Policy) -> DataFrame:
    """One boolean column ``kept_<version>`` for each policy."""
    return book.select("*", *[(~fails(p)).alias(f"kept_{p.version}") for p in policies])


def only_failure(policy: Policy) -> Column:
    """Name of the one rule of the policy that rejects a document, which would stay without it; null if none or several do."""
    under = F.col("failed").bitwiseAND(F.lit(policy.mask()).cast("long"))
    return F.coalesce(*[F.when(under == (1 << k), name) for k, (name, _) in enumerate(rules()) if policy.mask() >> k & 1])


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it rejects (kept without it)."""
    mask = policy.mask()
    under = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    inside = [(k, name) for k, (name, _) in enumerate(rules()) if mask >> k & 1]
    sums = [F.count_if(under.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"f{k}") for k, _ in inside]
    sums += [F.count_if(under == (1 << k)).alias(f"o{k}") for k, _ in inside]
    each = ", ".join(f"'{name}', f{k}, o{k}" for k, name in inside)
    total = book.agg(F.count("*").alias("documents"), F.count_if(under != 0).alias("rejected"), F.bit_or(under).alias("seen"), *sums)
    return total.selectExpr(f"'{policy.version}' AS policy", "documents", "rejected", f"stack({len(inside)}, {each}) AS (rule, fails, only)")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policies(ledger(table(spark, sf_dir, "documents")), BASE, CURRENT)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        fails(BASE).alias("base_failed"),
        (F.col("kept_base") & F.col("kept_2")).alias("kept"),
        "kept_base", "kept_2", only_failure(CURRENT).alias("only_failure"),
    )


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy rejects go; the columns of the others stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    # Without the row number Spark would move the filter below the measurements and repeat them in it.
    book = ledger(rows, ("row",)).withColumn("at", F.monotonically_increasing_id())
    return book.filter((F.col("at") >= 0) & ~fails(BASE) & ~fails(CURRENT)).select("row.*")
