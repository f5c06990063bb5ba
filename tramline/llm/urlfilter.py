"""URL filter: stated rules, and association rules mined from labels for the urls that no stated rule fits.

A url is a set of tokens: its host and the domains above it, the words of its host, the steps of its path, the names in its
query. Tokens that stand on exactly the same labelled urls are one item, so that a fixed path of many steps is one item
and not a set with all its subsets. Spark's FP-growth finds the combinations of items that labelled urls share with a
verdict; those with enough support, enough confidence, and a confidence that is surely (by Wilson's bound) over the
verdict's usual share are rules, unless a more general rule with the same verdict is as confident. Support is a number of
urls, not a share, so that rare hosts can be judged in a large corpus too. Labels are those of the documents that the
pages show, and nothing else: no list of words. Rules are found through an inverted index: a rule
is listed under the rarest of its tokens, the tokens of each url look their rules up, and a rule fits if the url has
all of its tokens. Of the rules that fit, the most confident decides.

Defined cases: a url that is null or has no ``://`` has an empty host and path and no tokens; such urls and those that no
rule fits are allowed; very long urls are read whole; repeated rows are judged alike, one by one; an empty table gives no
rows, and without labels there are no mined rules; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Stated:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that come before what is mined.
STATED = (
    Stated("allow", "org", "/"),
    Stated("block", "example.org", "/es/"),
    Stated("block", "example.org", "/en/1"),
    Stated("allow", "com", "/fr/"),
    Stated("block", "com", "/de/"),
)
#: Least number of labelled urls with a rule's tokens and verdict, and least share of its urls with its verdict.
LEAST_URLS, CONFIDENCE = 10, 0.6
#: Standard errors by which a rule's confidence must lie over the verdict's usual share.
ERRORS = 1.96


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without a ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What stands between the host and the next ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; numbers are one token, since each would be its own."""
    found = host(url)
    labels = F.split(found, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.concat(F.lit("path:#"), F.regexp_extract(s, r"(\.[a-z]+)?$", 0))).otherwise(F.concat(F.lit("path:"), F.translate(s, UPPER, LOWER))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.regexp_extract(s, r"(?s)^([^=]*)", 1)))
    words = F.transform(F.filter(F.split(found, r"[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w))
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(above, words, steps, names)))


def stated_rule(found_host: Column, found_path: Column, rules: tuple[Stated, ...] = STATED) -> tuple[Column, Column]:
    """Text and verdict of the longest stated rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((found_host == rule.host) | F.endswith(found_host, F.lit("." + rule.host))) & F.startswith(found_path, F.lit(rule.path))
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and verdict of pages that show a labelled document, whose id is the last number of their path.

    A page is to be blocked if its document is of low quality or toxic.
    """
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]+)(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("url", number.try_cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL")
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("coalesce(quality, toxic) IS NOT NULL")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return shown.join(known, "doc_id").select("url", F.when(bad, "block").otherwise("allow").alias("verdict"))


def _items(urls: DataFrame, least: int) -> DataFrame:
    """(item, token) of tokens that stand on least urls or more; those on exactly the same urls have one item. urls: id, tokens."""
    counts = urls.select(F.xxhash64("id").alias("id"), F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("id").alias("on")).filter(F.col("n") >= least)
    first = counts.groupBy("n", "on").agg(F.min("token").alias("item"))
    return counts.join(first, ["n", "on"]).select("item", "token")


def mine(found: DataFrame, least: int = LEAST_URLS, confidence: float = CONFIDENCE, errors: float = ERRORS) -> DataFrame:
    """Rules (tokens, verdict, support, confidence) from urls with verdicts."""
    spark = found.sparkSession
    schema = "tokens array<string>, verdict string, support long, confidence double"
    urls = stored(found.select(F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("tokens"), "verdict"), "labelled-urls")
    shares = {r["verdict"]: r["count"] for r in urls.groupBy("verdict").count().collect()}
    total = sum(shares.values())
    if not total:
        return spark.createDataFrame([], schema)
    items = stored(_items(urls, least), "items")
    own = urls.select("id", "verdict", F.explode("tokens").alias("token")).join(items, "token").groupBy("id", "verdict").agg(F.collect_set("item").alias("items"))
    baskets = stored(own.select(F.concat("items", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items")), "baskets")
    if baskets.isEmpty():
        return spark.createDataFrame([], schema)
    held = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / held), minConfidence=confidence).fit(baskets)
    sets = stored(model.freqItemsets, "itemsets")
    named = F.filter("items", lambda x: F.startswith(x, F.lit("verdict:")))
    # A rule's confidence: the urls with its items and verdict, by the urls with its items.
    whole = sets.filter((F.size(named) == 1) & (F.size("items") > 1)).select(F.array_sort(F.array_except("items", named)).alias("items"), F.substring(F.element_at(named, 1), 9, 99).alias("verdict"), F.col("freq").alias("support"))
    parts = sets.filter(F.size(named) == 0).select(F.array_sort("items").alias("items"), "freq")
    usual = F.element_at(F.create_map(*[F.lit(x) for k, n in shares.items() for x in (k, n / total)]), F.col("verdict"))
    p, n, z = F.col("support") / F.col("freq"), F.col("freq"), errors
    surely = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    kept = whole.join(parts, "items").filter((F.col("support") >= least) & (p >= confidence) & (surely > usual)).select("items", "verdict", "support", p.alias("confidence"))
    rules = stored(kept.withColumn("rule", F.monotonically_increasing_id()), "mined")
    # A rule with one item less, the same verdict and no less confidence decides wherever the longer one does.
    fewer = rules.filter(F.size("items") > 1).select("rule", "verdict", F.col("confidence").alias("own"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"))
    spare = fewer.join(rules.select("items", "verdict", "confidence"), ["items", "verdict"]).filter("confidence >= own").select("rule").distinct()
    left = rules.join(spare, "rule", "left_anti").select("rule", "verdict", "support", "confidence", F.explode("items").alias("item"))
    return left.join(items, "item").groupBy("rule", "verdict", "support", "confidence").agg(F.array_sort(F.collect_set("token")).alias("tokens")).select("tokens", "verdict", "support", "confidence")


def inverted(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rules, each under its token that fewest of urls have."""
    listed = rules.select(F.monotonically_increasing_id().alias("rule_id"), "*")
    counts = urls.select(F.explode(tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = listed.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return listed.join(rarest, "rule_id").drop("rule_id")


def judge(pages: DataFrame, rules: DataFrame, stated: tuple[Stated, ...] = STATED) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined rule's confidence, if one decided."""
    url = F.col("url")
    text, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    urls = stored(pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path")).select("*", text.alias("rule"), verdict.alias("stated")), "urls")
    # A mined verdict hangs on the tokens alone, so each set of tokens is looked up once.
    open_sets = urls.filter(F.col("stated").isNull()).select(tokens(url).alias("tokens")).distinct()
    index = stored(inverted(stored(rules, "rules"), urls), "index")
    looked = open_sets.select("tokens", F.explode("tokens").alias("token")).alias("u").join(index.alias("r"), "token").filter(F.size(F.array_except("r.tokens", "u.tokens")) == 0)
    best = looked.groupBy("u.tokens").agg(F.max_by(F.struct("r.verdict", "r.confidence", F.array_join("r.tokens", " ").alias("mined")), F.struct("r.confidence", "r.support", F.size("r.tokens"), F.col("r.verdict"), F.array_join("r.tokens", " "))).alias("best"))
    # As JSON, no two sets of tokens have one key, whatever characters a url holds.
    found = stored(best.select(F.to_json("tokens").alias("key"), "best"), "verdicts")
    keyed = urls.withColumn("key", F.when(F.col("stated").isNull(), F.to_json(tokens(url))))
    return keyed.join(found, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.mined").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(labelled(pages, table(spark, sf_dir, "labels"))))
