"""URL filters: given host and path rules first, then association rules that FP-growth mines from labelled URLs.

Each URL is a set of tokens: host suffixes, path segments (digits as #) and names in the query. Tokens in `MIN_SUPPORT` of the
labelled URLs or more are items; tokens that always occur together are one item, and of host suffixes in it only the longest counts.
Labelled URLs with their verdict as one more item go to Spark's FP-growth. A URL gives one transaction without its host and one for
each of its frequent suffixes, so the suffixes of a host, which all occur together, never multiply; the other items of a transaction
with a suffix are marked, so every set is counted once for each URL. Rules that end in a verdict, have at most `MAX_TOKENS` items and
pass `MIN_SUPPORT` and `MIN_CONFIDENCE` are kept. They are applied by an inverted index, to each different URL once: a rule is
filed under its rarest item and fires when all of its items are in the URL. Spark expressions only.

Defined cases: a null URL, or one without `://`, has an empty host and path and no tokens, and is allowed; of two rules of
the same length the one given first wins; of mined rules that fire the most confident wins, then block; where none fires the URL
is allowed; without labelled URLs nothing is mined; repeated rows and null ids are kept; an empty table gives an empty result;
other columns (html) are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import in_blocks, materialize

#: host, path, verdict (fixed values)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: Items of a mined rule at most; longer ones are no part of the model.
MAX_TOKENS = 4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    segments = F.transform(parts, lambda p, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(p, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("q:"), F.substring_index(q, "=", 1)))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, segments, names))).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))  # stable: the first given wins a tie
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def items_of(labelled: DataFrame, min_support: float, n: int) -> DataFrame:
    """(token, item, n, has_host) of tokens in `min_support` of the n rows or more.

    Tokens with the same count and the same sum of row hashes are in the same rows; such a class is one item, named by its longest
    token. There are at most tokens per row / min_support of them.
    """
    seen = F.xxhash64("tokens").cast("decimal(20,0)").alias("h")
    counted = labelled.select(F.explode("tokens").alias("token"), seen).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("n") >= min_support * n)
    is_host = F.startswith("token", F.lit("h:"))
    length = F.length("token")
    hosts = F.max(F.when(is_host, F.struct(length, "token"))).alias("host")
    classes = counted.groupBy("n", "h").agg(hosts, F.max(F.struct(length, "token")).alias("longest"))
    named = counted.join(classes, ["n", "h"]).where(~is_host | (F.col("token") == F.col("host.token")))
    return materialize(named.select("token", F.coalesce("host.token", "longest.token").alias("item"), "n", F.col("host").isNotNull().alias("has_host")))


def _with_items(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, items) of rows (key, tokens) that have an item; items in alphabetical order."""
    met = rows.select(key, F.explode("tokens").alias("token")).join(items.select("token", "item", "has_host"), "token")
    return met.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("item", "has_host"))).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled (tokens, verdict) -> rules (rule_id, tokens, key, verdict, confidence, support) over items, and `items_of`."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    # equal rows are one entry until the transactions are made
    rows = materialize(labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("copies")).withColumn("row", F.xxhash64("tokens", "verdict")))
    n = rows.agg(F.sum("copies")).first()[0]
    if not n:
        empty = spark.createDataFrame([], "rule_id long, tokens array<string>, key string, verdict string, confidence double, support double")
        return empty, spark.createDataFrame([], "token string, item string, n long, has_host boolean")
    items = items_of(labelled, min_support, n)
    own = _with_items(rows.select("row", "tokens"), items, "row")
    verdict = F.concat(F.lit("="), F.col("verdict"))
    hosts = F.transform(F.filter("items", lambda x: x["has_host"]), lambda x: x["item"])
    others = F.transform(F.filter("items", lambda x: ~x["has_host"]), lambda x: x["item"])
    views = F.concat(F.array(others), F.transform(hosts, lambda h: F.array_append(F.transform(others, lambda x: F.concat(F.lit("+"), x)), h)))
    each = rows.join(own, "row").select("verdict", "copies", F.explode(views).alias("items"))
    dealt = in_blocks(each.select(F.array_append(F.col("items"), verdict).alias("items"), "copies")).repartition("items", "block")
    transactions = materialize(dealt.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("items"))
    total = transactions.count()
    if not total:
        return mine(labelled.limit(0))[0], items
    model = FPGrowth(itemsCol="items", minSupport=max(min_support * n - 0.5, 0.5) / total, minConfidence=min_confidence).fit(transactions)
    marked = F.exists("antecedent", lambda x: F.startswith(x, F.lit("+")))
    bare = lambda x: F.when(F.startswith(x, F.lit("+")), F.substring(x, 2, 1 << 20)).otherwise(x)
    with_host = F.exists("antecedent", lambda x: F.startswith(x, F.lit("h:")))
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=")) & (F.size("antecedent") <= MAX_TOKENS) & (~marked | with_host))
    tokens = F.array_sort(F.transform("antecedent", bare))
    rules = found.select(F.xxhash64(tokens, "consequent").alias("rule_id"), tokens.alias("tokens"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("verdict"), "confidence", (F.col("support") * total / n).alias("support"))
    kept = prune_redundant(materialize(rules))
    counts = items.select("item", "n").distinct()
    keyed = kept.select("*", F.explode("tokens").alias("item")).join(counts, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("key"))
    return materialize(kept.join(keyed, "rule_id").select("rule_id", "tokens", "key", "verdict", "confidence", "support")), items


def prune_redundant(rules: DataFrame) -> DataFrame:
    """Drop a rule if one with fewer of its items gives the same verdict with at least its confidence.

    The shorter rule fires wherever the dropped one does, with the same verdict. The parts of a rule (at most 2^MAX_TOKENS) are looked up by
    equality, so rules are not compared pairwise.
    """
    size = F.size("tokens")
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 2)
    part = F.filter(F.col("tokens"), lambda _, i: F.getbit(F.col("mask"), i) == 1)
    parts = rules.where(size > 1).withColumn("mask", F.explode(masks)).select("rule_id", "verdict", F.col("confidence").alias("own"), part.alias("tokens"))
    shorter = rules.select("tokens", "verdict", "confidence")
    redundant = parts.join(shorter, ["tokens", "verdict"]).where("confidence >= own").select("rule_id").distinct()
    return rules.join(redundant, "rule_id", "left_anti")


def apply_rules(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """urls (url, tokens; each url once), mined rules and items -> (url, mined): the verdict of the best rule that fires."""
    own = _with_items(urls, items, "url").select("url", F.transform("items", lambda x: x["item"]).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("key")).join(rules, "key")
    fired = met.where(F.size(F.array_except("tokens", "own")) == 0)
    return fired.groupBy("url").agg(F.max_by("verdict", F.struct("confidence", "verdict", "rule_id")).alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, by. `labelled` (url, verdict); None: the URLs that the given rules decide."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "given": verdict})
    if labelled is None:
        learn = rows.where(F.col("given").isNotNull()).select("url", "host", "path", F.col("given").alias("verdict"))
    else:
        learn = labelled.select(url.alias("url"), "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    mined, items = mine(learn.select(tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "verdict"))
    open_ = rows.where(F.col("given").isNull() & (F.col("host") != "")).select("url", "host", "path").distinct()
    decided = apply_rules(open_.select("url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), mined, items)
    joined = rows.join(decided, "url", "left")
    by = F.when(F.col("given").isNotNull(), "given").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"), by.alias("by"))
