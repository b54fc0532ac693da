"""URL filters by association rules, in DataFrame operations and Spark's own FP-growth only.

A short list of rules (host and path prefix) decides what it covers. The URLs that it decides are the labelled
baskets of URL tokens: FP-growth finds the token combinations that go with ``allow`` or ``block``; rules are pruned by
support and confidence and by any shorter rule that says the same at least as surely. Other URLs get the verdict of
the surest rule whose tokens they all have, found by an inverted index from token to rule.

All domain levels and all path parts are tokens, and all rules that reach support and confidence are kept. What keeps
this small: only tokens that reach the support take part (at most tokens a URL / support, a few thousands whatever
the input), tokens that always occur together are mined as one (deep paths with one common beginning would
give a rule for each subset of their parts; a URL has the one token if it has any of them), and the open URLs are judged by their distinct sets of rule tokens.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash, table

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
#: A list of this size at most becomes one expression.
MAX_LISTED = 500
ALLOW, BLOCK = "=allow", "=block"


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; both are empty where the URL is null or has no ``://``."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return urls.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def listed_rule(rules=RULES) -> Column:
    """The longest rule that fits host (or a domain above it) and path, else null."""
    if len(rules) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} listed rules")
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens() -> Column:
    """Distinct tokens: each domain above the host, every path part by its place, path depth, file ending."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -i, i), ".")))
    domains = F.when(F.col("host") == "", F.array(F.lit("d:"))).otherwise(domains)
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    placed = F.transform(parts, lambda p, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), p))
    ends = F.array(F.concat(F.lit("n:"), F.size(parts).cast("string")), F.concat(F.lit("e:"), F.regexp_extract("path", r"(\.[a-z0-9]{1,5}|/)?\z", 1)))
    return F.array_distinct(F.concat(domains, placed, ends))


def common_tokens(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, stands_for) of the tokens that reach the support in baskets (verdict, tokens, n): a token and all that
    occur in just the same baskets have one ``stands_for``, the first of them. At most tokens a basket / support."""
    total = labelled.agg(F.sum("n").alias("all"))
    each = labelled.select(F.explode("tokens").alias("token"), "n", F.xxhash64("tokens", "verdict").alias("h"))
    held = each.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))
    held = held.where(F.col("n") >= F.lit(min_support) * total.scalar())
    same = held.groupBy("n", "k", "sum", "xor").agg(F.min("token").alias("stands_for"), F.collect_list("token").alias("all"))
    return same.select(F.explode("all").alias("token"), "stands_for")


def with_common(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Adds t: the tokens of each row that are common ones, each as what it stands for."""
    # One map for all rows: its size is bounded by the support, not by the input.
    held = common.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("token", "stands_for"))).alias("m"))
    found = F.filter(F.transform("tokens", lambda t: F.col("m")[t]), lambda t: t.isNotNull())
    return rows.withColumn("m", held.scalar()).withColumn("t", F.sort_array(F.array_distinct(found))).drop("m")


#: Rows that FP-growth reads (and one more for each distinct basket): beyond that each row stands for several URLs.
MINED_ROWS = 1_000_000


def mine(labelled: DataFrame, common: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, mined_rows: int = MINED_ROWS) -> DataFrame:
    """From baskets (verdict, tokens, n) and their common tokens: rule_tokens, verdict, confidence, support of every
    rule that no part of its tokens makes redundant. Written to the shared folder.

    Equal baskets are counted once. FP-growth knows no counts, so a basket of n URLs stands for n / g rows, rounded up, with one g
    for all that bounds the rows. No set of tokens loses share in rows by more than the threshold is lowered, so every
    frequent one is found; its support and confidence are then counted from the baskets themselves.
    """
    held = stash(with_common(labelled, common).groupBy("t", "verdict").agg(F.sum("n").alias("n")))
    total = held.agg(F.sum("n")).first()[0] or 0
    each = max(1, -(-total // mined_rows))
    rows = F.ceil(F.col("n") / each).cast("int")
    weight = held.agg(F.sum(rows)).first()[0] or 0
    least = min_support * (total / each / weight if weight else 1) * (1 - 1e-9)
    items = held.select(F.concat("t", F.array(F.concat(F.lit("="), "verdict"))).alias("items"), F.explode(F.array_repeat(F.lit(0), rows))).select("items")
    sets = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items).freqItemsets
    says = F.array_intersect("items", F.array(F.lit(ALLOW), F.lit(BLOCK)))
    sets = sets.withColumn("says", says).where((F.size("says") == 1) & (F.size("items") > 1))
    sets = stash(sets.select(F.array_sort(F.array_except("items", "says")).alias("rule_tokens"), F.substring(F.element_at("says", 1), 2, 9).alias("verdict")))
    # Each rule meets the baskets that hold one of its tokens, and counts in those that hold all.
    posted = sets.select("rule_tokens", F.element_at("rule_tokens", -1).alias("token")).distinct()
    met = held.select("t", "verdict", "n", F.explode("t").alias("token")).join(posted, "token").where(F.size(F.array_except("rule_tokens", "t")) == 0)
    counts = met.groupBy("rule_tokens").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")))
    own = F.when(F.col("verdict") == "allow", F.col("allow")).otherwise(F.col("block"))
    rules = sets.join(counts, "rule_tokens").select("rule_tokens", "verdict", (own / F.col("all")).alias("confidence"), (own / F.lit(max(total, 1))).alias("support"))
    rules = stash(rules.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)))
    # A rule goes if a part of its tokens says the same at least as surely: an equi-join with its parts.
    marked = rules.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("rule_tokens")) - 2))).where(F.size("rule_tokens") > 1)
    part = F.filter("rule_tokens", lambda t, i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    parts = marked.select("rule_tokens", "verdict", "confidence", part.alias("part"))
    shorter = rules.select(F.col("rule_tokens").alias("part"), "verdict", F.col("confidence").alias("surer"))
    covered = parts.join(shorter, ["part", "verdict"]).where("surer >= confidence").select("rule_tokens", "verdict").distinct()
    out = stash(rules.join(covered, ["rule_tokens", "verdict"], "left_anti"))
    for used in (held, sets, rules):
        discard(used)
    return out


def judge(urls: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Null URLs and URLs without ``://`` have empty host and path. Ties between learned rules go to the surer, then the
    more frequent, then the longer, then ``block``. Where no learned rule fits (or nothing is labelled), the commoner
    verdict of the labelled URLs is taken, ``allow`` if they are even or none. Repeated rows and null ids are judged
    like any other; URLs of any length and depth count whole; other columns are not read; an empty table gives an
    empty table.
    """
    says = F.create_map(*(F.lit(x) for verdict, rule in rules for x in (rule, verdict))) if rules else F.create_map().cast("map<string,string>")
    parts = with_parts(urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumn("rule", listed_rule(rules))
    labelled = stash(parts.where("rule IS NOT NULL").select(says[F.col("rule")].alias("verdict"), tokens().alias("tokens")).groupBy("verdict", "tokens").agg(F.count("*").alias("n")))
    common = stash(common_tokens(labelled, min_support))
    learned = mine(labelled, common, min_support, min_confidence)
    votes = labelled.groupBy().agg((F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(-F.col("n"))) > 0).alias("more"))
    usual = F.when(votes.select(F.coalesce("more", F.lit(False))).scalar(), F.lit("block")).otherwise(F.lit("allow"))
    # Open URLs by the rule tokens they have; those tokens are common ones, so their list is bounded.
    used = learned.select(F.explode("rule_tokens").alias("token")).groupBy().agg(F.collect_set("token").alias("used"))
    keyed = with_common(parts.withColumn("tokens", F.when(F.col("rule").isNull(), tokens())), common)
    keyed = keyed.withColumn("basket", F.array_intersect("t", used.scalar())).select("page_id", "host", "path", "rule", "basket")
    baskets = keyed.where("rule IS NULL").groupBy("basket").agg(F.count("*").alias("n"))
    # Inverted index: a rule stands under one of its tokens.
    posted = learned.select(F.element_at("rule_tokens", -1).alias("token"), "rule_tokens", F.struct("confidence", "support", F.size("rule_tokens").alias("k"), "verdict").alias("said"))
    met = baskets.select("basket", F.explode("basket").alias("token")).join(posted, "token")
    fits = met.where(F.size(F.array_except("rule_tokens", "basket")) == 0)
    best = fits.groupBy("basket").agg(F.max("said").alias("said")).select("basket", F.col("said.verdict").alias("learned"))
    judged = keyed.join(stash(best), "basket", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(says[F.col("rule")], "learned", usual).alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, listed rule and verdict."""
    return judge(table(spark, sf_dir, "pages"))
