"""URL filters: explicit host and path rules, then association rules that Spark's FP-growth
mines from labelled URLs and an inverted index matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bad rows that a rule must hold at least, whatever the share.
LEAST_ROWS = 5
#: Words by which a page's visible text names a trade that the corpus does not want.
UNWANTED = ("casino", "bets", "betting", "pills", "viagra", "porn", "adult", "xxx", "ads")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(name, verdict) of the longest rule that fits, null where none does. A rule fits its
    host and all subdomains where the path starts with the rule's; block wins a tie."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, top level domain, host labels, path words, number length and query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    top = F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld="), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    digits = F.when(path.rlike("[0-9]"), F.array(F.concat(F.lit("digits="), F.length(F.regexp_extract(path, "([0-9]+)", 1)).cast("string")))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.split(x, "=")[0]))
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))), top,
        F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.lit("label="), x)), F.transform(words, lambda x: F.concat(F.lit("path="), x)), digits, keys,
    )
    return F.array_distinct(F.when(url.isNull(), F.array().cast("array<string>")).otherwise(tokens))


def content_labels(pages: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(url, bad) for every page with a url and some html: bad where the visible text (no tags,
    comments, scripts or styles) names an unwanted trade. The url itself is not looked at."""
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.filter("url IS NOT NULL AND html IS NOT NULL").select("url", visible.rlike(rf"(?i)\b(?:{'|'.join(words)})\b").alias("bad"))


def matches(held: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, the columns of `held`) for every row whose `tokens` hold all tokens of a rule: an inverted
    index from each rule's rarest token to the rule, then a containment check."""
    posted = rules.select("rule", F.col("tokens").alias("needs"), "key")
    met = held.select("*", F.explode("tokens").alias("key")).join(posted, "key")
    return met.filter(F.size(F.array_except("needs", "tokens")) == 0).drop("key", "needs")


def mine_rules(labelled: DataFrame, support: float, confidence: float, lift: float) -> DataFrame:
    """Rules (rule, tokens, key, confidence) that imply a bad url, from rows of `tokens` and `bad`.

    FP-growth mines the token combinations of the bad rows, without tokens that are no more
    frequent there than among all rows (alone they tell nothing, and they multiply itemsets). All
    labelled rows then give each combination's confidence. Rules below the bounds go, and so do
    rules that a shorter one with at least their confidence implies already. `key` is a rule's
    rarest token.
    """
    labelled = save(labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    rows, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    empty = labelled.sparkSession.createDataFrame([], "rule long, tokens array<string>, key string, confidence double")
    if not bad:
        return empty
    least = max(support * rows, LEAST_ROWS)
    single = labelled.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    single = save(single.filter((F.col("bad") >= least) & (F.col("bad") * float(rows) > F.col("n") * float(bad))).select("token", F.col("n").alias("freq")), "tokens")
    numbered = labelled.filter("bad").select("row", F.explode("tokens").alias("token"))
    baskets = save(numbered.join(single, "token").groupBy("row").agg(F.collect_set("token").alias("items")), "baskets")  # bounded by the url's length
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(baskets.count(), 1)), minConfidence=confidence).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")).withColumn("rule", F.xxhash64("tokens"))
    keyed = sets.select("rule", "tokens", "bad", F.explode("tokens").alias("token")).join(single, "token")
    keyed = save(keyed.groupBy("rule", "tokens", "bad").agg(F.min(F.struct("freq", "token"))["token"].alias("key")), "itemsets")
    held = matches(labelled.filter("NOT bad").select("tokens"), keyed).groupBy("rule").agg(F.count("*").alias("good"))
    share = F.col("bad") / (F.col("bad") + F.coalesce("good", F.lit(0)))
    rules = keyed.join(held, "rule", "left").withColumn("confidence", share).filter((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * bad / rows))
    rules = save(rules.select("rule", "tokens", "key", "confidence"), "rules")
    wide = rules.select(F.col("rule").alias("w"), "tokens", F.col("confidence").alias("c"))
    implied = matches(wide, rules).join(rules.select("rule", F.size("tokens").alias("n"), "confidence"), "rule").filter("n < size(tokens) AND confidence >= c")
    return rules.join(implied.select(F.col("w").alias("rule")).distinct(), "rule", "left_anti")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold all tokens of a rule."""
    held = urls.filter("url IS NOT NULL").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    return matches(held, rules).select("url").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = 0.002, confidence: float = 0.8, lift: float = 1.2) -> DataFrame:
    """page_id, host, path, rule and verdict for every page (page_id, url).

    The longest explicit rule that fits decides; elsewhere a page is blocked if a mined rule
    matches its URL. `labels` are rows of url and bad (see content_labels); null values are left
    out, repeated rows count. Null urls or urls without :// have empty host and path. Without
    bad labels nothing is mined and nothing but the explicit rules blocks. Repeated rows are
    each judged; extra columns are ignored.
    """
    labelled = labels.filter("url IS NOT NULL AND bad IS NOT NULL").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = save(mine_rules(labelled, support, confidence, lift), "mined")
    hits = save(blocked_urls(pages, mined), "blocked").withColumn("hit", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path")).withColumn("__r", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.coalesce("hit", F.lit(False)), "block").otherwise("allow")
    return found.join(hits, "url", "left").select("page_id", "host", "path", F.col("__r.name").alias("rule"), F.coalesce("__r.verdict", method).alias("verdict"))
