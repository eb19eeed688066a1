"""URL filters: stated host and path rules, and association rules mined by FP-growth. DataFrame functions only.

A URL becomes a set of tokens (scheme, labels below the domain, domain, top-level label, path segments with digits made
one sign, extension, query keys, fragment). Spark's FP-growth mines the combinations that go with a bad label among all
labelled pages.

A combination is a rule if its share of bad pages is LIFT times that of all labelled pages or more, and if so many bad
pages would be LEAST_Z standard deviations or more above what that share lets expect. Before mining, tokens that all
pages have go, and of tokens that always occur together one stays, so that long runs of implied tokens do not multiply
into all their subsets. Of two rules of which one holds all tokens of the other, one goes: the shorter one if its pages
outside the longer one are no worse than average, as the longer one says it better; else the longer one, as the shorter
one blocks what it would. A URL that holds all tokens of a rule is blocked. Rules are found through an inverted index that posts each rule under
its rarest token.

A stated rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins and goes
before the mined ones.

Defined cases: a null URL, or one without ``://``, has empty host and path and no tokens, and is allowed; a URL of any
length is judged whole; pages whose labels are all null or missing are not mined; repeated pages are judged alike; empty
or one-sided labels mine no rules; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Stated rules: verdict, and host with path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Least share of the labelled pages that hold a rule's tokens and are bad. It bounds the tokens that FP-growth ranks on
#: the driver: at most (tokens of a page / share). A bad group must have that share of the labelled pages to be found.
SUPPORT = 0.002
#: Least number of those pages, whatever their share.
LEAST_PAGES = 5
#: Least confidence in units of the share of bad pages, and least distance from chance in standard deviations.
LIFT, LEAST_Z = 1.3, 2.0
BAD = "label=bad"
#: So many rules are put in the plan as constants; more are joined by shuffle.
CONSTANT_RULES = 2_000
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, by the first ``://``; empty strings where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def stated(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The set of tokens of a URL."""
    host, path = host_and_path(url)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    tail = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    shape = lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "#")
    parts = F.concat(
        named("scheme=", F.array(F.lower(scheme))),
        named("below=", F.split(F.regexp_replace(host, r"\.?[^.]+\.[^.]+$", ""), r"\.")),
        named("domain=", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        named("top=", F.array(F.regexp_extract(host, r"([^.]+)$", 1))),
        named("path=", F.transform(F.split(path, "/"), shape)),
        named("file=", F.array(F.regexp_extract(F.lower(path), r"\.([a-z0-9]{1,5})$", 1))),
        named("query=", F.transform(F.split(tail, "&"), lambda x: F.lower(F.regexp_extract(x, r"^([^=]*)", 1)))),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the pages that have a label, with BAD among them if any label of theirs is bad."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(bad.alias("bad"))
    both = pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).join(known, F.col("page_id") == F.col("doc_id"))
    return both.filter(F.size("tokens") > 0).select(F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))


def telling(items: DataFrame, need: int, total: int) -> list[str]:
    """The tokens of need pages or more but not of all, one (the first by name) of those that occur in the same pages.

    At most (tokens of a page / SUPPORT) of them: a bound that does not grow with the pages.
    """
    each = items.withColumn("_h", F.xxhash64("items", F.monotonically_increasing_id())).select("_h", F.explode(F.array_remove("items", BAD)).alias("token"))
    each = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("places"))
    return sorted(r["token"] for r in each.filter((F.col("df") >= need) & (F.col("df") < total)).groupBy("df", "places").agg(F.min("token").alias("token")).collect())


def mine(items: DataFrame, support: float = SUPPORT, lift: float = LIFT, least_z: float = LEAST_Z, least: int = LEAST_PAGES) -> DataFrame:
    """Rules (rule_id, tokens, anchor, support, confidence, z), none of which holds another's tokens.

    Anchor: the token of the rule that the fewest labelled pages have (ties to the first by name).
    """
    schema = "rule_id long, tokens array<string>, anchor string, support long, confidence double, z double"
    total, bad = items.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BAD))).first()
    need = max(least, math.ceil(support * total))
    if not 0 < bad < total or bad < need:
        return items.sparkSession.createDataFrame([], schema)
    items = checkpoint(items)
    known = telling(items, need, total)
    if not known:
        return items.sparkSession.createDataFrame([], schema)
    kept = items.select(F.array_intersect("items", F.array(*map(F.lit, [*known, BAD]))).alias("items"))
    sets = checkpoint(FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total).fit(kept).freqItemsets.withColumn("items", F.array_sort("items")))
    share = bad / total
    held = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad"))
    both = held.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").withColumn("confidence", F.col("bad") / F.col("freq"))
    z = (F.col("bad") - F.col("freq") * share) / F.sqrt(F.col("freq") * share * (1 - share))
    both = both.withColumn("z", z).filter((F.col("confidence") >= lift * share) & (F.col("z") >= least_z))
    single = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("df"))
    ranked = both.withColumn("token", F.explode("tokens")).join(single, "token").groupBy("tokens", "bad", "confidence", "z").agg(F.min(F.struct("df", "token"))["token"].alias("anchor"))
    rules = checkpoint(ranked.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "anchor", F.col("bad").alias("support"), "confidence", "z", F.round(F.col("bad") / F.col("confidence")).alias("freq")))
    # a rule that holds a shorter one meets it under that one's anchor
    short = rules.select("anchor", F.col("tokens").alias("s_tokens"), F.col("support").alias("s_bad"), F.col("freq").alias("s_freq"))
    pairs = rules.select("tokens", "support", "freq", F.explode("tokens").alias("anchor")).join(short, "anchor")
    pairs = checkpoint(pairs.filter((F.size("s_tokens") < F.size("tokens")) & (F.size(F.array_except("s_tokens", "tokens")) == 0)))
    rest_freq, rest_bad = F.col("s_freq") - F.col("freq"), F.col("s_bad") - F.col("support")
    explained = pairs.filter((rest_freq > 0) & (rest_bad <= share * rest_freq)).select(F.col("s_tokens").alias("tokens")).distinct()
    left = rules.join(explained, "tokens", "left_anti")
    covered = pairs.join(left.select(F.col("tokens").alias("s_tokens")), "s_tokens", "left_semi").select("tokens").distinct()
    return checkpoint(left.join(covered, "tokens", "left_anti").select(*(c.split()[0] for c in schema.split(", "))))


def blocked_by(pages: DataFrame, rules: DataFrame, constant: int = CONSTANT_RULES) -> DataFrame:
    """pages (with `_tokens`) and `mined`, whether a rule's tokens are all among the page's."""
    few = rules.select("anchor", "tokens").take(constant + 1)
    if len(few) <= constant:
        index: dict[str, list[list[str]]] = {}
        for r in few:
            index.setdefault(r["anchor"], []).append(r["tokens"])
        hit = F.lit(False)
        if index:
            lists = F.create_map(*[x for k, v in sorted(index.items()) for x in (F.lit(k), F.array(*[F.array(*[F.lit(t) for t in s]) for s in sorted(v)]))])
            posted = F.flatten(F.transform(F.filter("_tokens", lambda t: F.map_contains_key(lists, t)), lambda t: lists[t]))
            hit = F.exists(posted, lambda s: F.size(F.array_except(s, F.col("_tokens"))) == 0)
        return pages.withColumn("mined", hit)
    # each distinct token set once, so that a hot host does not gather; then by token, salted
    sets = pages.select(F.col("_tokens").alias("_set")).distinct().withColumn("_key", F.xxhash64("_set"))
    posted = rules.select("anchor", "tokens").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = sets.withColumn("anchor", F.explode("_set")).withColumn("_salt", F.pmod("_key", F.lit(SALTS))).join(posted, ["anchor", "_salt"])
    found = found.filter(F.size(F.array_except("tokens", "_set")) == 0).select(F.col("_set").alias("_found")).distinct()
    return pages.join(found, F.col("_tokens") == F.col("_found"), "left").withColumn("mined", F.col("_found").isNotNull()).drop("_found")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = SUPPORT, lift: float = LIFT, constant: int = CONSTANT_RULES) -> DataFrame:
    """page_id, host, path, the stated rule that decides, the verdict, and whether a mined rule matches."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    mined = mine(labelled(pages, labels), support, lift)
    host, path = host_and_path(F.col("url"))
    found = blocked_by(pages.select("page_id", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("_tokens")), mined, constant)
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
