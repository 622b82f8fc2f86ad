"""URL filtering by listed rules and by mined token combinations.

Listed rules name a host, with its subdomains, and the start of a path; the
longest that fits decides.  For all other urls, FP-growth mines combinations of url
tokens that go with a bad label; rules of enough support and confidence stay unless
a part of them is as telling, and an inverted index from tokens to rules finds the
rules of which a url has every token.

Mining runs over all labelled rows and rules may be of any length.  Tokens in too
few bad rows are left out first, as no rule can hold them; a token that stands in
bad rows only is a rule by itself, and no longer one with it can tell more, so it is
left out as well; and tokens that stand in the same rows are mined as one and told
apart afterwards.  None of this changes the rules, and urls of a blocked site that
repeat their names, however many, cost no more than these.  The work grows with the
combinations of enough support that are left.

Defined results: a null url, or one without ``://``, has an empty host and path,
no tokens and no rule, and is allowed; rows of a null id or label are not learned
from; equal urls get equal results; a long url is read whole; of several rules that
fit, the highest confidence is given; an empty table gives no rows or rules; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.plans.staging import broadcast_if_small, staged

#: Least labelled rows of a combination, as a number and as a share.
LEAST_ROWS, LEAST_SHARE = 10, 0.0005
LEAST_CONFIDENCE = 0.8

_BAD = "bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, its_host, its_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == its_host) | F.endswith(host, F.lit("." + its_host))) & F.startswith(path, F.lit(its_path))
        rule, verdict = F.when(fits, its_host + its_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: the host's labels and their parts, words of the path, names in the query."""
    words = lambda text, mark, cut: F.transform(F.filter(F.split(text, cut), lambda w: w.rlike("[a-z]")), lambda w: F.concat(F.lit(mark), w))
    lower = lambda text: F.translate(text, _UPPER, _LOWER)
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "(?s)^([^=]*)", 1))
    own = F.concat(
        words(host(url), "h:", r"\."), words(host(url), "w:", r"[.\-_]"), words(lower(path(url)), "p:", r"[^a-z0-9]+"),
        F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("q:"), lower(n))),
    )
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(own))).otherwise(F.expr("array()").cast("array<string>"))


def listed_labels(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Labels (id, bad) of the pages whose url one of the listed rules fits: whether it blocks."""
    url = F.col(url_col).cast("string")
    _, verdict = listed(host(url), path(url), rules)
    return pages.select(F.col(id_col).alias("id"), (verdict == "block").alias("bad")).dropna()


def mined(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: str = "quality = 0",
    least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE, least_confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """Rules (rule_id, items, confidence, support) for the label that ``bad`` is true of."""
    marks = labels.select(F.col(label_id).alias("id"), F.expr(bad).alias("bad")).dropna()
    rows = staged(pages.select(F.col(id_col).alias("id"), tokens(F.col(url_col)).alias("items")).join(marks, "id").select(F.monotonically_increasing_id().alias("row"), "bad", "items"))
    n = rows.count()
    least = max(1, math.ceil(min(1.0, max(least_share, least_rows / max(n, 1))) * n))
    # Tokens of enough bad rows, their number bounded by the share; two hashes of its rows tell those in the same rows.
    each = rows.select("row", "bad", F.explode("items").alias("token"))
    same = F.bit_xor(F.xxhash64("row")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("m2")
    often = each.groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n_rows"), *same).filter(F.col("n_bad") >= least)
    often = staged(often)
    telling = often.filter("n_bad = n_rows").select(F.array("token").alias("items"), F.lit(1.0).alias("confidence"), (F.col("n_bad") / max(n, 1)).alias("support"))
    classes = staged(often.filter("n_bad < n_rows").groupBy("m1", "m2").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("tokens")))
    baskets = each.join(broadcast_if_small(classes.select("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.first("bad").alias("bad"))
    baskets = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    own = staged(baskets)
    share = min(1.0, (least - 0.5) / max(own.count(), 1))
    found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=least_confidence).fit(own).associationRules
    support = F.col("support") * own.count() / max(n, 1)
    rules = staged(found.filter(F.col("consequent") == F.array(F.lit(_BAD))).select(F.array_sort("antecedent").alias("items"), "confidence", support.alias("support")))
    # A rule goes if a part of it, one item less, is as telling.
    parts = rules.select("items", "confidence", F.explode("items").alias("out")).select("items", "confidence", F.array_remove("items", F.col("out")).alias("part"))
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("its"))
    weaker = parts.join(shorter, "part").filter("its >= confidence").select("items").distinct()
    best = rules.join(weaker, "items", "left_anti").withColumn("rule", F.monotonically_increasing_id())
    # Each token of a class may stand for it.
    named = staged(best).select("rule", "confidence", "support", F.explode("items").alias("token")).join(broadcast_if_small(classes.select("token", "tokens")), "token")
    whole = named.groupBy("rule").agg(F.collect_list("tokens").alias("sets"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    longer = lambda sets, own: F.flatten(F.transform(sets, lambda s: F.transform(own, lambda t: F.array_append(s, t))))
    choices = F.aggregate("sets", F.expr("array(cast(array() as array<string>))"), longer)
    chosen = whole.select("confidence", "support", F.explode(choices).alias("items")).withColumn("items", F.array_sort("items")).unionByName(telling)
    return chosen.select(F.sha1(F.array_join("items", "\n").cast("binary")).alias("rule_id"), "items", "confidence", "support")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence) of the token sets (key, tokens) that a rule fits, by an inverted index: a rule stands at that of its tokens which the fewest rules have."""
    each = rules.select("rule_id", "confidence", "items", F.explode("items").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"))
    rarest = each.join(uses, "token").groupBy("rule_id").agg(F.min(F.struct("uses", "token")).alias("at"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    index = broadcast_if_small(staged(rarest.select("at.token", "items", "confidence")))
    seen = token_sets.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return seen.filter(F.size(F.array_except("items", "tokens")) == 0).groupBy("key").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, lists: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule, if the method decides and one fits)."""
    url = F.col(url_col).cast("string")
    given = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    rule, verdict = listed(F.col("host"), F.col("path"), lists)
    rows = given.withColumns({"rule": rule, "verdict": verdict, "key": F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens"))})
    open_ = rows.filter("verdict is null and size(tokens) > 0").groupBy("key").agg(F.first("tokens").alias("tokens"))
    blocked = broadcast_if_small(staged(matched(open_, rules)))
    joined = rows.join(blocked, "key", "left")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.when(F.col("verdict").isNull(), F.col("confidence")).alias("confidence"))
