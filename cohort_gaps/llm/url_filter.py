"""URL filtering by association rules: FP-growth mines token combinations of labelled URLs, an inverted index matches them.

A list of fixed rules comes first, longest match wins; the mined rules judge the rest. A mined rule is a set of tokens
that is frequent among labelled URLs and of which, at the lower end of the Wilson interval, enough are to be blocked.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch

# Verdict, host and path of the rules that come before the mined ones.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

BAD = "=block"
# Support: this share of the labelled URLs, and this many of them at least.
MIN_SUPPORT, LEAST_URLS = 0.001, 8
# Confidence: the lower end of the interval of so many deviations is at least this. Of the thousands of combinations
# tried, hardly one gets there by chance.
MIN_CONFIDENCE, DEVIATIONS = 0.5, 3.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: str) -> Column:
    """The different tokens of a URL: scheme, host labels and their words, domain, path segments, file kind, query keys and
    pairs, fragment. Segments of digits are one token. A URL that is null or has no ``://`` has none."""
    raw = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    labels = F.split(host, r"\.")
    segments = F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(r"\A[0-9]+\z"), "0").otherwise(x))
    pairs = F.split(F.regexp_extract(raw, r"(?s)\A[^#]*?\?([^#]*)", 1), "&")
    parts = F.concat(
        marked("s:", F.array(F.regexp_extract(raw, r"(?s)\A(.*?)://", 1))),
        marked("h:", labels), marked("w:", F.split(host, r"[.\-]")),
        marked("d:", F.array(F.substring_index(host, ".", -2))),
        marked("p:", segments), marked("x:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))),
        marked("q:", pairs), marked("k:", F.transform(pairs, lambda x: F.substring_index(x, "=", 1))),
        marked("f:", F.array(F.regexp_extract(raw, r"(?s)#(.*)\z", 1))))
    return F.when(raw.contains("://"), F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def wilson_low(hits: str, n: str, deviations: float = DEVIATIONS) -> Column:
    """The lower end of the Wilson interval of ``hits`` out of ``n``."""
    hits, n, square = F.col(hits), F.col(n), deviations * deviations
    share = hits / n
    return (share + square / (2 * n) - deviations * F.sqrt((share * (1 - share) + square / (4 * n)) / n)) / (1 + square / n)


def _without_twins(rows: DataFrame, n_rows: int) -> DataFrame:
    """``(row, is_bad, token)`` without tokens that all ``n_rows`` rows have, and with the longest of those that always come together.

    Twins have the same rows, known by their number and the sum of the rows' hashes, so sets with either are equally
    frequent; left in, each would double the number of frequent sets.
    """
    hashed = F.xxhash64("row").cast("decimal(20,0)")
    per_token = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("rows"))
    kept = per_token.filter(F.col("n") < n_rows).groupBy("n", "rows").agg(
        F.max(F.struct(F.char_length("token").alias("size"), "token")).alias("most")).select("most.token")
    return rows.join(kept, "token", "left_semi")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, least_urls: int = LEAST_URLS,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(rule, tokens, anchor, n, n_block, confidence)``: token sets of ``labelled``, ``(url, is_bad)``, that call for a
    block.

    All labelled URLs are mined; rows without a URL or a label count for nothing, equal URLs count each. A set is kept if
    it is frequent enough, sure enough, and none of its parts with one token less is. ``anchor`` is its rarest token. No
    labelled row, no rule.
    """
    with scratch(labelled.sparkSession) as own:
        urls = labelled.filter("url IS NOT NULL AND is_bad IS NOT NULL").select(
            F.monotonically_increasing_id().alias("row"), "is_bad", tokens_of("url").alias("tokens"))
        rows = cut_lineage(urls.filter(F.size("tokens") > 0))
        n = rows.count()
        single = _without_twins(rows.select("row", "is_bad", F.explode("tokens").alias("token")), n)
        # A token is in a row once, so a list is no longer than the row's URL.
        baskets = cut_lineage(single.groupBy("row").agg(F.concat(
            F.collect_list("token"), F.when(F.max("is_bad"), F.array(F.lit(BAD))).otherwise(
                F.array().cast("array<string>"))).alias("items")))
        if n == 0:
            sets = labelled.sparkSession.createDataFrame([], "items array<string>, freq bigint")
        else:
            share = min(1.0, max(min_support, least_urls / n))
            sets = cut_lineage(FPGrowth(minSupport=share).fit(baskets).freqItemsets)
        plain = sets.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"),
                                                                   F.col("freq").alias("n"))
        bad = sets.filter(F.array_contains("items", BAD)).select(
            F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_block"))
        sure = plain.join(bad, "tokens").withColumn("confidence", F.col("n_block") / F.col("n")).filter(
            wilson_low("n_block", "n") >= min_confidence)
        parts = sure.select(F.col("tokens").alias("whole"), F.explode("tokens").alias("out")).select(
            "whole", F.array_remove("whole", F.col("out")).alias("tokens"))
        covered = parts.join(sure.select("tokens"), "tokens", "left_semi").select(F.col("whole").alias("tokens")).distinct()
        kept = sure.join(covered, "tokens", "left_anti")
        counts = plain.filter(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("token"), F.col("n").alias("m"))
        anchors = kept.select("tokens", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens").agg(
            F.min_by("token", F.struct("m", "token")).alias("anchor"))
        rules = cut_lineage(kept.join(anchors, "tokens").select(
            F.array_join("tokens", " ").alias("rule"), "tokens", "anchor", "n", "n_block", "confidence"))
        own.keep_all_of([rules])
    return rules


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, mined)``: of the URLs that a mined rule fits, the surest rule, the first by name on ties.

    The index holds each rule under its rarest token, so a URL meets only rules of which it has that token, and a rule
    fits if it has the others too.
    """
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"), "rule", "confidence")
    single = urls.select("url", tokens_of("url").alias("tokens")).withColumn("token", F.explode("tokens"))
    fits = F.size(F.array_except("needed", "tokens")) == 0
    return single.join(index, "token").filter(fits).groupBy("url").agg(
        F.min_by("rule", F.struct((-F.col("confidence")).alias("c"), "rule")).alias("mined"))


def match_fixed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, verdict)``: of the URLs that a rule ``(verdict, host, path)`` fits, the longest rule.

    A rule fits its host, all subdomains, and paths that begin as its own does. A URL meets the rules of its host and of
    what is left of it behind each dot. The longest is the one with the longest host and path together, then the longer
    host; of two verdicts for one rule, block counts.
    """
    labels = F.split(F.col("host"), r"\.")
    behind = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select("url", host_of("url").alias("host"), path_of("url").alias("path"))
    met = hosts.select("url", "path", F.explode(behind).alias("rule_host")).join(rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("said")), "rule_host")
    fits = met.filter(F.startswith("path", F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(
        F.char_length(text).alias("size"), F.char_length("rule_host").alias("host_size"),
        (F.col("said") == "block").alias("blocks"), text.alias("rule"), F.col("said").alias("verdict"))).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def labelled_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, is_bad)`` of the pages whose heading opens a labelled document: bad if one of these documents is toxic or of
    no quality. A heading is the text's beginning; documents are brought together per opening first."""
    heading = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        heading = F.replace(heading, F.lit(name), F.lit(sign))
    shown = pages.select("url", F.trim(heading).alias("opening")).filter(F.char_length("opening") >= 20)
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("is_bad"))
    # Headings end after 60 characters.
    opened = docs.select("doc_id", F.trim(F.substring(F.regexp_replace("text", r"\s", " "), 1, 60)).alias("opening"))
    known = opened.join(marked, "doc_id").groupBy("opening").agg(F.max("is_bad").alias("is_bad"))
    return shown.join(known, "opening").select("url", "is_bad")


def judge(pages: DataFrame, rules: DataFrame, fixed: DataFrame) -> DataFrame:
    """Every row of ``pages`` with its ``host``, ``path``, the fixed ``rule`` and the ``mined`` rule that fit, and a
    ``verdict``: the fixed rule's, else block if a mined rule fits, else allow.

    Null URLs and such without ``://`` have an empty host and path and fit nothing. A URL that many pages share is judged
    once. Whole URLs count, however long. Rows that repeat a ``page_id`` are judged each; other columns change nothing.
    """
    urls = cut_lineage(pages.select("url").filter("url IS NOT NULL").distinct())
    found = match_fixed(urls, fixed).join(match_rules(urls, rules), "url", "full")
    joined = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path")).join(
        found, "url", "left")
    mined = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", mined).alias("verdict"), "mined")


def report(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of ``op12_url_filter``."""
    fixed = pages.sparkSession.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(pages, mine_rules(labelled_pages(pages, docs, labels)), fixed)
