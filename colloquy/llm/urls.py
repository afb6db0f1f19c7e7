"""URL filter: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import broadcast_if, lower_ascii, materialise

#: (rule, verdict, pattern, rank): a host and path rule outranks every pattern, the longest first.
Rule = tuple[str, str, str, int]
SCHEMA = "rule string, verdict string, pattern string, rank int"

#: Listed host and path rules and their verdicts.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Patterns of unwanted addresses. Each literal token in one stands between non-alphanumerics.
PATTERNS = tuple(
    rf"(?:^|[^0-9a-z]){body}(?:[^0-9a-z]|$)"
    for body in ("casino", "free-bets", "cheap-pills", "adult-videos", "payday-loans?", "replica-watches", "click-bait")
)


def host_rule(rule: str, verdict: str) -> Rule:
    host, slash, path = rule.partition("/")
    return rule, verdict, r"^://(?:[^/?#]*\.)?" + re.escape(host) + re.escape(slash + path), 1_000_000 + len(rule)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [(f"pattern {i}", "block", p, i) for i, p in enumerate(PATTERNS)]


def literal_tokens(rule: Column, pattern: Column, rank: Column) -> Column:
    """Alphanumeric runs that every URL that matches has as whole tokens; an empty array means the rule is unindexed.

    A pattern is cut down to what each match must have. Edges (`\\b`, `^`, `$`, an end of text or a
    non-alphanumeric) and literal punctuation become `/`; classes, dots, escapes, groups of any
    other content and characters under a quantifier become a mark that no token may touch. Patterns with
    alternatives outside an edge, with flags or look-arounds, or with brackets left open yield none.
    """
    host = F.regexp_extract_all(F.lower(F.substring_index(rule, "/", 1)), F.lit("[0-9a-z]+"), F.lit(0))
    below = F.regexp_extract_all(F.lower(F.regexp_extract(rule, "(/.*)$", 1)), F.lit("[0-9a-z]+(?=/)"), F.lit(0))  # the last part of a path may go on in the URL
    steps = [
        (r"\(\?:\^\|\[\^0-9a-z\]\)|\(\?:\[\^0-9a-z\]\|\$\)(?![?*+{])", "/"),
        (r"\\b|^\^|\$$", "/"),
        (r"\\[^0-9A-Za-z](?:[?*+]|\{[^}]*\})[?+]?", "~"),
        (r"\\([^0-9A-Za-z\[\]()|])", "/"),
        (r"\\.(?:[?*+]|\{[^}]*\})?[?+]?", "~"),
        (r"\[\^?\]?[^\]]*\](?:[?*+]|\{[^}]*\})?[?+]?", "~"),
        *[(r"\((?:\?:)?[^()?][^()]*\)(?:[?*+]|\{[^}]*\})?[?+]?", "~")] * 4,
        (r"[^()|](?:[?*+]|\{[^}]*\})[?+]?", "~"),
        (r"\.", "~"),
        (r"[!-,:;<=>@_`-]", "/"),
    ]
    cut = pattern
    for k, (what, by) in enumerate(steps):
        if k == len(steps) - 1:  # brackets and alternatives that are left make the pattern unindexed
            cut = F.when(F.regexp_like(cut, F.lit(r"[()|{}\[\]\\]")), F.lit("~")).otherwise(cut)
        cut = F.regexp_replace(cut, F.lit(what), F.lit(by))
    of_pattern = F.when(F.regexp_like(pattern, F.lit(r"\(\?(?!:)")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(cut, F.lit("(?<=/)[0-9a-z]+(?=/)"), F.lit(0)))
    return F.when(rank >= 1_000_000, F.concat(host, below)).otherwise(of_pattern)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages; rules(rule, verdict, pattern, rank), as a list or a table.

    Every rule is filed under the literal token that the fewest distinct URLs have. A URL's tokens
    fetch the rules filed under them, and only those run their regular expressions, on the lower-case
    host followed by the rest as it is (patterns: on the whole in lower case). Rules without a token
    that every match has run on every URL. The highest rank wins, ties go to the greater rule: the
    longest host rule, else a pattern, else the default verdict. `rule` names host rules only.

    Equal URLs are judged once, repeated rows each get the result. Null URLs and those without `://`
    have an empty host and path, match no rule and get the default; URLs of any length are read
    whole. An empty table of pages gives an empty result, one of rules the default. Added columns
    replace those of the same name, and other columns stay.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(default_rules() if rules is None else rules, SCHEMA)
    pages = pages.drop("host", "path", "rule", "verdict")
    c = F.col(f"`{url}`").cast("string")
    urls = pages.select(c.alias("_u_url")).where(c.contains("://")).distinct()
    seen = urls.select(
        "_u_url",
        F.concat(F.lit("://"), host_of(F.col("_u_url")), F.regexp_extract("_u_url", r"^[\s\S]*?://[^/?#]*([\s\S]*)$", 1)).alias("_u_canon"),
    ).withColumn("_u_tokens", F.array_distinct(F.regexp_extract_all(F.lower("_u_canon"), F.lit("[0-9a-z]+"), F.lit(0))))

    filed = materialise(rules.select("rule", "verdict", "pattern", F.col("rank").cast("int").alias("rank")).withColumn("_tokens", literal_tokens(F.col("rule"), F.col("pattern"), F.col("rank"))), "url-rules")
    size = filed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pattern") + F.octet_length("rule") + 64).alias("b")).first()
    known = filed.select(F.explode("_tokens").alias("token")).distinct()
    hits = seen.select(F.explode("_u_tokens").alias("token")).join(broadcast_if(known, size["b"] or 0), "token")
    counts = hits.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    by_rule = filed.select("*", F.explode("_tokens").alias("token")).join(counts, "token", "left")
    rarest = by_rule.groupBy("rule", "verdict", "pattern", "rank").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = materialise(rarest, "url-index")
    loose = filed.where(F.size("_tokens") == 0).select("rule", "verdict", "pattern", "rank")

    by_token = seen.select("_u_url", "_u_canon", F.explode("_u_tokens").alias("token")).join(broadcast_if(index, size["b"] or 0), "token")
    fetched = by_token.select("_u_url", "_u_canon", "rule", "verdict", "pattern", "rank")
    if loose.take(1):  # each of these has to meet every URL
        fetched = fetched.unionByName(seen.select("_u_url", "_u_canon").join(broadcast_if(loose, size["b"])))
    fits = F.when(F.col("rank") >= 1_000_000, F.regexp_like("_u_canon", F.col("pattern"))).otherwise(F.regexp_like(F.lower("_u_canon"), F.col("pattern")))
    best = fetched.where(fits).groupBy("_u_url").agg(F.max_by(F.struct("rule", "verdict", "rank"), F.struct("rank", "rule")).alias("_u_best"))
    joined = pages.withColumn("_u_key", c).join(best, F.col("_u_key") == F.col("_u_url"), "left")
    return joined.select(
        *[F.col(f"`{x}`") for x in pages.columns],
        host_of(c).alias("host"),
        path_of(c).alias("path"),
        F.when(F.col("_u_best.rank") >= 1_000_000, F.col("_u_best.rule")).alias("rule"),
        F.coalesce(F.col("_u_best.verdict"), F.lit(default)).alias("verdict"),
    )


#: DuckDB SQL of the same result with the default rules.
def oracle() -> str:
    host = "translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '')"
    rules = sorted(HOST_RULES, key=lambda r: -len(r[0]))
    fits = [(r, v, f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))") for r, v in rules]
    any_pattern = " OR ".join(f"regexp_matches(lower(canon), '{p}')" for p in PATTERNS)
    return f"""
WITH p AS (SELECT page_id, {host} AS host, {path} AS path,
  CASE WHEN url LIKE '%://%' THEN '://' || {host} || regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([\\s\\S]*)$', 1) ELSE '' END AS canon FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r}'" for r, _, f in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for _, v, f in fits)} WHEN {any_pattern} THEN 'block' ELSE 'allow' END AS verdict
FROM p"""
