"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is filed under the one of its literal tokens that is rarest over all urls. The tokens of a url fetch the
rules filed under them, and only those rules run their regular expression. Tokens are the maximal runs of letters and the
maximal runs of digits, lower-cased: a number after a word is a token of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# Fixed values of the query: (action, host/path) rules, and patterns for urls that no rule fits.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
PATTERNS = [("block", r"(^|[.-])spam-farm\.", "spam"), ("block", r"(^|[.-])cheap-pills\.", "pills"), ("block", r"(^|[.-])casino\d*\.", "casino")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on host followed by path; ``literals`` are tokens that every url it fits holds; ``name`` is shown."""

    action: str
    regex: str
    literals: tuple[str, ...]
    name: str | None = None
    rank: int = 0


def host_path_rule(action: str, text: str) -> Rule:
    """A rule on a host with all its subdomains and a path prefix, from text like ``example.com/en/``."""
    host, slash, rest = text.partition("/")
    # whole tokens only: the path's last run of letters may go on in the url, unless a separator ends it
    literals = [*_tokens(host), *_tokens(rest if re.search(r"[^0-9a-z]$", rest.lower()) or not rest else re.sub(r"[0-9A-Za-z]+$", "", rest))]
    return Rule(action, r"(?s)^([^/]*\.)?" + re.escape(host) + re.escape(slash + rest) + ".*$", tuple(dict.fromkeys(literals)), text, len(text))


def _tokens(text: str) -> list[str]:
    return re.findall("[0-9]+|[a-z]+", text.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat_ws("/", host, path)), "[^0-9a-z]+|(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])"))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, list[int]]:
    """File each rule under its literal token that fewest of all urls hold (ties: first by name).

    Counts cover the whole table; only the tokens that rules name come to the driver.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    counted = urls.select(F.explode(F.array_intersect("__tokens", F.array(*[F.lit(t) for t in wanted]))).alias("t")).groupBy("t").count()
    count = {row["t"]: row["count"] for row in counted.collect()}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if not rule.literals:
            raise ValueError(f"a rule needs a literal token: {rule}")
        index.setdefault(min(rule.literals, key=lambda t: (count.get(t, 0), t)), []).append(i)
    return index


def filter_urls(pages: DataFrame, rules: Sequence[Rule], patterns: Sequence[Rule] = (), url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (name or null) and verdict to every row; columns of these names are replaced.

    The rule of the highest rank that fits decides (ties: first by name); without one any fitting pattern's action
    decides, block before allow, else ``default``. A null url, or one without ``://``, has empty host and path. The
    rules are a literal of the plan and rows are judged one by one: no shuffle, hot hosts don't matter. Repeated rows are
    judged alike; an empty table gives an empty one.
    """
    both = [*rules, *patterns]
    host, path = split_url(F.col(url))
    d = pages.withColumn("host", host).withColumn("path", path)
    d = d.withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_tokens(d, both)
    whole = F.concat("host", "path")

    def as_struct(i: int) -> Column:
        r, is_pattern = both[i], i >= len(rules)
        rank = -1 - (r.action == "allow") if is_pattern else r.rank
        return F.struct(F.lit(-rank).alias("order"), F.lit(r.name or "").alias("name"), F.lit(is_pattern).alias("pattern"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))

    filed = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*[as_struct(i) for i in ids]))])
    fetched = F.flatten(F.transform(F.array_intersect("__tokens", F.array(*[F.lit(t) for t in sorted(index)])), lambda t: F.element_at(filed, t)))
    d = d.withColumn("__whole", whole).withColumn("__fetched", fetched)
    d = d.withColumn("__best", F.array_min(F.filter("__fetched", lambda r: F.regexp(F.col("__whole"), r["regex"]))))
    best = F.col("__best")
    d = d.withColumn("rule", F.when(~best["pattern"], best["name"])).withColumn("verdict", F.coalesce(best["action"], F.lit(default)))
    return d.drop("__tokens", "__whole", "__fetched", "__best")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, and by the patterns where no rule fits."""
    rules = [host_path_rule(*r) for r in RULES]
    patterns = [Rule(action, regex, (literal,), regex) for action, regex, literal in PATTERNS]
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, patterns).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {
    "op3_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '(^|[.-])(spam-farm|cheap-pills|casino[0-9]*)\.') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
}
