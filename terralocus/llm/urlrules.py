"""URL filters: pattern rules found by their rarest literal token.

A rule is `host/path` with a verdict; `*` stands for any characters within the
host or within the path. It fits its host and all subdomains when the url's
path starts with the rule's; the longest fitting rule wins, then the longer
host, then the larger text. A url that no rule fits is allowed.

Every rule is filed under one token: of the literal tokens that a fitting url
must contain whole, the one that the fewest rules share (ties: the longest,
then the smallest). A rule without such a token is filed under the empty one,
which every url has. The tokens of a url fetch its candidates, and only those
run their regular expressions.

Defined results: a null url, or one without `://`, has empty host and path and
gets no rule; repeated urls and ids are judged alike; an empty rule list allows
everything.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import BROADCAST_ROWS

# Rules up to this number go into the plan as a map; above, they are a joined table.
INLINE_RULES = 256
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str
    token: str
    pattern: str
    rank: str


def _tokens(host: str, path: str) -> list[str]:
    """Literal tokens that stand whole in any url the rule fits."""
    found = []
    for part, open_start, open_end in ((host, False, False), (path, False, True)):
        for m in re.finditer(r"[0-9A-Za-z]+", part):
            before, after = part[:m.start()], part[m.end():]
            if before.endswith("*") or after.startswith("*") or (open_end and not after) or (open_start and not before):
                continue  # may be a piece of a longer token
            found.append(m.group().lower())
    return found


def compiled(rules: list[tuple[str, str]]) -> list[Rule]:
    """(host/path, verdict) pairs with token, expression over `host\\npath`, and rank."""
    split = [(rule, verdict, *rule.partition("/")[::2]) for rule, verdict in rules]
    split = [(rule, verdict, "".join(c.lower() if "A" <= c <= "Z" else c for c in host), "/" + path if "/" in rule else "")
             for rule, verdict, host, path in split]
    shared = Counter(t for _, _, host, path in split for t in set(_tokens(host, path)))
    out = []
    for rule, verdict, host, path in split:
        token = min(_tokens(host, path), key=lambda t: (shared[t], -len(t), t), default="")
        spelled = [".*".join(re.escape(x) for x in part.split("*")) for part in (host, path)]
        pattern = rf"\A(?:[^\n]*\.)?{spelled[0]}\n{spelled[1]}"
        out.append(Rule(rule, verdict, token, pattern, f"{len(host) + len(path):06d}{len(host):06d}{rule}"))
    return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    # A-Z only: other letters keep their case
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct lower-case tokens of a url, and the empty one."""
    words = F.split(F.lower(F.concat(host, F.lit("\n"), path)), r"[^0-9a-z]+")
    return F.array_distinct(F.concat(words, F.array(F.lit(""))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """`pages` as a struct column `row`, with host, path, rule and verdict."""
    own = compiled(rules)
    parted = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(own) <= inline:
        best = _best_inline(own)
        judged = parted.withColumn("best", best) if own else parted.withColumn("best", F.lit(None).cast("struct<rank:string,rule:string,verdict:string>"))
    else:
        judged = _best_joined(parted, own)
    return judged.select("row", "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce(F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict"))


def _best_inline(own: list[Rule]) -> Column:
    """The winning rule as an expression: no row moves."""
    by_token: dict[str, list[Rule]] = {}
    for r in own:
        by_token.setdefault(r.token, []).append(r)
    entry = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    index = F.create_map(*[x for t, rs in by_token.items() for x in (F.lit(t), F.array(*map(entry, rs)))])
    target = F.concat("host", F.lit("\n"), "path")
    fetched = F.flatten(F.filter(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.try_element_at(index, t)), lambda c: c.isNotNull()))
    fitting = F.filter(fetched, lambda c: F.rlike(target, c["pattern"]))
    best = F.array_max(F.transform(fitting, lambda c: F.struct(c["rank"].alias("rank"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))
    return F.when(F.col("host") != "", best)


def _best_joined(parted: DataFrame, own: list[Rule]) -> DataFrame:
    """The winning rule through a join on tokens, once per distinct (host, path)."""
    spark: SparkSession = parted.sparkSession
    index = spark.createDataFrame([(r.token, r.rank, r.rule, r.verdict, r.pattern) for r in own],
                                  "token string, rank string, rule string, verdict string, pattern string")
    if len(own) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    urls = parted.select("host", "path").distinct().filter("host != ''")
    fetched = urls.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path")))).join(index, "token")
    fitting = fetched.filter(F.rlike(F.concat("host", F.lit("\n"), "path"), F.col("pattern")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    return parted.join(best, ["host", "path"], "left")
