"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rule.  A *site rule* is a host and a path: it fits the host and its subdomains if
the url's path starts with the rule's; the longest fitting one decides.  A *pattern rule* is a
regular expression over ``host + rest of the url``; it decides where no site rule fits, block
before allow.  Both are regular expressions in the end, and every rule is filed under one token,
the rarest in the corpus of those that any url fitting it must hold as a whole token.  Each
distinct url is cut into tokens, the tokens fetch the rules filed under them by a join, and only
those run.  A rule without such a token runs on every url.

Tokens are maximal runs of ASCII letters and digits, lower-cased.

Defined results: a null url or one without ``://`` has an empty host and path and is allowed,
unless a rule without token fits the empty text; pages without an id and repeated pages are judged
like others; other columns are not used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import quoted, written

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre


@dataclass(frozen=True)
class Site:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return r"^(?:[^/?#]*\.)?" + _literal(self.host) + ("" if self.path.startswith("/") else r"(?![^/?#])") + _literal(self.path)


@dataclass(frozen=True)
class Pattern:
    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


#: Used where a query gives no others: unwanted hosts and paths.
DEFAULT_PATTERNS = (
    Pattern("block", r"(?:^|\.)spam-farm\."), Pattern("block", r"(?:^|[./-])casino[./-]"), Pattern("block", r"(?:^|[./-])adult[./-]"),
    Pattern("block", r"/login(?:[/?#.]|$)"), Pattern("block", r"/cart(?:[/?#.]|$)"), Pattern("block", r"[?&]sessionid="),
)


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every text matched by ``pattern`` holds whole: runs of literals between other literals or ends."""
    found: set[str] = set()
    run, open_left = "", False  # open_left: what stands before the run surely is no token character
    for op, arg in [*_sre.parse(pattern), (None, None)]:
        name = str(op)
        c = chr(arg).lower() if name == "LITERAL" else ""  # tokens are lower-cased
        if c and c.isascii() and c.isalnum():
            run += c
            continue
        border = bool(c) or op is None or _borders([(op, arg)])
        if run and open_left and border:
            found.add(run)
        run, open_left = "", border
    return found


def _no_token_character(items) -> bool:
    """A character class of listed characters, none of which can be in a token."""
    return all(str(op) == "LITERAL" and not (chr(a).isascii() and chr(a).isalnum()) for op, a in items)


def _borders(items) -> bool:
    """Whether the items are one end of the text or one character that no token holds, in each of their branches."""
    items = list(items)
    if len(items) != 1:
        return False
    (op, arg), name = items[0], str(items[0][0])
    if name == "BRANCH":
        return all(_borders(branch) for branch in arg[1])
    if name == "SUBPATTERN":
        return _borders(arg[-1])
    if name == "LITERAL":
        return not (chr(arg).isascii() and chr(arg).isalnum())
    return name == "AT" and str(arg) != "AT_NON_BOUNDARY" or name == "IN" and _no_token_character(arg)


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Lower-cased host, path, and host with all that follows it."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    there = F.contains(u, F.lit("://"))
    after = F.when(there, F.substr(u, F.locate("://", u) + 3)).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^?#]*", 0), F.concat(host, rest)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"))


def _site_tokens(rule: Site) -> set[str]:
    """Tokens of a site rule: all of its host's labels, and of its path those that end before the path does."""
    host = re.findall(r"[a-z0-9]+", rule.host.lower())
    path = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", rule.path.lower()) if rule.path.startswith("/") else []
    return {*host, *path}


def judged(pages: DataFrame, sites: list[Site], patterns: list[Pattern] | tuple = DEFAULT_PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, url, host, path, rule, verdict, pattern)``: the deciding site rule's name or null, and the deciding pattern or null."""
    spark = pages.sparkSession
    rules = [(i, "site", r.action, r.name, r.pattern, len(r.name), sorted(_site_tokens(r))) for i, r in enumerate(sites)]
    rules += [(len(rules) + i, "pattern", r.action, r.name, r.pattern, 0, sorted(literal_tokens(r.pattern))) for i, r in enumerate(patterns)]
    table = spark.createDataFrame(rules, "rule_id int, kind string, action string, name string, pattern string, length int, tokens array<string>")

    host, path, text = host_and_path(F.col("url"))
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).cast("string").alias("url"))
    urls = rows.select("url").distinct().select("url", text.alias("text"))
    tokens = urls.select("url", "text", F.explode(_tokens(F.col("text"))).alias("token"))
    wanted = table.select("rule_id", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    filed = table.drop("tokens").join(rarest, "rule_id", "left")
    candidates = tokens.join(filed.where("token IS NOT NULL"), "token").drop("token")
    always = [r for r in rules if not r[-1]]
    if always:
        each = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r[:6], ("rule_id", "kind", "action", "name", "pattern", "length"), strict=True)]) for r in always])
        candidates = candidates.unionByName(urls.select("url", "text", F.explode(each).alias("r")).select("url", "text", "r.*"))
    fits = candidates.where(F.rlike("text", F.col("pattern")))
    block = (F.col("action") == "block").cast("int")
    site = F.max(F.when(F.col("kind") == "site", F.struct("length", block.alias("block"), F.col("name"))))
    other = F.max(F.when(F.col("kind") == "pattern", F.struct(block.alias("block"), F.col("name"))))
    # written, so that the join below is between two shuffles and a very common url can be split
    best = written(fits.groupBy("url").agg(site.alias("site"), other.alias("other")).withColumnRenamed("url", "_url"), "best")
    out = rows.join(best.hint("shuffle_hash"), F.col("url").eqNullSafe(F.col("_url")), "left")  # a row for each url: not to be broadcast
    blocked = F.coalesce(F.col("site.block"), F.col("other.block"), F.lit(0)) == 1
    pattern = F.when(F.col("site").isNull(), F.col("other.name"))
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), host.alias("host"), path.alias("path"), F.col("site.name").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), pattern.alias("pattern")
    )
