"""URL filters: pattern rules indexed by their rarest literal token.  DataFrame functions only.

The literal tokens that every fitting URL must hold are read off a rule's
pattern, for each of its branches.  How often each token occurs is counted over
all URLs, and a rule is filed, for each branch, under the rarest one; a branch
without such a token is filed under the empty one, which every URL has.  URLs'
tokens are joined with that index, only the rules so fetched run their regular
expressions, and the best fitting rule is joined back by URL.

The index is broadcast while its rules' text, which is measured, takes
``BROADCAST_BYTES`` at most; beyond that the same joins shuffle.
"""

from __future__ import annotations

import re
import re._parser as syntax
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the index's rules up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


class Rule(NamedTuple):
    """``on``: ``site`` (host and path) or ``url`` (the whole URL, A-Z lower-cased); tier 0 beats tier 1, then the longest."""

    name: str
    verdict: str
    pattern: str
    on: str = "url"
    tier: int = 1

    @property
    def weight(self) -> int:
        return len(self.name)


#: What a place of a pattern can hold beside a letter or digit: something that ends a token for certain, or anything.
_END, _ANY = "end", "any"
#: Ways through a pattern that are told apart; a part with more counts as anything.
WAYS = 64


def _ways(parsed) -> list[list[str]]:
    """The ways through a parsed pattern, each a list of letters, digits, ends and unknowns."""
    ways: list[list[str]] = [[]]
    for op, arg in parsed:
        if op is syntax.LITERAL:
            c = chr(arg).lower()
            step = [[c if re.fullmatch("[a-z0-9]", c) else _END]]
        elif op is syntax.IN:
            ends = all(o is syntax.LITERAL and not re.fullmatch("[A-Za-z0-9]", chr(x)) for o, x in arg)
            step = [[_END if ends else _ANY]]
        elif op is syntax.AT:
            step = [[_END if arg in (syntax.AT_BEGINNING, syntax.AT_END) else _ANY]]
        elif op is syntax.BRANCH:
            step = [w for branch in arg[1] for w in _ways(branch)]
        elif op is syntax.SUBPATTERN:
            step = _ways(arg[-1])
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
            least, most, inner = arg
            step = ([[]] if least == 0 else []) + (_ways(inner) if most == 1 else [[_ANY]])
        else:
            step = [[_ANY]]
        ways = [a + b for a in ways for b in (step if len(step) * len(ways) <= WAYS else [[_ANY]])]
    return ways


def literals(pattern: str) -> set[tuple[str, ...]]:
    """For each branch of a pattern the whole tokens that all its matches hold."""
    out = set()
    for way in _ways(syntax.parse(pattern)):
        tokens, run = set(), None  # run: letters since an end, or None after an unknown
        for x in [*way, _ANY]:
            if x == _END:
                tokens |= {run} if run else set()
                run = ""
            else:
                run = None if x == _ANY or run is None else run + x
        out.add(tuple(sorted(tokens)))
    return out


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path."""
    where = host + path
    return Rule(where, verdict, "^(?:[^/]*\\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", where), "site", 0)


#: The contract's site rules.
SITE_RULES = [
    site_rule("net", "/", "block"),
    site_rule("example.net", "/en/", "allow"),
    site_rule("example.com", "/de/", "block"),
    site_rule("org", "/fr/", "allow"),
]

#: Pattern rules for everything that no site rule decides.
PATTERN_RULES = [
    Rule("spam-farm", "block", r"://(?:[^/?#]*[.-])?spam-farm[.-]"),
    Rule("cheap-pills", "block", r"://(?:[^/?#]*[.-])?cheap-pills[.-]"),
    Rule("free-casino", "block", r"[./-](?:free-)?casino[./-]"),
    Rule("adult-site", "block", r"://(?:[^/?#]*\.)?(?:xxx|porn)\."),
    Rule("adult-domain", "block", r"://[^/?#]*\.xxx(?:[/:?#]|$)"),
    Rule("session-link", "block", r"[?&;](?:php)?sessid="),
    Rule("php-session-link", "block", r"[?&;]phpsessid="),
    Rule("login-page", "block", r"/(?:wp-)?login(?:[./?#]|$)"),
    Rule("cart-page", "block", r"/(?:cart|checkout)/?(?:[?#]|$)"),
]

DEFAULT = "allow"
_ADDRESS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def address(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty without a scheme or a URL."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({"host": lower_ascii(F.regexp_extract(url, _ADDRESS, 1)), "path": F.regexp_extract(url, _ADDRESS, 2)})


def url_tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the URL."""
    return F.array_distinct(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def _broadcast(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df.hint("shuffle_hash")


def rarest(pages: DataFrame, rules: list[Rule], most: int = BROADCAST_BYTES) -> list[tuple[str, Rule]]:
    """The index: (token, rule filed under it).  Counts each literal token over all URLs."""
    branches = [(r, literals(r.pattern)) for r in rules]
    words = sorted({t for _, b in branches for ts in b for t in ts})
    n: dict[str, int] = {}
    if words:
        table = _broadcast(pages.sparkSession.createDataFrame([(w,) for w in words], "t string"), sum(map(len, words)), most)
        met = pages.select(F.explode(url_tokens(F.col("url"))).alias("t")).join(table, "t")
        n = {r["t"]: r["count"] for r in met.groupBy("t").count().collect()}  # one row for each literal of a rule at most
    return sorted({(min(ts, key=lambda t: (n.get(t, 0), t), default=""), r) for r, b in branches for ts in b})


def judge(pages: DataFrame, rules: list[Rule] | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and method_rule of every page.

    ``rule`` is the deciding site rule; without one, ``method_rule`` is the
    deciding pattern rule, and without either the verdict is ``allow``.  Null
    and scheme-less URLs have an empty host and path and are judged by pattern
    rules alone; repeated rows and rows without a page_id are judged each; empty
    tables give no rows; other columns are ignored.
    """
    rules = [*SITE_RULES, *PATTERN_RULES] if rules is None else rules
    rows = [(t, r.name, r.verdict, r.pattern, r.on == "site", r.tier, r.weight) for t, r in rarest(pages, rules, most)]
    filed = pages.sparkSession.createDataFrame(rows, "t string, name string, verdict string, pattern string, site boolean, tier int, weight int")
    filed = _broadcast(filed, sum(len(x) for r in rows for x in r[:4]), most)
    tokens = F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))
    met = address(pages.select("url")).select("url", "host", "path", F.explode(tokens).alias("t")).join(filed, "t")
    fits = F.when(F.col("site"), F.regexp_like(F.concat("host", "path"), F.col("pattern"))).otherwise(F.regexp_like(lower_ascii(F.coalesce("url", F.lit(""))), F.col("pattern")))
    best = met.where(fits).groupBy(F.coalesce("url", F.lit("")).alias("found")).agg(F.max(F.struct((-F.col("tier")).alias("tier"), "weight", "name", "verdict")).alias("best"))
    base = address(pages.select("page_id", "url"))
    out = base.join(best, F.coalesce(base.url, F.lit("")) == best.found, "left")
    return out.select(
        "page_id", "url", "host", "path", F.when(F.col("best.tier") == 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"), F.when(F.col("best.tier") < 0, F.col("best.name")).alias("method_rule"),
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for :func:`op7_url_filter`, without an index."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    sites = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.name[: r.name.index('/')])}, {q(r.name[r.name.index('/') :])})" for r in SITE_RULES)
    pats = ", ".join(f"({q(r.name)}, {q(r.verdict)}, {q(r.pattern)})" for r in PATTERN_RULES)
    return f"""
WITH s(rule, verdict, rhost, rpath) AS (VALUES {sites}),
m(name, verdict, pattern) AS (VALUES {pats}),
p AS (SELECT row_number() OVER () AS k, page_id, url,
             translate(regexp_extract(coalesce(url, ''), '{_ADDRESS}', 1), '{upper}', '{lower}') AS host,
             regexp_extract(coalesce(url, ''), '{_ADDRESS}', 2) AS path FROM pages),
bs AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
       FROM p, s WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
bm AS (SELECT k, arg_max(verdict, length(name)) AS verdict FROM p, m
       WHERE regexp_matches(translate(coalesce(url, ''), '{upper}', '{lower}'), pattern) GROUP BY k)
SELECT page_id, host, path, bs.rule AS rule, coalesce(bs.verdict, bm.verdict, 'allow') AS verdict
FROM p LEFT JOIN bs USING (k) LEFT JOIN bm USING (k)"""
