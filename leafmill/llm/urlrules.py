"""Pattern rules for URLs, each found by its rarest literal token.

Rules have the syntax of content filters: ``||host^`` anchors at a host or its parent, ``|`` at an end of the URL, ``*`` is anything, ``^`` a separator or
the end, ``/.../`` a regular expression, a leading ``@@`` an exception; all without regard to case. A literal run of letters and digits between
characters that are neither must be a whole token of every URL that the rule matches, in a regular expression of every URL that one of its alternatives matches. Of each
alternative's tokens the one rarest among all URLs is a key of the rule: a URL's tokens fetch its candidate rules, and only those run their regular expressions. Rules with an
alternative that has no token are candidates for every URL; ``RULES`` has none.
"""

from __future__ import annotations

import re
from re import _parser  # type: ignore[attr-defined]  the standard library's own parser of expressions
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved

#: What the registered query filters by: spam hosts, tracking parameters, pagination, archives and a few exceptions.
RULES = [
    "||spam-farm.example.org^", "||cheap-pills.example.com^", "||casino.example.net^", "||adult-site.example.com^", "||ads.example.org^",
    "?utm_source=feed", "&utm_medium=", "?page=*&ref=", "&ref=x|", "|http://blog.", "||m.*/fr/", ".html|", "/es/*/|", "#top|", "/login^", "/wp-admin/", "/cgi-bin/", "/feed/rss^",
    r"/\/(?:en|de)\/\d{1,2}(?:[?#]|$)/", r"/^https:\/\/www\.[a-z]+\.example\.com\/en\/\d+$/", "@@||example.org/de/", "@@/en/7*.html|", "@@||blog.*/en/1",
]

#: A regular expression with more alternatives than this when its groups are multiplied out has no token.
MOST = 64


class Rule(NamedTuple):
    rule_id: int
    allow: bool
    pattern: str
    #: Of each alternative, the tokens that every match holds whole.
    tokens: list[list[str]]


def compiled(text: str, rule_id: int) -> Rule:
    """The rule's regular expression, in what Java and RE2 have in common, over lower-case URLs, and the tokens that its matches must hold whole. A blank rule raises ValueError."""
    allow, body = text.startswith("@@"), text.removeprefix("@@").strip()
    if not body.strip("*|^"):
        raise ValueError(f"rule {rule_id} matches everything: {text!r}")
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\\[({$?+]", body):
        pattern = body[1:-1].replace(r"\/", "/")
        return Rule(rule_id, allow, pattern, expression_tokens(pattern))
    body = body.lower()
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    body = body.lstrip("|")
    body = body[:-1] if end else body
    pattern = "".join(".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() or c in "_/-=&%#:;,~!@\"'<> " else "\\" + c for c in body)
    head = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if host else "^" if start else ""
    symbols = [_EDGE if host or start else _GAP, *(_GAP if c == "*" else _EDGE if c == "^" else c for c in body), _EDGE if end else _GAP]
    return Rule(rule_id, allow, head + pattern + ("$" if end else ""), [_whole(symbols)])


#: In what an expression spells: something unknown, which may go on with a token; the URL's edge or a character of no token.
_GAP, _EDGE = "gap", "edge"


def _whole(symbols: list[str]) -> list[str]:
    """The runs of letters and digits that nothing unknown touches."""
    found, run, open_ = set(), "", False
    for c in [*symbols, _GAP]:
        if len(c) == 1 and c.isascii() and c.isalnum():
            run += c
            continue
        if run and not open_ and c != _GAP:
            found.add(run)
        run, open_ = "", c == _GAP
    return sorted(found)


def expression_tokens(pattern: str) -> list[list[str]]:
    """Of each alternative of a regular expression, the tokens that each of its matches holds whole; alternatives are multiplied out, up to ``MOST``."""
    try:
        ways = _ways(list(_parser.parse(pattern)))
    except (re.error, OverflowError):
        return [[]]
    return [_whole([_GAP, *w, _GAP]) for w in ways] if ways else [[]]


def _ways(items: list) -> list[list[str]] | None:
    out: list[list[str]] = [[]]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = [[chr(arg)]]
        elif name == "AT":
            more = [[_EDGE]] if str(arg) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING") else [[_GAP]]
        elif name == "IN":
            more = [[_EDGE if all(str(k) == "LITERAL" and not chr(v).isalnum() for k, v in arg) else _GAP]]
        elif name == "SUBPATTERN":
            more = _ways(list(arg[3])) if not arg[1] and not arg[2] else [[_GAP]]
        elif name == "BRANCH":
            parts = [_ways(list(x)) for x in arg[1]]
            more = None if any(x is None for x in parts) else [w for x in parts for w in x]
        else:
            more = [[_GAP]]
        if more is None or len(out) * len(more) > MOST:
            return None
        out = [a + b for a in out for b in more]
    return out


def filtered(df: DataFrame, rules: list[str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, blocked, rules): the rules that match each row's URL, as a sorted array of their places in the list, from 0; blocked if one does that is no
    exception and no exception does.

    A null or empty URL matches nothing and isn't blocked. Repeated rows are decided alike, each. Rules that are repeated all match. An empty table gives an
    empty result. Other columns are ignored, whatever their names."""
    spark = df.sparkSession
    made = [compiled(r, k) for k, r in enumerate(RULES if rules is None else rules)]
    urls = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    distinct = urls.where("url <> ''").select("url").distinct().withColumn("low", F.lower("url"))
    tokens = distinct.select("url", "low", F.array_distinct(F.filter(F.split("low", "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))

    schema = "rule_id int, allow boolean, pattern string, tokens array<array<string>>"
    table = spark.createDataFrame(made, schema) if made else spark.createDataFrame([], schema)
    ways = table.select("rule_id", F.posexplode("tokens").alias("way", "tokens"))
    wanted = ways.select("rule_id", "way", F.explode("tokens").alias("token"))
    counted = _small(tokens.select(F.explode("tokens").alias("token")), wanted.select("token").distinct(), made, "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # each alternative's rarest token; a rule with an alternative that has none has no key
    rarest = wanted.join(counted, "token", "left").groupBy("rule_id", "way").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    keys = ways.join(rarest, ["rule_id", "way"], "left").groupBy("rule_id").agg(F.collect_set("token").alias("keys"), F.bool_or(F.col("token").isNull()).alias("loose"))
    index = saved(table.join(keys, "rule_id").select("rule_id", "allow", "pattern", "loose", "keys"))

    keyed = _small(tokens.select("url", "low", F.explode("tokens").alias("token")), index.where("NOT loose").select("rule_id", "allow", "pattern", F.explode("keys").alias("token")), made, "inner")
    loose = index.where("loose").select("rule_id", "allow", "pattern")
    if not loose.isEmpty():
        every = tokens.select("url", "low").crossJoin(F.broadcast(loose) if _bytes(made) <= BROADCAST_BYTES else loose)  # each such rule is stated to be one of every URL
        keyed = keyed.select("url", "low", "rule_id", "allow", "pattern").unionByName(every)
    hits = keyed.select("url", "low", "rule_id", "allow", "pattern").where("low RLIKE pattern")
    decided = hits.groupBy("url").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"), F.bool_or("allow").alias("allowed"), F.bool_or(~F.col("allow")).alias("struck"))
    return urls.join(decided, "url", "left").select("page_id", "url", F.coalesce(F.col("struck") & ~F.col("allowed"), F.lit(False)).alias("blocked"), F.coalesce("rules", F.array().cast("array<int>")).alias("rules"))


def _bytes(made: list[Rule]) -> int:
    return sum((64 + len(r.pattern)) * max(1, len(r.tokens)) + 16 * sum(map(len, r.tokens)) for r in made)


def _small(big: DataFrame, side: DataFrame, made: list[Rule], how: str) -> DataFrame:
    return big.join(F.broadcast(side) if _bytes(made) <= BROADCAST_BYTES else side, "token", how)


def sql() -> str:
    """The registered query in DuckDB's SQL: every rule's expression on every URL."""
    quoted = ", ".join("({}, {}, '{}')".format(r.rule_id, str(r.allow).lower(), r.pattern.replace("'", "''")) for r in (compiled(x, k) for k, x in enumerate(RULES)))
    return f"""
WITH r(rule_id, allow, pattern) AS (VALUES {quoted}),
u AS (SELECT DISTINCT url FROM pages WHERE url <> ''),
h AS (SELECT url, string_agg(rule_id::VARCHAR, ',' ORDER BY rule_id) AS rules, bool_or(allow) AS allowed, bool_or(NOT allow) AS struck FROM u JOIN r ON regexp_matches(lower(url), pattern) GROUP BY url)
SELECT page_id, url, coalesce(struck AND NOT allowed, false) AS blocked, coalesce(rules, '') AS rules FROM pages LEFT JOIN h USING (url)"""
