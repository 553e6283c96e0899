"""URL filters: rules indexed by their rarest literal token.

A rule is written in the syntax of filter lists: ``||`` starts at a host's
label, ``*`` is anything, ``^`` a separator or the end; the rest is literal.
Each rule stands in the index under the literal token that the fewest URLs
have. A URL's tokens fetch their rules, and only those run their regular
expressions. Host rules (rank over 0) mind the case of paths, pattern rules
don't.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Rule(NamedTuple):
    verdict: str
    text: str
    #: Of two rules that fit, one of a higher rank wins, then the longer one.
    rank: int


#: Host and path rules, which come first.
HOST_RULES = (
    Rule("allow", "||com/", 1),
    Rule("block", "||example.com/en/", 1),
    Rule("allow", "||www.example.com/en/", 1),
    Rule("block", "||net/es/", 1),
    Rule("block", "||net/fr/", 1),
)
PATTERN_RULES = (
    Rule("block", "||spam-farm.", 0),
    Rule("block", "-spam.", 0),
    Rule("block", "^casino^", 0),
    Rule("block", "^poker^", 0),
    Rule("block", "^adult^", 0),
    Rule("block", "/wp-login.php", 0),
    Rule("block", "/cgi-bin/*.cgi^", 0),
    Rule("block", "^phishing^", 0),
)
DEFAULT = "allow"
#: Rules whose index may be broadcast; beyond, the join shuffles.
BROADCAST_RULES = 100_000
#: The token of rules that have no literal one: each URL fetches them.
ANY = ""


def regex_of(text: str) -> str:
    """The rule as a regular expression over host and what follows it. A separator that a rule begins with is the host's start, too."""
    body, head = (text[2:], r"^([^/?#]*\.)?") if text.startswith("||") else (text, "")
    special = {"*": ".*", "^": r"([^A-Za-z0-9_%]|$)"}
    if not head and body.startswith("^"):
        body, head = body[1:], r"(^|[^A-Za-z0-9_%])"
    return "(?s)" + head + "".join(special.get(c) or re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", c) for c in body)


def literal_tokens(text: str) -> list[str]:
    """Tokens that each URL has that the rule fits: runs of letters and digits with a fixed character or anchor on either side."""
    body = ("|" + text[2:] if text.startswith("||") else "*" + text).lower() + "*"
    return [m[0] for m in re.finditer(r"[a-z0-9]+", body) if body[m.start() - 1] != "*" and body[m.end()] != "*"]


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _lower(text: Column) -> Column:
    """A to Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; nothing without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_append(F.array_remove(F.array_distinct(F.split(_lower(target), "[^a-z0-9]+")), ""), F.lit(ANY))


_LISTED = "verdict string, text string, rank int, regex string, literals array<string>"


def _listed(verdict: str, text: str, rank: int) -> tuple:
    """A rule with what the index needs. Pattern rules, of rank 0, are lower case."""
    text = text if rank > 0 else text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return verdict, text, rank, regex_of(text), literal_tokens(text) or [ANY]


def listed_rules(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """Rules, given here or as a table (verdict, text, rank), with their regular expressions and literal tokens."""
    if not isinstance(rules, DataFrame):
        return pages.sparkSession.createDataFrame([_listed(*r) for r in rules], _LISTED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [_listed(*r) for r in rows.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["verdict", "text", "rank", "regex", "literals"])

    return rules.select("verdict", "text", F.coalesce("rank", F.lit(0)).cast("int").alias("rank")).dropna().mapInPandas(run, _LISTED)


def judge(pages: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] | DataFrame = HOST_RULES + PATTERN_RULES, default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    Each distinct URL is judged once. ``rules`` are listed or a table
    (verdict, text, rank); of its rows those with a null verdict or text count
    for nothing, and a null rank is 0. ``rule`` is the host rule that won,
    written without its anchor; null if none fits, and then pattern rules
    or ``default`` give the verdict. Of rules of one text "block" wins. A null
    URL or one without ``://`` has an empty host and path and fits no rule
    that asks for any character. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    target = F.concat(host_of(F.col("url")), F.regexp_extract(_rest(F.col("url")), r"(?s)^[^/?#]*(.*)", 1))
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct().select("url", target.alias("target"))
    tokens = scratch.keep(urls.select("url", "target", _lower(F.col("target")).alias("lowered"), F.explode(_tokens(F.col("target"))).alias("token")), "tokens")
    listed = scratch.keep(listed_rules(pages, rules).distinct().select("verdict", "text", "rank", "regex", F.explode("literals").alias("token")), "rules")
    few = F.broadcast if listed.count() <= broadcast_rules else lambda df: df
    counts = tokens.join(few(listed.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    index = scratch.keep(listed.join(few(counts), "token", "left").groupBy("verdict", "text", "rank", "regex").agg(rarest.alias("token")), "index")
    fits = tokens.join(few(index), "token").filter(F.expr("rlike(if(rank > 0, target, lowered), regex)"))
    won = fits.groupBy("url").agg(F.max_by(F.struct("rank", F.col("text").alias("rule"), "verdict"), F.struct("rank", F.length("text"), "text", F.col("verdict") == "block")).alias("won"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    # Null URLs meet nothing: they stay out of the join, where all would be one key.
    judged = rows.filter(F.col("url").isNotNull()).join(won, "url", "left").select("page_id", "url", "won.*")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("rank", "int"), ("rule", "string"), ("verdict", "string"))]
    out = judged.unionByName(rows.filter(F.col("url").isNull()).select("page_id", "url", *nothing))
    url = F.coalesce("url", F.lit(""))
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.col("rank") > 0, F.regexp_replace("rule", r"^\|\|", "")).alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
