"""URL filters: host and path rules, and a weighted vocabulary matched by Aho-Corasick.

A strict term weighs as much as the limit, a soft term one. Each distinct term counts once, and only where no ASCII
letter or digit touches it; a url whose weights reach the limit is blocked: one strict or several distinct soft terms.
Terms are looked for in host and path, A-Z lower-cased.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed; repeated rows give
repeated rows; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Reject when the weights of the distinct terms found reach this.
LIMIT = 2
STRICT = ("porn", "xxx", "casino", "viagra", "pills", "escort", "spam", "adult", "jackpot", "hentai", "camgirls")
SOFT = ("free", "cheap", "bets", "bet", "win", "poker", "ads", "track", "tracker", "farm", "click", "bonus", "loan", "deal", "sex", "pill")
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)?", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty string."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))


@functools.lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...], limit: int):
    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (limit, strict)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def _free(text: str, i: int) -> bool:
    return not 0 <= i < len(text) or not (text[i].isascii() and text[i].isalnum())


def weight_of(text: str, strict: tuple[str, ...], soft: tuple[str, ...], limit: int) -> int:
    found = {}
    for last, (term, weight) in automaton(strict, soft, limit).iter(text):
        if _free(text, last + 1) and _free(text, last - len(term)):
            found[term] = weight
    return sum(found.values())


def vocabulary_weight(text: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, limit: int = LIMIT) -> Column:
    strict, soft = tuple(strict), tuple(soft)

    @pandas_udf("long")
    def weigh(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: weight_of(t, strict, soft, limit))

    return weigh(text)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of two as long, the blocking one)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judge(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    limit: int = LIMIT,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, weight) of each row."""
    parts = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select(
        "_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    host, path = F.col("host"), F.col("path")
    text = F.concat(host, F.translate(path, UPPER, LOWER))
    name, verdict = rule_for(host, path, rules)
    weighed = parts.withColumn("weight", vocabulary_weight(text, strict, soft, limit))
    method = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return weighed.select(
        F.col("_id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "weight"
    )


def judge_sql(rules=RULES, strict=STRICT, soft=SOFT, limit=LIMIT) -> str:
    """``judge`` over ``pages`` as SQL."""
    term = lambda t: f"CAST(regexp_matches(t, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)"
    weight = " + ".join([*(f"{limit} * {term(t)}" for t in strict), *(term(t) for t in soft)])
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    names = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    kinds = " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in ordered)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM rest),
weighed AS (
  SELECT *, {weight} AS weight FROM (SELECT *, host || translate(path, '{UPPER}', '{LOWER}') AS t FROM parts))
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {kinds} WHEN weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict, weight FROM weighed"""
