"""URL filter: host-suffix and path-prefix expressions, joined with rules on a short hash prefix.

An empty or NULL url, or one without "://", has an empty host and path and fits no rule. Ports and
user names count as part of the host, as the contract cuts at "/", "?" and "#" only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
# Rules are held on every executor up to this many; each takes some 200 bytes. Beyond it the join is
# left to the optimizer, which shuffles both sides by the hash prefix.
BROADCAST_RULES = 100_000

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, LETTERS, LETTERS.lower()), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def expressions(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Digests of every (host suffix at a label border) x (prefix of the path of a rule's length).

    Rule paths are plain prefixes, so only prefixes as long as some rule's path can fit.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.filter(
        F.lit(path_lengths).cast("array<int>"), lambda n: n <= F.length(path)
    )
    pairs = F.transform(
        suffixes, lambda s: F.transform(lengths, lambda n: digest(s, F.substring(path, F.lit(1), n)))
    )
    return F.array_distinct(F.flatten(pairs))


def judged(
    pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url"
) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` are (verdict, host, path). The longest fitting rule wins (host and path together); of
    equally long ones the one with the longer host, then block before allow. Expressions are made
    once per distinct (host, path) that occurs, matched by a prefix of their digest, confirmed by
    the whole digest, and the winning rule is joined back; repeated pages stay repeated. Columns of
    `pages` named host, path, rule or verdict are replaced, others pass through; no pages, no rows.
    """
    host, path = host_and_path(F.col(url))
    parted = pages.withColumns({"host": host, "path": path})
    # One literal, however many rules, so that no Python rows enter the plan.
    given = json.dumps([{"r_verdict": v, "r_host": h, "r_path": p} for v, h, p in rules])
    rule_type = "array<struct<r_verdict:string,r_host:string,r_path:string>>"
    listed = pages.sparkSession.range(1).select(F.inline(F.from_json(F.lit(given), rule_type)))
    listed = listed.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "prefix", F.substring("r_digest", 1, PREFIX_DIGITS)
    )
    if len(rules) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    lengths = sorted({len(p) for _, _, p in rules})
    places = parted.select("host", "path").where("host <> ''").distinct()
    asked = places.select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e")
    ).withColumn("prefix", F.substring("e", 1, PREFIX_DIGITS))
    precedence = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host"),
        (F.col("r_verdict") == "block").alias("block"),
    )
    won = (
        asked.join(listed, "prefix")
        .where(F.col("e") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), precedence
            ).alias("__won")
        )
    )
    return (
        parted.join(won, ["host", "path"], "left")
        .withColumns(
            {
                "rule": F.col("__won.rule"),
                "verdict": F.coalesce(F.col("__won.r_verdict"), F.lit(DEFAULT_VERDICT)),
            }
        )
        .drop("__won")
    )
