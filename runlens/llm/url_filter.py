"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests, precedence.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or ends in a dot and the rule's, and whose
path starts with the rule's, at any character. The rule of the longest text (host and path) wins, then that of the
longer host, then ``block`` before others. A URL that no rule fits gets ``default``: a list of rules says what
is listed, all else is ``allow``.

Every URL is expanded into the strings a fitting rule can have: the host suffixes of as many labels, and the path
prefixes of as many characters, as some rule has. Only the first ``PREFIX_BYTES`` bytes of their SHA-256 are joined; a pair
counts if the whole digests agree. Verdicts depend on host and path alone, so they are found once for each
distinct pair and then joined to the rows; AQE splits a pair that holds many of them.

Rules are broadcast after their size was measured. Beyond the bound only rules whose prefix some URL asks for are
kept (distinct prefixes combine before they shuffle, however many URLs share ``com/``). If those are too many as
well, expressions are dealt over ``SALTS`` parts of each prefix and the rules repeated for them.

Built-in functions only. Defined cases: null URLs and those without ``://`` have empty host and path, and no host rule fits an
empty host. Rules with a null host, path or verdict, or an empty host, fit nothing; of rules with equal host and
path the one that precedes is taken. Repeated rows stay. No rules, or no rows, are fine. Other columns pass through, columns called host, path, rule
or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runlens.llm.common import table
from runlens.session import BROADCAST_BYTES, BROADCAST_ROWS, measure

PREFIX_BYTES = 4
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to a slash, question mark or hash; and from there up to one of the latter."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: str) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def listed_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with their digests, and what decides between those that fit."""
    usable = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where(
        "host is not null and path is not null and verdict is not null and host <> ''"
    )
    blocks = F.col("verdict") == "block"
    first = usable.groupBy("host", "path").agg(F.max(F.struct(blocks.alias("blocks"), "verdict")).alias("v"))
    rule, digest = F.concat("host", "path"), F.col("digest")
    return first.select(
        "host", "path", rule.alias("rule"), F.col("v.verdict").alias("verdict"), _digest(rule).alias("digest"),
        F.struct(F.char_length(rule).alias("chars"), F.char_length("host").alias("host_chars"), "v.blocks").alias("order"),
    ).withColumn("prefix", F.substring(digest, 1, PREFIX_BYTES))


def _shapes(listed: DataFrame) -> list[tuple[int, int]]:
    """Host labels and path characters that rules have. As many as lengths, not as rules; runs a job."""
    return sorted(map(tuple, listed.select(_labels("host"), F.char_length("path")).distinct().collect()))


def expressions(host: str, path: str, shapes: list[tuple[int, int]]) -> Column:
    """All strings of these shapes that a rule for the URL can have."""
    numbers = lambda i: F.split(F.lit(",".join(str(s[i]) for s in shapes)), ",").cast("array<int>")
    shape = F.arrays_zip(numbers(0).alias("labels"), numbers(1).alias("chars"))
    fits = F.filter(shape, lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.char_length(path)))
    suffix = lambda s: F.call_function("substring_index", F.col(host), F.lit("."), -s["labels"])
    return F.transform(fits, lambda s: F.concat(suffix(s), F.substr(F.col(path), F.lit(1), s["chars"])))


def _joined(asked: DataFrame, listed: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Expressions with the rules of the same hash prefix."""

    def small(df: DataFrame) -> bool:
        rows, size = measure(df)
        return rows <= max_rows and size <= max_bytes

    if small(listed):
        return asked.join(F.broadcast(listed), "prefix")
    wanted = table(listed.join(asked.select("prefix").distinct(), "prefix", "left_semi"), "rules")
    if small(wanted):
        return asked.join(F.broadcast(wanted), "prefix")
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["prefix", "salt"])


def verdicts(
    urls: DataFrame, rules: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) rows that a rule fits. Runs jobs."""
    listed = table(listed_rules(rules), "listed")
    shapes = _shapes(listed)
    seen = urls.select("host", "path").distinct()
    if not shapes:
        return seen.where("false").selectExpr("host", "path", "'' as rule", "'' as verdict")
    asked = seen.where("host <> ''").withColumn("expression", F.explode(expressions("host", "path", shapes)))
    hashed = asked.select("host", "path", _digest(F.col("expression")).alias("asked"))
    hashed = hashed.withColumn("prefix", F.substring("asked", 1, PREFIX_BYTES))
    pairs = _joined(hashed, listed.drop("host", "path"), max_rows, max_bytes).where("asked = digest")
    best = F.max_by(F.struct("rule", "verdict"), "order")
    return table(pairs.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict"), "verdicts")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of ``pages``, with host, path, rule (null if none fits) and verdict. Runs jobs."""
    host, path = host_and_path(F.col(f"`{url}`"))
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    found = verdicts(pages.select(host.alias("host"), path.alias("path")), rules, max_rows, max_bytes)
    judged = pages.select(*named, host.alias("host"), path.alias("path")).join(found, ["host", "path"], "left")
    return judged.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
