"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule rejects a document by a condition over features of its text. Features are built on demand, in
stages: what a rule does not need is not computed for a document that an earlier rule has rejected.
The cost of each feature (seconds that it takes on a sample, beyond those of reading it) and the
selectivity of each rule (share rejected) are measured on that sample, and rules run in order of rejections per cost.
The order changes the work, never the verdict, which is the conjunction of all rules.

Defined cases: null text has no words; it fails the word count rule. Repeated rows are judged alike. An
empty table gives an empty result; the rules then keep their given order. Columns of the input named
like a feature or like ``kept`` are replaced by the computed ones.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runlens.functions.once import evaluated
from runlens.llm.common import WORD, table

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 2000
#: Seconds below which the clock tells nothing.
LEAST_COST = 0.001
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over features and never null; ``needs`` lists those features."""

    name: str
    fails: str
    needs: tuple[str, ...]


#: Below the base rules, thresholds lie well outside of what prose in European languages shows.
RULES = (
    Rule("few_words", "n_words < 20", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", ("n_words", "n_repeat_words")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", ("n_words", "word_chars")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("repeated_lines", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
)
BASE = RULES[:2]

def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _lines_with_words(text: str) -> Column:
    return F.filter(F.split(_body(text), "\n"), lambda x: x.rlike(WORD))


def add_feature(df: DataFrame, name: str, text: str, wanted: Column | None = None) -> DataFrame:
    """Add one feature as a column; null where ``wanted`` is false, and not computed there."""

    def on_demand(value: Column) -> Column:
        return value if wanted is None else F.when(wanted, value)

    if name == "n_repeat_words":
        return _add_repeat_words(df, text, on_demand)
    value = {
        "n_words": lambda: F.regexp_count(_body(text), F.lit(WORD)),
        "word_chars": lambda: F.char_length(F.regexp_replace(_body(text), r"[\x20\x09-\x0D]+", "")),
        "n_symbols": lambda: F.regexp_count(_body(text), F.lit(SYMBOLS)),
        "n_lines": lambda: F.size(_lines_with_words(text)),
        "n_dup_lines": lambda: F.size(_lines_with_words(text)) - F.size(F.array_distinct(_lines_with_words(text))),
    }[name]()
    return df.withColumn(name, on_demand(value.cast("long")))


def _add_repeat_words(df: DataFrame, text: str, on_demand) -> DataFrame:
    """Words inside windows of eight words that occur twice or more in the text.

    Windows are 64-bit hashes of eight word hashes. Where all differ, and that is nearly everywhere,
    nothing is sorted. Otherwise sorting brings equal windows side by side; their start positions
    p1 < p2 < ... cover 8 words each, less what the next one covers as well.
    """
    none = F.array().cast("array<bigint>")
    words = F.transform(F.regexp_extract_all(_body(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    hashed = evaluated(df, __words=F.coalesce(on_demand(words), none))
    n = F.size("__words")
    grams = evaluated(
        hashed,
        __grams=F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))),
        ).otherwise(none),
    ).drop("__words")
    pairs = F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i")))
    some_repeat = F.size(F.array_distinct("__grams")) < F.size("__grams")
    ordered = evaluated(grams, __sorted=F.when(some_repeat, F.array_sort(pairs))).drop("__grams")

    def repeats(x: Column, k: Column) -> Column:
        before = F.get("__sorted", k - 1)["g"]
        after = F.get("__sorted", k + 1)["g"]
        return F.coalesce(before == x["g"], F.lit(False)) | F.coalesce(after == x["g"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter("__sorted", repeats), lambda x: x["i"]))
    first = F.struct(F.lit(-WINDOW).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts,
        first,
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return ordered.withColumn("n_repeat_words", on_demand(F.coalesce(covered, F.lit(0).cast("long")))).drop("__sorted")


def _without_features(df: DataFrame) -> DataFrame:
    return df.drop(*FEATURES)


def _seconds(rows: DataFrame) -> float:
    """Time to compute all columns of some rows; the shorter of two runs, as the first one compiles."""
    spent = []
    for _ in range(2):
        began = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - began)
    return min(spent)


def feature_costs(sample: DataFrame, text: str, features: Sequence[str]) -> dict[str, float]:
    """Seconds that each feature takes on a sample that was written. Runs jobs."""
    idle = _seconds(sample.select(F.char_length(_body(text)).alias("n")))
    return {f: max(_seconds(add_feature(sample, f, text).select(f)) - idle, LEAST_COST) for f in features}


def order_rules(docs: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per second, most first; both measured on a sample. Runs jobs.

    A feature that an earlier rule has computed costs nothing more, so rules are picked one by one.
    """
    n = docs.count()
    rows = docs.select(F.col(f"`{text}`").alias("__text"))
    sample = table(rows.sample(min(1.0, sample_rows / n), seed=7) if n > sample_rows else rows, "sample")
    features = [f for f in FEATURES if any(f in r.needs for r in rules)]
    costs, measured = feature_costs(sample, "__text", features), sample
    for name in features:
        measured = add_feature(measured, name, "__text")
    shares = measured.agg(*[F.avg(F.expr(r.fails).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    if shares is None or shares["r0"] is None:
        return list(rules)
    left, known, ordered = list(enumerate(rules)), set(), []
    while left:

        def gain(entry):
            i, rule = entry
            return shares[f"r{i}"] / (sum(costs[f] for f in rule.needs if f not in known) + LEAST_COST)

        best = max(left, key=gain)
        left.remove(best)
        known |= set(best[1].needs)
        ordered.append(best[1])
    return ordered


def cascade(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    measured: Sequence[str] = (),
    sample_of: DataFrame | None = None,
) -> DataFrame:
    """Add ``kept`` (boolean) and ``rejected_by`` (the first rule in running order that fails, or null).

    ``measured`` names features that ``docs`` already has as columns; rules are then ordered on ``sample_of``, the documents
    without them, so that no feature is computed for the sample's sake. Runs jobs on a sample.
    """
    columns = [c for c in docs.columns if c not in ("kept", "rejected_by")]
    named = {c: c if c in measured else f"c{i}" for i, c in enumerate(columns)}
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.lit(None).cast("string").alias("__by"))
    known = set(measured)
    for rule in order_rules(docs if sample_of is None else sample_of, text, rules, sample_rows):
        going_on = F.col("__by").isNull()
        for feature in rule.needs:
            if feature not in known:
                out = add_feature(out, feature, named[text], going_on)
                known.add(feature)
        fails = F.when(F.col("__was").isNull() & F.expr(rule.fails), F.lit(rule.name))
        out = evaluated(out.withColumnRenamed("__by", "__was"), __by=F.coalesce("__was", fails)).drop("__was")
    return out.select(
        *[F.col(n).alias(c) for c, n in named.items()], F.col("__by").isNull().alias("kept"), F.col("__by").alias("rejected_by")
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All features as columns, for reports."""
    out = _without_features(docs)
    for name in FEATURES:
        out = add_feature(out, name, text)
    return out
