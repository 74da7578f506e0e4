"""Quality rules: statistics of a text and a decision list learned from labelled statistics, all in Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidence.operators.scale import stored

# Fixed patterns of words and symbols.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Rules are fitted on at most about this many labelled rows, drawn by a hash of their ids.
TRAINING_ROWS = 20_000
#: Cut points a feature, taken from the quantiles of each class.
CUTS = 24

FEATURES = [
    "n_words", "mean_word", "symbol_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "upper_rate", "exclaim_rate",
    "digit_rate",
]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for a row, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def window(i: Column) -> Column:
        text = F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.struct(text.alias("g"), i.alias("i"))

    def covered(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, j: F.coalesce(x["g"] == F.get(ordered, j - 1)["g"], F.lit(False))
            | F.coalesce(x["g"] == F.get(ordered, j + 1)["g"], F.lit(False)),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda x: x["i"])), start,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")),
            lambda acc: acc["n"],
        )

    # texts without two equal hashes have no window twice; the others sort the windows themselves
    different = let(F.transform(starts, hashed), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(different, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(starts, window)), covered))


def text_statistics(text: Column) -> Column:
    """Struct of counts of a whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and others (long).

    A null text counts as an empty one: no words.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_exclaim"),
            F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counts)


def base_failed(s: Column) -> Column:
    """The rule that holds whatever was learned: under 50 words, or more than half of them repeated."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """Rates that do not depend on the length of the text; 0 where a text has no words."""

    def rate(n: str, d: str) -> Column:
        return F.coalesce(F.try_divide(s[n].cast("double"), s[d].cast("double")), F.lit(0.0))

    return {
        "n_words": s["n_words"].cast("double"), "mean_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"), "repeat_rate": rate("n_repeat_words", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "distinct_rate": rate("n_distinct", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "exclaim_rate": rate("n_exclaim", "n_words"),
        "digit_rate": rate("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    """feature >= cut or feature < cut."""

    feature: str
    at_least: bool
    cut: float

    def column(self, found: dict[str, Column]) -> Column:
        x = found[self.feature]
        return x >= self.cut if self.at_least else x < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, found: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.column(found) for c in rule], F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _cut_points(rows: DataFrame, names: list[str], cuts: int) -> dict[str, list[float]]:
    """Quantiles of every feature in both classes, in one pass."""
    points = [(i + 0.5) / cuts for i in range(cuts)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, points, 1000).alias(n) for n in names]).collect()
    return {n: sorted({x for r in found for x in r[n] or []}) for n in names}


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], p0: float, n0: float) -> tuple[Condition, float] | None:
    """The condition of highest information gain, from one histogram per feature over the rows."""

    def binned(name: str) -> Column:
        reached = F.filter(F.array(*map(F.lit, cuts[name])), lambda cut: cut <= F.col(name))
        return F.struct(F.lit(name).alias("f"), F.size(reached).alias("b"))

    bins = F.array(*[binned(n) for n in cuts if cuts[n]])
    counted = (
        rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    )
    best: tuple[Condition, float] | None = None
    for name in sorted(cuts):
        table = {r["b"]: (r["p"], r["n"]) for r in counted if r["f"] == name}
        below_p = below_n = 0
        for i, cut in enumerate(cuts[name]):
            p, n = table.get(i, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for at_least, (a, b) in ((True, (p0 - below_p, n0 - below_n)), (False, (below_p, below_n))):
                gain = _gain(a, b, p0, n0)
                if gain > 1e-9 and (best is None or gain > best[1] + 1e-9):
                    best = (Condition(name, at_least, cut), gain)
    return best


def learn_rules(
    labelled: DataFrame, names: list[str] = FEATURES, most_rules: int = 12, most_conditions: int = 4,
    least_precision: float = 0.9, least_found: int = 5, cuts: int = CUTS,
) -> list[Rule]:
    """Ordered rules for bad rows by sequential covering over (key, bad 0/1, features…).

    Two thirds of the rows grow a rule one condition after another, by information gain over histograms of the
    features; the other third picks the prefix of best (p - n) / (p + n). A rule stays
    if it finds ``least_found`` bad rows with ``least_precision`` there; rows that it covers are taken
    out, and the next is grown from the rest. The driver sees counts only, at most features x cut points a step. No
    rows, or rows of one class: no rules.
    """
    part = F.pmod(F.xxhash64("key", F.lit("prune")), F.lit(3))
    grow, prune = labelled.where(part != 0), labelled.where(part == 0)
    columns = {n: F.col(n) for n in names}
    points = _cut_points(grow, names, cuts)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        open_rows = ~reduce(lambda a, b: a | b, [holds(r, columns) for r in rules], F.lit(False))
        rest, check = grow.where(open_rows), prune.where(open_rows)
        conditions: list[Condition] = []
        here = rest.agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        p, n = here["p"] or 0, here["n"] or 0
        while p and n and len(conditions) < most_conditions:
            found = _best_condition(rest.where(holds(tuple(conditions), columns)), points, p, n)
            if found is None:
                break
            conditions.append(found[0])
            here = rest.where(holds(tuple(conditions), columns)).agg(
                F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
            ).first()
            p, n = here["p"] or 0, here["n"] or 0
        if not conditions:
            break
        prefixes = [tuple(conditions[: i + 1]) for i in range(len(conditions))]
        tried = check.agg(*[
            F.coalesce(F.sum(F.when(holds(r, columns) & (F.col("bad") == b), 1)), F.lit(0)).alias(f"{'np'[b]}{i}")
            for i, r in enumerate(prefixes) for b in (0, 1)
        ]).first()
        scored = [(tried[f"p{i}"], tried[f"n{i}"]) for i in range(len(prefixes))]
        worth = [(a - b) / (a + b) if a + b else -1.0 for a, b in scored]
        pick = max(range(len(prefixes)), key=lambda i: (worth[i], scored[i][0], -i))
        found_bad, found_good = scored[pick]
        if found_bad < least_found or found_bad < least_precision * (found_bad + found_good):
            break
        rules.append(prefixes[pick])
    return rules


def first_rule(rules: list[Rule], found: dict[str, Column]) -> Column:
    """Number of the first rule that holds (from 1), null if none: one ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    start = F.when(holds(rules[0], found), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        start = start.when(holds(rule, found), F.lit(i))
    return start


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs as one struct ``_row`` beside ``_s``, so that names never clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_statistics(F.col(text)).alias("_s"))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    training_rows: int = TRAINING_ROWS, **options,
) -> list[Rule]:
    """Rules for documents whose label is 0, among those that the base rule keeps.

    The labelled rows are drawn by a hash of their ids so that about ``training_rows`` are left; only those
    are broadcast to find their texts. Null labels and ids are left out; of several labels of an id the
    lowest counts; documents that repeat an id all count.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    share = min(1.0, training_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.groupBy(F.col(key).alias("_key")).agg(F.when(F.min(label) == 0, 1).otherwise(0).alias("bad"))
    s = F.col("_s")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("key") == F.col("_key"))
    rows = joined.select("key", "bad", text_statistics(F.col("text")).alias("_s"))
    # filtered after it is stored: a filter on statistics would move below the join and read every text
    table = stored(rows.select("key", "bad", base_failed(s).alias("failed"), *[c.alias(n) for n, c in features(s).items()]))
    return learn_rules(table.where(~F.col("failed")), **options)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(_row, _s, base_failed, rule, kept) for every document."""
    s = F.col("_s")
    judged = with_statistics(docs, text).withColumns({"base_failed": base_failed(s), "rule": first_rule(rules, features(s))})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
