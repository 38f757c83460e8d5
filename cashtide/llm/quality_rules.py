"""Quality rules: a learned decision list over statistics of a text.

Everything runs as DataFrame functions.  Statistics come from one pass over the whole
texts.  Labelled rows then grow an ordered list of rules that reject: each rule is a
conjunction of thresholds, grown condition by condition on two thirds of the labelled rows
by information gain, pruned on the other third, and followed by the next one on the rows
that no rule covers yet.  A step is one count per statistic and threshold, over all
labelled rows; only those counts, as many as there are thresholds, come to the driver.  The
result is a list of conditions, printed as it is and applied as one Spark expression.

Words are runs without white space (space, \\t, \\n, \\v, \\f, \\r).  A null or empty text has no
words and fails the base rules.  Rows of ``labels`` without a label are ignored; of several
for a document the lower one counts.  Repeated rows are judged each, a null id can't be
labelled; without labels of both kinds no rule is learned; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import Scratch

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Statistics that rules may use, as SQL over those of ``text_statistics``.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
}
BINS = 24  # thresholds per statistic
MAX_RULES, MAX_CONDITIONS = 12, 4
MIN_PRECISION = 0.9  # of a rule on the rows kept for pruning
MIN_COVER = 0.01  # of the rows to reject, for a rule to be worth having


def text_statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Counts of every whole text; arrays stay within their row.  ``carry`` names more columns
    to keep."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in carry],
    )
    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        *carry,
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
    )
    rows = rows.select(
        "doc_id",
        *carry,
        "n_symbols",
        "n_capitals",
        "n_digits",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("digests"),
    )
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("digests")).cast("bigint"))
    rows = rows.withColumn(
        "windows",
        F.expr(
            "if(size(digests) < 5, cast(array() as array<bigint>), transform(sequence(0, size(digests) - 5), "
            "i -> xxhash64(digests[i], digests[i + 1], digests[i + 2], digests[i + 3], digests[i + 4])))"
        ),
    ).drop("digests")
    # Only texts in which a window repeats are sorted: neighbours show the repeated ones, and
    # each of those covers five words or as many as there are to the next one's start.
    rows = rows.withColumn(
        "ordered",
        F.expr(
            "if(size(array_distinct(windows)) = size(windows), "
            "cast(array() as array<struct<h:bigint,i:int>>), "
            "sort_array(transform(windows, (h, i) -> struct(h, i))))"
        ),
    ).drop("windows")
    rows = rows.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(ordered, (x, k) -> "
            "coalesce(get(ordered, k - 1).h = x.h, false) or coalesce(get(ordered, k + 1).h = x.h, false)), x -> x.i))"
        ),
    ).drop("ordered")
    repeated = F.expr(
        "aggregate(transform(places, (p, k) -> least(5, coalesce(get(places, k + 1), p + 5) - p)), 0L, (a, x) -> a + x)"
    )
    rows = rows.withColumn("n_repeat_words", repeated).drop("places")
    # One row out of one: the generator keeps a filter on the counts above their computation,
    # where the planner would otherwise repeat it, arrays and all, once per use of a count.
    counts = [c for c in rows.columns if c != "doc_id" and c not in carry]
    packed = rows.select("doc_id", *carry, F.explode(F.array(F.struct(*counts))).alias("_counts"))
    return packed.select("doc_id", *carry, "_counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return "(" + " and ".join(c.sql() for c in self.conditions) + ")"

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in their order; a text that none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def covering(self) -> Column:
        """The number of the first rule that covers a row, from 1; null if none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        return F.expr("case " + " ".join(f"when {r.sql()} then {i}" for i, r in enumerate(self.rules, 1)) + " end")

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "keep"])


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the rows to reject by narrowing a rule from (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _counts(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.sum("bad").alias("p"), F.count("*").alias("n")).first()
    return int(r.p or 0), int(r.n) - int(r.p or 0)


def learn_rules(labelled: DataFrame, scratch: Scratch) -> DecisionList:
    """Sequential covering over statistics with ``bad`` (1 to reject, 0 to keep)."""
    learned = DecisionList()
    names = list(FEATURES)
    numbers = [F.expr(FEATURES[f]).alias(f"f_{f}") for f in names]
    rows = scratch.store(
        labelled.select(*labelled.columns, *numbers, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"))
    )
    shares = [i / (BINS + 1) for i in range(1, BINS + 1)]
    asked = [F.percentile_approx(f"f_{f}", shares, 10_000).alias(f) for f in names]
    # Thresholds from the rows to reject and from those to keep, so that rare kinds show.
    cuts = {f: set() for f in names}
    for r in rows.filter("bad is not null").groupBy("bad").agg(*asked).collect():
        for f in names:
            cuts[f] |= set(r[f] or [])
    cuts = {f: sorted(c) for f, c in cuts.items()}
    bins = F.array(*[_bin(f, cuts[f]) for f in names])
    rows = scratch.store(rows.withColumn("bins", bins))
    total_bad, _ = _counts(rows)
    open_rows = rows
    while len(learned.rules) < MAX_RULES:
        grow = open_rows.filter("not held")
        p0, n0 = _counts(grow)
        if p0 == 0 or n0 == 0:
            break
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS and n0:
            best = _best_condition(grow, names, cuts, p0, n0)
            if best is None:
                break
            condition, p0, n0 = best
            rule.append(condition)
            grow = grow.filter(condition.sql())
        if not rule:
            break
        pruned = _pruned(open_rows.filter("held"), rule)
        if pruned is None:
            break
        covered, _ = _counts(open_rows.filter(pruned.sql()))
        if covered < max(2, MIN_COVER * total_bad):
            break
        learned.rules.append(pruned)
        open_rows = open_rows.filter(f"not {pruned.sql()}")
    return learned


def _bin(feature: str, cuts: Sequence[float]) -> Column:
    """How many thresholds lie below the value."""
    if not cuts:
        return F.lit(0)
    value = F.col(f"f_{feature}")
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda t: t < value))


def _best_condition(rows: DataFrame, names, cuts, p0: int, n0: int) -> tuple[Condition, int, int] | None:
    counted = rows.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
        F.sum("bad").alias("p"), F.count("*").alias("n")
    )
    per_bin: dict[tuple[int, int], tuple[int, int]] = {(r.f, r.bin): (int(r.p), int(r.n - r.p)) for r in counted.collect()}
    best, best_gain = None, 1e-9
    for f, name in enumerate(names):
        p = n = 0
        for b, cut in enumerate(cuts[name]):
            more = per_bin.get((f, b), (0, 0))
            p, n = p + more[0], n + more[1]
            for above, (a, z) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = _gain(a, z, p0, n0)
                if z < n0 and gain > best_gain:
                    best, best_gain = (Condition(name, above, float(cut)), a, z), gain
    if best is None:
        return None
    # The threshold goes midway between the values on either side of it.
    condition, p, n = best
    value = F.col(f"f_{condition.feature}")
    gap = rows.agg(
        F.max(F.when(value <= condition.threshold, value)).alias("below"),
        F.min(F.when(value > condition.threshold, value)).alias("above"),
    ).first()
    middle = (gap.below + gap.above) / 2
    return Condition(condition.feature, condition.above, middle if middle < gap.above else gap.below), p, n


def _pruned(held: DataFrame, rule: list[Condition]) -> Rule | None:
    """The leading conditions that do best on rows the rule was not grown on."""
    fits = [Rule(tuple(rule[:k])).sql() for k in range(1, len(rule) + 1)]
    found = held.agg(
        *[F.sum(F.when(F.expr(s), F.col("bad")).otherwise(0)).alias(f"p{k}") for k, s in enumerate(fits, 1)],
        *[F.sum(F.when(F.expr(s), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}") for k, s in enumerate(fits, 1)],
    ).first()
    best = None
    for k in range(1, len(rule) + 1):
        p, n = int(found[f"p{k}"] or 0), int(found[f"n{k}"] or 0)
        worth = (p - n) / (p + n) if p + n else -1.0
        if p + n and p / (p + n) >= MIN_PRECISION and (best is None or worth > best[0]):
            best = (worth, k)
    return None if best is None else Rule(tuple(rule[: best[1]]))


def fit_rules(
    statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> DecisionList:
    """The decision list of all labelled rows that the base rules don't already reject.

    ``statistics`` are those of ``text_statistics``, best stored: they are small, and the
    labels meet them without the texts.  ``label_col`` is 1 for texts to keep and 0 for
    those to reject.
    """
    scratch = Scratch(statistics.sparkSession, "quality")
    known = scratch.store(
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
        .filter("_id is not null and _label is not null")
        .groupBy("_id")
        .agg((1 - F.min("_label")).cast("bigint").alias("bad"))
    )
    labelled = statistics.filter(~base_failed()).join(known, F.col("doc_id") == F.col("_id")).drop("_id")
    return learn_rules(scratch.store(labelled), scratch)


def judge_quality(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """``statistics`` with ``base_failed``, ``rule`` (the one that rejects, from 1) and ``kept``."""
    judged = statistics.withColumn("base_failed", base_failed()).withColumn("rule", rules.covering())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdicts of every text; each is read once."""
    stats = Scratch(docs.sparkSession, "quality").store(text_statistics(docs))
    return judge_quality(stats, fit_rules(stats, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
