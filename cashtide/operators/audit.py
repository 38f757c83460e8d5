"""Checks that files cannot enforce: keys, references, values, dependencies.

Each operator returns the offending rows.  Counting per key combines map-side, so
a key that occurs millions of times is no hot spot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.operators.views import view_cost_isa_violations
from cashtide.schemas import TABLES, Table
from cashtide.session import materialise


#: Rows of the keys of a parent that are broadcast; beyond, child keys are grouped and joined.
MOST_BROADCAST = 2_000_000


def key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


#: Whole numbers of a key that travel as such; what else belongs to it travels as text.
KEY_NUMBERS = 2


def _placed(df: DataFrame, key: Sequence[str]) -> tuple[list[str], list[str]]:
    """The columns of a key that travel as numbers, and the others."""
    whole = [c for c in key if df.schema[c].dataType.typeName() in ("long", "integer", "short", "byte")][:KEY_NUMBERS]
    return whole, [c for c in key if c not in whole]


def key_groups(tables: Sequence[tuple[DataFrame, Sequence[tuple[Sequence[str], Sequence[str]]]]]) -> DataFrame:
    """How often the values of many keys occur, and whether what hangs on them differs.

    Each table comes with its rules, pairs of key and dependent columns.  Every row is
    expanded to one small row per rule, so each table is read once and all are grouped in one
    shuffle: ``rule`` (its place among all rules), ``key_value``, ``occurrences``, and
    ``differs``.  Keys are grouped by their values, whole numbers as numbers.  Counts and the
    least and greatest digest of the dependents combine map-side and are numbers too, so
    nothing is sorted.
    """
    slots = [f"_n{j}" for j in range(KEY_NUMBERS)]

    def row(df: DataFrame, i: int, key: Sequence[str], dependents: Sequence[str]) -> Column:
        whole, rest = _placed(df, key)
        numbers = [F.col(c).cast("bigint") for c in whole] + [F.lit(None).cast("bigint")] * (KEY_NUMBERS - len(whole))
        text = F.array(*[F.col(c).cast("string") for c in rest]) if rest else F.lit(None).cast("array<string>")
        parts = [x for c in dependents for x in (F.col(c), F.col(c).isNull())]
        digest = F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(i).alias("rule"), *[n.alias(s) for n, s in zip(numbers, slots)], text.alias("_text"), digest.alias("_digest")
        )

    expanded, shapes, i = [], {}, 0
    for df, rules in tables:
        for n, (key, _) in enumerate(rules):
            whole, rest = _placed(df, key)
            shape = tuple(f"_n{whole.index(c)}" if c in whole else f"_text[{rest.index(c)}]" for c in key)
            shapes.setdefault(shape, []).append(i + n)
        expanded.append(df.select(F.inline(F.array(*[row(df, i + n, *rule) for n, rule in enumerate(rules)]))))
        i += len(rules)
    value = F.lit(None).cast("string")
    for shape, which in shapes.items():
        text = F.concat_ws("|", *[F.expr(part).cast("string") for part in shape])
        value = F.when(F.col("rule").isin(which), text).otherwise(value)
    return (
        reduce(DataFrame.unionByName, expanded)
        .groupBy("rule", *slots, "_text")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min("_digest").alias("_a"), F.max("_digest").alias("_z"))
        .select("rule", value.alias("key_value"), "occurrences", (F.col("_a") != F.col("_z")).alias("differs"))
    )


def named_rules(groups: DataFrame, *labels: tuple[str, Sequence]) -> DataFrame:
    """``groups`` with what the rules are called instead of their places."""
    return groups.withColumns({name: F.get(F.array(*[F.lit(v) for v in values]), F.col("rule")) for name, values in labels}).drop("rule")


def audit_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def audit_foreign_keys(
    child: DataFrame, parent: DataFrame, columns: Sequence[str], parent_columns: Sequence[str] | None = None
) -> DataFrame:
    """Values without a parent row, with the number of rows that hold them.

    A reference with a null part passes, as in SQL.
    """
    parent_columns = list(parent_columns or columns)
    complete = child.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("orphan_rows"))
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
    return complete.join(known, list(columns), "left_anti")


@dataclass(frozen=True)
class KeyIndex:
    """The keys of a parent, stored: whole numbers as 64-bit sets, others one by one; without a
    ``frame`` if there are too many."""

    parent: DataFrame
    columns: tuple[str, ...]
    frame: DataFrame | None
    sets: bool
    small: bool


def key_index(parent: DataFrame, columns: Sequence[str], most: int | None = None) -> KeyIndex:
    """The exact set of the keys of a parent, with its measured size.

    Ids that lie close together take a bit each, so the index of a table of a hundred
    million ids is some million rows.  Their number is estimated first, in a pass that shuffles
    nothing: an index that would be too large to be broadcast is not built.
    """
    most = MOST_BROADCAST if most is None else most
    kinds = [parent.schema[c].dataType.typeName() for c in columns]
    sets = kinds in (["long"], ["integer"])
    keys = parent.select(*columns).dropna()
    word = F.expr(f"shiftright(cast({columns[0]} as bigint), 6)")
    about = F.approx_count_distinct(word if sets else F.struct(*columns))
    if keys.select(about).first()[0] > most:
        return KeyIndex(parent, tuple(columns), None, sets, False)
    if sets:
        member = F.expr(f"shiftleft(1L, cast({columns[0]} & 63 as int))")
        frame = keys.groupBy(word.alias("_word")).agg(F.bit_or(member).alias("_set"))
    else:
        frame = keys.distinct()
    frame = materialise(frame)
    return KeyIndex(parent, tuple(columns), frame, sets, frame.count() <= most)


def audit_references(child: DataFrame, references: Sequence[tuple[str, Sequence[str], KeyIndex]]) -> DataFrame:
    """``reference`` (its name), ``key_value`` and ``orphan_rows`` of values without a parent.

    All references whose parent has an index small enough to be broadcast are looked up in one
    pass over the child, which is not shuffled; only orphans are grouped.
    """
    wanted = dict.fromkeys(c for _, columns, _ in references for c in columns)
    rows, found, large = child.select(*wanted), [], []
    for i, (name, columns, index) in enumerate(references):
        if not index.small:
            large.append(
                audit_foreign_keys(child, index.parent, columns, index.columns).select(
                    F.lit(name).alias("reference"), key_text(columns).alias("key_value"), "orphan_rows"
                )
            )
            continue
        if index.sets:
            (c,) = columns
            known = index.frame.select(F.col("_word").alias(f"_word{i}"), F.col("_set").alias(f"_set{i}"))
            rows = rows.join(F.broadcast(known), F.expr(f"shiftright(cast({c} as bigint), 6)") == F.col(f"_word{i}"), "left")
            there = F.expr(f"shiftright(_set{i}, cast({c} & 63 as int)) & 1") == 1
        else:
            known = index.frame.select(*[F.col(p).alias(f"_{i}{p}") for p in index.columns], F.lit(True).alias(f"_hit{i}"))
            rows = rows.join(F.broadcast(known), [F.col(c) == F.col(f"_{i}{p}") for c, p in zip(columns, index.columns)], "left")
            there = F.col(f"_hit{i}")
        given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        entry = F.struct(F.lit(name).alias("reference"), key_text(columns).alias("key_value"))
        found.append(F.when(given & ~F.coalesce(there, F.lit(False)), entry))
    if found:
        orphans = rows.select(F.inline(F.array_compact(F.array(*found))))
        large.append(orphans.groupBy("reference", "key_value").agg(F.count(F.lit(1)).alias("orphan_rows")))
    return reduce(DataFrame.unionByName, large)


def table_predicates(table: Table, columns: Sequence[str]) -> dict[str, str]:
    """Value checks, required columns and text lengths of a declared table, as far
    as the given columns allow."""
    predicates = {
        name: predicate
        for name, predicate in table.checks.items()
        if all(c not in predicate.split() or c in columns for c in table.column_names)
    }
    for c in table.columns:
        if c.name not in columns:
            continue
        if not c.nullable:
            predicates[f"{c.name}_required"] = f"{c.name} IS NOT NULL"
        if c.length is not None:
            predicates[f"{c.name}_length"] = f"length({c.name}) <= {c.length}"
    return predicates


def audit_checks(df: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """Rows that break a predicate, with the names of those they break.

    One pass evaluates all predicates; an unknown result passes.
    """
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(True)), F.lit(n)) for n, p in predicates.items()])
    )
    return df.withColumn("broken_checks", broken).filter(F.size("broken_checks") > 0)


def audit_functional_dependency(df: DataFrame, determinant: Sequence[str], dependents: Sequence[str]) -> DataFrame:
    """Determinant values that come with more than one combination of dependents.

    Combinations become unique map-side and are then counted per value, map-side as well.
    """
    return (
        df.select(*determinant, *dependents)
        .distinct()
        .groupBy(*determinant)
        .agg(F.count(F.lit(1)).alias("combinations"))
        .filter("combinations > 1")
    )


def audit_specialisation(cost: DataFrame, project_cost: DataFrame, operational_cost: DataFrame) -> DataFrame:
    """Costs in neither or both subtypes."""
    return view_cost_isa_violations(
        {"cost": cost, "project_cost": project_cost, "operational_cost": operational_cost}
    )


def declared_rules(name: str, columns: Sequence[str]) -> list[tuple[tuple[str, ...], list[str], bool]]:
    """Keys and determinants of a declared table with what they determine, as far as the columns
    are there, and whether the key has to be unique."""
    table, rules = TABLES[name], {}
    for determinant, dependents in table.functional_dependencies:
        if set(determinant) <= set(columns):
            rules[tuple(determinant)] = [c for c in dependents if c in columns and c not in determinant]
    unique = {tuple(k) for k in table.keys if set(k) <= set(columns)}
    return [(k, rules.get(k, []), k in unique) for k in dict.fromkeys([*unique, *rules])]


def audit_tables(T: Mapping[str, DataFrame]) -> DataFrame:
    """Every declared rule over every given table: one row per rule that is broken,
    with the number of offending rows or key values."""
    findings, indexes, rules = [], {}, []
    named = {name: T[name] for name in TABLES if name in T}
    for name, df in named.items():
        columns = df.columns
        rules += [(name, *rule) for rule in declared_rules(name, columns)]
        references = []
        for r in TABLES[name].references:
            if r.parent in T and set(r.columns) <= set(columns):
                place = (r.parent, tuple(r.parent_columns))
                if place not in indexes:
                    indexes[place] = key_index(T[r.parent], r.parent_columns)
                references.append((f"{', '.join(r.columns)} -> {r.parent}", r.columns, indexes[place]))
        if references:
            orphans = audit_references(df, references).groupBy(F.col("reference").alias("rule")).agg(F.count(F.lit(1)).alias("offenders"))
            findings.append(orphans.withColumns({"table_name": F.lit(name), "kind": F.lit("reference")}))
        broken = audit_checks(df, table_predicates(TABLES[name], columns)).select(F.explode("broken_checks").alias("rule"))
        broken = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("offenders"))
        findings.append(broken.withColumns({"table_name": F.lit(name), "kind": F.lit("check")}))
    groups = key_groups([(df, [(key, rest) for n, key, rest, _ in rules if n == name]) for name, df in named.items()])
    labels = [("table_name", [r[0] for r in rules]), ("columns", [", ".join(r[1]) for r in rules]), ("unique", [r[3] for r in rules])]
    kinds = F.array(
        F.when(F.col("unique") & (F.col("occurrences") > 1), F.struct(F.lit("key").alias("kind"), F.col("columns").alias("rule"))),
        F.when(F.col("differs"), F.struct(F.lit("dependency").alias("kind"), F.concat("columns", F.lit(" -> rest")).alias("rule"))),
    )
    broken = named_rules(groups, *labels).select("table_name", F.inline(F.array_compact(kinds)))
    findings.append(broken.groupBy("table_name", "kind", "rule").agg(F.count(F.lit(1)).alias("offenders")))
    return reduce(DataFrame.unionByName, findings).select("table_name", "kind", "rule", "offenders")
