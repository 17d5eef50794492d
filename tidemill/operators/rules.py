"""Quality rules as data: a name, the columns it needs, a condition. Compiled to one CASE or one array expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Values = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """Fires where the condition holds; null counts as no. Idle where a needed column is absent."""

    name: str
    needs: tuple[str, ...]
    when: Callable[[Values], Column]

    def condition(self, values: Values) -> Column:
        return F.coalesce(self.when(values), F.lit(False))


def active(rules: Iterable[Rule], present: Iterable[str]) -> list[Rule]:
    have = set(present)
    return [r for r in rules if have.issuperset(r.needs)]


def first_match(rules: Iterable[Rule], values: Values, present: Iterable[str]) -> Column:
    """Name of the first rule that fires, else null."""
    case = None
    for rule in active(rules, present):
        case = (F if case is None else case).when(rule.condition(values), F.lit(rule.name))
    return F.lit(None).cast("string") if case is None else case


def all_matches(rules: Iterable[Rule], values: Values, present: Iterable[str]) -> Column:
    """Names of all rules that fire, in the order of the rules."""
    hits = [F.when(rule.condition(values), F.lit(rule.name)) for rule in active(rules, present)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
