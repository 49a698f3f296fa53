"""Key cleaning rules: a rule is a function from Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakedupes.fixed import SPACE

Rule = Callable[[Column], Column]
T = TypeVar("T")


def strip_spaces(key: Column) -> Column:
    """Trim every path segment and drop the segments that become empty."""
    ends = F.regexp_replace(key, rf"(?U)^[{SPACE}/]+|[{SPACE}/]+\z", "")
    return F.regexp_replace(ends, rf"(?U)[{SPACE}]*/[{SPACE}/]*", "/")


def strip_backslashes(key: Column) -> Column:
    """Remove backslashes; in keys that had any, runs of spaces become one."""
    bare = F.replace(key, F.lit("\\"), F.lit(""))
    return F.when(key.contains("\\"), F.regexp_replace(bare, " {2,}", " ")).otherwise(key)


_RULES: dict[str, Rule] = {
    "strip-spaces": strip_spaces,
    "strip-backslashes": strip_backslashes,
}


def register_rule(name: str, rule: Rule) -> None:
    """Make a rule available by name."""
    _RULES[name] = rule


def chosen(registry: Mapping[str, T], names: Iterable[str], kind: str) -> list[tuple[str, T]]:
    """The named entries of a registry, in order; the first name that it lacks is an error."""
    out = []
    for name in names:
        if name not in registry:
            raise ValueError(f"no {kind} {name!r}; there are {', '.join(registry)}")
        out.append((name, registry[name]))
    return out


def rules_named(names: Sequence[str]) -> list[tuple[str, Rule]]:
    """Rules by name, looked up before any plan is built."""
    return chosen(_RULES, names, "rule")
