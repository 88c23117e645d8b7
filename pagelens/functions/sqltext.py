"""Column rules are written as Spark SQL text.

A rule such as URL joining has hundreds of sub-expressions. As text it reaches the JVM in one call
and is parsed there; built node by node from Python it would take thousands of round trips.
"""

from __future__ import annotations


def q(text: str) -> str:
    """Quoted SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rlike(expr: str, pattern: str) -> str:
    return f"({expr} RLIKE {q(pattern)})"


def extract(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def extract_all(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group})"


def sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(replacement)})"


def in_list(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(q(v) for v in values)}))"


def lookup(table: dict[str, str], key: str) -> str:
    """Literal map lookup, NULL when the key is unknown."""
    return f"try_element_at(map({', '.join(f'{q(k)}, {q(v)}' for k, v in table.items())}), {key})"


def settled(df, keep: list[str], columns: dict[str, str]):
    """``keep`` plus computed columns that later filters cannot be rewritten into.

    Catalyst pushes a filter below projections by copying the expressions it mentions. For a staged
    computation that multiplies the work (and the planning time) with every stage. A one-element
    generator keeps the filter above and evaluates each column once.
    """
    fields = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return df.selectExpr(*keep, f"inline_outer(array(struct({fields})))")
