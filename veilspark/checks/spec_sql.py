"""Declared tables as SQL: the columns of a spec, stated a second time from their plain rules."""

from __future__ import annotations

from ..functions.draws import cumulative
from ..sources.generate import Spec
from .registry import index_sql, q6, quoted, u_sql


def double(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def literal(x) -> str:
    return quoted(x) if isinstance(x, str) else str(x)


def real_sql(u: str, lo, hi, digits: int) -> str:
    return f"round({double(lo)} + {u} * {double(hi - lo)}, {digits})"


def integer_sql(u: str, lo: int, hi: int) -> str:
    return f"least(floor({lo} + {u} * {hi - lo})::BIGINT, {hi - 1})"


def column_sql(spec: Spec, table: str, column: str, rows: str, row: str = "id") -> str:
    """Value of a declared column in row number ``row``; ``rows`` is a template with one place for a
    declared row count, which gives the number of rows that the table really has."""
    s = spec[table].columns[column]

    def u(*extra):
        return u_sql(quoted(table), quoted(column), f"({row})", *[quoted(str(e)) for e in extra])

    if s.parent:
        parent, target = s.parent
        drawn = f"({index_sql(u(), rows.format(spec[parent].rows))} + 1)"
        return column_sql(spec, parent, target, rows, drawn)
    if s.price_of:
        units, parent, price = s.price_of
        link = next(c for c, p in spec[table].columns.items() if p.parent and p.parent[0] == parent)
        key = column_sql(spec, table, link, rows, row)
        return f"round({column_sql(spec, table, units, rows, row)} * {column_sql(spec, parent, price, rows, key)}, 2)"
    kind, *rest = s.rule
    match kind:
        case "key":
            return f"({quoted(rest[0])} || ({row}))" if rest[0] else f"({row})"
        case "label":
            prefix, width = rest
            return f"""printf({quoted(prefix + (f"%0{width}d" if width else "%d"))}, {row})"""
        case "listed":
            return f"[{', '.join(map(literal, rest[0]))}][({row} - 1) % {len(rest[0])} + 1]"
        case "constant":
            return literal(rest[0])
        case "choice":
            return f"[{', '.join(map(literal, rest[0]))}][{index_sql(u(), str(len(rest[0])))} + 1]"
        case "weighted":
            values, weights = rest
            steps = [f"WHEN {u()} < {double(c)} THEN {literal(v)}" for v, c in zip(values, cumulative(weights)[:-1])]
            return f"(CASE {' '.join(steps)} ELSE {literal(values[-1])} END)"
        case "integer":
            return integer_sql(u(), *rest)
        case "real":
            return real_sql(u(), *rest)
        case "millions":
            return f"round({real_sql(u(), *rest, 6)} * 1000000.0::DOUBLE, 0)"
        case "phone":
            return f"concat_ws('-', {', '.join(integer_sql(u(g), lo, hi) for g, (lo, hi) in enumerate(rest[0]))})"
    raise ValueError(f"no SQL for rule {kind!r}")


REALS = ("real", "millions")


def spec_sql(spec: Spec, factor: str) -> str:
    """All tables of a spec with row counts multiplied by the scalar SQL ``factor``: one row per row,
    its table's name first, columns of other tables null."""
    rows = f"ceil({{}} * {factor})::BIGINT"
    parts = []
    for name, t in spec.items():
        columns = []
        for c, s in t.columns.items():
            value = column_sql(spec, name, c, rows)
            if s.price_of or (s.rule and s.rule[0] in REALS):
                value = q6(value)
            elif s.rule and s.rule[0] in ("choice", "weighted") and isinstance(s.rule[1][0], int):
                value = f"({value})::BIGINT"
            columns.append(f'{value} AS "{c}"')
        slots = f"(SELECT unnest(range(1, {rows.format(t.rows)} + 1)) AS id)"
        parts.append(f"SELECT '{name}' AS table_name, {', '.join(columns)} FROM {slots}")
    return " UNION ALL BY NAME ".join(parts)
