"""One spelling of the expressions that Spark SQL and the checking engine write differently.

Plans are SQL text over a dialect. Spark runs them through Catalyst; the same plan in the checking
dialect is its oracle. Numbers that matter are spelled as doubles by n().
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def table(self, name: str) -> str:
        return self.prefix + name

    def text(self, x: str) -> str:
        return "r'" + x + "'"

    def n(self, x: float) -> str:
        return f"{x!r}D" if "e" not in repr(float(x)) else f"CAST({x!r} AS DOUBLE)"

    def dbl(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} DIV {b})"

    def found(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(p)}, {group})"

    def first(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(p)}, {group})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.text(p)}, '{r}')"

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.text(p)})"

    def keep(self, a: str, cond: str) -> str:
        """Elements v, at places i from 1, that hold."""
        return f"filter({a}, (v, i0) -> {cond.replace('@i', '(i0 + 1)')})"

    def each(self, a: str, e: str) -> str:
        return f"transform({a}, v -> {e})"

    def fold(self, a: str, e: str) -> str:
        """Sum over the elements v of e, a double."""
        return f"aggregate(transform({a}, v -> CAST({e} AS DOUBLE)), 0D, (s, t) -> s + t)"

    def at(self, a: str, x: str) -> str:
        return f"array_position({a}, {x})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def uniq(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"

    def common(self, a: str, b: str) -> str:
        return f"CAST(size(array_intersect({a}, {b})) AS BIGINT)"

    def either(self, a: str, b: str) -> str:
        return f"CAST(size(array_union({a}, {b})) AS BIGINT)"

    def cat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def cut(self, a: str, n: int | str) -> str:
        return f"slice({a}, 1, {n})"

    def joined(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def explode(self, cols: str, a: str, source: str) -> str:
        """Rows of cols, x and its place pos from 0."""
        return f"SELECT {cols}, posexplode({a}) AS (pos, x) FROM {source}"

    def listed(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def lines(self, x: str, order: str) -> str:
        return f"listagg({x}, '\\n') WITHIN GROUP (ORDER BY {order})"

    def cut_at(self, x: str, sep: str) -> str:
        """Parts between single characters sep."""
        return f"split({x}, '[{sep}]', -1)"

    def cut_lines(self, x: str) -> str:
        return f"split({x}, '\\n', -1)"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def after_last(self, x: str, mark: str) -> str:
        return f"substring_index({x}, '{mark}', -1)"

    def any(self, a: str, cond: str) -> str:
        return f"exists({a}, v -> {cond})"

    def inside(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def gathered(self, x: str) -> str:
        return f"collect_list({x})"

    def collected(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def hex_int(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def day(self, days: str) -> str:
        return f"date_format(date_add(DATE'2023-01-01', CAST({days} AS INT)), 'yyyyMMddHHmm')"

    def head(self, x: str, n: int) -> str:
        return f"substring({x}, 1, {n})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def half_even(self, x: str) -> str:
        return f"bround({x})"

    def line(self) -> str:
        return "'\\n'"

    def spread(self, n: str) -> str:
        return f"sequence(0, {n} - 1)"


class Duck(Spark):
    name = "duckdb"

    def text(self, x: str) -> str:
        return "'" + x + "'"

    def n(self, x: float) -> str:
        return f"{x!r}::DOUBLE"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.text(p)}, '{r}', 'g')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.text(p)})"

    def keep(self, a: str, cond: str) -> str:
        return f"list_filter({a}, lambda v, i: {cond.replace('@i', 'i')})"

    def each(self, a: str, e: str) -> str:
        return f"list_transform({a}, lambda v: {e})"

    def fold(self, a: str, e: str) -> str:
        return f"coalesce(list_sum(list_transform({a}, lambda v: CAST({e} AS DOUBLE))), 0::DOUBLE)"

    def at(self, a: str, x: str) -> str:
        return f"list_position({a}, {x})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def uniq(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def common(self, a: str, b: str) -> str:
        return f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"

    def either(self, a: str, b: str) -> str:
        return f"CAST(len(list_distinct(list_concat({a}, {b}))) AS BIGINT)"

    def cat(self, *a: str) -> str:
        return "(" + " || ".join(a) + ")"

    def cut(self, a: str, n: int | str) -> str:
        return f"list_slice({a}, 1, {n})"

    def joined(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def explode(self, cols: str, a: str, source: str) -> str:
        return f"SELECT {cols}, unnest({a}) AS x, generate_subscripts({a}, 1) - 1 AS pos FROM {source}"

    def listed(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def lines(self, x: str, order: str) -> str:
        return f"string_agg({x}, chr(10) ORDER BY {order})"

    def cut_at(self, x: str, sep: str) -> str:
        return f"string_split({x}, '{sep}')"

    def cut_lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def after_last(self, x: str, mark: str) -> str:
        return f"list_extract(string_split({x}, '{mark}'), -1)"

    def any(self, a: str, cond: str) -> str:
        return f"len(list_filter({a}, lambda v: {cond})) > 0"

    def inside(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def gathered(self, x: str) -> str:
        return f"list({x})"

    def collected(self, x: str) -> str:
        return f"list_sort(list(DISTINCT {x}))"

    def hex_int(self, x: str) -> str:
        return f"CAST('0x' || {x} AS BIGINT)"

    def day(self, days: str) -> str:
        return f"strftime(DATE '2023-01-01' + CAST({days} AS INTEGER), '%Y%m%d%H%M')"

    def head(self, x: str, n: int) -> str:
        return f"substr({x}, 1, {n})"

    def json(self, x: str, key: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.{key}') END"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def line(self) -> str:
        return "chr(10)"

    def spread(self, n: str) -> str:
        return f"range(0, {n})"


class Text(str):
    """A query's text that remembers its steps."""

    steps: dict[str, str]
    final: str


def with_steps(steps: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + f"\n{final}" if steps else final


def plan(*steps: tuple[str, str], final: str) -> Text:
    """A WITH query of named steps; later definitions of a name are dropped."""
    seen: dict[str, str] = {}
    for name, sql in steps:
        seen.setdefault(name, sql)
    out = Text(with_steps(seen, final))
    out.steps, out.final = seen, final
    return out
