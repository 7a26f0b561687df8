"""One way to write an expression for Spark SQL and for the SQL it is held against.

The two engines differ in the names of array and regular-expression functions;
everything else in this package is plain SQL text.  ``SPARK`` is what runs.
"""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Spark:
    name = "spark"

    def __init__(self, folder: str = "", relation: str = "", spread: int = 0, scored: str = "") -> None:
        """``relation``: a view of papers to use in place of the one derived from documents; ``spread``: partitions that few large pieces of documents are dealt into, 0 for none; ``scored``: a view of papers that the rules have been applied to."""
        self.folder, self.relation, self.spread, self.scored = folder, relation, spread, scored

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`"

    def text(self, value: str) -> str:
        # Raw literals keep backslashes; a quote can't stand in one.
        return f"r'{value}'" if "'" not in value else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text('(?i)' + pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.text('(?i)' + pattern)})"

    def first(self, x: str, pattern: str) -> str:
        """First match, or the empty string."""
        return f"regexp_extract({x}, {self.text('(?i)' + pattern)}, 0)"

    def all(self, x: str, pattern: str, exact: bool = False) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern if exact else '(?i)' + pattern)}, 0)"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def split(self, x: str, pattern: str, most: int = -1) -> str:
        """Parts between matches; beyond ``most`` parts, where it is given, the text may stay whole."""
        return f"split({x}, {self.text(pattern)}, {most})"

    def tokens(self, x: str) -> str:
        """Words of the recommender where the dialect has a function for them; empty where it has none."""
        return ""

    def sentences(self, x: str) -> str:
        return f"split(trim({x}), {self.text(r'(?<=[.!?])\s+')})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def texts(self, items: list[str]) -> str:
        return f"array({', '.join(map(self.text, items))})" if items else "cast(array() as array<string>)"

    def filter(self, arr: str, cond: str) -> str:
        return f"filter({arr}, x -> {cond})"

    def map(self, arr: str, expr: str) -> str:
        return f"transform({arr}, x -> {expr})"

    def join(self, arr: str, by: str) -> str:
        return f"array_join({arr}, {self.text(by)})"

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def has(self, arr: str, item: str) -> str:
        return f"array_contains({arr}, {item})"

    def slice(self, arr: str, n: int) -> str:
        return f"slice({arr}, 1, {n})"

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def at(self, arr: str, i: int) -> str:
        return f"get({arr}, {i - 1})"

    def sort(self, arr: str) -> str:
        return f"array_sort({arr})"

    def distinct(self, arr: str) -> str:
        """Keeps the first of equal items, in order."""
        return f"array_distinct({arr})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def explode(self, arr: str) -> str:
        return f"explode({arr})"

    def pick(self, arr: str, i: str) -> str:
        return f"element_at({arr}, cast({i} as int))"

    def gather(self, item: str, *order: str, where: str = "true") -> str:
        """Items of a group in order; ``where`` bounds how many."""
        keys = ", ".join(f"{o} as o{i}" for i, o in enumerate(order))
        return f"transform(array_sort(collect_list(struct({keys}, {item} as v)) FILTER (WHERE {where})), x -> x.v)"

    def least_by(self, item: str, order: str) -> str:
        return f"min_by({item}, {order})"

    def md5(self, x: str) -> str:
        return f"md5({x})"

    def date(self, x: str) -> str:
        return f"try_to_date({x}, 'yyyy-MM-dd')"

    def days(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    def plus(self, date: str, days: str) -> str:
        return f"date_add({date}, CAST({days} AS int))"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def count_if(self, cond: str) -> str:
        return f"count_if({cond})"

    def chars(self, x: str) -> str:
        return f"char_length({x})"


class Duck(Spark):
    name = "duck"

    def table(self, name: str) -> str:
        return name

    def text(self, value: str) -> str:
        return quoted(value)

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {quoted(pattern)}, 'i')"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {quoted(pattern)}, 0, 'i'))"

    def first(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {quoted(pattern)}, 0, 'i')"

    def all(self, x: str, pattern: str, exact: bool = False) -> str:
        return f"regexp_extract_all({x}, {quoted(pattern)})" if exact else f"regexp_extract_all({x}, {quoted(pattern)}, 0, 'i')"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"

    def split(self, x: str, pattern: str, most: int = -1) -> str:
        return f"string_split_regex({x}, {quoted(pattern)})"

    def sentences(self, x: str) -> str:
        return rf"string_split(regexp_replace(trim({x}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def texts(self, items: list[str]) -> str:
        return f"[{', '.join(map(quoted, items))}]::VARCHAR[]"

    def filter(self, arr: str, cond: str) -> str:
        return f"list_filter({arr}, lambda x: {cond})"

    def map(self, arr: str, expr: str) -> str:
        return f"list_transform({arr}, lambda x: {expr})"

    def join(self, arr: str, by: str) -> str:
        return f"array_to_string({arr}, {quoted(by)})"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def has(self, arr: str, item: str) -> str:
        return f"list_contains({arr}, {item})"

    def slice(self, arr: str, n: int) -> str:
        return f"({arr})[1:{n}]"

    def concat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def at(self, arr: str, i: int) -> str:
        return f"({arr})[{i}]"

    def sort(self, arr: str) -> str:
        return f"list_sort({arr})"

    def distinct(self, arr: str) -> str:
        return f"list_filter({arr}, lambda x, i: list_position({arr}, x) = i)"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def explode(self, arr: str) -> str:
        return f"unnest({arr})"

    def pick(self, arr: str, i: str) -> str:
        return f"({arr})[{i}]"

    def gather(self, item: str, *order: str, where: str = "true") -> str:
        return f"list({item} ORDER BY {', '.join(order)}, {item}) FILTER (WHERE {where})"

    def least_by(self, item: str, order: str) -> str:
        return f"arg_min({item}, {order})"

    def date(self, x: str) -> str:
        return f"try_cast({x} AS DATE)"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {b}, {a})"

    def plus(self, date: str, days: str) -> str:
        return f"({date} + CAST({days} AS int))"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def chars(self, x: str) -> str:
        return f"length({x})"


SPARK, DUCK = Spark(), Duck()
