"""Tables that pages carry in their scripts: ``const NAME = [{key: 'value', ...}, ...]``.

One row for each object and key.  Quotes may hold brackets, commas and other quotes; a
backslash keeps the next character; comments between values are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a script that matter: quoted text, comments, brackets.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|[\[\]{}]', re.S)
_PAIR = re.compile(r'(\w+)\s*:\s*("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|true\b|false\b|-?\d+(?:\.\d+)?)|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)


def objects(text: str, name: str) -> Iterator[dict[str, str]]:
    """The objects of the array ``name`` in order, values as text; of a key given twice the last counts."""
    start = re.search(rf"\bconst\s+{re.escape(name)}\s*=\s*\[", text)
    if not start:
        return
    depth, kept, last = 0, [], start.end()
    for m in _TOKEN.finditer(text, start.end()):
        token = m.group()
        if token.startswith(("//", "/*")):
            if depth:
                kept.append(text[last : m.start()])
            last = m.end()
        elif token in "[{":
            if depth == 0:
                kept, last = [], m.end()
            depth += 1
        elif token in "]}":
            depth -= 1
            if depth < 0:
                return
            if depth == 0 and token == "}":
                kept.append(text[last : m.start()])
                pairs = (p for p in _PAIR.finditer("".join(kept)) if p.group(1))
                yield {p.group(1): re.sub(r"\\(.)", r"\1", p.group(2)[1:-1], flags=re.S) if p.group(2)[0] in "\"'" else p.group(2) for p in pairs}


class EmbeddedTable:
    def eval(self, text: str | None, name: str):  # noqa: ANN201  rows of a table function
        for i, row in enumerate(objects(text or "", name)):
            for key, value in row.items():
                yield i, key, value


def embedded(pages: DataFrame, name: str, text: str = "html") -> DataFrame:
    """Columns of ``pages`` but the text, with ``at`` (place of the object), ``key``, ``value``; pages without the array, and null ones, give no row."""
    table = F.udtf(EmbeddedTable, returnType="at int, key string, value string")
    others = [c for c in pages.columns if c != text]
    clash = {"at", "key", "value", "_text"} & set(others)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    rows = pages.select(*others, F.col(text).alias("_text"))
    return rows.lateralJoin(table(F.col("_text").outer(), F.lit(name))).drop("_text")


def by_key(rows: DataFrame, page: str, key: str = "short") -> DataFrame:
    """One row for each value of ``key``, in lower case: its fields as a map; of equal ones the last of the last page counts."""
    one = rows.groupBy(page, "at").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    keyed = one.withColumn("id", F.lower(F.trim(F.try_element_at("fields", F.lit(key))))).where("id <> ''")
    return keyed.groupBy("id").agg(F.max_by("fields", F.struct(page, "at")).alias("fields"))
