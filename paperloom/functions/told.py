"""What the rules' patterns find in a paper, counted once for all of them over Arrow columns.

RE2 reads a text once for many patterns together; only lines that hold any of them are
read again, for fewer patterns each time.  It is also the engine of the SQL that queries
are held against, so a match is the same in both.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..rules import tables as R
from . import scoring as S
from . import tokens
from .dialect import SPARK, Spark

#: Patterns whose matches are counted; of the others it is only told whether there is one.
COUNTED = [R.NOVELTY_UP, R.NOVELTY_DOWN, R.FOUNDATIONAL, R.SURPRISE, R.PRACTICAL, R.EXPLAIN, R.BROAD, R.CLARITY]
#: Patterns of title and abstract.  None matches a line feed, so lines are read apart.
SPOKEN = list(dict.fromkeys([*COUNTED[:-1], R.L1_PATTERN, R.L3_PATTERN, R.L4_PATTERN, *(p for _, p in [*R.TAGS, *R.PAPER_TYPES, *R.LABS, *R.UNIVERSITIES, *R.PATTERN_GAPS])]))
#: Patterns of the folded affiliations, or the abstract, and of the plain abstract; they reach over lines.
HOUSED, OPEN = [p for _, p in R.INSTITUTIONS], [R.EXPLICIT_GAP]
WIDTH = len(SPOKEN) + 1 + len(HOUSED) + len(OPEN)
FUNCTION = "paperloom_told"
#: Patterns that find something together are asked in so many parts; texts are taken in pieces of about this many bytes.
PARTS, PIECE = 5, 16 << 20


@cache
def _places() -> dict[tuple[str, str], int]:
    """Where the number of a pattern stands, by the expression it is looked for in."""
    keys = [("txt", p) for p in SPOKEN] + [(S.folded(SPARK, "abstract"), R.CLARITY)] + [(S.folded(SPARK, S.housing(SPARK)), p) for p in HOUSED] + [("abstract", p) for p in OPEN]
    return {k: i for i, k in enumerate(keys)}


class Told(Spark):
    """Spark's dialect over papers with the column ``told``."""

    def like(self, x: str, pattern: str) -> str:
        place = _places().get((x, pattern))
        return super().like(x, pattern) if place is None else f"(get(told, {place}) > 0)"

    def count(self, x: str, pattern: str) -> str:
        place = _places().get((x, pattern))
        return super().count(x, pattern) if place is None else f"get(told, {place})"

    def tokens(self, x: str) -> str:
        return f"{tokens.FUNCTION}(lower({x}))"

    def first(self, x: str, pattern: str) -> str:
        return super().first(S.folded(self, S.TEXT) if x == "txt" else x, pattern)

    def telling(self) -> str:
        """The column ``told`` of papers."""
        return f"{FUNCTION}(title, abstract, CASE WHEN {self.size('affiliations_raw')} > 0 THEN {self.join('affiliations_raw', ' ')} END) AS told"


def _folded(texts: pa.Array) -> pa.Array:
    plain = pc.all(pc.string_is_ascii(texts)).as_py()
    return texts if plain else pc.replace_substring_regex(texts, S.FOREIGN, "_")


def _find(texts: pa.Array, rows: np.ndarray, patterns: list[tuple[int, str]], out: np.ndarray, folded: bool = True) -> None:
    """Notes in ``out`` what patterns, each with its place, find in texts of the given rows.

    Where all together find nothing, none does.  That is asked of texts before they are
    folded: what is found in a folded text is found in the plain one too.
    """
    if not len(texts) or not patterns:
        return
    hits = pc.fill_null(pc.match_substring_regex(texts, "|".join(f"(?:{p})" for _, p in patterns), ignore_case=True), False)
    texts, rows = texts.filter(hits), rows[hits.to_numpy(zero_copy_only=False)]
    if folded or len(patterns) > 1:
        texts = _folded(texts) if folded else texts
        for part in np.array_split(np.arange(len(patterns)), min(PARTS, len(patterns))):
            _find(texts, rows, [patterns[i] for i in part], out, False)
        return
    place, pattern = patterns[0]
    if pattern in COUNTED:
        np.add.at(out[:, place], rows, pc.count_substring_regex(texts, pattern, ignore_case=True).to_numpy(zero_copy_only=False))
    else:
        out[rows, place] = 1


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines, and the text that each is of."""
    lines = pc.split_pattern(texts, "\n")
    return lines.flatten(), pc.list_parent_indices(lines).to_numpy()


def _tell(title: pa.Array, abstract: pa.Array, housed: pa.Array) -> np.ndarray:
    n, k = len(title), len(SPOKEN)
    out, everyone = np.zeros((n, WIDTH), dtype=np.int32), np.arange(n)
    spoken, clear = list(enumerate(SPOKEN)), [(k, R.CLARITY)]
    # The title stands before the first line of the abstract; the other lines are lines of both.
    lines, rows = _lines(abstract)
    first = np.diff(rows, prepend=-1) != 0
    top, top_rows = lines.filter(pa.array(first)), rows[first]
    heads, head_rows = _lines(pc.binary_join_element_wise(title.take(pa.array(top_rows)), top, pa.scalar(" ", pa.large_string())))
    _find(heads, top_rows[head_rows], spoken, out)
    _find(top, top_rows, clear, out)
    _find(lines.filter(pa.array(~first)), rows[~first], spoken + clear, out)
    _find(pc.coalesce(housed, abstract), everyone, list(enumerate(HOUSED, k + 1)), out)
    _find(abstract, everyone, list(enumerate(OPEN, k + 1 + len(HOUSED))), out, False)
    return out


def _told(title: pa.Array, abstract: pa.Array, housed: pa.Array) -> pa.Array:
    title, abstract, housed = (x.cast(pa.large_string()) for x in (title, abstract, housed))
    n, k = len(title), len(SPOKEN)
    step = max(1, PIECE * n // max(1, abstract.nbytes))
    out = np.concatenate([np.zeros((0, WIDTH), dtype=np.int32), *(_tell(*(x.slice(i, step) for x in (title, abstract, housed))) for i in range(0, n, step))])
    # Nothing is known of a null text, not even that it holds no match.
    untitled, blank, nowhere = (pc.is_null(x).to_numpy(zero_copy_only=False)[:, None] for x in (title, abstract, pc.coalesce(housed, abstract)))
    lost = np.hstack([np.repeat(untitled | blank, k, 1), blank, np.repeat(nowhere, len(HOUSED), 1), np.repeat(blank, len(OPEN), 1)])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WIDTH), pa.array(out.ravel(), mask=lost.ravel()))


def register(spark: SparkSession) -> None:
    """Makes ``telling`` and ``tokens`` known to a session."""

    @F.arrow_udf("array<int>")
    def told(title: pa.Array, abstract: pa.Array, housed: pa.Array) -> pa.Array:
        return _told(title, abstract, housed)

    spark.udf.register(FUNCTION, told)
    spark.udf.register(tokens.FUNCTION, tokens.tokens)
