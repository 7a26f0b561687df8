"""Words of the recommender, cut out of whole Arrow columns at once; the same as ``text.tokens`` finds by its pattern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..rules.tables import STOP_WORDS

FUNCTION = "paperloom_tokens"
LEAST, MOST = 3, 32
#: What a byte is to a word: nothing, a later character of one, or a letter, which may begin one.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*b"0123456789+-"]] = 1
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2


def cut(texts: pa.Array) -> pa.Array:
    """The words of each lower-cased text, in order; null for null."""
    lost = pc.is_null(texts).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2] if len(texts) else None
    kind = _KIND[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    edges = at - at[0]
    # Runs of characters of words end with their text.
    inside = np.zeros(len(kind) + 2, dtype=bool)
    inside[1:-1] = kind > 0
    between = np.unique(edges[(edges > 0) & (edges < len(kind))])
    between = between[inside[between] & inside[between + 1]]
    begins = np.sort(np.concatenate([np.flatnonzero(inside[1:-1] & ~inside[:-2]), between]))
    ends = np.sort(np.concatenate([np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1, between]))
    # A word begins with the first letter of its run.
    letters = np.append(np.flatnonzero(kind == 2), len(kind))
    late = np.flatnonzero(kind[begins] != 2)
    begins[late] = np.minimum(letters[np.searchsorted(letters, begins[late])], ends[late])
    fits = (ends - begins >= LEAST) & (ends - begins <= MOST)
    begins, ends = begins[fits], ends[fits]
    words = pa.array([], pa.large_string())
    if len(begins):
        # Words and what is between them, over the bytes of the texts; only the words are copied.
        marks = np.column_stack([begins, ends]).ravel() + at[0]
        words = pa.LargeStringArray.from_buffers(len(marks) - 1, pa.py_buffer(marks), data).take(pa.array(np.arange(0, len(marks), 2)))
        said = pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS, pa.large_string())))
        words, begins = words.filter(said), begins[said.to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, edges).astype(np.int32)), words.cast(pa.string()), mask=pa.array(lost))


@F.arrow_udf(ArrayType(StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    return cut(texts)


#: Of a lower-cased text.  Filters on words stay above it, so that it runs once.
tokens = _tokens.asNondeterministic()
