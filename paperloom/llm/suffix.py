"""Suffix-array deduplication as a depth-limited radix sort.

Suffixes are ordered only through THRESHOLD bytes, most significant digit first,
and a group is sorted further only while it has more than one member; the groups
that are still equal after the last digit are exactly the repeated windows.

* First digit: the least (by hash) of the ANCHOR-byte strings within the window.
  Equal windows have equal anchors, and neighbouring windows share theirs, so
  one entry stands for a range of windows and a pass moves about one entry for
  each hundred bytes.  A range alone with its anchor holds no repeated window.
* Second digit: the whole span of a range's windows.  Ranges of equal span are
  repeated in all their windows.
* Last digit: the THRESHOLD bytes themselves, for the ranges that share an anchor
  but not a span; of each span one copy takes part for all.

Anchors are told apart by a rolling hash, which only chooses and groups: ranges
whose anchors are taken for equal by mistake part at the next digit.  Equality
rests on BLAKE2b digests of the bytes themselves, 64 bits of a span beside the 64
of its anchor, 128 bits of a window.  Entries are pre-aggregated by block before
each shuffle; rows of one doc_id, or of none, are dealt over blocks by their text.

Defined cases: null text is empty; a text shorter than the threshold keeps all
its bytes; matches in one document and in repeated rows count; bytes that are
left may break a character and are returned as binary; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Slice, block_of, bounds, number_of_blocks, planes, slices, unplanes
from .common import release, staged, table

THRESHOLD = 400
ANCHOR = 200
_MOST = np.uint64((1 << 64) - 1)
#: What a range is told: all its windows repeat; that, and it speaks for its span in the last pass; it is judged there.
ALL, SPEAKS, JUDGED = 1, 2, 3

ENTRY = "block long, bucket int, keys binary, spans binary, marks binary"
ANSWER = "_block long, keys binary, checks binary, marks binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.strip().split() for x in schema.split(",")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two columns of 64 bits for each of the strings."""
    raw, blake = memoryview(data), hashlib.blake2b
    found = [blake(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    best, fill = (np.minimum, _MOST) if least else (np.maximum, np.uint64(0))
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = best.accumulate(grid, axis=1).reshape(-1)
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


class Ranges:
    """Ranges of windows of some texts that share an anchor: first and last window, anchor, span, and whether the anchor recurs within."""

    def __init__(self, part: Slice, size: int, gram: int) -> None:
        self.part, self.size = part, size
        total = len(part.data)
        self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.span = np.zeros(0, np.uint64)
        self.again = np.zeros(0, bool)
        if total < size:
            return
        at = np.arange(total - gram + 1)
        anchors = part.hashes(at, at + gram)
        # Anchors across the end of a text belong to no window.
        for e in part.ends[:-1].tolist():
            anchors[max(0, e - gram + 1) : e] = _MOST
        width = size - gram + 1
        least = _slide(anchors, width, least=True)
        valid = np.zeros(total - size + 2, bool)
        for s, e in zip(part.starts.tolist(), part.ends.tolist()):
            if e - s >= size:
                valid[s : e - size + 1] = True
        valid = valid[: len(least)]
        change = np.ones(len(least) + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | ~valid[1:] | ~valid[:-1]
        for s in part.starts.tolist():  # texts of just the size adjoin
            if s < len(least):
                change[s] = True
        cuts = np.flatnonzero(change)
        first, last = cuts[:-1], cuts[1:] - 1
        real = valid[first]
        self.first, self.last = first[real], last[real]
        self.anchor = least[self.first]
        self.span = digests(part.data, self.first, self.last + size)[:, 0]
        # Places of anchors: where one is the least of some window.
        over = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        places = np.flatnonzero((anchors == _slide(over, width, least=False)[: len(anchors)]) & (anchors != _MOST))
        lo, hi = np.searchsorted(places, self.first), np.searchsorted(places, self.last + width)
        count = hi - lo
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = anchors[places[lo[row] + inner]] == self.anchor[row]
        self.again = np.bincount(row[same], minlength=len(count)) > 1

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and digests of all windows of the chosen ranges."""
        n = self.last[which] - self.first[which] + 1
        at = np.repeat(self.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at, digests(self.part.data, at, at + self.size)


def _pieces(texts: pa.ChunkedArray, size: int, gram: int) -> Iterator[tuple[list[bytes], list[int], Ranges]]:
    for _, raw in slices(texts):
        able = [i for i, t in enumerate(raw) if len(t) >= size]
        yield raw, able, Ranges(Slice([raw[i] for i in able]), size, gram)


def _merged(keys: np.ndarray, spans: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key and span: marks hold a count up to two in their low bits and flags above, which are united."""
    order = np.lexsort((spans, keys))
    keys, spans, marks = keys[order], spans[order], marks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (spans[1:] != spans[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return keys, spans, marks
    count = np.minimum(np.add.reduceat((marks & 3).astype(np.int64), at), 2).astype(np.uint8)
    return keys[at], spans[at], count | np.bitwise_or.reduceat(marks & 252, at)


def _send(block: int, keys: np.ndarray, spans: np.ndarray, marks: np.ndarray, n_buckets: int) -> pa.Table:
    return _table([(block, k, planes(keys[a:b]), planes(spans[a:b]), marks[a:b].tobytes()) for k, a, b in bounds(keys, n_buckets)], ENTRY)


def _received(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = [unplanes(x.as_py(), "<u8") for x in group.column("keys")]
    spans = np.concatenate([unplanes(x.as_py(), "<u8") for x in group.column("spans")])
    marks = np.frombuffer(b"".join(x.as_py() for x in group.column("marks")), np.uint8)
    return group.column("block").to_pylist(), np.concatenate(keys), spans, marks, np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def _answer(blocks: list[int], source: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, marks: np.ndarray) -> pa.Table:
    order = np.argsort(source, kind="stable")
    source, keys, marks = source[order], keys[order], marks[order]
    checks = None if checks is None else checks[order]
    cuts = np.searchsorted(source, np.arange(len(blocks) + 1))
    return _table([(blocks[i], planes(keys[a:b]), b"" if checks is None else planes(checks[a:b]), marks[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], ANSWER)


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x.as_py(), "<u8") for x in answers.column("keys"))])
    marks = np.frombuffer(b"".join(x.as_py() for x in answers.column("marks")), np.uint8)
    order = np.argsort(keys, kind="stable")
    return keys[order], marks[order]


def _look_up(wanted: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Marks of the wanted keys; 0 where there is none."""
    out = np.zeros(len(wanted), np.uint8)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        same = keys[at] == wanted
        out[same] = marks[at[same]]
    return out


_PAIR = np.dtype([("key", "<u8"), ("check", "<u8")])


def _sorted_pairs(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), _PAIR)
    out["key"], out["check"] = keys, checks
    return out[np.lexsort((checks, keys))]


def _within(wanted: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which of the wanted rows of two are among the sorted pairs."""
    out = np.zeros(len(wanted), bool)
    at = np.searchsorted(pairs["key"], wanted[:, 0])
    live = np.flatnonzero(at < len(pairs))
    while len(live):
        live = live[pairs["key"][at[live]] == wanted[live, 0]]
        out[live] |= pairs["check"][at[live]] == wanted[live, 1]
        live = live[~out[live]]
        at[live] += 1
        live = live[at[live] < len(pairs)]
    return out


_AGAIN, _JUDGE = 4, 4


def first_digit(n_buckets: int, size: int, gram: int):
    def of_block(docs: pa.Table) -> pa.Table:
        found = [(r.anchor, r.span, r.again) for _, _, r in _pieces(docs.column("_text"), size, gram)]
        anchor, span, again = (np.concatenate(x) for x in zip(*found))
        merged = _merged(anchor, span, np.uint8(1) | (again.astype(np.uint8) * np.uint8(_AGAIN)))
        return _send(docs.column("_block")[0].as_py(), *merged, n_buckets)

    return of_block


def second_digit(group: pa.Table) -> pa.Table:
    """Of a bucket of anchors: what each block's ranges are told."""
    blocks, keys, spans, marks, source = _received(group)
    order = np.lexsort((source, spans, keys))
    keys, spans, marks, source = keys[order], spans[order], marks[order], source[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new_span = new_key.copy()
    new_span[1:] |= spans[1:] != spans[:-1]
    key_at, span_at = np.flatnonzero(new_key), np.flatnonzero(new_span)
    key_of, span_of = np.cumsum(new_key) - 1, np.cumsum(new_span) - 1
    copies = np.add.reduceat((marks & 3).astype(np.int64), span_at)[span_of]
    members = np.add.reduceat((marks & 3).astype(np.int64), key_at)[key_of]
    several = np.add.reduceat(new_span.astype(np.int64), key_at)[key_of] > 1
    again = np.bitwise_or.reduceat(marks & _AGAIN, key_at)[key_of] > 0
    told = np.zeros(len(keys), np.uint8)
    told[(members > 1) & (copies > 1)] = ALL
    further = several | again
    told[further & (copies > 1) & new_span] = SPEAKS
    told[further & (copies == 1)] = JUDGED
    keep = told > 0
    return _answer(blocks, source[keep], spans[keep], None, told[keep])


def last_digit(n_buckets: int, size: int, gram: int):
    def of_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, marks = _told(answers)
        keys, marks = keys[marks != ALL], marks[marks != ALL]
        if not len(keys) or not docs.num_rows:
            return _table([], ENTRY)
        hashes, counts = [], []
        for _, _, r in _pieces(docs.column("_text"), size, gram):
            told = _look_up(r.span, keys, marks)
            for mark, count in ((SPEAKS, 2), (JUDGED, 1 | _JUDGE)):
                which = np.flatnonzero(told == mark)
                _, found = r.windows(which)
                hashes.append(found)
                counts.append(np.full(len(found), count, np.uint8))
        h = np.concatenate(hashes)
        merged = _merged(h[:, 0], h[:, 1], np.concatenate(counts))
        return _send(docs.column("_block")[0].as_py(), *merged, n_buckets)

    return of_block


def repeated_windows(group: pa.Table) -> pa.Table:
    """Of a bucket of windows: those that occur twice, told to the blocks that asked."""
    blocks, key, check, marks, source = _received(group)
    order = np.lexsort((check, key))
    key, check, marks, source = key[order], check[order], marks[order], source[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    total = np.add.reduceat((marks & 3).astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    tell = (total > 1) & (marks & _JUDGE > 0)
    return _answer(blocks, source[tell], key[tell], check[tell], np.ones(int(tell.sum()), np.uint8))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove(size: int, gram: int):
    """Of a block: its texts without the bytes under repeated windows.  Answers of kind 0 are for spans, of kind 1 for windows."""

    def of_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0)
        keys, marks = _told(answers.filter(pa.array(kind == 0)))
        told_windows = answers.filter(pa.array(kind == 1))
        repeated = _sorted_pairs(*(np.concatenate([np.zeros(0, np.uint64), *(unplanes(x.as_py(), "<u8") for x in told_windows.column(c))]) for c in ("keys", "checks")))
        ids, rows, number = docs.column("doc_id").to_pylist(), [], 0
        for _, raw in slices(docs.column("_text")):
            able = [i for i, t in enumerate(raw) if len(t) >= size] if len(keys) else []
            cover = np.zeros(1, np.int64)
            part = Slice([raw[i] for i in able])
            if able:
                r = Ranges(part, size, gram)
                told = _look_up(r.span, keys, marks)
                cover = np.zeros(len(part.data) + 1, np.int64)
                whole = np.flatnonzero((told == ALL) | (told == SPEAKS))
                np.add.at(cover, r.first[whole], 1)
                np.add.at(cover, r.last[whole] + size, -1)
                at, found = r.windows(np.flatnonzero(told == JUDGED))
                at = at[_within(found, repeated)]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            place = {i: (int(s), int(e)) for i, s, e in zip(able, part.starts, part.ends)}
            for i, text in enumerate(raw):
                n = spans = 0
                kept = text
                if i in place:
                    out = gone[place[i][0] : place[i][1]]
                    n = int(out.sum())
                    if n:
                        spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~out].tobytes()
                rows.append((ids[number], len(text), n, spans, kept))
                number += 1
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _REMOVED.types)], schema=_REMOVED)

    return of_block


def dedup(docs: DataFrame, size: int = THRESHOLD, gram: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``."""
    spark, gram = docs.sparkSession, gram or size // 2
    n = number_of_blocks(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    rows = rows.withColumn("_block", block_of(F.xxhash64("doc_id", "_text"), n))
    texts = rows.groupBy("_block")
    entries = texts.applyInArrow(first_digit(n, size, gram), ENTRY)
    spans, _ = staged(entries.groupBy("bucket").applyInArrow(second_digit, ANSWER), "spans")
    release(spark)
    asked = texts.cogroup(spans.groupBy("_block")).applyInArrow(last_digit(n, size, gram), ENTRY)
    windows, _ = staged(asked.groupBy("bucket").applyInArrow(repeated_windows, ANSWER), "windows")
    release(spark)
    answers = spans.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    return texts.cogroup(answers.groupBy("_block")).applyInArrow(remove(size, gram), REMOVED)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"), THRESHOLD, ANCHOR)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
