"""Best-fit packing of token sequences by bin completion.

A document longer than a sequence is cut into pieces; pieces are packed into as few
sequences as can be.  What a sequence may hold depends on the lengths of pieces
alone, and there are at most LENGTH of them: the packing is planned on how many
pieces have each length, whatever the number of documents.

The plan comes from branch-and-bound over bins.  A bin is completed around the
largest piece that is left, by fillings that no other filling dominates, those that
waste least first; as many bins as the counts allow are filled alike.  A branch ends
when its waste passes what a packing of fewer bins than the incumbent could afford.
The first incumbent is best fit in descending order; the search stops at the lower
bound, or after STEPS steps, and then keeps the incumbent.

The pieces find their places by their rank among those of their length: ranks are
counted by the tasks that write the pieces, and start where the counts of the tasks
before end.

Defined cases: null text is empty text and has the end id alone; repeated rows and
rows of one doc_id, or of none, are documents of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LENGTH = 4096
#: Steps that the search takes before it keeps the incumbent, and the share of lengths that are left when it sums up anew.
STEPS, USED_UP = 2_000_000, 0.9
#: Characters that are encoded at a time; distinct words, and characters of them, after which a worker forgets.
CHUNK = 8_000_000
REMEMBERED, REMEMBERED_CHARS = 1_400_000, 32_000_000

_MARKS = frozenset(".,;:!?")
#: Letters before this one are the same in all normal forms, but for case.
_LATIN = "\u0250"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """The tokenizers library behind a memory of words.

    The vocabulary drops white space and never joins over it, so what lies between
    ASCII white space is encoded on its own; the words of a batch are told apart by
    Arrow and their ids gathered by numpy.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for what follows 255.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.starts = array("I"), array("q", [0])

    def learn(self, words: list[str]) -> None:
        """Latin letters, alone or with one mark behind them, go straight to the library's model; all else to the whole library."""
        known, ids, starts, tokenize, others = self.known, self.ids, self.starts, self.model.tokenize, []
        for word in words:
            mark = word[-1:] if word[-1:] in _MARKS else ""
            letters = word[:-1] if mark else word
            if not letters.isalpha():
                others.append(word)
                continue
            small = letters.lower()
            if (at := known.get(small)) is not None:
                if not mark:
                    known[word] = at
                    continue
                ids.extend(ids[starts[at] : starts[at + 1]])
            elif letters.isascii():
                ids.extend([x.id for x in tokenize(small)])
            elif max(letters) < _LATIN and small.isalpha():
                ids.extend([x.id for x in tokenize(small.encode().decode("latin-1").translate(self.alphabet))])
            else:
                others.append(word)
                continue
            if mark:
                ids.extend([x.id for x in tokenize(mark)])
            known[word] = len(starts) - 1
            starts.append(len(ids))
        for i in range(0, len(others), 2_000):
            some = others[i : i + 2_000]
            for word, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                ids.extend(found.ids)
                known[word] = len(starts) - 1
                starts.append(len(ids))
        self.held += sum(map(len, words))

    def packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.forget()
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        # Words hold no space: one string of all is handed over at once.
        words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        places = list(map(self.known.get, words))
        if missing := [i for i, place in enumerate(places) if place is None]:
            self.learn([words[i] for i in missing])
            for i in missing:
                places[i] = self.known[words[i]]
        word = np.array(places, np.int64)[coded.indices.to_numpy()]
        starts = np.frombuffer(self.starts, np.int64)
        counts = np.diff(starts)[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        from_ = np.repeat(starts[word] - ends[:-1], counts)
        from_ += np.arange(len(from_))
        held = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        return held[from_], np.diff(ends[offsets - offsets[0]])


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, rank``: pieces, each with its rank among those of its length in its task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            for doc_ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1)):
                ids, counts = coder.packed(texts)
                ids, ends = ids.astype("<u4"), np.cumsum(counts).tolist()
                out = []
                for doc_id, n, end in zip(doc_ids, counts.tolist(), ends):
                    own = np.append(ids[end - n : end], np.uint32(end_id))
                    for k, at in enumerate(range(0, n + 1, size)):
                        cut = own[at : at + size]
                        out.append((doc_id, k, at, len(cut), zlib.crc32(cut.tobytes()), part, seen[len(cut)]))
                        seen[len(cut)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE.types)], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, PIECES)


def chunks(doc_ids: list, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Rows in pieces of about CHUNK characters."""
    ids, held, size = [], [], 0
    for doc_id, text in zip(doc_ids, texts):
        ids.append(doc_id)
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield ids, held
            ids, held, size = [], [], 0
    if held:
        yield ids, held


@dataclass(frozen=True)
class Fill:
    """``bins`` bins from number ``first`` on hold ``each`` pieces of ``length`` from ``offset`` on; the last of them may hold fewer."""

    length: int
    first: int
    bins: int
    each: int
    count: int
    offset: int


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: by the sum of all lengths, and by pieces that can't share a bin.

    For each k: pieces over size - k share none with pieces of k or more; those over
    half share none with each other, and pieces of k or more go into their room.
    """
    n = np.zeros(size + 2, object)
    for length, c in counts.items():
        n[length] = c
    number = np.r_[0, np.cumsum(n)]  # number[x]: pieces shorter than x
    amount = np.r_[0, np.cumsum(n * np.arange(size + 2))]
    best, half = -(-amount[-1] // size), size // 2
    for k in range(1, half + 1):
        large = number[size + 1] - number[half + 1]
        middle = number[size - k + 1] - number[half + 1]
        room = middle * size - (amount[size - k + 1] - amount[half + 1])
        best = max(best, large + max(0, -(-(amount[half + 1] - amount[k] - room) // size)))
    return int(best)


def best_fit(counts: dict[int, int], size: int) -> tuple[list[Fill], int]:
    """Best fit in descending order: the fills, and how many bins there are.

    Bins of the same room are handled together: the tightest ones that take a piece
    take as many pieces of its length as they can.
    """
    fills: list[Fill] = []
    rooms: list[int] = []  # of open bins, ascending
    held: dict[int, list[tuple[int, int]]] = {}  # room: ranges of bins

    def put(room: int, first: int, bins: int) -> None:
        if room:
            if room not in held:
                insort(rooms, room)
            held.setdefault(room, []).append((first, bins))

    n_bins = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect_left(rooms, length)
        while left:
            if at == len(rooms):  # new bins
                each = size // length
                bins = -(-left // each)
                put(size, n_bins, bins)
                n_bins += bins
                at = bisect_left(rooms, length)
                continue
            room = rooms[at]
            first, bins = held[room].pop()
            each = room // length
            full = min(bins, left // each)
            if full:
                fills.append(Fill(length, first, full, each, full * each, size - room))
                put(room - each * length, first, full)
                left -= full * each
            elif left:
                fills.append(Fill(length, first, 1, left, left, size - room))
                put(room - left * length, first, 1)
                full, left = 1, 0
            if full < bins:
                held[room].append((first + full, bins - full))
            if not held[room]:
                del held[room]
                rooms.remove(room)
            at = bisect_left(rooms, length)
    return fills, n_bins


class Sums:
    """What can be made of the lengths that are left: bit s of ``reach[i]`` is set if some pieces of the ``i`` shortest lengths sum to s."""

    def __init__(self, left: dict[int, int], size: int) -> None:
        self.lengths, self.reach, mask = sorted(left), [1], (1 << (size + 1)) - 1
        for n in self.lengths:
            now, c, k = self.reach[-1], min(left[n], size // n), 1
            while c:
                take = min(k, c)
                now |= (now << (take * n)) & mask
                c, k = c - take, k * 2
            self.reach.append(now)


def fillings(left: dict[int, int], sums: Sums, size: int, most_waste: int, steps: list[int]) -> Iterator[tuple[int, dict[int, int]]]:
    """Undominated ways to fill a bin around the largest piece that is left, as (waste, {length: pieces}), least waste first.

    A filling is dominated if a piece of it, or two of them, or its waste, could give
    way to a piece that is left, fits and is no shorter in sum: the pieces taken out
    fit wherever that one had gone.  ``sums`` may come from more pieces than are left.
    """
    largest = max(left)
    room = size - largest
    rest = left | {largest: left[largest] - 1}
    lengths, reach = sums.lengths, sums.reach

    def exact(i: int, want: int) -> Iterator[dict[int, int]]:
        """Pieces of the ``i`` shortest lengths that sum to ``want``, long ones and many of them first."""
        if want == 0:
            yield {}
            return
        for j in range(min(i, bisect_right(lengths, want)) - 1, -1, -1):
            if steps[0] <= 0 or not reach[j + 1] >> want & 1:
                return
            n = lengths[j]
            steps[0] -= n in rest
            for c in range(min(rest.get(n, 0), want // n), 0, -1):
                for more in exact(j, want - c * n):
                    yield {n: c} | more

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            for found in exact(len(lengths), room - waste):
                if not dominated(found, rest, waste, steps):
                    yield waste, found | {largest: found.get(largest, 0) + 1}
        if steps[0] <= 0:
            return


def dominated(filling: dict[int, int], rest: dict[int, int], waste: int, steps: list[int]) -> bool:
    chosen = sorted(filling)
    swaps = [(x, x + 1) for x in (0, *chosen)] if waste else []
    swaps += [(a + b, a + b) for i, a in enumerate(chosen) for b in chosen[i:] if a != b or filling[a] > 1]
    steps[0] -= len(swaps) * (waste + 1)
    return any(rest.get(n, 0) > filling.get(n, 0) for gone, least in swaps for n in range(least, gone + waste + 1))


def complete(counts: dict[int, int], size: int, bound: int, incumbent: int, steps: int = STEPS) -> list[tuple[int, dict[int, int]]] | None:
    """Bins of a packing of fewer than ``incumbent`` bins, as (how many, {length: pieces in each}); None if none was found.

    Depth first: the bin around the largest piece is completed in one of its ways, as
    many bins as the counts allow; the waste of all bins is bounded by what one bin
    fewer than the best packing so far could waste.
    """
    total = sum(n * c for n, c in counts.items())
    left = {n: c for n, c in counts.items() if c}
    best, budget, sums = None, [steps], Sums(left, size)
    afford = (incumbent - 1) * size - total
    # A frame: the ways that are left, the bins filled in the last one and how; waste, bins and sums before it.
    frames: list[list] = []
    waste = bins = 0
    descend = True
    while budget[0] > 0:
        if descend and not left:
            best = [(f[1], f[2]) for f in frames]
            afford = (bins - 1) * size - total
            if bins <= bound:
                break
        elif descend and waste <= afford:
            if len(left) < USED_UP * len(sums.lengths):
                sums = Sums(left, size)
            frames.append([fillings(left, sums, size, afford - waste, budget), 0, {}, waste, bins, sums])
        step = None
        while frames and step is None:
            ways, many, filling, waste, bins, sums = frames[-1]
            for n, c in filling.items():
                left[n] = left.get(n, 0) + many * c
            frames[-1][1:3] = 0, {}
            step = next(ways, None)
            if step is None:
                frames.pop()
        if step is None:
            break
        lost, filling = step
        many = min(left[n] // c for n, c in filling.items())
        many = min(many, (afford - waste) // lost) if lost else many
        descend = many > 0
        if descend:
            frames[-1][1:3] = many, filling
            for n, c in filling.items():
                left[n] -= many * c
                if not left[n]:
                    del left[n]
            waste, bins = waste + many * lost, bins + many
    return best


def plan(counts: dict[int, int], size: int = LENGTH, steps: int = STEPS) -> tuple[list[Fill], int]:
    """Fills of all pieces and how many bins there are."""
    fills, n_bins = best_fit(counts, size)
    bound = lower_bound(counts, size)
    better = complete(counts, size, bound, n_bins, steps) if n_bins > bound else None
    if better is None:
        return fills, n_bins
    fills, first = [], 0
    for bins, filling in better:
        offset = 0
        for n, c in filling.items():
            fills.append(Fill(n, first, bins, c, bins * c, offset))
            offset += n * c
        first += bins
    return fills, first


class Places:
    """Where the piece of a length and rank goes."""

    def __init__(self, fills: list[Fill], size: int) -> None:
        fills = sorted(fills, key=lambda f: f.length)
        self.length, self.first, self.each, self.count, self.offset = (np.array([getattr(f, c) for f in fills], np.int64) for c in ("length", "first", "each", "count", "offset"))
        self.start = np.searchsorted(self.length, np.arange(size + 2))
        ends = np.r_[0, np.cumsum(self.count)]
        self.before = ends[:-1]
        self.base = ends[self.start[:-1]]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        at = self.base[length] + rank
        i = np.searchsorted(self.before, at, "right") - 1
        nth = at - self.before[i]
        return self.first[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, size: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    found, _ = staged(pieces(docs, tokenizer or public_tokenizers.path(TOKENIZER), end_id, size), "pieces")
    tally = found.groupBy("length", "part").agg((F.max("rank") + 1).alias("c"))
    before = F.sum("c").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts, _ = staged(tally.select("length", "part", "c", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most ``size`` rows
    held = spark.sparkContext.broadcast(Places(plan(counts, size)[0], size))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts.hint("merge")
    ranked = found.join(starts.drop("c"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = held.value.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
