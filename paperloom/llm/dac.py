"""Token ids in directly addressable codes.

A file of the format is a Parquet table whose rows are segments: consecutive
documents in doc_id order, about SEGMENT_TOKENS ids.  A segment's ids are split
into chunks of 8 bits; level k holds the k-th chunk of every id that has one,
level k's continuation bitmap says which of them go on, and a rank directory
holds the bitmap's count of ones before every 64-bit word.  The place of an id's
next chunk is the rank of its bit, so any token is read by one array access and
one rank for each level, without decoding a block.

Defined cases: null text is empty text and has the end id alone; rows of equal
doc_id follow each other in order of their texts; null ids come first; an empty
table writes no segments; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEGMENT_TOKENS = 1_000_000
#: Texts that are encoded at a time, in characters.
CHUNK = 2_000_000
#: Distinct units, and characters of them, after which a worker forgets; a chunk adds CHUNK of them and a text at most.
REMEMBERED, REMEMBERED_CHARS = 1_400_000, 32_000_000
#: A unit ends before a space that follows a character that is no space: the
#: byte-level pattern never joins over such a place, so units encode on their own.
#: The first pattern finds white space before a space, in Arrow's dialect.
_RUNS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_MARKS = frozenset(".,;:!?")
_UNITS = re.compile(r"(?<=\S)(?= )")

SEGMENT = "part int, before long, n_tokens long, doc_ids array<long>, ends array<long>, codes array<binary>, bitmaps array<binary>, ranks array<binary>"
_SEGMENT = pa.schema([
    ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
    ("codes", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])

_encoders: dict[str, UnitEncoder] = {}


class UnitEncoder:
    """The tokenizers library behind a memory of units.

    The memory is one array of ids and, by unit, where its ids start and how many
    there are; the units of a batch are told apart by Arrow and their ids gathered
    by numpy, so that Python sees each distinct unit of a batch once.
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
    def of(cls, path: str) -> UnitEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # units with their leading space taken off
        self.first: dict[str, int] = {}  # units as they stand
        self.held = 0
        self.ids, self.starts = array("I"), array("q", [0])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        ids, counts = self.packed(texts, 0)
        ends = np.cumsum(counts)
        return [ids[a : b - 1].astype("<u4").tobytes() for a, b in zip(ends - counts, ends)]

    def packed(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each text's followed by ``end_id``; and how many each has."""
        if len(self.starts) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.forget()
        column = pa.array(texts, pa.large_string())
        # Of a text of single spaces the units begin with a space, but for the first one.
        spaced = pc.match_substring_regex(column, _RUNS).to_numpy(zero_copy_only=False)
        if spaced.any():
            units = [_UNITS.split(t) if s else None for t, s in zip(texts, spaced.tolist())]
            column = pc.if_else(pa.array(spaced), "", column)
        else:
            units = []
        parts = pc.split_pattern(column, " ")
        values, offsets = parts.flatten(), parts.offsets.to_numpy()
        heads, at = values.take(pa.array(offsets[:-1])).to_pylist(), offsets[:-1] - offsets[0]
        coded = values.dictionary_encode()
        # Units hold no space: one string of all is handed over at once.
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        places = np.fromiter(self._places(distinct, self.known, True), np.int64)
        unit = places[coded.indices.to_numpy()]
        unit[at] = np.fromiter(self._places(heads, self.first, False), np.int64)
        sizes = np.diff(offsets)
        for i in np.flatnonzero(spaced).tolist():
            units[i] = np.fromiter(self._places(units[i], self.first, False), np.int64)
        if units:
            pieces = np.split(unit, at[1:])
            unit = np.concatenate([p if u is None else u for p, u in zip(pieces, units)])
            sizes = np.array([len(p if u is None else u) for p, u in zip(pieces, units)])
        ends = np.cumsum(sizes)
        held, begin = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(1, np.uint32), np.frombuffer(self.starts, np.int64)
        counts = np.diff(begin)[unit]
        totals = np.add.reduceat(counts, ends - sizes) + 1
        counts, starts = np.insert(counts, ends, 1), np.insert(begin[unit], ends, 0)
        from_ = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        from_ += np.arange(len(from_))
        out = held[np.minimum(from_, len(held) - 1)]
        out[np.cumsum(totals) - 1] = end_id
        return out, totals

    def _places(self, units: list[str], memory: dict[str, int], lead: bool) -> list[int]:
        """Numbers of the units, which are learned first where they are new."""
        places = list(map(memory.get, units))
        missing = [i for i, place in enumerate(places) if place is None]
        if missing:
            self._learn([units[i] for i in missing], memory, lead)
            for i in missing:
                places[i] = memory[units[i]]
        return places

    def _learn(self, new: list[str], memory: dict[str, int], lead: bool) -> None:
        """Words, words with a mark behind them and lines of such go to the library's model match by match, all else to the library."""
        space, others, piece = " " if lead else "", [], self._piece
        ids, starts = self.ids, self.starts
        for unit in new:
            if unit.isalpha():
                piece(unit, lead)
                continue
            if unit[:-1].isalpha() and unit[-1] in _MARKS:
                found = [piece(unit[:-1], lead), piece(unit[-1], False)]
            elif "\n" not in unit or not (found := self._lines(unit, lead)):
                others.append(unit)
                continue
            for at in found:
                ids.extend(ids[starts[at] : starts[at + 1]])
            memory[unit] = len(starts) - 1
            starts.append(len(ids))
        for i in range(0, len(others), 2_000):
            some = others[i : i + 2_000]
            for unit, x in zip(some, self.library.encode_batch_fast([space + u for u in some], add_special_tokens=False)):
                ids.extend(x.ids)
                memory[unit] = len(starts) - 1
                starts.append(len(ids))
        self.held += sum(map(len, new))

    def _lines(self, unit: str, lead: bool) -> list[int] | None:
        """Numbers of words, each alone or with one mark behind it, on lines of their own; None for other units.

        A single line end between two characters that are no spaces is a match of the pattern by itself.
        """
        out: list[int] = []
        for i, line in enumerate(unit.split("\n")):
            word, mark = (line, "") if line[-1:].isalpha() else (line[:-1], line[-1:])
            if not word.isalpha() or mark and mark not in _MARKS:
                return None
            if i:
                out.append(self._piece("\n", False))
            out.append(self._piece(word, lead and not i))
            if mark:
                out.append(self._piece(mark, False))
        return out

    def _piece(self, piece: str, lead: bool) -> int:
        """The number of one match of the pattern, its ids straight from the library's model."""
        memory = self.known if lead else self.first
        at = memory.get(piece)
        if at is None:
            if piece.isascii():
                coded = "\u0120" + piece if lead else piece if piece != "\n" else "\u010a"
            else:
                coded = (" " + piece if lead else piece).encode().decode("latin-1").translate(self.alphabet)
            self.ids.extend([x.id for x in self.model.tokenize(coded)])
            at = memory[piece] = len(self.starts) - 1
            self.starts.append(len(self.ids))
        return at


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Codes, continuation bitmaps and rank directories of each level."""
    codes, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        codes.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest >>= 8
        more = rest > 0
        if not more.any():
            return codes, bitmaps, ranks
        words = np.zeros((len(more) + 63) // 64 * 8, np.uint8)
        words[: (len(more) + 7) // 8] = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(words.view("<u8"))
        bitmaps.append(words.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        rest = rest[more]


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, codes: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> None:
        self.codes = [np.frombuffer(x, np.uint8) for x in codes]
        self.bitmaps = [np.frombuffer(x, "<u8") for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at the places, in any order."""
        out = np.zeros(len(places), np.uint32)
        who, here = np.arange(len(places)), places.astype(np.int64)
        for level, codes in enumerate(self.codes):
            out[who] |= codes[here].astype(np.uint32) << (8 * level)
            if level == len(self.bitmaps):
                break
            word, bit = self.bitmaps[level][here >> 6], (here & 63).astype(np.uint64)
            goes_on = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.ranks[level][here >> 6] + np.bitwise_count(below)
            who, here = who[goes_on], rank[goes_on].astype(np.int64)
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` to ``end``: neighbours' next chunks are neighbours, so a rank finds the first of them."""
        out = self.codes[0][begin:end].astype(np.uint32)
        who: np.ndarray | slice = slice(None)
        for level, bitmap in enumerate(self.bitmaps):
            word, bit = begin >> 6, begin & 63
            bits = np.unpackbits(bitmap[word : (end + 63) >> 6].view(np.uint8), bitorder="little")[bit : bit + end - begin].astype(bool)
            if not bits.any():
                break
            below = int(bitmap[word]) & ((1 << bit) - 1)
            begin = int(self.ranks[level][word]) + below.bit_count()
            end = begin + int(bits.sum())
            who = np.flatnonzero(bits) if isinstance(who, slice) else who[bits]
            out[who] |= self.codes[level + 1][begin:end].astype(np.uint32) << np.uint32(8 * (level + 1))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """doc_ids and texts of about CHUNK characters."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes ``docs`` and writes the segments to ``path`` in doc_id order.

    The texts are dealt by ranges of doc_id before they are encoded, so that
    sampling the ranges costs a scan and no encoding.
    """
    file = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = UnitEncoder.of(file), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [part, before, len(ids), list(doc_ids), np.cumsum(np.concatenate(sizes)).tolist(), *pack(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SEGMENT.types)], schema=_SEGMENT)

        for some, texts in _chunks(batches):
            ids, counts = coder.packed(texts, end_id)
            doc_ids += some
            held.append(ids)
            sizes.append(counts)
            if (n := sum(map(len, held))) >= SEGMENT_TOKENS:
                yield flush()
                before += n
                doc_ids, held, sizes = [], [], []
        if held:
            yield flush()

    rows.mapInArrow(segments, SEGMENT).write.option("compression", "zstd").parquet(path)


READ = "doc_id long, part int, start long, n_tokens long, ids binary"
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in the file; start counts the ids of all documents before."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # A row for each partition of the writer: what comes before it.
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, so_far = {}, 0
    for part, n in totals:
        offsets[part] = so_far
        so_far += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["codes"], row["bitmaps"], row["ranks"])
                out, begin = [], 0
                for doc_id, end in zip(row["doc_ids"], row["ends"]):
                    ids = segment.span(begin, end).astype("<u4").tobytes()
                    out.append((doc_id, row["part"], offsets[row["part"]] + row["before"] + begin, end - begin, ids))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _READ.types)], schema=_READ)

    return files.mapInArrow(documents, READ).drop("part")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
