"""Language identification by partial matching.

Each language has a byte context tree of variable order, up to ORDER bytes, with
the counts of what followed each context in its training texts.  A byte's
probability in a context that has seen n bytes, d of them different, is c/(n+d)
if the byte was seen c times; else it escapes with d/(n+d) to the next shorter
context, below the empty one to 1/256.  The counts are frozen after training, so
a word has one exact code length in each language: the contexts begin anew at
white space, and a text's length is the sum over its words.  The shortest code
wins; ties go to the first name.

The trees are trained on SAMPLE_DOCS labelled documents of each language, on fewer
of each where that is more than TOTAL_DOCS together, chosen by the hash of doc_id;
every text is scored whole.

Defined cases: null text or text without a letter is ``und`` with score 0, and so
is everything when no document can be learned from; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, drop_path, staged, table

ORDER = 4
#: Labelled documents of each language that the trees are trained on.
SAMPLE_DOCS = 300
#: Labelled documents of all languages together; with more than TOTAL_DOCS / SAMPLE_DOCS languages each has fewer.
TOTAL_DOCS = 60_000
FOLDS = 5
#: Distinct words remembered by a worker.
REMEMBERED = 400_000

Tree = dict[bytes, dict[int, int]]
_scorers: dict[str, Scorer] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def learn(text: str, tree: Tree, order: int = ORDER) -> None:
    """Adds the counts of a text's words."""
    for word in text.encode().split():
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            byte = coded[i]
            for k in range(min(order, i) + 1):
                seen = tree.setdefault(coded[i - k : i], {})
                seen[byte] = seen.get(byte, 0) + 1


def bits(context: bytes, byte: int, tree: Tree) -> float:
    """Code length of a byte after a context."""
    out = 0.0
    while True:
        seen = tree.get(context)
        if seen:
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return out - float(np.log2(seen[byte] / total))
            out -= float(np.log2(len(seen) / total))
        if not context:
            return out + 8.0
        context = context[1:]


def _trees(texts: DataFrame) -> DataFrame:
    """``lang, tree`` (pickled) of ``lang, text``; a worker holds the sample of one language at a time."""

    def each(group: pa.Table) -> pa.Table:
        tree: Tree = {}
        for chunk in group.column("text").chunks:
            for text in chunk:
                learn(text.as_py(), tree)
        return pa.table({"lang": group.column("lang").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return texts.groupBy("lang").applyInArrow(each, "lang string, tree binary")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, total_docs: int = TOTAL_DOCS) -> dict[str, Tree]:
    """A tree for each language of the documents outside the held-out fold; a null doc_id is not learned from.

    The sample is drawn by a hash of doc_id, least first, in two passes whatever the
    number of languages: one for ids, which Spark limits by language before it
    shuffles, one for their texts.  The workers build the trees.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn, path = staged(known.select("lang", "doc_id", F.row_number().over(by_hash).alias("rn")).where(F.col("rn") <= sample_docs), "drawn")
    share = max(1, min(sample_docs, total_docs // max(1, drawn.where("rn = 1").count())))
    chosen = drawn.where(F.col("rn") <= share).select("lang", "doc_id").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    found = _trees(known.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text"))
    trees = {r["lang"]: pickle.loads(r["tree"]) for r in found.toLocalIterator()}
    drop_path(docs.sparkSession, path)
    return trees


class Scorer:
    """Code lengths of words in every language, remembered by word and by context."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]
        self.grams: dict[bytes, int] = {}
        self.gram_bits = np.zeros((1024, len(self.names)))
        self.forget()

    @classmethod
    def of(cls, key: str, trees: dict[str, Tree]) -> Scorer:
        """The worker's scorer for a model; one model at a time."""
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = cls(trees)
        return _scorers[key]

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.word_bits = np.zeros((1024, len(self.names)))

    def _gram(self, gram: bytes) -> int:
        at = self.grams[gram] = len(self.grams)
        if at == len(self.gram_bits):
            self.gram_bits = np.concatenate([self.gram_bits, np.zeros_like(self.gram_bits)])
        self.gram_bits[at] = [bits(gram[:-1], gram[-1], tree) for tree in self.trees]
        return at

    def _add(self, new: list[bytes]) -> None:
        if len(self.grams) > 4 * REMEMBERED:
            self.grams = {}
        get, flat, starts = self.grams.get, [], []
        for word in new:
            coded = b" " + word + b" "
            starts.append(len(flat))
            for i in range(1, len(coded)):
                gram = coded[max(0, i - ORDER) : i + 1]
                at = get(gram)
                flat.append(self._gram(gram) if at is None else at)
        sums = np.add.reduceat(self.gram_bits[flat], starts, axis=0)
        first = len(self.words)
        while first + len(new) > len(self.word_bits):
            self.word_bits = np.concatenate([self.word_bits, np.zeros_like(self.word_bits)])
        self.word_bits[first : first + len(new)] = sums
        self.words.update(zip(new, range(first, first + len(new))))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """A row of code lengths for each text, which all have words."""
        split = [t.encode().split() for t in texts]
        if len(self.words) > REMEMBERED:
            self.forget()
        words = self.words
        new = list({w for ws in split for w in ws if w not in words})
        if new:
            self._add(new)
        get, flat, starts = words.__getitem__, [], []
        for ws in split:
            starts.append(len(flat))
            flat += map(get, ws)
        return np.add.reduceat(self.word_bits[flat], starts, axis=0)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        if able:
            found = self.lengths([texts[i] for i in able])
            best = found.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(found.min(axis=1, keepdims=True) - found, -1000)).sum(axis=1)
            for i, b, s in zip(able, best.tolist(), share.tolist()):
                names[i], scores[i] = self.names[b], s
        return names, scores


def predict(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; score is the winner's share of probability."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # at most SAMPLE_DOCS texts a language
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(key, held.value)
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.slice(i, 500)
                names, scores = scorer.judge(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))

