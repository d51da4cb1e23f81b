"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features (``FEATURES``) are densities and counts of lexicon words and stems, the same after
obfuscation is undone, how many hits stand near a second-person word, and rates of capitals,
punctuation and obfuscated tokens. The text is the only input; language, source and ids are none.

The lexicon is learned too: a word or word beginning enters if most of the labelled texts that hold it are
toxic and it stands between changing neighbours there. The second condition keeps out the words of a
toxic text that was copied often. Neighbours are counted in 64-bit maps, so a term is one row a task.

Labels are learned only from rows whose crc32(doc_id) modulo 4 is not 2. Of these at most
``MAX_LABELS`` are used, the first by a hash of the id; the lexicon and the trees learn from remainders
0 and 1, the calibration from remainder 3. The lexicon holds at most ``MAX_TERMS`` terms a kind. Both bounds
make what is broadcast bounded. All documents are scored, over their whole texts.

Null and empty texts are scored like any other (all features 0). A null doc_id counts as the empty string in
the remainder. Repeated labels of an id: toxic if any says so; null labels are skipped. Without labels of both
kinds every score is the share of toxic labels, or 0. Rows are scored one by one, so repeated rows and ties
need no rule. The columns read are doc_id, text and, of labels, toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.arrays import ALNUM, NOT_SPACE, Slice, Spans, counts_by_row, hashes, mix, prefix_hash, slices, span_hash, words
from sheaf.llm.near import written
from sheaf.llm.tables import add_by_text

MAX_LABELS = 20_000
MAX_TERMS = 2_000
THRESHOLD = 0.3
STEMS = (4, 5, 6)
MIN_CONTEXTS = 6
MIN_SHARE = 0.6
NEAR = 5

#: Words that address the reader, in English, German, French and Spanish.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "euch", "euer", "tu", "toi", "te", "ton", "ta", "tes",
    "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "vosotros",
)

FEATURES = (
    "words", "word_hits", "word_density", "stem_hits", "stem_density", "plain_hits", "hidden_hits", "address_hits", "address_words",
    "capitals", "shouted", "marks", "punctuation", "obfuscated", "weight",
)

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()-", np.uint8))
_FILLER = np.isin(np.arange(256), np.frombuffer(b".-*_~^+|", np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"*_~^+|@$#%&0134578!", np.uint8))
#: Characters read as letters.
_READ_AS = np.arange(256, dtype=np.uint8)
for _old, _new in zip(b"013457@$!", b"oieastasi", strict=True):
    _READ_AS[_old] = _new


@dataclass
class Lexicon:
    """Sorted hashes of words and of beginnings of words, each with its log odds."""

    words: np.ndarray
    word_weights: np.ndarray
    stems: np.ndarray
    stem_weights: np.ndarray


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _word_list(items) -> np.ndarray:
    out = []
    for s in slices(pa.array(list(items))):
        out.append(hashes(s.data, words(s, ALNUM), 0))
    return np.unique(np.concatenate(out))


def _stems(data: np.ndarray, spans: Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every stem length, the words that are longer and the hashes of their beginnings."""
    prefix = prefix_hash(data, 1)
    for n in STEMS:
        long = np.flatnonzero(spans.end - spans.start > n)
        start = spans.start[long]
        yield long, span_hash(prefix, start, start + n, 1)


def _lookup(h: np.ndarray, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of hashes, 0 for those the table lacks."""
    if not len(table):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, weights[at], 0.0)


def _hits(s: Slice, lexicon: Lexicon) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a lower-case slice, their hashes, and word and stem weights."""
    spans = words(s, ALNUM)
    h = hashes(s.data, spans, 0)
    stem = np.zeros(len(h))
    for at, own in _stems(s.data, spans):
        stem[at] = np.maximum(stem[at], _lookup(own, lexicon.stems, lexicon.stem_weights))
    return spans, h, _lookup(h, lexicon.words, lexicon.word_weights), stem


def undone(s: Slice) -> Slice:
    """A lower-case slice with digits and signs inside words read as letters, fillers between letters and
    long repeats taken out."""
    letter = _LETTER[s.data]
    n = len(s.data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    data = np.where(before | after, _READ_AS[s.data], s.data)
    drop = _FILLER[s.data] & before & after
    if n > 2:
        drop[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return Slice(s.first, s.rows, data[~drop], kept[s.offsets])


def features(s: Slice, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each row of a slice."""
    low = s.lower()
    spans, h, word, stem = _hits(low, lexicon)
    n = counts_by_row(spans.row, s.rows)
    many = np.maximum(n, 1)
    hit = (word > 0) | (stem > 0)
    clear = undone(low)
    other, _, word2, stem2 = _hits(clear, lexicon)
    hidden = counts_by_row(other.row[(word2 > 0) | (stem2 > 0)], s.rows)
    address = np.isin(h, second)
    total = np.concatenate([[0], np.cumsum(address)])
    at = np.flatnonzero(hit)
    begin = np.cumsum(n) - n
    lo = np.maximum(at - NEAR, begin[spans.row[at]])
    hi = np.minimum(at + NEAR + 1, (begin + n)[spans.row[at]])
    close = total[hi] > total[lo]
    row = np.repeat(np.arange(s.rows), np.diff(s.offsets))
    letters = np.maximum(counts_by_row(row[_LETTER[s.data]], s.rows), 1)
    size = np.maximum(np.diff(s.offsets), 1)
    token = words(s, NOT_SPACE)
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[s.data])])
    long = token.end - token.start
    shouted = (long > 2) & (capitals[token.end] - capitals[token.start] == long)
    inner = np.zeros(len(s.data), bool)
    inner[1:-1] = _SYMBOL[s.data[1:-1]] & _LETTER[s.data[:-2]] & _LETTER[s.data[2:]]
    plain = counts_by_row(spans.row[hit], s.rows)
    return np.stack(
        [
            np.log1p(n),
            np.log1p(counts_by_row(spans.row[word > 0], s.rows)),
            counts_by_row(spans.row[word > 0], s.rows) / many,
            np.log1p(counts_by_row(spans.row[stem > 0], s.rows)),
            counts_by_row(spans.row[stem > 0], s.rows) / many,
            plain,
            np.maximum(hidden - plain, 0),
            counts_by_row(spans.row[at[close]], s.rows),
            counts_by_row(spans.row[address], s.rows) / many,
            counts_by_row(row[_CAPITAL[s.data]], s.rows) / letters,
            counts_by_row(token.row[shouted], s.rows) / many,
            counts_by_row(row[_MARK[s.data]], s.rows) / size,
            counts_by_row(row[_PUNCTUATION[s.data]], s.rows) / size,
            counts_by_row(row[inner], s.rows) / many,
            np.bincount(spans.row, weights=np.maximum(word, stem), minlength=s.rows)[: s.rows],
        ],
        axis=1,
    )


def add_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the text, with a column for every feature."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, _word_list(SECOND_PERSON)))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, second = shared.value
        for batch in batches:
            parts = [features(s, own, second) for s in slices(batch.column("text"))]
            values = np.concatenate([*parts, np.zeros((0, len(FEATURES)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x) for x in values.T.copy())], names=[*names, *(f"f_{x}" for x in FEATURES)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"f_{x} double" for x in FEATURES)])
    return docs.mapInArrow(run, schema)


def learn_lexicon(texts: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """From labelled ``text, toxic``: terms that toxic texts hold in many surroundings and others seldom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)) == 1
            for s in slices(batch.column("text")):
                s = s.lower()
                spans = words(s, ALNUM)
                h = hashes(s.data, spans, 0)
                before, after = np.zeros_like(h), np.zeros_like(h)
                before[1:], after[:-1] = h[:-1], h[1:]
                bit = mix(before + after * np.uint64(3)) >> np.uint64(58)
                for kind, (at, own) in enumerate([(np.arange(len(h)), h), *_stems(s.data, spans)]):
                    if len(own):
                        yield _terms(min(kind, 1), own, spans.row[at], np.uint64(1) << bit[at], toxic[s.first : s.first + s.rows])

    kinds = "kind int, term bigint, bits bigint, bad bigint, fine bigint"
    found = (
        texts.select("text", "toxic")
        .mapInArrow(run, kinds)
        .groupBy("kind", "term")
        .agg(F.bit_or("bits").alias("bits"), F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
        .withColumn("contexts", F.bit_count("bits"))
        .filter((F.col("contexts") >= MIN_CONTEXTS) & (F.col("contexts") >= 0.4 * F.least("bad", F.lit(64))))
        .filter(F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("fine")))
        .withColumn("weight", F.log((F.col("bad") + 0.5) / (F.col("fine") + 0.5)))
    )
    tables = []
    for kind in (0, 1):
        best = found.filter(F.col("kind") == kind).orderBy(F.desc("bad"), "term").limit(max_terms).select("term", "weight").toArrow()
        term = best.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        tables += [term[order], np.maximum(best.column("weight").to_numpy()[order], 1e-3)]
    return Lexicon(*tables)


def _terms(kind: int, term: np.ndarray, row: np.ndarray, bit: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    """Per term: the map of its surroundings in toxic texts, and how many texts of both kinds hold it."""
    order = np.lexsort((row, term))
    term, row, bit = term[order], row[order], bit[order]
    bad = toxic[row]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first), kind, np.int32)),
            pa.array(term[first].view(np.int64)),
            pa.array(np.bitwise_or.reduceat(np.where(bad, bit, np.uint64(0)), first).view(np.int64)),
            pa.array(np.add.reduceat((new & bad).astype(np.int64), first)),
            pa.array(np.add.reduceat((new & ~bad).astype(np.int64), first)),
        ],
        names=["kind", "term", "bits", "bad", "fine"],
    )


@dataclass
class Model:
    """What scoring needs; without trees every score is ``share``."""

    lexicon: Lexicon | None
    trees: object
    curve: object
    share: float


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    marks = labels.select("doc_id", "toxic").filter("toxic is not null").filter(remainder(F.col("doc_id"), 4) != 2)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))  # max_labels rows at most
    sample = written(docs.select("doc_id", "text").join(some, "doc_id").withColumn("fold", remainder(F.col("doc_id"), 4)), "labelled")
    seen = {r.toxic: r.n for r in sample.filter("fold != 3").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.0
    if len(seen) < 2 or sample.filter("fold = 3").select("toxic").distinct().count() < 2:
        return Model(None, None, None, share)
    lexicon = learn_lexicon(sample.filter("fold != 3"))
    table = written(_vector(add_features(sample, lexicon)).select("fold", "toxic", "features"), "features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.3, minInstancesPerNode=5, seed=1).fit(table.filter("fold != 3"))
    curve = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(_raw(trees, table.filter("fold = 3")))
    return Model(lexicon, trees, curve, share)


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="features").transform(df)


def _raw(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the other columns of ``docs`` but the text, and ``score``."""
    if model.trees is None:
        return docs.drop("text").withColumn("score", F.lit(model.share))
    scored = model.curve.transform(_raw(model.trees, _vector(add_features(docs, model.lexicon))))
    return scored.select(*(c for c in docs.columns if c != "text"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns, whatever they are called. A text goes to the
    worker once and comes back in slices, so memory does not grow with the size of a batch."""
    model = fit(docs, labels)
    names = docs.columns
    plain = docs.toDF(*[f"own{i}" for i in range(len(names))])
    if model.trees is None:
        scored = plain.withColumn("score", F.lit(model.share))
    else:
        shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, _word_list(SECOND_PERSON)))
        added = [T.StructField(f"f_{x}", T.DoubleType(), False) for x in FEATURES]

        def work(s: Slice) -> list[pa.Array]:
            return [pa.array(x) for x in features(s, *shared.value).T.copy()]

        scored = model.curve.transform(_raw(model.trees, _vector(add_by_text(plain, f"own{names.index('text')}", added, work))))
    return scored.filter(F.col("score") < THRESHOLD).select(*plain.columns).toDF(*names)
