"""Token counts as rollups that deltas maintain.

A delta says what happened to a document under a tokenizer version: inserted (its count), deleted (the
count it had), revised (old count out, new count in). Each becomes signed rows of documents and tokens, so
totals by source, language and tokenizer version are sums and a batch is never read again once it is added
up. ``commit`` adds a batch up and writes it as one folder below the store, named by the batch id; Spark
replaces that folder as a whole, so committing a batch twice, or again after a crash, changes nothing.
``totals`` adds up the committed batches: some rows a batch, however large the batch was. ``compact`` writes
the totals as a new base; it names the batches it holds, which are then no longer read.

A hot source is no load: sums are combined before the shuffle. Null sources and languages are groups of
their own. A delta of unknown kind is an error. Deltas are a log: repeated rows count as often as
they stand there. Null counts count as 0. Groups whose documents and tokens have come to 0 are left out.
Other columns are not read; an empty batch is a batch.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.near import written

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
DELTAS = "source string, lang string, tokenizer string, kind string, tokens bigint, before bigint"


def signed(deltas: DataFrame) -> DataFrame:
    """Signed ``n_docs, n_tokens`` of each delta: ``kind`` is insert, delete or revise; ``tokens`` is the count
    inserted, deleted or new, ``before`` the count that a revision replaces."""
    tokens, before = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("tokens", "before"))
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of delta: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
    change = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).when(kind == "revise", tokens - before).otherwise(wrong.cast("bigint"))
    return deltas.select(*KEYS, docs.cast("bigint").alias("n_docs"), change.alias("n_tokens"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals below a shared folder. One writer at a time may compact; commits of different batches may overlap."""

    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = spark, store.rstrip("/")

    def commit(self, batch_id: str, deltas: DataFrame) -> None:
        """Add a batch; the second commit of a batch id takes the place of the first, unless it is compacted."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, _ and - only: {batch_id!r}")
        if batch_id not in self._compacted()[1]:
            _sums(signed(deltas)).write.mode("overwrite").parquet(f"{self.store}/batch={batch_id}")

    def totals(self) -> DataFrame:
        base, held = self._compacted()
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.store}/{name}") for name in self._names("batch=") if name.removeprefix("batch=") not in held]
        if base:
            parts.append(self.spark.read.schema(SCHEMA).parquet(f"{self.store}/{base}/totals"))
        rows = parts[0] if parts else self.spark.createDataFrame([], SCHEMA)
        for part in parts[1:]:
            rows = rows.union(part)
        return _sums(rows).filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Write all committed batches as one base. It counts once its list of batches is written, the last step."""
        base, held = self._compacted()
        number = int(base.removeprefix("base=")) + 1 if base else 1
        names = sorted({*held, *(n.removeprefix("batch=") for n in self._names("batch="))})
        where = f"{self.store}/base={number:09d}"
        self.totals().write.mode("overwrite").parquet(f"{where}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{where}/batches")

    def _compacted(self) -> tuple[str | None, set[str]]:
        for base in reversed(self._names("base=")):
            if self._done(f"{base}/batches"):
                return base, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.store}/{base}/batches").collect()}
        return None, set()

    def _names(self, prefix: str) -> list[str]:
        folder, fs = self._path("")
        if not fs.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
        return [n for n in names if n.startswith(prefix) and (prefix == "base=" or self._done(n))]

    def _done(self, name: str) -> bool:
        path, fs = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}" if name else self.store)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def word_tokens(text: Column) -> Column:
    """A simple count: runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def alnum_tokens(text: Column) -> Column:
    """Another: runs of ASCII letters and digits, and runs of what lies beyond ASCII."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z]+|[^\x00-\x7F]+")).cast("bigint")


def document_log(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """The life of a corpus in three batches: all documents come in under two tokenizer versions; copies of
    a text, all but the one of least id, are deleted; the rest is counted anew under the first."""
    counted = docs.select(
        "doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("name"),
        word_tokens(F.col("text")).alias("words"), alnum_tokens(F.col("text")).alias("pieces"),
    )
    counted = written(counted, "counts")
    first = counted.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    copies = counted.join(first, ["name", "doc_id"], "left_anti")
    kept = counted.join(first, ["name", "doc_id"], "left_semi")
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, kind: str, *counts: tuple[str, Column, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), a.alias("tokens"), b.alias("before")) for t, a, b in counts]))
        return df.select("source", "lang", each.alias("x")).select("source", "lang", "x.tokenizer", F.lit(kind).alias("kind"), "x.tokens", "x.before")

    words, pieces = F.col("words"), F.col("pieces")
    both = (("words-1", words, none), ("alnum-1", pieces, none))
    return [
        ("insert", rows(counted, "insert", *both)),
        ("copies", rows(copies, "delete", *both)),
        ("recount", rows(kept, "revise", ("words-1", pieces, words))),
    ]


def corpus_totals(docs: DataFrame, store: str) -> DataFrame:
    """Totals after the batches of ``document_log``, one of them committed twice as after a crash, and a compaction."""
    totals = Rollup(docs.sparkSession, store)
    log = document_log(docs)
    for batch_id, deltas in [*log[:2], *log[1:]]:
        totals.commit(batch_id, deltas)
    totals.compact()
    return totals.totals()


#: Totals after the three batches of ``document_log``.
SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, md5(coalesce(text, '')) AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+|[^\x00-\x7F]+')) AS pieces
  FROM documents),
kept AS (SELECT c.* FROM counted c JOIN (SELECT name, min(doc_id) AS doc_id FROM counted GROUP BY name) f USING (name, doc_id))
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(pieces) AS BIGINT) AS n_tokens
FROM kept CROSS JOIN (VALUES ('words-1'), ('alnum-1')) AS t(tokenizer)
GROUP BY source, lang, tokenizer
"""
