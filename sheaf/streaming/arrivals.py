"""A watched tree, taken in batch by batch, every file once.

Spark's file streams pass over empty files and over names that begin with a dot or an underscore, which a tree of
sources is full of. Here a batch is what a listing of the tree shows beyond the ledger of files taken before. The
ledger of a batch is written first and settles what the batch holds; its rows come after and replace whatever an
earlier try left. So a batch that was stopped anywhere is done again with the same files and adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.charsets import DEFAULT_ENCODINGS
from sheaf.functions.globs import Rule, default_rules
from sheaf.operators.classify import classify_text, decode_text
from sheaf.operators.exclude import exclude_filter
from sheaf.operators.paragraphs import build_paragraphs
from sheaf.schemas import PARAGRAPHS
from sheaf.sources.files import list_tree, read_contents

_LEDGER = "path string, length bigint, raw binary"


class WatchedTree:
    """Paragraphs of a folder that all executors reach, kept below ``store``. One taker at a time.

    A path counts once: a file that changes after it was taken is not read again. A file that is listed but cannot be
    read is taken without rows. Rules decide before content is read; excluded files are listed anew each time.
    """

    def __init__(
        self, spark: SparkSession, root: str, store: str, rules: Sequence[Rule] | None = None,
        encodings: Sequence[str] = DEFAULT_ENCODINGS, bundle_id: str = "0",
    ) -> None:
        self.spark, self.root, self.store = spark, root, store.rstrip("/")
        self.rules = default_rules() if rules is None else rules
        self.encodings, self.bundle_id = encodings, bundle_id

    def take(self) -> int | None:
        """Take in what has arrived and return the number of the batch, or None if there is nothing new.

        A batch that was begun and not finished is finished instead.
        """
        begun, done = self._batches("ledger"), self._batches("rows")
        open_ = sorted(set(begun) - set(done))
        if open_:
            self._finish(open_[0])
            return open_[0]
        listing = exclude_filter(list_tree(self.spark, self.root, self.rules), self.rules)
        if begun:
            listing = listing.join(self._ledger(begun), "raw", "left_anti")
        number = max(begun, default=0) + 1
        listing.select("path", "length", "raw").write.mode("overwrite").parquet(self._folder("ledger", number))
        if self._ledger([number]).isEmpty():
            self._drop("ledger", number)
            return None
        self._finish(number)
        return number

    def paragraphs(self) -> DataFrame:
        """Rows of all finished batches."""
        folders = [self._folder("rows", n) for n in self._batches("rows")]
        reader = self.spark.read.schema(PARAGRAPHS)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], PARAGRAPHS)

    def _finish(self, number: int) -> None:
        files = read_contents(self._ledger([number]), self.root).select(
            F.lit(self.bundle_id).alias("bundle_id"), F.lit(0).alias("source_ord"), "path", "length", "content"
        )
        texts = decode_text(classify_text(files, self.encodings).filter("is_text"), self.encodings)
        build_paragraphs(texts).write.mode("overwrite").parquet(self._folder("rows", number))

    def _ledger(self, numbers: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(_LEDGER).parquet(*(self._folder("ledger", n) for n in numbers))

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.store}/{kind}/batch={number:09d}"

    def _drop(self, kind: str, number: int) -> None:
        path, fs = self._path(self._folder(kind, number))
        fs.delete(path, True)

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the batches written whole."""
        folder, fs = self._path(f"{self.store}/{kind}")
        if not fs.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
        whole = [n for n in names if fs.exists(self._path(f"{self.store}/{kind}/{n}/_SUCCESS")[0])]
        return [int(n.removeprefix("batch=")) for n in whole]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())
