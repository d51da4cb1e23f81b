"""A bundle table in which single bundles can be replaced.

Bundles lie in a fixed number of slots, by a hash of their names; every slot is a partition, and the number of
slots is one too, so a reader needs no other record of it. Replacing bundles rewrites the slots they lie in and no
others. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.paragraphs import build_paragraphs
from sheaf.schemas import PARAGRAPHS
from sheaf.sources.bundles import cluster_files

SLOTS = 64
_PLACE = ["slots", "slot"]
_SCHEMA = f"{PARAGRAPHS}, slots int, slot int"


def _slot(bundle_id: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(bundle_id), slots.cast("bigint")).cast("int")


def _placed(rows: DataFrame, slots: int) -> DataFrame:
    return rows.withColumns({"slots": F.lit(slots), "slot": _slot(F.col("bundle_id"), F.lit(slots))})


def _write(rows: DataFrame, path: str, overwrite: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy(*_PLACE).parquet(path)


def write_slots(texts: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write texts (bundle_id, source_ord, path, text) as paragraphs in slots, replacing what is there.

    Whole files move, before their lines are exploded; a large bundle is spread over many tasks of its slot. The
    null bundle is a bundle like any other.
    """
    if slots < 1:
        raise ValueError(f"slots must be positive: {slots}")
    clustered = cluster_files(_placed(texts, slots), [*_PLACE, "bundle_id", "source_ord", "path"])
    places = clustered.select("bundle_id", "source_ord", "path", "text")
    _write(_placed(build_paragraphs(places), slots), path, "static")


def read_slots(spark: SparkSession, path: str, bundle_ids: Sequence[str] | None = None) -> DataFrame:
    """Paragraph table; of chosen bundles only their slots are listed for reading."""
    table = spark.read.schema(_SCHEMA).parquet(path)
    if bundle_ids is not None:
        # Both sides are partition columns and literals, so other slots are pruned before any file is opened.
        lies = [F.col("slot") == _slot(F.lit(x), F.col("slots")) for x in bundle_ids]
        near = F.lit(False)
        for one in lies:
            near = near | one
        table = table.filter(near & F.col("bundle_id").isin(list(bundle_ids)))
    return table.drop(*_PLACE)


def replace_bundles(texts: DataFrame, path: str) -> None:
    """Put new versions of the bundles that ``texts`` hold in place of the old ones; bundles not there yet are added.

    The other bundles of the slots concerned are read and written again, all other slots stay as they are. A slot is
    swapped when the new one is complete, so a job that is stopped before leaves the old version. Without texts
    nothing changes. Bundles are told apart by a join; what the driver collects is at most one number a slot.
    """
    spark = texts.sparkSession
    old = spark.read.schema(_SCHEMA).parquet(path)
    known = old.select("slots").first()
    if known is None:
        return write_slots(texts, path)
    new = _placed(build_paragraphs(texts.select("bundle_id", "source_ord", "path", "text")), known["slots"])
    bundles = _placed(texts.select("bundle_id").distinct(), known["slots"])
    slots = [r["slot"] for r in bundles.select("slot").distinct().collect()]
    if not slots:
        return
    same = F.col("o.bundle_id").eqNullSafe(F.col("n.bundle_id"))
    stay = old.filter(F.col("slot").isin(slots)).alias("o").join(bundles.alias("n"), same, "left_anti")
    _write(cluster_files(stay.unionByName(new), [*_PLACE, "bundle_id", "source_ord", "path", "line_no"]), path, "dynamic")
