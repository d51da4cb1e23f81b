"""Names for outputs: common parent, default name, and the next free name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import base_name, parent, stem

# Default names and the last suffix tried.
DEFAULT_OUTPUT = "output.docx"
DEFAULT_STEM = "output"
OUTPUT_EXTENSION = ".docx"
UNPACKED_SUFFIX = "_unpacked"
LAST_SUFFIX = 9999
# What stands for the time of the run in names beyond the last number.
STAMP = "more"


def common_prefix(low: Column, high: Column) -> Column:
    """Leading elements two arrays share."""
    short = F.least(F.size(low), F.size(high))
    same = F.transform(F.slice(low, 1, short), lambda x, i: F.when(x == F.get(high, i), 1).otherwise(0))
    first_gap = F.array_position(same, 0)
    return F.slice(low, 1, F.when(first_gap > 0, first_gap - 1).otherwise(short).cast("int"))


def common_parent(sources: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Longest directory all sources of a bundle lie in; null if there is none but the root.

    What the least and the greatest directory share is shared by all between them, so the answer
    comes from a min and a max, summed up before the shuffle.
    """
    parts = F.split(parent(F.col("path")), "/", -1)
    ends = sources.groupBy(key).agg(
        F.min(parts).alias("low"), F.max(parts).alias("high"), F.count("*").alias("sources")
    )
    shared = F.array_join(common_prefix(F.col("low"), F.col("high")), "/")
    named = F.when(~shared.isin("", "/"), shared)
    return ends.select(key, "sources", named.alias("common_parent"))


def output_names(sources: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Output name per bundle from sources (path, is_dir) and its ``explicit`` name.

    An explicit name is used as it stands unless it is the default. Otherwise one file gives its
    stem, one directory its name, several sources the name of their common parent.
    """
    common = common_parent(sources, key)
    first = sources.groupBy(key).agg(
        F.min(F.struct("source_ord", "path", "is_dir")).alias("first"),
        F.max("explicit").alias("explicit"),
    )
    path, shared = F.col("first.path"), F.col("common_parent")
    parts = first.join(common, key).select(
        key,
        "explicit",
        (F.col("sources") == 1).alias("single"),
        F.col("first.is_dir").alias("is_dir"),
        base_name(path).alias("base"),
        stem(path).alias("stem"),
        parent(path).alias("parent"),
        shared.alias("shared"),
        base_name(shared).alias("shared_base"),
    )
    single = F.col("single")
    name = (
        F.when(single & (F.col("base") == ""), DEFAULT_STEM)
        .when(single & F.col("is_dir"), F.col("base"))
        .when(single, F.col("stem"))
        .when(F.col("shared").isNotNull(), F.col("shared_base"))
        .otherwise(DEFAULT_STEM)
    )
    folder = F.when(single | F.col("shared").isNull(), F.col("parent")).otherwise(F.col("shared"))
    named = parts.select(key, "explicit", folder.alias("folder"), F.concat(name, F.lit(OUTPUT_EXTENSION)).alias("name"))
    given = F.col("explicit").isNotNull() & (F.col("explicit") != DEFAULT_OUTPUT)
    own = join_path(F.col("folder"), F.col("name"))
    return named.select(key, F.when(given, F.col("explicit")).otherwise(own).alias("output_name"), given.alias("given"))


def resolve_output_names(
    sources: DataFrame, existing: DataFrame, key: str = "bundle_id", stamp: str = STAMP
) -> DataFrame:
    """:func:`output_names`, renamed where the name exists; explicit names are kept. ``error`` is null
    where there is a name."""
    names = output_names(sources, key)
    asked = names.filter(~F.col("given")).select(
        F.col(key).alias("request_id"), F.col("output_name").alias("name")
    )
    free = allocate_names(asked, existing, stamp=stamp).select(F.col("request_id").alias(key), "allocated", "error")
    return names.join(free, key, "left").select(
        key, F.when(F.col("given"), F.col("output_name")).otherwise(F.col("allocated")).alias("output_name"), "error"
    )


def join_path(folder: Column, name: Column) -> Column:
    return (
        F.when(folder == "", name)
        .when(folder == "/", F.concat(folder, name))
        .otherwise(F.concat(folder, F.lit("/"), name))
    )


def default_unpack_name(path: Column) -> Column:
    """Path without its extension, with the suffix of unpacked folders."""
    return F.concat(join_path(parent(path), stem(path)), F.lit(UNPACKED_SUFFIX))


def _suffixed(name: Column, n: Column, whole: bool) -> Column:
    """Name number ``n``: the suffix goes before the extension, or after the whole name."""
    cut = F.lit("") if whole else F.regexp_extract(name, r"(?s)[^/](\.[^./]*)\z", 1)
    head = F.substring(name, F.lit(1), F.length(name) - F.length(cut))
    return F.when(n.cast("string") == "0", name).otherwise(F.concat(head, F.lit("_"), n.cast("string"), cut))


def allocate_names(
    requests: DataFrame, existing: DataFrame, whole: bool = False, stamp: str = STAMP
) -> DataFrame:
    """Give every request (request_id, name) the first free of name, name_1, name_2, ...

    ``existing`` holds names in use. Requests for one name are served in the order of request_id;
    a name someone asks for is not given to a request for another name. The n-th request takes the
    n-th free number, so it is a join of two rankings. Numbers end at 9999, so the rankings are cut
    there (before the shuffle, even if most requests want one name). Requests beyond get
    name_``stamp``_request_id, which needs no ranking; only if that is in use too there is an error.
    """
    in_use = existing.select("name").union(requests.select("name")).distinct()
    taken = existing.select("name", F.lit(True).alias("exists")).distinct()
    pattern = r"(?s)\A(.*)_([1-9][0-9]{0,3})\z" if whole else r"(?s)\A(.*)_([1-9][0-9]{0,3})(\.[^./]*|)\z"
    tail = F.lit("") if whole else F.regexp_extract("name", pattern, 3)
    numbered = (
        in_use.filter(F.col("name").rlike(pattern))
        .select(
            F.concat(F.regexp_extract("name", pattern, 1), tail).alias("base"),
            F.regexp_extract("name", pattern, 2).cast("int").alias("n"),
            "name",
        )
        .filter(_suffixed(F.col("base"), F.col("n"), whole) == F.col("name"))
        .select(F.col("base").alias("name"), "n")
    )
    numbered = numbered.unionByName(taken.select("name", F.lit(0).alias("n")))
    wanted = requests.groupBy("name").agg(F.count("*").alias("asked"))
    used = numbered.groupBy("name").agg(F.collect_set("n").alias("used"))
    upper = F.least(F.col("asked") + F.size("used"), F.lit(LAST_SUFFIX)).cast("int")
    free = (
        wanted.join(used, "name", "left")
        .withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
        .select("name", F.posexplode(F.array_except(F.sequence(F.lit(0), upper), "used")).alias("rank", "n"))
    )
    place = F.row_number().over(Window.partitionBy("name").orderBy("request_id"))
    ranked = (
        requests.withColumn("place", place)
        .filter(F.col("place") <= LAST_SUFFIX + 1)
        .withColumn("rank", F.col("place") - 1)
    )
    given = ranked.join(free, ["name", "rank"]).select(
        "request_id", _suffixed(F.col("name"), F.col("n"), whole).alias("allocated")
    )
    suffix = F.concat(F.lit(f"{stamp}_"), F.col("request_id").cast("string"))
    served = requests.join(given, "request_id", "left").withColumn(
        "beyond", F.when(F.col("allocated").isNull(), _suffixed(F.col("name"), suffix, whole))
    )
    used = in_use.select(F.col("name").alias("beyond"), F.lit(True).alias("beyond_used"))
    return served.join(used, "beyond", "left").select(
        "request_id",
        "name",
        F.coalesce("allocated", F.when(F.col("beyond_used").isNull(), F.col("beyond"))).alias("allocated"),
        F.when(F.col("beyond_used"), "no free name").alias("error"),
    )
