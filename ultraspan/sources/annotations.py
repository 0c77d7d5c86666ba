"""Annotation tables: one tab-separated file for each folder of recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import stash

#: Columns of the files and ours.
COLUMNS = {
    "Selection": ("selection", "int"),
    "View": ("view", "string"),
    "Channel": ("channel", "int"),
    "Begin Time (s)": ("begin_time", "double"),
    "End Time (s)": ("end_time", "double"),
    "Delta Time (s)": ("delta_time", "double"),
    "Low Freq (Hz)": ("low_freq", "double"),
    "High Freq (Hz)": ("high_freq", "double"),
    "Center Freq (Hz)": ("center_freq", "double"),
    "Peak Freq (Hz)": ("peak_freq", "double"),
    "Begin File": ("begin_file", "string"),
    "Delta Freq (Hz)": ("delta_freq", "double"),
    "USV TYPE": ("usv_type", "string"),
}


def clean_label(label: Column) -> Column:
    """Lower case, a null as the text ``nan``, and one spelling of the 22 kHz call."""
    low = F.lower(F.coalesce(label, F.lit("nan")))
    return F.when(low == "22-khz call", "22-khz").otherwise(low)


def _fields(line: Column, n: int) -> Column:
    """The ``n`` fields of a tab-separated line, quotes taken off; null where the line is shorter."""
    cut = F.from_csv(line, ", ".join(f"_{i} string" for i in range(n)), {"sep": "\t", "maxColumns": str(max(n, 2) + 1), "maxCharsPerColumn": "-1"})
    return F.array(*[cut[f"_{i}"] for i in range(n)])


def _header_name(name: Column) -> Column:
    """Blanks for underscores, no blanks around, no byte order mark."""
    return F.trim(F.translate(name, "_\ufeff", " "))


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns by each file's own header (in any order, blanks or underscores in names, ``NOTE`` for the type where there
    is no ``USV TYPE``); those that a file lacks are null. Of columns with one name the first counts. A line that is the
    header once more, and an empty one, are skipped. ``folder`` is the last folder of the path.

    One scan of the first block of each file gives the headers (a row for each file), a second one reads the lines; a line
    is cut once, and its header's places tell where the values are.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.filter(F.trim(F.translate("value", "\t\r\ufeff", "")) != "")
    # lines of a block are read in order by one task
    first = lines.filter("_block = 0").withColumn("_n", F.monotonically_increasing_id()).groupBy("_file").agg(F.min_by("value", "_n").alias("_header"))
    headers = stash(first)
    width = headers.agg(F.max(F.size(F.split("_header", "\t", -1)))).first()[0]
    if width is None:
        width = 1
    names = F.transform(_fields(F.col("_header"), width), _header_name)
    place = lambda name: F.array_position("_names", F.lit(name))
    places = {name: place(header) for header, (name, _) in COLUMNS.items()}
    places["usv_type"] = F.when(place("USV TYPE") > 0, place("USV TYPE")).otherwise(place("NOTE"))
    known = headers.withColumn("_names", names).select(F.col("_file").alias("_of"), "_header", F.struct(*[p.cast("int").alias(n) for n, p in places.items()]).alias("_at"))
    rows = lines.join(known, F.col("_file") == F.col("_of")).filter(F.col("value") != F.col("_header")).withColumn("_values", _fields(F.col("value"), width))
    at = lambda name: F.col(f"_at.{name}")
    own = [F.when(at(name) > 0, F.get("_values", at(name) - 1)).try_cast(kind).alias(name) for name, kind in COLUMNS.values()]
    folder = F.url_decode(F.regexp_replace(F.regexp_extract("_file", r"([^/]*)/[^/]*$", 1), r"\+", "%2B"))
    return rows.select(folder.alias("folder"), *own).withColumn("usv_type", clean_label(F.col("usv_type")))


def clean_labels(annotations: DataFrame, label: str = "usv_type", background: str = "background", drop: bool = True, junk: Sequence[str] = ("junk",)) -> DataFrame:
    """``junk`` is background; background rows are dropped from ground truth."""
    named = annotations.withColumn(label, F.when(F.col(label).isin(*junk), background).otherwise(F.col(label)))
    return named.filter(~F.col(label).eqNullSafe(background)) if drop else named


def align_annotation_times(annotations: DataFrame, recordings: DataFrame) -> DataFrame:
    """``annotations``: folder, begin_file, begin_time, end_time; ``recordings``: folder, name, duration. Times of a
    folder run on from file to file; files are ordered by their median begin time, and the durations of earlier ones are
    taken off. ``in_order`` is false where a begin isn't above 0 in a file that isn't the first.

    Files without annotations have no place in the order and take no time off others.
    """
    files = annotations.groupBy("folder", F.col("begin_file").alias("name")).agg(F.percentile("begin_time", F.lit(0.5)).alias("median"))
    order = W.partitionBy("folder").orderBy("median", "name")
    earlier = F.coalesce(F.sum("duration").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    shifts = files.join(recordings.select("folder", "name", "duration"), ["folder", "name"], "left").select("folder", F.col("name").alias("begin_file"), earlier.alias("shift"), (F.row_number().over(order) == 1).alias("first"))
    moved = annotations.join(shifts, ["folder", "begin_file"])
    return (
        moved.withColumn("begin_time", F.col("begin_time") - F.col("shift"))
        .withColumn("end_time", F.col("end_time") - F.col("shift"))
        .withColumn("in_order", F.col("first") | (F.col("begin_time") > 0))
        .select(*annotations.columns, "shift", "in_order")
    )
