"""Files as rows: path, modificationTime, length. Contents are never read (the column is pruned)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long"


def files(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False, missing: bool = False) -> DataFrame:
    """FILES under folder whose name fits the pattern; missing=True takes a folder that isn't there as empty."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    except AnalysisException as e:
        if missing and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], FILES)
        raise
    return found.select("path", "modificationTime", "length")


def name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """k, name, path of a folder's JPEG frames in order of their names; k is the number that the name ends with, else null."""
    found = files(spark, folder, "*.{jpg,JPG,jpeg}").withColumn("name", name())
    number = F.regexp_extract("name", r"(\d+)\.[^.]*$", 1).try_cast("long")
    return found.select(number.alias("k"), "name", "path").orderBy("name")


def newest(found: DataFrame) -> DataFrame:
    """The one file written last; of several the last by path."""
    return found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def first(found: DataFrame) -> DataFrame:
    return found.orderBy("path").limit(1)


def last(found: DataFrame) -> DataFrame:
    """The last by path, as text: iteration_9 comes after iteration_30."""
    return found.orderBy(F.desc("path")).limit(1)


def ordered(paths: list[DataFrame]) -> DataFrame:
    """The distinct paths of several listings, in order."""
    whole = paths[0].select("path")
    for p in paths[1:]:
        whole = whole.unionByName(p.select("path"))
    return whole.distinct().orderBy("path")


def expired(found: DataFrame, hours: float = 24.0, now: Column | None = None) -> DataFrame:
    """Files last written over `hours` before now; deleting them is the caller's decision."""
    age = F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp("modificationTime")
    return found.where(age > hours * 3600)
