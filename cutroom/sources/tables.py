"""Reading: tables by explicit schema, pages, new files, cached responses, sampled frames, feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import source_type, stamp

VIDEO_FILES = ("mp4", "mkv", "avi", "mov", "webm", "flv")


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A table of another database, read in ranges of key by many tasks."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def media(spark: SparkSession, path: str, extensions: tuple[str, ...] = VIDEO_FILES) -> DataFrame:
    """path, modified_at and bytes of media files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes")).filter(is_media(F.col("path"), extensions))


def is_media(path: Column, extensions: tuple[str, ...] = VIDEO_FILES) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def unseen(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of found, once for each key, that known has not."""
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The row with these values, if there is one."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df.limit(1)


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows with all wanted values; what is None or '' is not asked for."""
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    return df


def page_with_total(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page, with the number of all rows (total) on each of its rows."""
    return page(df, order, skip, limit).join(F.broadcast(df.agg(F.count("*").alias("total"))), F.lit(True))


def cached(requests: DataFrame, cache: DataFrame, key: str, now: Column, ttl_s: int, at: str = "cached_at") -> DataFrame:
    """requests with the cached columns of their key, null where there is none that is fresh; of several the latest."""
    others = [c for c in cache.columns if c != key]
    last = fresh(cache, now, ttl_s, at).groupBy(key).agg(F.max_by(F.struct(*others), at).alias("__c"))
    return requests.join(last, key, "left").select(*requests.columns, *(F.col(f"__c.{c}").alias(c) for c in others))


def fresh(cache: DataFrame, now: Column, ttl_s: int, at: str = "cached_at") -> DataFrame:
    return cache.filter(now - F.col(at) <= ttl_s)


def sampled_frames(frames: DataFrame, key: str, index: str, most: int = 24) -> DataFrame:
    """Every (n // most)-th frame of each key, `most` at most."""
    n = F.count("*").over(Window.partitionBy(key))
    step = F.greatest(F.lit(1), F.floor(n / most))
    place = F.row_number().over(Window.partitionBy(key).orderBy(index)) - 1
    return frames.withColumns({"__step": step, "__place": place}).filter((F.col("__place") % F.col("__step") == 0) & (F.col("__place") / F.col("__step") < most)).drop("__step", "__place")


def action_units(spark: SparkSession, path: str, most: int = 35) -> DataFrame:
    """Rows of an action-unit CSV: its AU*_r columns in order as one array of `most` numbers, what is missing or NaN as 0."""
    raw = spark.read.option("header", True).csv(path)
    names = sorted(c for c in raw.columns if c.strip().startswith("AU") and c.strip().endswith("_r"))[:most]
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return raw.select(F.concat(F.array(*(value(c) for c in names)), F.array_repeat(F.lit(0.0), most - len(names))).alias("au"))


def well_shaped(df: DataFrame, column: str, rows: int, columns: int) -> DataFrame:
    """Rows whose matrix has that many rows and columns."""
    return df.filter((F.size(column) == rows) & F.forall(column, lambda r: F.size(r) == columns))


def url_list(urls: DataFrame, column: str, target_emotion: str | None = None) -> DataFrame:
    """Rows of videos to come, one for each address that is not blank: title and source_url (trimmed), source_type, status `queued`, target_emotion. An address that stands twice comes twice."""
    url = F.trim(F.col(column), F.lit(" \t\r\n"))
    rows = urls.select(*(c for c in urls.columns if c != column), url.alias("source_url")).filter("source_url <> ''")
    return rows.withColumns({"title": F.col("source_url"), "source_type": source_type(F.col("source_url")), "status": F.lit("queued"), "target_emotion": F.lit(target_emotion).cast("string")})


def uploads(files: DataFrame, name: str, now: Column, folder: str = "videos", target_emotion: str | None = None, extensions: tuple[str, ...] = VIDEO_FILES) -> DataFrame:
    """Rows of videos that are uploaded under their file's name: title (without its ending), source_type, file_path with a stamp, status; error for files that are no videos, whose other columns are null."""
    whole = F.coalesce(F.nullif(F.element_at(F.split(name, "[/\\\\]"), -1), F.lit("")), F.lit("video.mp4"))
    ending = F.lower(F.regexp_extract(whole, r"(\.[^.]*)$", 1))
    good = F.substring(ending, 2, 99).isin(*extensions)
    made = {
        "title": F.regexp_replace(whole, r"\.[^.]*$", ""), "source_type": F.lit("upload"), "file_path": F.concat(F.lit(f"{folder}/upload_"), stamp(now), F.lit("_"), whole),
        "status": F.lit("queued"), "target_emotion": F.lit(target_emotion).cast("string"),
    }
    return files.withColumns({**{c: F.when(good, v) for c, v in made.items()}, "error": F.when(~good, F.concat(F.lit("unsupported: "), ending))})


def to_copy(here: DataFrame, there: DataFrame, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Files of here (of these kinds) that there has not: what a sync has to copy."""
    wanted = here.filter(F.col(path).isNotNull())
    wanted = wanted.filter(is_media(F.col(path), extensions)) if extensions else wanted
    return wanted.join(there.filter(F.col(path).isNotNull()).select(path), path, "left_anti")
