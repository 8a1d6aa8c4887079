"""Result tables: completeness, keyed idempotent appends, chunk checks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 100
#: Folders of one write at most; their span of chunks grows by ``GROWTH`` until so few are left.
FOLDERS, GROWTH = 1000, 8


def complete(spectra: str = "h_spec") -> Column:
    """Whether a record is whole: land needs centre, spacings and a spectrum that is not all zero; ocean needs its centre."""
    centre = F.col("clat").isNotNull() & F.col("clon").isNotNull()
    land = F.col("dk").isNotNull() & F.col("dl").isNotNull() & F.col(spectra).isNotNull() & F.exists(spectra, lambda x: x != 0)
    return F.coalesce(centre & F.when(F.col("is_land") == 1, land).otherwise(True), F.lit(False))


def packed_spectra(modes: DataFrame, n_modes: int, keys: tuple[str, ...] = ("cell_id",), values: tuple[str, ...] = ("ampl", "kk", "ll")) -> DataFrame:
    """Fixed-length vectors of each cell's positive modes in (l, k) order, padded with zeros; more than ``n_modes`` raises an error."""
    rows = modes.where("ampl > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("l_idx", "k_idx", *values))).alias("m"))
    fits = F.when(F.size("m") > n_modes, F.raise_error(F.lit("more positive modes than the vector holds"))).otherwise(F.lit(n_modes) - F.size("m"))
    return rows.select(*keys, *[F.concat(F.col("m")[v], F.array_repeat(F.lit(0.0), fits.cast("int"))).alias(v) for v in values])


def folder_span(records: DataFrame, key: str) -> int:
    """How many chunks a folder holds, so that the records fall in about ``FOLDERS`` of them at most however many there are: 1 for small tables."""
    chunks = records.select(F.expr(f"`{key}` div {CHUNK}").alias("c")).distinct()
    spans = [GROWTH**k for k in range(20)]  # 8 ** 19 chunks are more than a long id has
    counts = chunks.agg(*[F.approx_count_distinct(F.expr(f"c div {s}"), 0.02).alias(f"s{s}") for s in spans]).head()
    return next((s for s in spans if counts[f"s{s}"] <= FOLDERS), spans[-1])


def append_missing(records: DataFrame, path: str, key: str = "cell_id") -> DataFrame:
    """Append the records whose key is not in the table at ``path`` yet, with their ``chunk``, and return the table.

    Each append writes folders of ``span`` chunks (``folder_span``), the first one names them. Only the folders that lie between the new records' least and
    largest key are read. Of new records with one key the one that sorts first stays; a stored record of the new ones' chunks that is not complete raises
    an error instead of being passed over. One writer at a time: a marker beside the table makes a second one fail.
    """
    spark = records.sparkSession
    marker = f"{path.rstrip('/')}._writing"
    if not create_new(spark, marker):
        raise RuntimeError(f"another writer is at {path}, or one was lost there: {marker} exists")
    try:
        columns = [c for c in records.columns if c != key]
        new, chunk = records, F.expr(f"cast(`{key}` div {CHUNK} as int)")
        span = folder_span(new, key)
        records = records.groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, "_r.*").withColumn("chunk", chunk)
        if exists(spark, path):
            low, high = new.agg(F.min(chunk), F.max(chunk)).head()
            have = spark.read.parquet(path).where((F.col("folder") <= F.lit(high)) & (F.col("folder") + F.col("span") > F.lit(low)))
            broken = have.where(~complete()).select("chunk").distinct()
            if broken.join(new.select(chunk.alias("chunk")), "chunk", "left_semi").limit(1).count():
                raise ValueError("a stored record is incomplete")
            records = records.join(have.select(key), key, "left_anti")
        _in_folders(records, span, "folder", F.col("chunk")).write.mode("append").partitionBy("span", "folder").parquet(path)
    finally:
        delete(spark, marker)
    return spark.read.parquet(path).drop("span", "folder")


def _in_folders(records: DataFrame, span: int, name: str, chunk: Column) -> DataFrame:
    """Records with their folder's span and first chunk, dealt by folder."""
    first = chunk - F.pmod(chunk, F.lit(span)) if span > 1 else chunk
    return records.withColumns({"span": F.lit(span).cast("long"), name: first.cast("long")}).repartition(name)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_new(spark: SparkSession, path: str) -> bool:
    """Whether an empty file could be made that was not there before."""
    fs, at = _place(spark, path)
    return bool(fs.createNewFile(at))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)


def write_versioned(table: DataFrame, path: str, params: dict | None = None) -> str:
    """Write ``table`` at ``path``; what was there is kept as ``path_old`` (an older one goes). ``params`` become a side table of (name, value).

    Values that are not strings or numbers are written as their repr.
    """
    spark = table.sparkSession
    fs, at = _place(spark, path.rstrip("/"))
    if fs.exists(at):
        delete(spark, f"{path.rstrip('/')}_old")
        fs.rename(at, _place(spark, f"{path.rstrip('/')}_old")[1])
    table.write.option("compression", "gzip").parquet(path)
    if params is not None:
        rows = [(k, v if isinstance(v, str) else repr(v)) for k, v in sorted(params.items())]
        spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}_params")
    return path


def merged_strictly(chunks: DataFrame, first: int, last: int, key: str = "cell_id") -> DataFrame:
    """All records of the chunks, each id from first to last; an id that is missing, comes twice or lies outside raises an error when read.

    Columns that a chunk lacks are null (union the chunks by name). One row of counts is met by every record.
    """
    seen = chunks.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    whole = (F.col("n") == last - first + 1) & (F.col("ids") == F.col("n")) & (F.col("lo") == first) & (F.col("hi") == last)
    marked = chunks.crossJoin(F.broadcast(seen.select(F.coalesce(whole, F.lit(False)).alias("_whole"))))
    return marked.where(F.when(F.col("_whole"), True).otherwise(F.raise_error(F.lit(f"the chunks do not hold each id from {first} to {last} once")))).drop("_whole")


def cover_counts(records: DataFrame) -> DataFrame:
    """(n, n_land, n_ocean) of merged records."""
    land = F.count_if(F.col("is_land") == 1)
    return records.agg(F.count("*").alias("n"), land.alias("n_land"), (F.count("*") - land).alias("n_ocean"))


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).limit(0).count()
    except AnalysisException:
        return False
    return True


def merged(chunks: DataFrame, first: int, last: int, key: str = "cell_id", order: str = "chunk_order") -> DataFrame:
    """Every id from first to last once: of several the last chunk's, of none an ocean placeholder at (0, 0)."""
    columns = [c for c in chunks.columns if c not in (key, order)]
    latest = chunks.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    ids = chunks.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    out = ids.join(latest, key, "left").withColumn("is_placeholder", F.col("r").isNull())
    zero = {"is_land": F.lit(0), "clat": F.lit(0.0), "clon": F.lit(0.0)}
    return out.select(key, "is_placeholder", *[F.coalesce(F.col(f"r.{c}"), zero[c]).alias(c) if c in zero else F.col(f"r.{c}").alias(c) for c in columns])


def gaps(chunks: DataFrame, start: str = "first_id", end: str = "last_id") -> DataFrame:
    """(after, before) of each hole between consecutive chunks, and before the first if that is not 0. One row a chunk file."""
    order = Window.partitionBy(F.lit(0)).orderBy(start)
    rows = chunks.withColumn("_prev", F.coalesce(F.lag(end).over(order), F.lit(-1)))
    return rows.where(F.col(start) != F.col("_prev") + 1).select(F.col("_prev").alias("after"), F.col(start).alias("before"))


def missing_and_extra(ids: DataFrame, first: int, last: int, key: str = "cell_id") -> DataFrame:
    """(key, what): expected ids that are missing and present ones that are not expected."""
    expected = ids.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    missing = expected.join(ids.select(key).distinct(), key, "left_anti").withColumn("what", F.lit("missing"))
    extra = ids.select(key).distinct().where(~F.col(key).between(first, last)).withColumn("what", F.lit("extra"))
    return missing.unionByName(extra)


# fixed values: names of a result table's variables and those that readers know them by
RESULT_NAMES = {"lat": "lat", "lon": "lon", "recon": "data", "ampls": "spec", "pmf_sg": "pmf"}


def read_results(table: DataFrame, key: str = "cell_id") -> DataFrame:
    """A result table's key and known variables under the readers' names; a variable that it lacks is left out."""
    return table.select(key, *[F.col(a).alias(b) for a, b in RESULT_NAMES.items() if a in table.columns])


def write_chunks(records: DataFrame, path: str, key: str = "cell_id", nulls: bool = False) -> str:
    """Write records in a folder for each chunk of ids (``CHUNK`` of them); return the path. Of large tables a folder holds ``span`` chunks
    (``folder_span``) and bears the first one's number. A record with a null id is an error, as no range finds it, unless ``nulls`` are let in."""
    own = F.expr(f"`{key}` div {CHUNK}")
    if not nulls:
        own = F.when(F.col(key).isNotNull(), own).otherwise(F.raise_error(F.lit("a record has no id")))
    _in_folders(records, folder_span(records, key), "chunk", own).write.partitionBy("span", "chunk").parquet(path)
    return path


def read_range(spark: SparkSession, path: str, start: int, end: int, key: str = "cell_id") -> DataFrame:
    """The records of chunked results with start <= id < end (one cell: end = start + 1); only their chunks' folders are listed as input. Ids are not negative."""
    table = spark.read.parquet(path)
    low, high = F.lit(max(0, start) // CHUNK), F.lit((max(end, 1) - 1) // CHUNK)
    return table.where((F.col("chunk") <= high) & (F.col("chunk") + F.col("span") > low) & (F.col(key) >= start) & (F.col(key) < end)).drop("span", "chunk")


def digest(points: DataFrame, keys: tuple[str, ...] = ("cell_id",), order: tuple[str, ...] = ("i", "j"), value: str = "z", places: int = 3) -> DataFrame:
    """(keys, digest): SHA-256 of each field's values as decimals of so many places, joined by commas in the field's order; null is empty."""
    text = F.coalesce(F.format_string(f"%.{places}f", F.round(F.col(value), places) + F.lit(0.0)), F.lit(""))
    text = F.when(F.col(value).isNull(), F.lit("")).otherwise(text)
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_v"))))["_v"]
    return points.groupBy(*keys).agg(F.sha2(F.array_join(rows, ","), 256).alias("digest"))


def write_sidecar(records: DataFrame, path: str, key: str = "cell_id") -> str:
    """Write the arrays that verify a result beside it, as ``path_verified``: each cell's key, centre, land flag and whether its record is complete; return the path."""
    out = f"{path.rstrip('/')}_verified"
    records.select(key, "clat", "clon", "is_land", complete().alias("complete")).write.mode("overwrite").parquet(out)
    return out
