"""Reading corpora and writing pieces without overwriting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files as rows with a path and a length; the bytes are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def file_corpus(spark: SparkSession, folder: str, pattern: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Files of a folder whose names fit ``pattern`` with the rows that each holds: name, file, length, rows.

    Only listed names and lengths come from the files themselves (pruned by the pattern
    before anything is opened); rows are counted by the hidden file column of the tables
    and joined by path. A file that no table reads has no rows.
    """
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = scan_files(spark, folder, pattern).select(plain("path").alias("path"), "length")
    counts = None
    for name, rows in tables.items():
        held = rows.select(plain("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name))
        counts = held if counts is None else counts.unionByName(held)
    return listed.join(counts, "path", "left").select("name", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.coalesce("rows", F.lit(0)).alias("rows"))


INFO = ("title", "author", "subject", "keywords", "creator", "producer")


def corpus_info(docs: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per document: page count, bytes, cropping, version, encryption and six descriptive fields.

    ``facts``: doc_id, version, encrypted and the descriptive fields, blank ones being absent.
    """
    sizes = pages.groupBy("doc_id").agg(
        F.sum((F.col("size_mb") * 1_000_000).cast("long")).alias("size_bytes"), F.max(F.col("crop_inset").isNotNull()).alias("cropped")
    )
    return docs.join(sizes, "doc_id", "left").join(facts, "doc_id", "left").select(
        "doc_id",
        "source",
        "page_count",
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("cropped", F.lit(False)).alias("cropped"),
        "version",
        F.coalesce("encrypted", F.lit(False)).alias("encrypted"),
        *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in INFO],
    )


def taken_names(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that are already there, or that two pieces share; nothing is written while any is left."""
    clash = manifest.join(existing.select("name").distinct(), "name", "left_semi").select("name")
    twice = manifest.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    return clash.union(twice).distinct()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _records(spark: SparkSession, path: str) -> list[str]:
    where, files = _files(spark, f"{path}/commits")
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the stages that make up a folder of pieces, oldest first.

    A commit is one numbered record that holds the name of its stage, with ``only`` where
    that replaces all before it. It is moved to its place complete, so readers never see
    part of a write.
    """
    out: list[str] = []
    for name in _records(spark, path):
        where, files = _files(spark, f"{path}/commits/{name}")
        stream = files.open(where)
        stage, *only = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        stream.close()
        out = [stage] if only else [*out, stage]
    return out


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """All published rows of a folder of pieces; what was staged but not published is not read."""
    parts = [f"{path}/stages/{name}/rows" for name in commits(spark, path)]
    if not parts:
        raise FileNotFoundError(f"nothing published in {path}")
    rows = spark.read.parquet(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(spark.read.parquet(part))
    return rows


def published_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of all pieces that a folder holds."""
    parts = [f"{path}/stages/{name}/names" for name in commits(spark, path)]
    if not parts:
        return spark.createDataFrame([], "name string")
    return spark.read.schema("name string").parquet(*parts)


def _publish(spark: SparkSession, path: str, stage: str, number: int, only: bool) -> bool:
    """Move a record to its place; false if another writer has taken the number."""
    draft, files = _files(spark, f"{path}/stages/{stage}/record")
    out = files.create(draft, True)
    out.write(bytearray(f"{stage} only" if only else stage, "ascii"))
    out.close()
    record, _ = _files(spark, f"{path}/commits/{number:012d}")
    files.mkdirs(record.getParent())
    return not files.exists(record) and files.rename(draft, record)


def save_pieces(pieces: DataFrame, path: str, *, by: list[str], cluster: list[str], names: DataFrame, force: bool = False) -> None:
    """Publish ``pieces`` in a folder all at once, or nothing of them.

    Rows and names are staged where no reader looks. Then all ``names`` are checked,
    against each other and (unless ``force``, which replaces what is there) against those
    published, and one record makes the stage part of the folder. A failed task, a taken
    name or a lost driver leaves at most an unread stage. Where another writer published
    meanwhile, names are checked again before the next try. The record is moved by a
    rename that fails if the number is taken, as file systems with real renames have it.
    Rows are laid out by hash of ``cluster``, finer than the folders, so one large piece
    is written by many tasks.
    """
    spark = pieces.sparkSession
    stage = uuid.uuid4().hex
    at = f"{path}/stages/{stage}"
    names.select(F.col("name").cast("string").alias("name")).write.parquet(f"{at}/names")
    manifest = spark.read.schema("name string").parquet(f"{at}/names")
    staged = False
    while True:
        records = _records(spark, path)
        there = manifest.limit(0) if force else published_names(spark, path)
        taken = taken_names(manifest, there).limit(1).collect()
        if taken:
            where, files = _files(spark, at)
            files.delete(where, True)
            raise FileExistsError(f"NameTaken: {taken[0]['name']}")
        if not staged:
            pieces.repartition(*[F.col(c) for c in (*by, *cluster)]).write.partitionBy(*by).parquet(f"{at}/rows")
            staged = True
            if _records(spark, path) != records:
                continue
        if _publish(spark, path, stage, len(records), force):
            return


def write_pieces(
    pieces: DataFrame, path: str, *, by: list[str], cluster: list[str], force: bool = False, manifest: DataFrame | None = None, existing: DataFrame | None = None
) -> None:
    """Write rows partitioned by ``by``; an existing path is refused unless forced.

    With a ``manifest`` of all names, they are checked against each other and against
    ``existing`` ones before the first row is written.

    Rows are laid out by hash of ``cluster``, finer than the folders, so one large piece
    is written by many tasks.
    """
    if manifest is not None:
        there = existing if existing is not None else manifest.select("name").limit(0)
        taken = taken_names(manifest, there.limit(0) if force else there).limit(1).collect()
        if taken:
            raise FileExistsError(f"NameTaken: {taken[0]['name']}")
    (
        pieces.repartition(*[F.col(c) for c in (*by, *cluster)])
        .write.mode("overwrite" if force else "errorifexists")
        .partitionBy(*by)
        .parquet(path)
    )
