"""Files, metadata JSON and logs as DataFrames."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURE = "timestamp STRING, file STRING, error_type STRING, error STRING"


def listing(spark: SparkSession, root: str, tags: tuple[str, ...] = (), pattern: str = "*.[pP][dD][fF]", content: bool = False) -> DataFrame:
    """path, root_path, tags, size, mtime (and content, digest) of the files below a root; files without a byte are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    out = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(root).alias("root_path"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *([F.col("content"), F.sha2("content", 256).alias("digest")] if content else []))
    return out


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # local files without checksums beside them: people edit the metadata file, and its checksum would no longer hold
    return fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs, place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _path(spark, path)
    return fs.exists(place)


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, mtime, content, digest of the named files only."""
    if not paths:
        return spark.createDataFrame([], "path string, size long, mtime timestamp, content binary, digest string")
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", F.sha2("content", 256).alias("digest"))


def markers(spark: SparkSession, root: str, name: str) -> DataFrame:
    """dir: the directories that hold a marker file. Hidden ones (beginning with . or _), which Spark doesn't list, are
    looked for in one listing on the driver, which keeps the hits only."""
    if name.startswith((".", "_")):
        fs, place = _path(spark, root)
        found, every = [], fs.listFiles(place, True)
        while every.hasNext():
            at = every.next().getPath()
            if at.getName() == name:
                found.append((at.getParent().toUri().getPath(),))
        return spark.createDataFrame(found, "dir string").distinct()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return rows.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/[^/]*$", "").alias("dir")).distinct()


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A listing of a single PDF; an error if it isn't one."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return listing(spark, path)


def marked_parents(spark: SparkSession, path: str, roots: list[str], name: str) -> list[str]:
    """The directories above a file, up to its root (or the top), that hold a marker."""
    above = [r.rstrip("/") for r in roots if path.startswith(r.rstrip("/") + "/")]
    found, at = [], path.rpartition("/")[0]
    while at:
        if exists(spark, f"{at}/{name}"):
            found.append(at)
        if at in above:
            break
        at = at.rpartition("/")[0]
    return found


def extract(files: DataFrame, reader: Callable[[bytes], tuple]) -> DataFrame:
    """path, text, page_count, pdf_title, pdf_author, error of each file's content.

    reader: content -> (text, pages) or (text, pages, {"title", "author"}). A file that fails has an error; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content in b.column(1).to_pylist():
                try:
                    text, pages, *more = reader(content)
                    info = more[0] if more else {}
                    out.append((text.strip(), pages, info.get("title"), info.get("author"), None))
                except Exception as e:  # noqa: BLE001  any failure belongs to its file
                    out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=["path", "text", "page_count", "pdf_title", "pdf_author", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, page_count int, pdf_title string, pdf_author string, error string")


def paged(pages: list[str]) -> str:
    """Pages as one text with a header each; blank ones are left out."""
    return "\n\n".join(f"[Page {k}]\n{p.strip()}" for k, p in enumerate(pages, 1) if p.strip())


def _ends(spark: SparkSession, path: str) -> tuple[str, str]:
    """The first two and the last four characters of a file, where they are plain."""
    fs, place = _path(spark, path)
    size = fs.getFileStatus(place).getLen()
    file = fs.open(place)
    try:
        head = [file.read() for _ in range(min(2, size))]
        file.seek(max(0, size - 4))
        return "".join(map(chr, head)), "".join(chr(file.read()) for _ in range(min(4, size)))
    finally:
        file.close()


def _by_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The members of a JSON object as ``save_metadata`` lays it out, a line each, read in parallel; None for any other file."""
    head, tail = _ends(spark, path)
    if head != "{\n" or tail[1:] != "\n}\n" or tail[0] == ",":
        return None
    line = F.rtrim("value")
    rows = spark.read.text(path).where(~F.col("value").isin("{", "}"))
    rows = rows.select(F.try_parse_json(F.concat(F.lit("{"), F.regexp_replace(line, ",$", ""), F.lit("}"))).alias("v"), F.when(~F.endswith(line, F.lit(",")), 1).alias("last"))
    found = rows.agg(F.count("last").alias("last"), F.count_if(F.col("v").isNull()).alias("bad")).first()
    braces = spark.read.text(path).where(F.col("value").isin("{", "}")).limit(3).count()
    if found.last != 1 or found.bad or braces != 2:
        return None
    rows.createOrReplaceTempView("lectern_metadata_lines")
    members = spark.sql("SELECT e.key AS meta_key, e.value AS value FROM lectern_metadata_lines, LATERAL variant_explode(v) AS e")
    return members if members.groupBy("meta_key").count().where("count > 1").isEmpty() else None


def metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """meta_key, value (variant): the members of a JSON object; an error for anything else.

    A file with a member on each line is read by lines; a file of another layout is one value, which Spark bounds in size.
    """
    found = _by_lines(spark, path)
    if found is not None:
        return found
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    if raw.where(F.schema_of_variant("v").startswith("OBJECT")).isEmpty():
        raise ValueError(f"{path} must hold a JSON object")
    raw.createOrReplaceTempView("lectern_metadata_json")
    return spark.sql("SELECT e.key AS meta_key, e.value AS value FROM lectern_metadata_json, LATERAL variant_explode(v) AS e")


def resolve_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files with value: by path, else by file name (unless the entry names another path), else by raw_path if there is that column."""
    name = F.substring_index("path", "/", -1)
    own = metadata.select("meta_key", "value", F.try_variant_get("value", "$.source_path", "string").alias("owner"))
    by_path = own.select(F.col("meta_key").alias("path"), F.col("value").alias("v1"))
    by_name = own.select(F.col("meta_key").alias("__name"), F.col("value").alias("v2"), F.col("owner").alias("__owner"))
    j = files.withColumn("__name", name).join(by_path, "path", "left").join(by_name, "__name", "left")
    fits = F.coalesce(F.col("__owner") == "", F.lit(True)) | (F.col("__owner") == F.col("path"))
    found = F.coalesce("v1", F.when(fits, F.col("v2")))
    if "raw_path" in files.columns:
        raw = metadata.select(F.col("meta_key").alias("raw_path"), F.col("value").alias("v3"))
        return j.join(raw, "raw_path", "left").withColumn("value", F.coalesce(found, "v3")).drop("v1", "v2", "v3", "__name", "__owner")
    return j.withColumn("value", found).drop("v1", "v2", "__name", "__owner")


def metadata_key(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files with meta_key, under which an entry is written: the path if it has one, else the name if its entry is this file's, else the path."""
    own = metadata.select("meta_key", F.try_variant_get("value", "$.source_path", "string").alias("__mk_owner"))
    j = files.withColumn("__mk_name", F.substring_index("path", "/", -1))
    j = j.join(own.select(F.col("meta_key").alias("path"), F.lit(True).alias("__mk_has")), "path", "left").join(own.select(F.col("meta_key").alias("__mk_name"), "__mk_owner", F.lit(True).alias("__mk_named")), "__mk_name", "left")
    fits = F.col("__mk_has").isNull() & F.coalesce("__mk_named", F.lit(False)) & (F.coalesce(F.col("__mk_owner") == "", F.lit(True)) | (F.col("__mk_owner") == F.col("path")))
    return j.withColumn("meta_key", F.when(fits, F.col("__mk_name")).otherwise(F.col("path"))).drop("__mk_name", "__mk_owner", "__mk_has", "__mk_named")


def save_metadata(rows: DataFrame, path: str) -> None:
    """rows (meta_key, entry as JSON), which must be written ones, as one JSON object in a file with a line each.

    One task sorts and writes it, as it is one file; no row goes to the driver.
    """
    spark, n = rows.sparkSession, rows.count()
    fs, place = _path(spark, path)
    part = place.suffix(".part")
    if n:
        name = F.to_json(F.array("meta_key"))
        at = F.monotonically_increasing_id()  # of a single partition: the row's place
        line = F.concat(F.when(at == 0, "{\n").otherwise(""), F.lit("  "), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(": "), "entry", F.when(at == n - 1, "\n}").otherwise(","))
        rows.repartition(1).sortWithinPartitions("meta_key").select(line.alias("value")).write.mode("overwrite").text(part.toString())
    else:
        spark.range(1).coalesce(1).select(F.lit("{\n}")).write.mode("overwrite").text(part.toString())
    made = next(s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-"))
    fs.delete(place, False)
    fs.rename(made, place)
    fs.delete(part, True)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """file of each readable line of a failure log, once; blank and broken lines are skipped."""
    return spark.read.schema(FAILURE).option("mode", "DROPMALFORMED").json(path).where("file is not null").select("file").distinct()


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> int:
    """A text file of lines, written as they come; their number."""
    fs, place = _path(spark, path)
    out, n = spark._jvm.java.io.OutputStreamWriter(fs.create(place, True), "UTF-8"), 0
    for n, line in enumerate(lines, 1):
        out.write(line + "\n")
    out.close()
    return n


def add_line(spark: SparkSession, folder: str, line: str) -> None:
    """A line more in a log: a file of its own in the log's folder, without a Spark job."""
    write_lines(spark, f"{folder.rstrip('/')}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", [line])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def without_failure(lines: DataFrame, file: str) -> DataFrame:
    """Lines of a failure log without those of one file; lines that can't be read stay."""
    return lines.where(F.coalesce(F.get_json_object("value", "$.file") != file, F.lit(True)))


def clear_failures(spark: SparkSession, path: str, done: DataFrame) -> None:
    """The log at path without the files of done (path); it is written anew and then takes the old one's place."""
    fs, place = _path(spark, path)
    if not fs.exists(place):
        return
    lines = spark.read.text(path).withColumn("path", F.get_json_object("value", "$.file"))
    kept = lines.join(done.select("path").distinct(), "path", "left_anti").select("value")
    new = place.suffix(".new")
    kept.write.mode("overwrite").text(new.toString())
    fs.delete(place, True)
    fs.rename(new, place)
