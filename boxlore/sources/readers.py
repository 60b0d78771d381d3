"""Readers of the engine's inputs as DataFrames. Files are read by Spark, so any store that it reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..sinks.commit import DIGITS, last_entry
from .jsonparts import JsonObject


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, raw) of the members of a JSON object, numbered in file order, each member as its raw text.

    A file that is not an object raises, and so does a repeated key at any depth. The file may be of any size: it is read by
    ranges, see ``jsonparts``; a folder's files, in the order of their names, are one object. Only a member is held whole.
    """
    return JsonObject(spark, path).members()


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a journal, which is one line file or a folder of numbered appends; ``pos`` orders the lines.

    Files are split by bytes, so a journal of any size is read by many tasks: a line's place is the number of its append, the
    part of it, the byte at which its split begins, and its turn within that. A folder of several files without numbers has
    no order, and raises; what is staged there is not read. Lines that are no UTF-8 go.
    """
    read = spark.read.option("lineSep", "\n")
    place = _metadata_place(F.lit(0).cast("long"), F.lit(0))
    if is_folder(spark, path):
        if last_entry(spark, path):
            name = F.col("_metadata.file_path")
            number = F.regexp_extract(name, rf"/(\d{{{DIGITS}}})/[^/]*\z", 1).cast("long")
            place = _metadata_place(number, F.regexp_extract(name, r"part-(\d+)[^/]*\z", 1).cast("int"))
            path = f"{path.rstrip('/')}/{'[0-9]' * DIGITS}"
        elif len(plain_files(spark, path)) > 1:
            raise ValueError(f"{path}: several files without numbers have no order; append them one after the other")
    elif not glob_files(spark, path):
        return spark.createDataFrame([], "pos struct<entry: bigint, part: int, block: bigint, turn: bigint>, line string")
    x = read.text(path).select(place.alias("pos"), F.col("value").alias("line"))
    return x.where(F.is_valid_utf8("line"))


def _metadata_place(entry: Column, part: Column) -> Column:
    return F.struct(entry.alias("entry"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))


def glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or a pattern names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [] if s.isFile()]


def plain_files(spark: SparkSession, folder: str) -> list[str]:
    """A folder's own files but for hidden and marker ones."""
    return [f for f in glob_files(spark, f"{folder.rstrip('/')}/*") if not f.rsplit("/", 1)[1].startswith((".", "_"))]


def groundtruth(spark: SparkSession, glob: str) -> DataFrame:
    """(sequence, filename, x, y, w, h) of ``<sequence>/groundtruth.txt`` files: comma lines of a name and four numbers.

    Blank and ``#`` lines and those of another number of fields are skipped; numbers are cut to integers; the last line of
    a name wins; text where a number should be raises. Files are split by bytes, so one of any size is read by many tasks; of
    several files of a sequence the later name comes later.
    """
    x = spark.read.option("lineSep", "\n").text(glob)
    n = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    commas = F.length("value") - F.length(F.replace("value", F.lit(",")))
    x = x.where((commas == 4) & ~F.startswith(F.ltrim("value"), F.lit("#"))).select(folder.alias("sequence"), n.alias("n"), F.rtrim("value", F.lit("\r")).alias("line"))
    field = lambda k: F.trim(F.substring_index(F.substring_index("line", ",", k + 1), ",", -1))
    number = lambda k: field(k).cast("double").cast("int")
    last = F.max(F.struct("n", number(1).alias("x"), number(2).alias("y"), number(3).alias("w"), number(4).alias("h"))).alias("r")
    return x.groupBy("sequence", field(0).alias("filename")).agg(last).select("sequence", "filename", "r.x", "r.y", "r.w", "r.h")


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """(sequence): folders of digits below a root that hold files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.regexp_extract("path", r"/(\d+)/[^/]+(?:/[^/]+)?\z", 1).alias("sequence")).where("sequence <> ''").distinct()


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def png_size(content: Column) -> Column:
    """(width, height) from a PNG's header; null if its signature or header tag is wrong."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    good = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(good, F.struct(number(17).alias("width"), number(21).alias("height")))


def images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """(path, sha, width, height): content hash and header size of each picture."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return x.select("path", F.sha2("content", 256).alias("sha"), png_size(F.col("content")).alias("s")).select("path", "sha", "s.width", "s.height")


def complete_samples(frames: DataFrame, files: DataFrame, columns: tuple[str, ...] = ("visible", "infrared", "depth")) -> DataFrame:
    """Frames all of whose files are listed."""
    out = frames
    for c in columns:
        out = out.join(files.select(F.col("path").alias(c)), c, "left_semi")
    return out


def hash_table(spark: SparkSession, path: str) -> DataFrame:
    """(sha, stem) of test pictures from JSON in any of four layouts: hash to stems, stem to hash, hash to anything, or a list."""
    first = spark.read.option("lineSep", ",").text(path).select(F.regexp_extract("value", r"\A\s*(.)", 1)).first()
    if first and first[0] == "[":
        return _rows(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("sha")).select("sha", F.lit(None).cast("string").alias("stem"))
    members = json_object(spark, path)
    head = members.where("pos = 0").first()
    sha = F.lit(64)
    if head is None:
        return spark.createDataFrame([], "sha string, stem string")
    if head.raw.lstrip().startswith("["):
        return members.select(F.col("key").alias("sha"), F.explode_outer(F.from_json("raw", "array<string>")).alias("stem"))
    if len(head.raw) == 64:
        return members.select(F.col("raw").alias("sha"), F.col("key").alias("stem"))
    return members.where(F.length("key") == sha).select(F.col("key").alias("sha"), F.col("raw").alias("stem"))


def scanned_hashes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(sha, stem) of the pictures in the first of the folders that has any."""
    for folder in folders:
        try:
            x = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(folder)
        except Exception as e:  # a folder that is not there is skipped, anything else is an error
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if not x.select("path").limit(1).isEmpty():
            return x.select(F.sha2("content", 256).alias("sha"), F.regexp_extract("path", r"([^/]+)\.[^.]*\z", 1).alias("stem"))
    return spark.createDataFrame([], "sha string, stem string")


ITEM = "visible string, infrared string, depth string, query string, bbox array<double>, width int, height int"


def inference_items(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(pos, key, visible, infrared, depth, query, bbox, width, height) of an artifact, an index or an official template.

    An artifact keeps its rows below ``data``. A template is known by its first row's path, and its three paths get the
    test set's folder put before them. Rows that are no objects raise. A table (of ids or keys and fields, as ``split``
    writes its index) is numbered by key.
    """
    if is_table(spark, path):
        held = spark.read.parquet(path)
        key = "key" if "key" in held.columns else "id"
        fields = [F.col(f[0]).cast(f[1]).alias(f[0]) if f[0] in held.columns else F.lit(None).cast(f[1]).alias(f[0]) for f in (x.split(" ", 1) for x in ITEM.split(", "))]
        rows = numbered(held.select(F.col(key).cast("string").alias("key"), *fields), F.col("key"), "pos").withColumn("pos", F.col("pos") - 1)
        rows = rows.select("pos", "key", *(x.split(" ", 1)[0] for x in ITEM.split(", ")))
        return rows.orderBy("pos").limit(limit) if limit else rows
    whole = JsonObject(spark, path)
    x = whole.within("data") if whole.last < 64 and set(whole.keys()) >= {"metadata", "data"} else whole.members()
    item = F.when(F.startswith(F.trim("raw"), F.lit("{")), F.from_json("raw", ITEM)).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.col("key"))).cast(f"struct<{', '.join(p.replace(' ', ': ', 1) for p in ITEM.split(', '))}>"))
    rows = x.select("pos", "key", item.alias("i")).select("pos", "key", "i.*")
    head = rows.where("pos = 0").select("visible").first()
    if head and (head.visible or "").startswith("Images/"):
        rows = rows.withColumns({c: F.concat(F.lit("Test/"), F.col(c)) for c in ("visible", "infrared", "depth")})
    return rows.orderBy("pos").limit(limit) if limit else rows


def approved(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(metadata, data) of an artifact, a file or a folder of files that are one object; data: pos, id, raw and its fields."""
    whole = JsonObject(spark, path)
    metadata = whole.value("metadata")
    rows = whole.within("data").select("pos", F.col("key").alias("id"), "raw", F.from_json("raw", ITEM).alias("i"))
    return metadata, rows.select("pos", "id", "raw", "i.*")


GENERATION = "sample_id string, sequence_id string, object_index int, bbox array<double>, query string, collision boolean"


def generation(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sample_id, sequence_id, object_index, bbox, query, collision) of a generation file; no records raises."""
    x = JsonObject(spark, path).within("records", "list").select("pos", F.from_json("raw", GENERATION).alias("r")).select("pos", "r.*")
    if x.limit(1).isEmpty():
        raise ValueError("the generation has no records")
    return x


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and files.getFileStatus(at).isDirectory()


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder of Parquet files, or of numbered entries of such; another folder's files are one JSON object."""
    here = path.rstrip("/")
    return is_folder(spark, path) and bool(last_entry(spark, path) or glob_files(spark, f"{here}/*.parquet"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(key, bbox) of predictions as one JSON object or as a table; a null box stays apart from a missing key."""
    if is_table(spark, path):
        return spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.col("key").cast("string").alias("key"), F.col("bbox").cast("array<double>").alias("bbox"))
    return json_object(spark, path).select("key", F.from_json("raw", "array<double>").alias("bbox"))


def saved_progress(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Predictions (key, bbox) of each saved source of a run: the tables that steps of this engine have saved, then its checkpoint
    file, then its shards' in order of their names."""
    tables = [p for p in (f"{folder}/predictions", *shard_folders(spark, folder)) if is_table(spark, p)]
    names = [r.path for r in listing(spark, folder, "*checkpoint.json").select("path").collect()]  # a few files
    out = []
    for name in sorted(names, key=lambda p: (not p.endswith("/checkpoint.json"), p)):
        out.append(JsonObject(spark, name).within("predictions").select("key", F.from_json("raw", "array<double>").alias("bbox")))
    return [predictions(spark, p) for p in tables] + out


def shard_folders(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a run's shards, by their numbers."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard=*/predictions")
    found = [s.getPath() for s in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []]
    return [str(p) for p in sorted(found, key=lambda p: int(p.getParent().getName()[6:]))]


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, channels, data) of decoded pictures, by Spark's own reader."""
    return spark.read.format("image").option("dropInvalid", "true").load(root).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").toDF("path", "width", "height", "channels", "data")
