"""An annotation session: items of a dataset joined with their live state, and progress by item and by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, is_canonical_path, is_human, is_pending, seed_alias, stem
from .ordering import numbered


def items(dataset: DataFrame, split: str, seeded: bool = False) -> DataFrame:
    """id, image, query, ordinal, frame_id, gt_bbox, category, corpus, status, annotator of each row of a dataset.

    dataset: id, visible, query, bbox, category, annotator. The ordinal is the number after ``#`` (1 if that is no number),
    else a running count within the frame in order of ids.
    """
    has_box, has_query = F.coalesce(F.size("bbox") == 4, F.lit(False)), F.coalesce(F.col("query") != "", F.lit(False))
    image = F.coalesce(F.col("visible"), F.lit(""))
    frame = F.when(image != "", F.concat(F.split_part("id", F.lit("_"), F.lit(1)), F.lit("_"), stem(image))).otherwise(F.col("id"))
    status = F.when(has_box & has_query, "annotated").otherwise("pending")
    x = dataset.select("*", frame.alias("frame_id"), status.alias("status"), F.contains("id", F.lit("#")).alias("numbered"))
    part = F.regexp_extract("id", r"#(.*)\z", 1)
    count = F.row_number().over(Window.partitionBy("frame_id", "numbered").orderBy("id"))
    ordinal = F.when(F.col("numbered"), F.when(part.rlike(r"\A\d+\z"), part.try_cast("int")).otherwise(1)).otherwise(count)
    annotator = F.coalesce(F.nullif("annotator", F.lit("")), F.when(F.col("status") == "annotated", "seed" if seeded else "human"))
    return x.select(
        "id", image.alias("image"), F.coalesce("query", F.lit("")).alias("query"), ordinal.alias("ordinal"), "frame_id", F.when(has_box, F.col("bbox")).alias("gt_bbox"),
        F.coalesce("category", F.lit("")).alias("category"), F.lit(split).alias("corpus"), "status", annotator.alias("annotator"),
    )


def live(session: DataFrame, state: DataFrame) -> DataFrame:
    """Each item with its present box, query and annotator: the state's, else the item's own unless it was marked absent."""
    s = state.select("id", F.col("bbox").alias("s_bbox"), F.col("query").alias("s_query"), F.col("annotator").alias("s_annotator"))
    x = session.join(s, "id", "left")
    gone = F.coalesce(F.col("s_annotator").endswith(":absent"), F.lit(False))
    box = F.coalesce("s_bbox", F.when(~gone, F.col("gt_bbox")))
    own = F.coalesce("annotator", F.when((F.col("status") == "annotated") & box.isNotNull(), "human"))
    annotator = F.when(F.col("s_annotator").isNull(), own).otherwise(seed_alias(F.col("s_annotator")))
    return x.select(
        "id", "image", F.coalesce("s_query", "query").alias("query"), F.col("s_query").isNotNull().alias("query_edited"), box.alias("bbox"), annotator.alias("annotator"),
        "ordinal", "frame_id", "gt_bbox", "category", "corpus", "status",
    )


def progress(entries: DataFrame) -> DataFrame:
    """One row: total_items, annotated, human_annotated, total_frames, reviewed_frames (each entry boxed, by a person)."""
    human = is_human(F.col("annotator"))
    boxed = F.col("bbox").isNotNull()
    frames = entries.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(boxed).alias("boxed"), F.count_if(human).alias("human"), F.bool_and(boxed & human).alias("done"))
    return frames.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), F.coalesce(F.sum("boxed"), F.lit(0)).alias("annotated"), F.coalesce(F.sum("human"), F.lit(0)).alias("human_annotated"),
        F.count("*").alias("total_frames"), F.count_if("done").alias("reviewed_frames"),
    )


def review_progress(entries: DataFrame) -> DataFrame:
    """One row as the reviewer sees it: human, absent, pending, total, percent, done_frames, frames; here absent counts as done."""
    a = F.coalesce("annotator", F.lit(""))
    absent, pending = a.endswith(":absent"), is_pending(F.col("annotator"))
    human = ~pending & F.col("bbox").isNotNull() & (a != "") & ~a.isin("seed", "seed:absent") & ~absent
    frames = entries.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(human).alias("human"), F.count_if(absent).alias("absent"), F.count_if(pending).alias("pending"), F.bool_and(human | absent).alias("done"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = frames.agg(whole("human").alias("human"), whole("absent").alias("absent"), whole("pending").alias("pending"), whole("n").alias("total"), F.count_if("done").alias("done_frames"), F.count("*").alias("frames"))
    percent = F.when(F.col("total") > 0, ((F.col("human") + F.col("absent")) * 100 / F.col("total")).cast("decimal(20,10)").cast("decimal(5,1)")).otherwise(F.lit(0).cast("decimal(5,1)"))
    return out.withColumn("percent", percent.cast("double"))


def positions(entries: DataFrame) -> DataFrame:
    """The entries with ``number``, their place in order of ids, counted by ranges of ids rather than in one task."""
    return numbered(entries, F.col("id"), "number")


def next_pending(entries: DataFrame, current: int, backwards: bool = False, pos: str = "pos") -> DataFrame:
    """One row, pos: the next pending item after ``current`` (before, if ``backwards``), starting over at the end."""
    waiting = F.when(is_pending(F.col("annotator")), F.col(pos))
    if backwards:
        return entries.agg(F.coalesce(F.max(F.when(F.col(pos) < current, waiting)), F.max(waiting)).alias("pos"))
    return entries.agg(F.coalesce(F.min(F.when(F.col(pos) > current, waiting)), F.min(waiting)).alias("pos"))


def find(entries: DataFrame, text: str, pos: str = "pos") -> DataFrame:
    """One row, pos (from 0): the first item whose id starts with the text, else whose file name or path holds it, else, for
    plain digits or a number after ``#``, the item of that number."""
    q = text.strip().lower()
    digits = q[1:] if q.startswith("#") else q
    number = F.lit(int(digits) - 1 if digits.isdigit() and int(digits) > 0 else None).cast("long")
    by_number = F.min(F.when(F.col(pos) == number, F.col(pos)))
    if not q or q.startswith("#"):
        return entries.agg(by_number.alias("pos"))
    by_id = F.min(F.when(F.startswith(F.lower("id"), F.lit(q)), F.col(pos)))
    name = F.lower(stem(file_name(F.col("image"))))
    by_path = F.min(F.when(F.contains(name, F.lit(q)) | F.contains(F.lower("image"), F.lit(q)), F.col(pos)))
    return entries.agg(F.coalesce(by_id, by_path, by_number).alias("pos"))


def store_of(corpus: DataFrame, stores: list[str], default: str) -> DataFrame:
    """The rows with ``store``: their corpus if it has a store, else the default."""
    return corpus.withColumn("store", F.when(F.col("corpus").isin(stores), F.col("corpus")).otherwise(F.lit(default)))


def pictures(entries: DataFrame, asked: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """(image, path): where each picture that was asked for lies: only pictures of the session, below the first root that has
    the file; null where none has or the session does not name it. files: path; asked: image."""
    named = entries.select("image").distinct().withColumn("named", F.lit(True))
    x = asked.select("image").distinct().join(named, "image", "left")
    places = F.posexplode(F.transform(F.array(*map(F.lit, roots)), lambda r: F.concat(r, F.lit("/"), F.col("image"))))
    x = x.select("image", "named", places.alias("turn", "path")).join(files.select("path", F.lit(True).alias("there")), "path", "left")
    found = F.min(F.when(F.col("named") & F.col("there") & is_canonical_path(F.col("image")), F.struct("turn", "path")))
    return x.groupBy("image").agg(found["path"].alias("path"))
