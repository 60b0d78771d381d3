"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_bytes: int, seed: int = 7) -> list[tuple[str, int]]:
    """(text, label 0 or 1): at most ``per_class`` labelled documents of each class, and about ``most_bytes`` of text.

    Only rows for which ``learn`` (over the labels' columns) holds are taken, those of smallest seeded hash first; null
    ids and labels are skipped, null texts are empty. The chosen ids, at most 2 * per_class, are broadcast to the scan of
    the documents. Each class has half of the bytes, and what the other leaves. A text that does not fit is passed over
    alone, and texts over 1/128 of the bytes come after all others, the shortest first; a class's first text is taken at
    any length. Rows come in the same order on every run.
    """
    # the position of a label row in the seeded order; the table's other columns are never read
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    usable = labels.where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"), order.alias("place"))
    chosen = usable.where("label = 0").orderBy("place", "id").limit(per_class).unionAll(usable.where("label = 1").orderBy("place", "id").limit(per_class))
    ids = chosen.dropDuplicates(["id", "label"])
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    size = F.octet_length("text").cast("long")
    late = F.when(size > most_bytes // 128, size).otherwise(0)
    found = found.select("place", "id", "label", "text", size.alias("size"), late.alias("late")).orderBy("late", "place", "id", "label", "text")
    taken, aside, held, waiting = [], [], [0, 0], 0
    seen, full = set(), set()
    for r in found.toLocalIterator():
        if r.label not in seen or held[r.label] + r.size <= most_bytes // 2:
            seen.add(r.label)
            held[r.label] += r.size
            taken.append(r)
        elif waiting + r.size <= most_bytes:  # the other class may leave room
            waiting += r.size
            aside.append(r)
        elif r.late:  # all that follow are as long or longer
            full.add(r.label)
            if len(full) == 2:
                break
    for r in aside:
        if sum(held) + r.size <= most_bytes:
            held[r.label] += r.size
            taken.append(r)
    return [(r.text, r.label) for r in sorted(taken, key=lambda r: (r.place, r.id, r.label, r.text))]
