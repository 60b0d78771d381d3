"""Training arithmetic as columns: steps, learning rate, accumulation windows, times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps_per_epoch(batches: Column, accumulate: int) -> Column:
    return F.ceil(batches / accumulate).cast("long")


def expected_steps(samples: Column, batch: int, accumulate: int, epochs: int) -> Column:
    return (steps_per_epoch(F.ceil(samples / batch), accumulate) * epochs).cast("long")


def warmup_steps(total: Column, ratio: float) -> Column:
    return F.floor(total * F.lit(ratio)).cast("long")


def rate_factor(step: Column, total: Column, warmup: Column, kind: str = "cosine") -> Column:
    """The learning rate's factor: a linear warm-up, then from 1 down to a tenth."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.greatest(F.lit(1), total - warmup))
    decay = {"cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * progress)), "linear": 1 - progress, "constant": F.lit(1.0)}[kind]
    return F.when(step < warmup, step / F.greatest(F.lit(1), warmup)).otherwise(0.1 + 0.9 * decay)


def window_size(index: Column, batches: Column, accumulate: int) -> Column:
    """Batches that batch ``index`` is accumulated with; the last window may be short."""
    return F.least(F.lit(accumulate).cast("long"), batches - F.floor(index / accumulate) * accumulate).cast("long")


def is_step(index: Column, batches: Column, accumulate: int) -> Column:
    return ((index + 1) % accumulate == 0) | (index + 1 == batches)


def time_left(seconds: Column) -> Column:
    """As 1h02m, 3m04s or 5s; a dash if negative."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(seconds < 0, "-").when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


def pixel_budget(pixels: Column, unit: int = 2) -> Column:
    """A processor's budget counts time as well, so a frame's pixels count twice."""
    return pixels * unit


def supervised_window(labels: Column, ignored: int = -100) -> Column:
    """(keep, labels): how many last positions a loss needs, and the labels they predict, from the first supervised one on."""
    first = F.array_position(F.transform(labels, lambda v: v != ignored), True).cast("int")
    keep = F.when(first > 0, F.least(F.size(labels), F.size(labels) - first + 2)).otherwise(0)
    ahead = F.concat(F.slice(labels, F.greatest(first, F.lit(2)), F.size(labels)), F.array(F.lit(ignored).cast("long")))
    return F.struct(keep.alias("keep"), F.when(first > 0, ahead).otherwise(F.slice(labels, 1, 0)).alias("labels"))


def prompt_length(prompt: Column, whole: Column) -> Column:
    """The prompt's length if its ids are a proper prefix of the whole's, else null."""
    return F.when((F.size(prompt) < F.size(whole)) & (F.slice(whole, 1, F.size(prompt)) == prompt), F.size(prompt))


def padded(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(0), length - F.size(values))))


def collated(batch: Column, pad: int, ignored: int = -100) -> Column:
    """A batch, an array of structs (input_ids, labels, attention_mask), with every array padded on its right to the longest:
    ids by ``pad``, labels by ``ignored``, the mask by 0."""
    longest = F.array_max(F.transform(batch, lambda r: F.size(r["input_ids"])))
    fill = (("input_ids", pad), ("labels", ignored), ("attention_mask", 0))
    return F.transform(batch, lambda r: F.struct(*(padded(r[c], longest, v).alias(c) for c, v in fill)))
