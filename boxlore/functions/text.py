"""Query text: cleaning, quality rules, mirror-safe augmentation, ids and paths. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let

# ---- fixed values: word lists and patterns that results depend on --------------------------------------------------

FORBIDDEN_PHRASES = ("red rectangle", "red outline", "bounding box", "image 1", "image 2", "first image", "second image")
SCAFFOLD_PHRASES = (
    "highlighted", "marked target", "marked object", "outlined target", "red rectangle", "red outline", "annotated image",
    "annotation view", "this frame", "current frame", "in the frame", "within the frame", "this image", "current image",
    "in the image", "within the image", "crop", "same target", "visible image", "thermal image", "infrared image",
    "depth image", "depth map",
)
ANNOTATION_TERMS = ("target", "crop", "annotation", "annotated", "bbox", "coordinate", "infrared", "thermal", "depth", "rgb")
GENERIC_CATEGORIES = ("thing", "item", "entity")
GLYPH_WORDS = ("letter", "letters", "word", "words", "text", "writing", "glyph", "symbol")
BODY_PARTS = (
    "hand", "hands", "arm", "arms", "foot", "feet", "leg", "legs", "eye", "eyes", "ear", "ears", "knee", "knees", "shoulder",
    "shoulders", "wing", "wings", "paw", "paws", "hoof", "hooves", "thumb", "palm", "elbow", "ankle", "cheek", "hip", "thigh",
    "shin", "horn", "antler", "tooth", "tusk", "fist", "wrist",
)
LATERAL_WORDS = ("left-most", "right-most", "leftmost", "rightmost", "left", "right")
WORD_PATTERN = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
COORDINATE_PATTERN = r"[\[(]\s*[+-]?\d+(?:\.\d+)?\s*,\s*[+-]?\d+(?:\.\d+)?"
CONTROL_PATTERN = r"<\|[^<>\r\n]*\|>"
DASHES = "‐‑-"

# --------------------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f]"  # with (?U): what Python strips


def _strip(t: Column, characters: str) -> Column:
    # a run is tried at the text's end from its first character only, which keeps the time in proportion to the text
    return F.regexp_replace(t, rf"(?U)\A{characters}+|(?<!{characters}){characters}+\z", "")


def clean_query(t: Column) -> Column:
    """Without surrounding space, backticks, quotes and closing punctuation; null becomes empty."""
    out = F.coalesce(t, F.lit(""))
    for characters in (_SPACE, "`", _SPACE, '"', "'", _SPACE):
        out = _strip(out, characters)
    return _strip(F.regexp_replace(out, r"(?<![.?!;])[.?!;]+\z", ""), _SPACE)


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(WORD_PATTERN))


def query_fault(t: Column, least: int = 1, most: int = 55) -> Column:
    """Why a generated query is refused, by the first rule that it breaks; null if it is good."""
    return let(clean_query(t), lambda q: _fault_of_clean(q, least, most))


def _fault_of_clean(q: Column, least: int, most: int) -> Column:
    words = word_count(q)
    scaffold = F.lit(False)
    for phrase in FORBIDDEN_PHRASES:
        scaffold = scaffold | F.contains(F.lower(q), F.lit(phrase))
    ascii_only = F.length(F.regexp_replace(q, r"[^\x00-\x7F]", ""))
    return (
        F.when(q == "", "empty response")
        .when(q.rlike(r"[\n\r]"), "query must be one line")
        .when(scaffold, "query mentions annotation scaffolding")
        .when(q.rlike(COORDINATE_PATTERN), "query contains coordinate-like output")
        .when(q.rlike(CONTROL_PATTERN), "query contains a model control token")
        .when(q.rlike(r"\A(?:#|- |\* )"), "query contains markdown formatting")
        .when((words < least) | (words > most), F.concat(F.lit(f"expected {least}-{most} English words, got "), words.cast("string")))
        .when(ascii_only / F.length(q) < 0.9, "query is not predominantly English/ASCII")
    )


def annotation_fault(t: Column) -> Column:
    """``query_fault``, then the annotation product's own rules: no scaffold phrase, annotation term or generic category."""
    return let(clean_query(t), lambda q: F.coalesce(_fault_of_clean(q, 1, 55), _annotation_fault_of_clean(q)))


def _annotation_fault_of_clean(q: Column) -> Column:
    phrase = F.get(F.filter(F.array(*map(F.lit, SCAFFOLD_PHRASES)), lambda p: F.regexp_like(F.lower(q), F.concat(F.lit("(?<![a-z])"), p, F.lit("(?![a-z])")))), 0)
    term = F.regexp_extract(q, rf"(?iU)\b(?:{'|'.join(ANNOTATION_TERMS)})\b", 0)
    generic = F.regexp_extract(q, rf"(?iU)\b(?:{'|'.join(GENERIC_CATEGORIES)})\b", 0)
    quoted = lambda start, x: F.concat(F.lit(start + " '"), x, F.lit("'"))
    return (
        F.when(phrase.isNotNull(), quoted("query mentions annotation scaffolding", phrase))
        .when(term != "", quoted("query mentions annotation term", term))
        .when(generic != "", quoted("query uses generic category", generic))
    )


def is_mirror_safe(t: Column) -> Column:
    """Whether left and right in the text order things in the picture: no glyphs, no one's own body sides."""
    glyph = rf"(?i)(?<![A-Za-z])(?:{'|'.join(GLYPH_WORDS)})(?![A-Za-z])"
    body = rf"(?iU)(?<![A-Za-z])(?:left|right)[\s{DASHES}]+(?:{'|'.join(BODY_PARTS)})(?![A-Za-z])"
    return F.coalesce((t != "") & ~t.rlike(glyph) & ~t.rlike(body), F.lit(False))


def _swapped(word: Column) -> Column:
    low = F.lower(word)
    other = F.when(low.startswith("left"), F.concat(F.lit("right"), F.substring(low, 5, 99))).otherwise(F.concat(F.lit("left"), F.substring(low, 6, 99)))
    first = F.substring(word, 1, 1)
    return F.when(word == F.upper(word), F.upper(other)).when(first == F.upper(first), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 99))).otherwise(other)


def mirror_query(t: Column) -> Column:
    """(query, changed): left and right swapped at once, case kept; unchanged where that is not safe."""
    pattern = rf"(?iU)\b({'|'.join(LATERAL_WORDS)})\b"
    words = F.regexp_extract_all(t, F.lit(pattern), 0)
    woven = F.array_join(F.zip_with(F.split(t, pattern, -1), words, lambda p, w: F.concat(p, F.coalesce(_swapped(w), F.lit("")))), "")
    changed = is_mirror_safe(t) & (F.size(words) > 0)
    return F.struct(F.when(changed, woven).otherwise(t).alias("query"), F.coalesce(changed, F.lit(False)).alias("changed"))


@F.udf(StringType(), useArrow=True)
def _casefold(t):
    return None if t is None else t.casefold()


def collision_key(t: Column, exact: bool = False) -> Column:
    """White space collapsed, case folded; ``exact`` folds beyond lower case (as for a sharp s), by Python."""
    flat = _strip(F.regexp_replace(t, rf"(?U){_SPACE}+", " "), " ")
    return _casefold(flat) if exact else F.lower(flat)


def scene_of(sample_id: Column, visible: Column) -> Column:
    """What stands before the id's first underscore, else the first all-digit part of the path; null if neither is there."""
    digits = F.filter(F.split(F.coalesce(visible, F.lit("")), "/"), lambda p: p.rlike(r"\A\d+\z"))
    return F.when(F.contains(sample_id, F.lit("_")), F.split_part(sample_id, F.lit("_"), F.lit(1))).otherwise(F.get(digits, 0))


def item_key(sample_id: Column, index: Column) -> Column:
    """The id with its object's number in at least two digits."""
    n = index.cast("string")
    return F.concat(sample_id, F.lit("#"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def common_tag(tag: Column) -> Column:
    """A run's tag without the token that names its split."""
    return F.regexp_replace(tag, r"[-_](train|val)([-_]|$)", "$2")


def split_name(given: Column, recorded: Column, path: Column) -> Column:
    """The split that was given, else recorded, else ``val`` if the file's stem says so, else ``train``."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*\z", "")
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(recorded, F.lit("")), F.when(F.contains(stem, F.lit("val")), "val").otherwise("train"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*\z", "")


def is_canonical_path(path: Column) -> Column:
    """A non-empty relative path with forward slashes, and no empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def modality_path(visible: Column, name: str) -> Column:
    """The sibling path of another modality, by replacing the colour folder."""
    return F.replace(visible, F.lit("/color/"), F.lit(f"/{name}/"))


def is_trusted_fingerprint(t: Column) -> Column:
    return F.coalesce(t.rlike(r"\Amanifest_[0-9a-f]{64}\z"), F.lit(False))


def is_human(annotator: Column) -> Column:
    """Whether an annotator is a person: there, not the seed, not an absence mark, not still to do."""
    return F.coalesce((annotator != "") & ~annotator.endswith(":absent") & ~annotator.endswith(":todo") & (annotator != "seed"), F.lit(False))


def is_pending(annotator: Column) -> Column:
    return F.coalesce((annotator == "") | annotator.isin("seed", "seed:absent") | annotator.endswith(":todo"), F.lit(True))


def seed_alias(annotator: Column) -> Column:
    """Machine pre-labels count as the seed."""
    return F.when(annotator == "ai-prelabel", "seed").when(annotator == "ai-prelabel:absent", "seed:absent").otherwise(annotator)


def chat_record(system: Column, user_template: Column, query: Column, answer: Column | None = None) -> Column:
    """Messages with roles, the query put into the user's template, and the answer for training."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", system), turn("user", F.replace(user_template, F.lit("{query}"), query))]
    return F.array(*turns, *([turn("assistant", answer)] if answer is not None else []))


def item_of_route(path: Column, suffix: str, prefix: str = "/api/item/") -> Column:
    """The id in a request's path between prefix and suffix, decoded; null if it is empty or has a further part."""
    middle = F.substr(path, F.lit(len(prefix) + 1), F.length(path) - len(prefix) - len(suffix))
    fits = F.startswith(path, F.lit(prefix)) & F.endswith(path, F.lit(suffix)) & (F.length(path) > len(prefix) + len(suffix)) & ~F.contains(middle, F.lit("/"))
    return F.when(fits, F.url_decode(F.replace(middle, F.lit("+"), F.lit("%2B"))))
