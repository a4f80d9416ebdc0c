"""Annotation text: parsing, validation and conversion of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import EDGE, Text, _c

#: What separates lines in a label file.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
_NUMBER = r"^[+-]?((\d+(_\d+)*)?\.?(\d+(_\d+)*)?([eE][+-]?\d+)?|inf|infinity|nan)$"
#: Error codes in the order in which the rules are tried.
ERRORS = ("fields", "class", "numeric", "coordinates", "horizontal", "vertical")


def _filled(text_col: str) -> Column:
    """The non-blank lines of a text as (line, value): physical numbers from 1, white space as single spaces."""
    numbered = F.transform(F.split(F.coalesce(_c(text_col), F.lit("")), LINE_BREAK), lambda x, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(x, r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " ")).alias("value")))
    return F.filter(numbered, lambda x: x["value"] != "")


def label_lines(files: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """A row for each non-blank line: keys, ``line`` (1-based, physical), ``annotation_index`` (0-based, non-blank) and ``fields``."""
    keys = keys if keys is not None else [c for c in files.columns if c != text_col]
    lines = files.select(*keys, F.posexplode(_filled(text_col)).alias("annotation_index", "_line"))
    return lines.select(*keys, F.col("_line.line").alias("line"), "annotation_index", F.split(F.col("_line.value"), " ").alias("fields"))


def _float(x: Column) -> Column:
    """A decimal number as written in label files; other spellings that Spark would cast are no numbers here."""
    clean = F.regexp_replace(x, "_", "")
    return F.when(x.rlike(_NUMBER) & x.rlike(r"\d|inf|nan"), clean.try_cast("double"))


#: The numbers of a label line, in order after the class.
NUMBERS = ("center_x", "center_y", "width", "height")


def line_error(fields: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The first rule that a line of ``fields`` with these numbers breaks, or null."""
    inside = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    numeric = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return (
        F.when(F.size(fields) != 5, ERRORS[0]).when(F.get(fields, F.lit(0)) != "0", ERRORS[1]).when(~numeric, ERRORS[2]).when(~inside | F.isnan(w) | F.isnan(h), ERRORS[3])
        .when((x - w / 2 < -EDGE) | (x + w / 2 > 1 + EDGE), ERRORS[4]).when((y - h / 2 < -EDGE) | (y + h / 2 > 1 + EDGE), ERRORS[5])
    )


def parse_boxes(lines: DataFrame) -> DataFrame:
    """Adds class_id text, centre and size as doubles and ``error``: the first rule that the line breaks, or null."""
    out = lines.withColumn("class_id", F.get("fields", F.lit(0)))
    out = out.withColumns({name: _float(F.get("fields", F.lit(k + 1))) for k, name in enumerate(NUMBERS)})
    return out.withColumn("error", line_error(F.col("fields"), *(F.col(n) for n in NUMBERS)))


def validate_label_text(files: DataFrame, source_col: str, text_col: str = "text") -> DataFrame:
    """For each row its box count, or the first violation with its physical line: (source, boxes, error_line, error).

    A rule of the row alone: nothing is shuffled, and repeated rows are judged each by themselves.
    """
    def numbers(x: Column) -> Column:
        fields = F.split(x["value"], " ")
        return F.struct(x["line"].alias("line"), fields.alias("fields"), *(_float(F.get(fields, F.lit(k + 1))).alias(n) for k, n in enumerate(NUMBERS)))

    lines = F.transform(_filled(text_col), numbers)
    judged = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), line_error(x["fields"], *(x[n] for n in NUMBERS)).alias("error")))
    out = files.select(source_col, judged.alias("_lines")).withColumn("_bad", F.get(F.filter("_lines", lambda x: x["error"].isNotNull()), F.lit(0)))
    return out.select(source_col, F.when(F.col("_bad").isNull(), F.size("_lines").cast("long")).alias("boxes"), F.col("_bad.line").alias("error_line"), F.col("_bad.error").alias("error"))


def collapse_to_class_zero(text: Text) -> Column:
    """The first field of each non-blank line becomes 0, fields stand one space apart, each line ends in a line feed."""
    lines = F.transform(F.split(_c(text), LINE_BREAK), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(F.regexp_replace(x, r"^\S+", "0"), F.lit("\n")))
    return F.array_join(lines, "")


def box_line(center_x: Column, center_y: Column, width: Column, height: Column, digits: int = 8) -> Column:
    """A label line of class 0; a number halfway between two takes the even digit."""
    fixed = (F.bround(x.cast("decimal(28,18)"), digits).cast("string") for x in (center_x, center_y, width, height))
    return F.concat(F.lit("0 "), *(part for k, x in enumerate(fixed) for part in ([F.lit(" "), x] if k else [x])))


def from_pixel_box(x: Text, y: Text, w: Text, h: Text, width: Text, height: Text, digits: int = 8) -> Column:
    """Pixel corner and size -> normalised centre form."""
    x, y, w, h, width, height = (_c(v).cast("double") for v in (x, y, w, h, width, height))
    return box_line((x + w / 2) / width, (y + h / 2) / height, w / width, h / height, digits)


def from_corners(left: Text, top: Text, right: Text, bottom: Text, width: Text, height: Text, digits: int = 8) -> Column:
    """Pixel corners -> normalised centre form."""
    a, b, c, d, width, height = (_c(v).cast("double") for v in (left, top, right, bottom, width, height))
    return box_line((a + c) / 2 / width, (b + d) / 2 / height, (c - a) / width, (d - b) / height, digits)


def instance_label(instance: Text, mode: str, canvas: tuple[int, int], min_pixels: int) -> Column:
    """Label of a placed instance (struct x, y and boxes ``visible``, ``amodal``, ``rect`` of left, top, right, bottom), or null if a side is short."""
    box, width, height = _c(instance)[mode], *canvas
    x, y = _c(instance)["x"], _c(instance)["y"]
    line = from_corners(box["left"] + x, box["top"] + y, box["right"] + x, box["bottom"] + y, F.lit(width), F.lit(height))
    return F.when((box["right"] - box["left"] >= min_pixels) & (box["bottom"] - box["top"] >= min_pixels), line)


def normalize_device(value: Text) -> Column:
    v = F.lower(F.trim(F.coalesce(_c(value), F.lit(""))))
    return F.when(v.contains("iphone") | v.contains("apple"), "iphone").when(v.contains("pixel") | v.contains("google"), "pixel").otherwise("unknown")


def infer_device(metadata: Text, path: Text, exif: Text) -> Column:
    """Struct (device, device_source): metadata first, then the path, then what the camera wrote."""
    tries = [(_c(metadata), "metadata"), (normalize_device(path), "path"), (normalize_device(exif), "exif")]
    found = [F.when(v.isNotNull() & (v != "unknown") if name != "metadata" else v.isNotNull(), F.struct(v.alias("device"), F.lit(name).alias("device_source"))) for v, name in tries]
    return F.coalesce(*found, F.struct(F.lit("unknown").alias("device"), F.lit("unavailable").alias("device_source")))


def looks_augmented(name: Text) -> Column:
    return F.lower(_c(name)).contains(".rf.") | _c(name).rlike(r"(?i)(?:aug|flip|mosaic|brightness|exposure)")


def below_camera_resolution(size: Text) -> Column:
    return (F.array_min(_c(size)) < 3000) | (F.array_max(_c(size)) < 4000)
