"""Label formats read into one shape: (path, name, stem, text), text in the normalised line format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import base_name, stem
from gridloom.operators.labels import from_corners, from_pixel_box

from .files import list_images, whole_texts

#: Text files beside labels that hold none.
RESERVED = ("classes.txt", "obj.names", "train.txt", "valid.txt", "test.txt")


class Problems(ValueError):
    """What a strict reader refuses: the rule and a few of the names that break it."""

    def __init__(self, rule: str, names: list[str]):
        super().__init__(f"{rule}: {', '.join(names)}")
        self.rule, self.names = rule, names


def _refuse(rule: str, rows: DataFrame, name: str) -> None:
    if bad := [str(r[0]) for r in rows.select(name).limit(5).collect()]:
        raise Problems(rule, bad)


def read_label_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Images with the text file of their stem, case aside. A second label or image of a stem, and an image without label, are refused; labels without image are not."""
    images = list_images(spark, folder).select("path", "name", "stem")
    labels = whole_texts(spark, folder, "*.txt").withColumn("stem", F.lower(stem("label_path"))).where(~F.lower(base_name("label_path")).isin(*RESERVED))
    for rows, rule in ((labels, "several labels of a stem"), (images, "several images of a stem")):
        _refuse(rule, rows.groupBy("stem").count().where("count > 1"), "stem")
    _refuse("images without label", images.join(labels, "stem", "left_anti"), "name")
    return images.join(labels.select("stem", "text"), "stem").select("path", "name", "stem", "text")


def _with_files(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    images = list_images(spark, folder).groupBy("name").agg(F.max("path").alias("path"))
    _refuse("annotated images that are missing", rows.join(images, "name", "left_anti"), "name")
    return rows.join(images, "name").select("path", "name", F.lower(stem("name")).alias("stem"), "text")


def find_coco(spark: SparkSession, folder: str) -> str | None:
    """The first JSON file, by path, that has both images and annotations."""
    texts = whole_texts(spark, folder, "*.json")
    keys = F.json_object_keys("text")
    both = texts.where(F.array_contains(keys, "images") & F.array_contains(keys, "annotations"))
    first = both.agg(F.min("label_path")).first()[0]
    return first


def read_coco(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Boxes x, y, w, h in pixels; categories are ignored, images without boxes have an empty text, files join by base name."""
    box = "array<struct<id:bigint,image_id:bigint,bbox:array<double>>>"
    raw = spark.read.option("multiLine", "true").schema(f"images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations {box}").json(path)
    images = raw.select(F.explode("images").alias("i")).select("i.id", base_name("i.file_name").alias("name"), "i.width", "i.height")
    boxes = raw.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", F.col("a.image_id").alias("id"), "a.bbox")
    joined = images.join(boxes, "id", "left")
    line = F.when(F.col("bbox").isNotNull(), from_pixel_box(*(F.get("bbox", F.lit(k)) for k in range(4)), "width", "height"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("ordinal", line.alias("line"))))), lambda x: F.concat(x["line"], F.lit("\n")))
    rows = joined.groupBy("id", "name").agg(F.array_join(lines, "").alias("text"))
    return _with_files(spark, folder, rows.select("name", "text"))


def find_cvat(spark: SparkSession, folder: str) -> str | None:
    """The first XML file, by path, whose root has image elements."""
    return whole_texts(spark, folder, "*.xml").where(F.col("text").rlike(r"<image[\s>]")).agg(F.min("label_path")).first()[0]


def read_cvat(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Box corners in pixels; only box elements count, images without any have an empty text."""
    schema = "_name string, _width double, _height double, box array<struct<_xtl:double,_ytl:double,_xbr:double,_ybr:double>>"
    raw = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)
    line = lambda b: F.concat(from_corners(b["_xtl"], b["_ytl"], b["_xbr"], b["_ybr"], F.col("_width"), F.col("_height")), F.lit("\n"))
    text = F.coalesce(F.array_join(F.transform("box", line), ""), F.lit(""))
    return _with_files(spark, folder, raw.select(base_name("_name").alias("name"), text.alias("text")))


def read_annotations(spark: SparkSession, folder: str, kind: str = "auto") -> tuple[str, DataFrame]:
    """The named format, or the first found of coco, cvat and label text; a named one that is not there is an error."""
    for name, find, read in (("coco", find_coco, read_coco), ("cvat", find_cvat, read_cvat)):
        if kind in ("auto", name):
            if path := find(spark, folder):
                return name, read(spark, folder, path)
            if kind == name:
                raise FileNotFoundError(f"no {name} annotations in {folder}")
    return "yolo", read_label_tree(spark, folder)
