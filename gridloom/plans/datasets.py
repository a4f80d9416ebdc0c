"""Composite data pipelines: imports, splits, controlled and external sets, assets, subsets, and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import base_name, stem
from gridloom.operators import audits, splits, tables
from gridloom.operators.labels import collapse_to_class_zero, from_corners, infer_device, label_lines, looks_augmented, parse_boxes, validate_label_text
from gridloom.session import checkpointed
from gridloom.sources.annotations import Problems, read_annotations
from gridloom.sources.files import binary, device_metadata, list_images, whole_texts, with_camera

#: How a depth map may be named after its background, and with which endings, best first.
DEPTH_NAMES = ("{}_depth", "{}_map", "{}")
DEPTH_ENDINGS = (".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")


def _refuse(rule: str, rows: DataFrame, column: str) -> None:
    if bad := [str(r[0]) for r in rows.select(column).limit(5).collect()]:
        raise Problems(rule, bad)


def import_records(spark: SparkSession, folder: str, kind: str = "auto", metadata_path: str | None = None, expected_images: int | None = None, expected_boxes: int | None = None, allow_unknown_device: bool = False, allow_processed: bool = False) -> tuple[str, DataFrame]:
    """One record an image: id, original_name, device, device_source, boxes, sizes, exif, digests and label text.

    Rule breaks raise ``Problems`` in the order of the checks: counts, stems, labels, devices, exact copies, processed input.
    """
    found, rows = read_annotations(spark, folder, kind)
    pictures = with_camera(binary(spark, folder).join(rows.select("path", "name", "stem", "text"), "path"))
    if metadata_path:
        named, bad = device_metadata(spark, metadata_path)
        _refuse("device metadata", bad, "name")
    else:
        named = spark.createDataFrame([], "name string, device string")
    given = named.select(F.col("name").alias("_name"), F.col("device").alias("_given"))
    joined = pictures.join(given, F.lower("name") == F.col("_name"), "left")
    device = infer_device("_given", "path", F.concat_ws(" ", "exif.make", "exif.model"))
    checked = validate_label_text(rows.select("path", "text"), "path")
    _refuse("labels", checked.where("error is not null").select(F.concat_ws(" ", F.concat_ws(":", base_name("path"), "error_line"), "error").alias("what")), "what")
    out = joined.withColumn("_d", device).join(checked.select("path", "boxes"), "path")
    out = out.select(
        F.col("stem").alias("id"), F.col("name").alias("original_name"), F.concat(F.lit("images/"), "stem", F.lit(".jpg")).alias("image"), F.concat(F.lit("labels/"), "stem", F.lit(".txt")).alias("label"),
        F.col("_d.device").alias("device"), F.col("_d.device_source").alias("device_source"), "boxes", "raw_size", "canonical_size", "exif", F.sha2("content", 256).alias("raw_image_sha256"), F.sha2("text", 256).alias("label_sha256"), "text",
    )
    out = checkpointed(out)  # images are read and decoded once, the checks read records
    total = out.agg(F.count("*").alias("n"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes")).first()
    for what, wanted, got in (("images", expected_images, total.n), ("boxes", expected_boxes, total.boxes)):
        if wanted is not None and wanted != got:
            raise Problems(f"{what}: expected {wanted}", [str(got)])
    _refuse("ids that stand twice", out.groupBy("id").count().where("count > 1"), "id")
    if not allow_unknown_device:
        _refuse("devices that cannot be told", out.where("device = 'unknown'"), "original_name")
    _refuse("exact copies", out.groupBy("raw_image_sha256").agg(F.count("*").alias("n"), F.min("original_name").alias("name")).where("n > 1"), "name")
    if not allow_processed:
        small = (F.array_min("raw_size") < 3000) | (F.array_max("raw_size") < 4000)
        _refuse("processed input", out.where(looks_augmented("original_name") | small), "original_name")
    return found, out


def import_summary(records: DataFrame) -> DataFrame:
    """Counts, histograms and signals of an import as one row."""
    size = lambda c: F.concat_ws("x", c[0].cast("string"), c[1].cast("string"))
    devices = tables.as_map(tables.histogram(records, ["device"]), F.col("device")).select(F.col("histogram").alias("devices"))
    raw = tables.as_map(records.groupBy(size(F.col("raw_size")).alias("size")).agg(F.count("*").alias("n")), F.col("size")).select(F.col("histogram").alias("raw_dimensions"))
    small = (F.array_min("raw_size") < 3000) | (F.array_max("raw_size") < 4000)
    head = records.agg(F.count("*").alias("images"), F.sum("boxes").alias("boxes"), F.count_if(looks_augmented("original_name")).alias("processed_filenames"), F.count_if(small).alias("below_camera_resolution"))
    fingerprint = tables.manifest_fingerprint(records, [], "id", "raw_image_sha256")
    return head.crossJoin(devices).crossJoin(raw).crossJoin(fingerprint)  # one row each


def dimension_histogram(records: DataFrame, size: str = "raw_size") -> DataFrame:
    """``{w}x{h}`` counts in numeric order."""
    counted = records.groupBy(F.col(size)[0].alias("w"), F.col(size)[1].alias("h")).agg(F.count("*").alias("n"))
    return counted.orderBy("w", "h").select(F.concat_ws("x", "w", "h").alias("size"), "n")


def split_records(records: DataFrame, val_images: int, seed: int) -> DataFrame:
    """Stratified by device; ``val`` is drawn first."""
    return splits.stratified_split(records, "device", "id", val_images, seed, "real")


def controlled_set(photos: DataFrame, boxes: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Photos with the box of their mask (positives) and photos without (empty labels), each split on its own.

    ``photos``: id, kind (positive or negative); ``boxes``: id, bbox (x0, y0, x1, y1), image_size (w, h). A positive
    without box is refused.
    """
    positive = photos.where("kind = 'positive'")
    _refuse("photos without a box", positive.join(boxes, "id", "left_anti"), "id")
    corners = [F.col("bbox")[k] for k in range(4)]
    text = F.concat(from_corners(*corners, F.col("image_size")[0], F.col("image_size")[1], digits=6), F.lit("\n"))
    labelled = positive.join(boxes, "id").select("id", "kind", text.alias("text"))
    empty = photos.where("kind = 'negative'").select("id", "kind", F.lit("").alias("text"))
    return splits.holdout_split(labelled, "id", ratio, seed, "positive").unionByName(splits.holdout_split(empty, "id", ratio, seed, "negative"))


def import_external(rows: DataFrame, collapse: bool = True, expected_images: int | None = None, expected_boxes: int | None = None) -> DataFrame:
    """An external test set: all classes become one, labels are validated, counts gated; images stay as they are."""
    text = collapse_to_class_zero("text") if collapse else F.col("text")
    out = rows.withColumn("text", text)
    checked = validate_label_text(out.select("path", "text"), "path")
    _refuse("labels", checked.where("error is not null"), "path")
    out = out.join(checked.select("path", "boxes"), "path").withColumn("id", F.col("stem"))
    total = out.agg(F.count("*").alias("n"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes")).first()
    for what, wanted, got in (("images", expected_images, total.n), ("boxes", expected_boxes, total.boxes)):
        if wanted is not None and wanted != got:
            raise Problems(f"{what}: expected {wanted}", [str(got)])
    return out


def depth_pairs(backgrounds: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(background, depth) by the first of the names that a map may have; and maps that no background uses. Backgrounds without a map drop out."""
    spark = backgrounds.sparkSession
    order = [(p * len(DEPTH_ENDINGS) + k, pattern, ending) for p, pattern in enumerate(DEPTH_NAMES) for k, ending in enumerate(DEPTH_ENDINGS)]
    tries = spark.createDataFrame(order, "priority int, pattern string, ending string")  # 18 rows
    stems = backgrounds.select(F.col("name").alias("image"), stem("name").alias("_stem"))
    wanted = stems.crossJoin(F.broadcast(tries)).select("image", "priority", F.lower(F.concat(F.replace(F.col("pattern"), F.lit("{}"), F.col("_stem")), "ending")).alias("key"))
    named = maps.select(F.lower("name").alias("key"), F.col("name").alias("depth"))
    best = wanted.join(named, "key").groupBy("image").agg(F.min_by("depth", F.struct("priority", "depth")).alias("depth"))
    return best, named.join(best, "depth", "left_anti").select("depth")


def asset_split(pairs: DataFrame, cutouts: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(split, kind, image, depth) of backgrounds and cutouts, split each on their own."""
    grounds = splits.holdout_split(pairs, "image", ratio, seed, "backgrounds").select("split", F.lit("background").alias("kind"), "image", "depth")
    cut = splits.holdout_split(cutouts.select(F.col("name").alias("image")), "image", ratio, seed, "cutouts")
    return grounds.unionByName(cut.select("split", F.lit("cutout").alias("kind"), "image", F.lit(None).cast("string").alias("depth")))


def nested_training_sets(manifest: DataFrame, base: int, multipliers: list[int]) -> DataFrame:
    """(multiplier, split, image) of nested training subsets, each with all validation images."""
    train = splits.nested_subsets(manifest.where("split = 'train'"), "image", base, multipliers)
    sizes = manifest.sparkSession.createDataFrame([(m,) for m in multipliers], "multiplier int")
    val = manifest.where("split = 'val'").crossJoin(F.broadcast(sizes))
    return train.select("multiplier", "split", "image").unionByName(val.select("multiplier", "split", "image"))


def audit_tree(images: DataFrame, labels: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Per split: images, labels, boxes, files without partner, bad labels, and whether all is as expected. Nothing raises.

    ``images``: split, stem; ``labels``: split, stem, text.
    """
    stems = images.select("split", "stem").distinct().withColumn("_i", F.lit(1)).join(labels.select("split", "stem").distinct().withColumn("_l", F.lit(1)), ["split", "stem"], "full_outer")
    parity = stems.groupBy("split").agg(F.count("_i").alias("images"), F.count("_l").alias("labels"), F.count_if(F.col("_l").isNull()).alias("without_label"), F.count_if(F.col("_i").isNull()).alias("without_image"))
    checked = validate_label_text(labels.withColumn("_f", F.concat_ws("/", "split", "stem")), "_f").withColumn("split", F.substring_index("_f", "/", 1))
    boxes = checked.groupBy("split").agg(F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.count("error").alias("bad_labels"))
    out = parity.join(boxes, "split", "left").withColumns({"boxes": F.coalesce("boxes", F.lit(0)), "bad_labels": F.coalesce("bad_labels", F.lit(0))})
    ok = (F.col("without_label") == 0) & (F.col("without_image") == 0) & (F.col("bad_labels") == 0)
    if expected:
        wanted = images.sparkSession.createDataFrame(list(expected.items()), "split string, expected_images long")
        out = out.join(F.broadcast(wanted), "split", "full_outer")  # a row for each split
        ok = F.coalesce(ok & (F.col("images") == F.coalesce("expected_images", "images")), F.lit(False))
    return out.withColumn("ok", ok)


def audit_split(records: DataFrame, frozen: DataFrame) -> DataFrame:
    """Leakage and coverage of a frozen split (id, split) as rule rows."""
    found = audits.coverage(records.select("id"), frozen, "id")
    return audits.report([audits.rule(f"split {c}", found, F.sum(c), 0) for c in ("missing", "overlapping", "unknown")])


def audit_assets(backgrounds: DataFrame, maps: DataFrame, cutouts: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rules on assets: there are some, each background has a map of its size or turned, cutouts have alpha, splits share nothing.

    Tables hold name, width, height; ``cutouts`` also opaque (count of opaque pixels).
    """
    pairs, _ = depth_pairs(backgrounds, maps)
    sized = pairs.join(backgrounds.select(F.col("name").alias("image"), "width", "height"), "image").join(maps.select(F.col("name").alias("depth"), F.col("width").alias("dw"), F.col("height").alias("dh")), "depth")
    odd = sized.where("not ((width = dw and height = dh) or (width = dh and height = dw))")
    shared = frozen.groupBy("kind", "image").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return audits.report([
        audits.rule("backgrounds without map", backgrounds.join(pairs, F.col("name") == F.col("image"), "left_anti"), F.count("*"), 0), audits.rule("sizes that differ", odd, F.count("*"), 0),
        audits.rule("cutouts without alpha", cutouts.where("coalesce(opaque, 0) = 0"), F.count("*"), 0), audits.rule("assets in both splits", shared, F.count("*"), 0),
        audits.rule("no backgrounds", backgrounds, (F.count("*") == 0).cast("int"), 0), audits.rule("no cutouts", cutouts, (F.count("*") == 0).cast("int"), 0),
    ])


def audit_generated(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest records against images, per split: (split, records, images, ok)."""
    records = manifest.groupBy("split").agg(F.count("*").alias("records"))
    there = images.groupBy("split").agg(F.count("*").alias("images"))
    both = records.join(there, "split", "full_outer").na.fill(0, ["records", "images"])
    return both.withColumn("ok", F.col("records") == F.col("images"))


def annotations(labels: DataFrame, dataset: str) -> DataFrame:
    """Valid boxes as rows: dataset, split, image, annotation_index, class_id, centre and size."""
    boxes = parse_boxes(label_lines(labels, "text", ["split", "stem"])).where("error is null")
    return boxes.select(F.lit(dataset).alias("dataset"), "split", F.col("stem").alias("image"), "annotation_index", F.col("class_id").cast("int").alias("class_id"), "center_x", "center_y", "width", "height")


def tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(images, labels) of a folder with images/{split} and labels/{split}."""
    part = lambda c: F.element_at(F.split(c, "/"), -2)
    images = list_images(spark, f"{root}/images").select(part("path").alias("split"), stem("name").alias("stem"), "path")
    texts = whole_texts(spark, f"{root}/labels", "*.txt")
    return images, texts.select(part("label_path").alias("split"), stem("label_path").alias("stem"), "text")
