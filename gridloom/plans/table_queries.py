"""More operators on the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import audits, labels, selection, series, splits, tables
from gridloom.plans import assets, datasets, experiments
from gridloom.plans.queries import _box_lines, _t
from gridloom.streaming import progress

SEEDS = [0, 1, 2]


def q_path_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names, stems and suffixes of page addresses, label folders of image folders."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/data/images/"), F.regexp_replace("url", "[?&=]", "."), F.when(F.col("page_id") % 3 == 0, ".JPG").otherwise("")).alias("path"))
    folder = F.concat(F.lit("/root/images/split"), F.col("page_id").cast("string"))
    return pages.select("page_id", X.base_name("path").alias("base"), X.stem("path").alias("stem"), X.suffix("path").alias("suffix"), X.relative_to("path", "/data/images").alias("relative"), X.label_directory(folder).alias("folder"))


SQL_PATHS = r"""
WITH p AS (SELECT page_id, '/data/images/' || regexp_replace(url, '[?&=]', '.', 'g') || CASE WHEN page_id % 3 = 0 THEN '.JPG' ELSE '' END AS path FROM pages),
b AS (SELECT page_id, path, split_part(path, '/', -1) AS base FROM p)
SELECT page_id, base, CASE WHEN strpos(substr(base, 2), '.') > 0 THEN left(base, length(base) - length(split_part(base, '.', -1)) - 1) ELSE base END AS stem,
CASE WHEN strpos(substr(base, 2), '.') > 0 AND split_part(base, '.', -1) <> '' THEN '.' || lower(split_part(base, '.', -1)) ELSE '' END AS suffix, substr(path, 14) AS relative, '/root/labels/split' || page_id AS folder FROM b
"""


def q_box_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel corner and size, and pixel corners, to normalised lines; labels of placed instances."""
    p = _t(spark, sf_dir, "part").select("p_partkey", *(((F.col("p_partkey") * a) % 64).alias(n) for n, a in (("x", 13), ("y", 29))), (F.col("p_size") + 1).alias("w"), F.lit(16).alias("h"))
    box = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.col("w").alias("right"), F.col("h").alias("bottom"))
    placed = F.struct("x", "y", box.alias("visible"))
    return p.select("p_partkey", labels.from_pixel_box("x", "y", "w", "h", F.lit(128), F.lit(256)).alias("pixel"), labels.from_corners("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.lit(128), F.lit(256), 6).alias("corners"), labels.instance_label(placed, "visible", (128, 256), 12).alias("instance"))


SQL_CONVERSION = """
WITH p AS (SELECT p_partkey, (p_partkey * 13) % 64 AS x, (p_partkey * 29) % 64 AS y, p_size + 1 AS w, 16 AS h FROM part),
c AS (SELECT p_partkey, w, (x + w / 2.0::DOUBLE) / 128 AS cx, (y + h / 2.0::DOUBLE) / 256 AS cy, w / 128.0::DOUBLE AS nw, h / 256.0::DOUBLE AS nh FROM p)
SELECT p_partkey, printf('0 %.8f %.8f %.8f %.8f', cx, cy, nw, nh) AS pixel, printf('0 %.6f %.6f %.6f %.6f', cx, cy, nw, nh) AS corners,
CASE WHEN w >= 12 THEN printf('0 %.8f %.8f %.8f %.8f', cx, cy, nw, nh) END AS instance FROM c
"""


def q_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of the label files with its ordinal and number, parsed."""
    found = labels.parse_boxes(labels.label_lines(_box_lines(spark, sf_dir)))
    return found.select("p_partkey", "line", "annotation_index", F.size("fields").alias("fields"), "class_id", F.coalesce("center_x", F.lit(-1.0)).alias("center_x"), F.col("error").isNull().alias("valid"))


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class becomes zero."""
    return _box_lines(spark, sf_dir).select("p_partkey", labels.collapse_to_class_zero("text").alias("text"))


_LINES = """
f AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS cls, printf('%.4f', ((p_partkey * 13) % 101)::DOUBLE / 100) AS x, printf('%.4f', ((p_partkey * 29) % 101)::DOUBLE / 100) AS y,
printf('%.4f', ((p_partkey * 7) % 101)::DOUBLE / 100 / 2) AS w, printf('%.4f', ((p_partkey * 11) % 101)::DOUBLE / 100 / 2) AS h,
CASE WHEN p_size % 5 = 0 THEN '0 0.5 x 0.1 0.1' WHEN p_size % 3 = 0 THEN '0 0.5 0.5 0.1' ELSE '0 0.5 0.5 0.25 0.25' END AS second FROM part),
g AS (SELECT *, x::DOUBLE AS dx, y::DOUBLE AS dy, w::DOUBLE AS dw, h::DOUBLE AS dh FROM f),
e AS (SELECT *, cls = 0 AND dw > 0 AND dw <= 1 AND dh > 0 AND dh <= 1 AND dx - dw / 2 >= -1e-6 AND dx + dw / 2 <= 1 + 1e-6 AND dy - dh / 2 >= -1e-6 AND dy + dh / 2 <= 1 + 1e-6 AS ok FROM g)
"""
SQL_LINES = f"""WITH {_LINES}
SELECT p_partkey, 1 AS line, 0 AS annotation_index, 5 AS fields, cls::VARCHAR AS class_id, dx AS center_x, ok AS valid FROM e
UNION ALL SELECT p_partkey, 3, 1, len(string_split(second, ' ')), '0', 0.5, second = '0 0.5 0.5 0.25 0.25' FROM e
"""
SQL_COLLAPSE = f"WITH {_LINES} SELECT p_partkey, '0 ' || x || ' ' || y || ' ' || w || ' ' || h || chr(10) || second || chr(10) AS text FROM e"


def q_audit_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as splits, parts as images, label files for all but each eleventh."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_brand").alias("split"), F.col("p_partkey").cast("string").alias("stem"))
    texts = part.join(_box_lines(spark, sf_dir), "p_partkey").where("p_partkey % 11 <> 0").select("split", "stem", "text")
    return datasets.audit_tree(part.select("split", "stem"), texts).select("split", "images", "labels", "without_label", "without_image", "boxes", "bad_labels", "ok")


SQL_TREE = f"""WITH {_LINES},
l AS (SELECT e.*, p_brand AS split, ok AND second = '0 0.5 0.5 0.25 0.25' AS good FROM e JOIN part USING (p_partkey))
SELECT split, count(*) AS images, count(*) FILTER (p_partkey % 11 <> 0) AS labels, count(*) FILTER (p_partkey % 11 = 0) AS without_label, 0::BIGINT AS without_image,
2 * count(*) FILTER (p_partkey % 11 <> 0 AND good) AS boxes, count(*) FILTER (p_partkey % 11 <> 0 AND NOT good) AS bad_labels, bool_and(p_partkey % 11 <> 0 AND good) AS ok FROM l GROUP BY 1
"""


def q_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid boxes as rows, and A3: their number an image."""
    files = _box_lines(spark, sf_dir).select(F.lit("train").alias("split"), F.col("p_partkey").cast("string").alias("stem"), "text")
    found = datasets.annotations(files, "parts")
    return found.groupBy("dataset", "image").agg(F.count("*").alias("boxes"), F.bround(F.sum(F.col("width") * F.col("height")), 6).alias("area"))


SQL_ANNOTATIONS = f"""WITH {_LINES}
SELECT 'parts' AS dataset, p_partkey::VARCHAR AS image, (ok::INTEGER + (second = '0 0.5 0.5 0.25 0.25')::INTEGER)::BIGINT AS boxes,
round_even(CASE WHEN ok THEN dw * dh ELSE 0 END + CASE WHEN second = '0 0.5 0.5 0.25 0.25' THEN 0.0625 ELSE 0 END, 6) AS area FROM e WHERE ok OR second = '0 0.5 0.5 0.25 0.25'
"""


def q_import_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of processed pictures and sizes below the cameras'."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 5 == 0, ".RF.jpg").when(F.col("doc_id") % 7 == 0, "_Flipped").otherwise(".jpg")).alias("name"), F.array(F.col("n_chars") * 2, F.lit(3000)).alias("size"))
    return docs.select("doc_id", labels.looks_augmented("name").alias("augmented"), labels.below_camera_resolution("size").alias("small"))


SQL_SIGNALS = "SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 OR regexp_matches(source, '(?i)aug|flip|mosaic|brightness|exposure') AS augmented, n_chars * 2 < 4000 AS small FROM documents"


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 and the audit of a frozen split: customers against what orders say of them."""
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    frozen = _t(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("id"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderstatus")).otherwise("train").alias("split"))
    return datasets.audit_split(customers, frozen)


SQL_COVERAGE = """
WITH f AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS id, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus ELSE 'train' END AS split FROM orders WHERE o_custkey % 3 <> 0),
r(rule, actual) AS (SELECT 'split missing', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM f)) UNION ALL SELECT 'split overlapping', (SELECT count(*) FROM (SELECT id FROM f GROUP BY id HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'split unknown', (SELECT count(DISTINCT id) FROM f WHERE id NOT IN (SELECT c_custkey FROM customer)))
SELECT rule, 0::BIGINT AS expected, actual::BIGINT AS actual, actual = 0 AS ok FROM r
"""


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of runs: priorities as models, statuses as conditions, customers modulo 3 as candidates and years as seeds."""
    seed = (F.year("o_orderdate") % 3).alias("seed")
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model_name"), F.col("o_orderstatus").alias("condition"), (F.col("o_custkey") % 3).alias("k"), seed, "o_totalprice")
    name = F.concat_ws("/", "model_name", "condition", F.col("k").cast("string"))
    runs = runs.groupBy("model_name", "condition", "k", "seed").agg(F.bround(F.avg("o_totalprice") / 1e6, 6).alias("map50_95"), F.count("*").cast("double").alias("training_seconds"))
    results = runs.withColumns({"candidate_id": name, "run_id": F.concat_ws("#", name, F.col("seed").cast("string")), "checkpoint": F.concat(name, F.lit(".pt"))})
    return results, results.select("candidate_id", "model_name", "condition", F.concat("model_name", F.lit(".pt")).alias("model")).distinct()


def q_select_by_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best complete candidate of each model and condition, what it is, and its runs' seconds."""
    chosen = experiments.select_by_validation(*_matrix(spark, sf_dir), SEEDS)
    seconds = F.aggregate("runs", F.lit(0.0), lambda a, r: a + r["training_seconds"])
    return chosen.select("model_name", "condition", "candidate_id", "model", "mean", "std", seconds.alias("seconds"), F.array_join(F.transform("runs", lambda r: r["checkpoint"]), ",").alias("checkpoints"))


def q_selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected runs with their evaluation; those never evaluated are beside them."""
    results, expected = _matrix(spark, sf_dir)
    chosen = experiments.select_by_validation(results, expected, SEEDS)
    evaluated = results.where("seed <> 2").select("run_id", (F.col("map50_95") * 2).alias("test"))
    found, lost = experiments.run_rows(chosen, evaluated)
    return found.select("run_id", "seed", "map50_95", "test").unionByName(lost.select("run_id", "seed", "map50_95", F.lit(None).cast("double").alias("test")))


_MATRIX = """
r AS (SELECT o_orderpriority AS model_name, o_orderstatus AS condition, o_custkey % 3 AS k, year(o_orderdate) % 3 AS seed, round_even(avg(o_totalprice) / 1e6, 6) AS v, count(*)::DOUBLE AS seconds FROM orders GROUP BY ALL),
n AS (SELECT *, model_name || '/' || condition || '/' || k AS candidate_id FROM r),
c AS (SELECT model_name, condition, candidate_id, round_even(avg(v), 6) AS mean, round_even(coalesce(stddev_samp(v), 0), 6) AS std, sum(seconds) AS seconds, count(*) AS runs FROM n GROUP BY ALL),
b AS (SELECT * FROM c WHERE runs = 3 QUALIFY row_number() OVER (PARTITION BY model_name, condition ORDER BY mean DESC, std, candidate_id DESC) = 1)
"""
SQL_SELECT = f"""WITH {_MATRIX} SELECT model_name, condition, candidate_id, model_name || '.pt' AS model, mean, std, seconds, candidate_id || '.pt,' || candidate_id || '.pt,' || candidate_id || '.pt' AS checkpoints FROM b"""
SQL_SELECTED_RUNS = f"""WITH {_MATRIX} SELECT candidate_id || '#' || seed AS run_id, seed, v AS map50_95, CASE WHEN seed <> 2 THEN v * 2 END AS test FROM n SEMI JOIN b USING (candidate_id)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evaluated runs: return flags as models, line numbers as conditions of which the first is the baseline."""
    line = F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model_name"), F.when(line == 1, experiments.BASELINE).when(line < 4, F.concat(F.lit("synthetic-"), line.cast("string"))).otherwise(F.concat(F.lit("mixed-"), line.cast("string"))).alias("condition"), (F.col("l_quantity") / 50).alias("precision"), (F.col("l_discount") * 10).alias("recall"), (F.col("l_tax") * 12).alias("map50"), (F.col("l_quantity") / 100).alias("map75"), (F.col("l_extendedprice") / 1e5).alias("map50_95"), (F.col("l_quantity") - 25).alias("bias"))
    return rows.withColumns({"f1": X.f1("precision", "recall"), "mae": F.abs("bias"), "rmse": F.col("bias") * F.col("bias")})


def q_evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over runs with the delta against the baseline."""
    out = experiments.evaluation_summary(_evaluated(spark, sf_dir))
    four = [c for c in out.columns if c.endswith(("_mean", "_std"))]
    return out.select("model_name", "condition", *(F.bround(c, 4).alias(c) for c in four if not c.startswith("count_rmse")), F.bround("delta_vs_manual_full", 4).alias("delta"), "runs")


def q_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fully synthetic conditions above the baseline."""
    out = selection.highlighted(experiments.evaluation_summary(_evaluated(spark, sf_dir)), "condition", "delta_vs_manual_full")
    return experiments.comparison(out).select("model", "condition", "runs", F.bround("map50_95_mean", 4).alias("mean"))


_EVALUATED = """
e AS (SELECT l_returnflag AS model_name, CASE WHEN l_linenumber = 1 THEN 'manual-full' WHEN l_linenumber < 4 THEN 'synthetic-' || l_linenumber ELSE 'mixed-' || l_linenumber END AS condition,
l_quantity / 50 AS p, l_discount * 10 AS r, l_tax * 12 AS m50, l_quantity / 100 AS m75, l_extendedprice / 1e5 AS m95, l_quantity - 25 AS b FROM lineitem),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM e),
""" + "s AS (SELECT model_name, condition, " + ", ".join(f"round_even({a}({x}), 6) AS {n}_{k}" for n, x in (("precision", "p"), ("recall", "r"), ("f1", "f"), ("map50", "m50"), ("map75", "m75"), ("map50_95", "m95"), ("count_mae", "abs(b)"), ("count_bias", "b")) for a, k in (("avg", "mean"), ("stddev_samp", "std"))) + ", count(*) AS runs FROM f GROUP BY 1, 2)"
SQL_EVALUATION = f"""WITH {_EVALUATED} SELECT model_name, condition, {', '.join(f"round_even({n}_{k}, 4) AS {n}_{k}" for n in ("precision", "recall", "f1", "map50", "map75", "map50_95", "count_mae", "count_bias") for k in ("mean", "std"))},
round_even(map50_95_mean - max(CASE WHEN condition = 'manual-full' THEN map50_95_mean END) OVER (PARTITION BY model_name), 4) AS delta, runs FROM s"""
SQL_HIGHLIGHTED = f"""WITH {_EVALUATED}, d AS (SELECT *, round_even(map50_95_mean - max(CASE WHEN condition = 'manual-full' THEN map50_95_mean END) OVER (PARTITION BY model_name), 6) AS delta FROM s)
SELECT model_name AS model, condition, runs, round_even(map50_95_mean, 4) AS mean FROM d WHERE condition LIKE 'synthetic-%' AND delta > 0"""


def q_ap_by_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten components of vectors as average precisions of classes."""
    vectors = _t(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))).alias("ap"))
    return selection.ap_by_iou(vectors, ["label"], "ap").select("label", "iou", F.bround("ap", 6).alias("ap"))


SQL_AP = "WITH e AS (SELECT label, unnest(range(10)) AS k, unnest(embedding[1:10]) AS v FROM embeddings) SELECT label, printf('%.2f', 0.5 + k * 0.05) AS iou, round_even(avg(abs(v::DOUBLE)), 6) AS ap FROM e GROUP BY 1, 2"


def q_best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the first maximum of a label's mean curve of eight points."""
    curve = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    steps = F.array(*(F.lit(k / 8) for k in range(8)))
    return selection.best_confidence(_t(spark, sf_dir, "embeddings").select("label", curve.alias("curve"), steps.alias("px")), ["label"], "curve", "px")


SQL_CONFIDENCE = """
WITH e AS (SELECT label, unnest(range(8)) AS k, unnest(embedding[1:8]) AS v FROM embeddings), m AS (SELECT label, k, avg(abs(v::DOUBLE)) AS f FROM e GROUP BY 1, 2)
SELECT label, round_even(f, 6) AS best_f1, k / 8.0::DOUBLE AS best_f1_confidence FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, k) = 1
"""


def q_annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and boxes of each dataset and split; images without boxes count."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("image"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_quantity") / 50).alias("center_x"), F.lit(0.5).alias("center_y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    return experiments.annotation_heat(lines.join(orders, "image"), orders, 8)[1]


SQL_STATS = "SELECT o_orderpriority AS dataset, o_orderstatus AS split, count(DISTINCT o_orderkey) AS images, count(l_orderkey) AS boxes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def q_count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted numbers beside the lines of each image's label file."""
    files = _box_lines(spark, sf_dir).withColumnRenamed("p_partkey", "id")
    return experiments.count_pairs(_t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("predicted")), files)


SQL_COUNT_PAIRS = "SELECT p_partkey AS id, 2::BIGINT AS target, (p_size % 4)::BIGINT AS predicted FROM part WHERE p_size > 10"


def q_counting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image out of what a run nests."""
    per = F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("target"), (F.col("l_quantity") + F.col("l_linenumber") - 3).alias("predicted"))
    runs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed"), "l_returnflag").agg(F.collect_list(per).alias("per_image"))  # a few lines an order
    runs = runs.select(F.col("l_returnflag").alias("model_name"), F.lit("c").alias("condition"), "seed", F.concat_ws("_", "l_returnflag", F.col("seed").cast("string")).alias("run_id"), "per_image")
    return experiments.counting_rows(runs)


SQL_COUNTING_ROWS = "SELECT l_returnflag AS model_name, 'c' AS condition, l_orderkey AS seed, l_returnflag || '_' || l_orderkey AS run_id, l_linenumber AS id, l_quantity AS target, l_quantity + l_linenumber - 3 AS predicted FROM lineitem"


def q_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: a nation's own settings over its region's."""
    own = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    defaults = F.create_map(F.lit("region"), F.col("r_name"), F.lit("key"), F.col("r_regionkey").cast("string"))
    joined = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.explode(X.overlay(defaults, own)).alias("key", "value"))


SQL_OVERLAY = "SELECT n_nationkey, unnest(['name', 'key', 'region']) AS key, unnest([n_name, n_nationkey::VARCHAR, r_name]) AS value FROM nation JOIN region ON n_regionkey = r_regionkey"


def q_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depth scales, and places of values on a drawn curve."""
    return _t(spark, sf_dir, "part").select("p_partkey", X.depth_scale(F.col("p_size") / 50, 0.4, 1.2).alias("scale"), X.curve_x("p_size", 1, 50, 70, 720).alias("x"), X.curve_y(F.col("p_retailprice") / 1000, 55, 430).alias("y"))


SQL_POINTS = "SELECT p_partkey, 0.4::DOUBLE + 0.8::DOUBLE * (p_size / 50.0::DOUBLE) AS scale, 70 + (p_size - 1) / 49.0::DOUBLE * 720 AS x, 55 + (1 - least(greatest(p_retailprice / 1000, 0), 1)) * 430 AS y FROM part"


def q_sample_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-S3, F2: unsigned 64-bit seeds of scenes, as text."""
    canonical = F.concat(F.lit('["scene",'), F.col("p_partkey").cast("string"), F.lit("]"))
    return _t(spark, sf_dir, "part").select("p_partkey", X.sample_seed(canonical).cast("string").alias("seed"), X.stable_hash(canonical, 24).alias("fingerprint"))


SQL_SEED = """WITH d AS (SELECT p_partkey, sha256('["scene",' || p_partkey || ']') AS d FROM part) SELECT p_partkey, CAST(('0x' || substr(d, 1, 16))::UBIGINT AS VARCHAR) AS seed, substr(d, 1, 24) AS fingerprint FROM d"""


def q_run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first runs in hash order, which is the feature."""
    return splits.run_order(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 2027, 25)


SQL_RUN_ORDER = "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY sha256('2027|order|' || o_orderkey) LIMIT 25"


def q_filter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: runs of some conditions, models by checkpoint or by name."""
    results, expected = _matrix(spark, sf_dir)
    runs = results.join(expected.select("candidate_id", "model"), "candidate_id")
    return experiments.filter_runs(runs, ["F", "O"], ["1-URGENT.pt", "5-LOW"]).select("run_id", "model_name")


SQL_FILTER_RUNS = "SELECT DISTINCT o_orderpriority || '/' || o_orderstatus || '/' || (o_custkey % 3) || '#' || (year(o_orderdate) % 3) AS run_id, o_orderpriority AS model_name FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW')"


def q_controlled_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, J8, P6, D-S1: photos with the box of their mask or without one, each kind split on its own."""
    part = _t(spark, sf_dir, "part")
    photos = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "positive").otherwise("negative").alias("kind"))
    boxes = part.select(F.col("p_partkey").alias("id"), F.array(F.lit(0), F.lit(8), F.col("p_size"), F.col("p_size") + 16).alias("bbox"), F.array(F.lit(64), F.lit(128)).alias("image_size"))
    return datasets.controlled_set(photos, boxes, 0.8, 7).select("id", "kind", "text", "split")


SQL_CONTROLLED = """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind, p_size FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('7|' || kind || '|' || id), id) AS k, count(*) OVER (PARTITION BY kind) AS n FROM p)
SELECT id, kind, CASE WHEN kind = 'positive' THEN printf('0 %.6f %.6f %.6f %.6f', p_size / 2.0::DOUBLE / 64, (p_size + 24) / 2.0::DOUBLE / 128, p_size / 64.0::DOUBLE, (p_size + 8) / 128.0::DOUBLE) || chr(10) ELSE '' END AS text,
CASE WHEN k <= CASE WHEN n > 1 THEN least(greatest(round_even(n * 0.8::DOUBLE, 0), 1), n - 1) ELSE round_even(n * 0.8::DOUBLE, 0) END THEN 'train' ELSE 'val' END AS split FROM r
"""


def _assets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("bg"), F.col("p_partkey").cast("string")).alias("s"))
    ending = F.when(F.col("p_partkey") % 3 == 0, "_depth.PNG").when(F.col("p_partkey") % 3 == 1, "_map.jpg").otherwise(".webp")
    maps = part.where("p_partkey % 5 <> 0").select(F.concat("s", ending).alias("name")).unionByName(part.where("p_partkey % 4 = 0").select(F.concat("s", F.lit("_depth.tif")).alias("name")))
    return part.select(F.concat("s", F.lit(".jpg")).alias("name")), maps


def q_depth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds with the depth map of the best name."""
    return datasets.depth_pairs(*_assets(spark, sf_dir))[0]


def q_unused_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth maps that no background uses."""
    return datasets.depth_pairs(*_assets(spark, sf_dir))[1]


_MAPS = """
m AS (SELECT p_partkey AS k, 'bg' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '_depth.PNG' WHEN 1 THEN '_map.jpg' ELSE '.webp' END AS depth, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE 17 END AS priority FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'bg' || p_partkey || '_depth.tif', 3 FROM part WHERE p_partkey % 4 = 0),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority) = 1)
"""
SQL_PAIRS = f"WITH {_MAPS} SELECT 'bg' || k || '.jpg' AS image, depth FROM b"
SQL_UNUSED = f"WITH {_MAPS} SELECT depth FROM m WHERE depth NOT IN (SELECT depth FROM b)"


def q_asset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: backgrounds and cut-outs, split each on their own."""
    pairs = datasets.depth_pairs(*_assets(spark, sf_dir))[0]
    return datasets.asset_split(pairs, _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), 0.75, 3)


SQL_ASSET_SPLIT = f"""WITH {_MAPS}, a AS (SELECT 'background' AS kind, 'backgrounds' AS space, 'bg' || k || '.jpg' AS image, depth FROM b UNION ALL SELECT 'cutout', 'cutouts', s_name, NULL FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('3|' || space || '|' || image), image) AS place, count(*) OVER (PARTITION BY kind) AS n FROM a)
SELECT CASE WHEN place <= CASE WHEN n > 1 THEN least(greatest(round_even(n * 0.75::DOUBLE, 0), 1), n - 1) ELSE round_even(n * 0.75::DOUBLE, 0) END THEN 'train' ELSE 'val' END AS split, kind, image, depth FROM r"""


def q_preprocess_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: the manifest of prepared backgrounds, cut-outs and maps."""
    grounds, maps = _assets(spark, sf_dir)
    paired = datasets.depth_pairs(grounds, maps)[0].select(F.col("image").alias("name"))
    return assets.preprocess_assets(grounds, _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), paired)


SQL_PREPROCESS = f"""WITH {_MAPS}, n AS (SELECT (SELECT count(*) FROM part) AS grounds, (SELECT count(DISTINCT s_name) FROM supplier) AS cut, (SELECT count(*) FROM b) AS maps)
SELECT 'backgrounds' AS stage, grounds AS inputs, grounds AS outputs, 0::BIGINT AS missing, true AS complete FROM n UNION ALL SELECT 'masks', cut, cut, 0, true FROM n UNION ALL SELECT 'depths', grounds, maps, grounds - maps, grounds = maps FROM n"""


def q_nested_training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested prefixes of the training images, which are the feature, each with all validation images."""
    rows = _t(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, "val").otherwise("train").alias("split"), F.col("s_name").alias("image"))
    return datasets.nested_training_sets(rows, 1, [1, 3, 5])


SQL_NESTED_SETS = """
WITH s AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, s_name AS image FROM supplier), m AS (SELECT unnest([1, 3, 5]) AS multiplier), t AS (SELECT *, row_number() OVER (ORDER BY image) AS k FROM s WHERE split = 'train')
SELECT multiplier, split, image FROM t JOIN m ON k <= multiplier UNION ALL SELECT multiplier, split, image FROM s, m WHERE split = 'val'
"""


def q_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split by device, the validation rows drawn first."""
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), labels.normalize_device(F.element_at(F.array(F.lit("Apple"), F.lit("pixel 7"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))).alias("device"))
    return datasets.split_records(rows, 17, 5)


SQL_SPLIT_RECORDS = """
WITH p AS (SELECT page_id AS id, ['iphone', 'pixel', 'unknown'][page_id % 3 + 1] AS device FROM pages), s AS (SELECT device, count(*) AS size FROM p GROUP BY 1), q AS (SELECT *, size * 17.0::DOUBLE / sum(size) OVER () AS exact FROM s),
f AS (SELECT *, floor(exact) AS quota, row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, device DESC) AS place FROM q), a AS (SELECT device, quota + CASE WHEN place <= 17 - sum(quota) OVER () THEN 1 ELSE 0 END AS n FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY sha256('5|real|' || id), id) AS k FROM p)
SELECT id, r.device, CASE WHEN k <= n THEN 'val' ELSE 'train' END AS split FROM r JOIN a ON r.device = a.device
"""


def q_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts of an import, its devices as JSON."""
    part = _t(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("device"), F.array(F.col("p_size") * 100, F.lit(4000)).alias("raw_size"), (F.col("p_size") % 3).alias("boxes"), F.concat("p_type", F.lit(".rf.jpg")).alias("original_name"), F.sha2("p_name", 256).alias("raw_image_sha256"))
    out = datasets.import_summary(rows)
    return out.select("images", "boxes", "processed_filenames", "below_camera_resolution", F.to_json("devices").alias("devices"), F.size("raw_dimensions").alias("dimensions"))


SQL_IMPORT = """
WITH d AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1)
SELECT count(*) AS images, sum(p_size % 3)::BIGINT AS boxes, count(*) AS processed_filenames, count(*) FILTER (p_size * 100 < 3000) AS below_camera_resolution,
(SELECT '{' || string_agg('"' || b || '":' || n, ',' ORDER BY b) || '}' FROM d) AS devices, count(DISTINCT p_size)::INTEGER AS dimensions FROM part
"""


def q_manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of manifests, whatever the order of their rows."""
    rows = _t(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"))
    return tables.manifest_fingerprint(rows, ["o_orderpriority"], "id", "digest")


SQL_FINGERPRINT = """
WITH o AS (SELECT o_orderpriority, o_orderkey::VARCHAR AS i, sha256(o_custkey::VARCHAR) AS d, substr(sha256(o_orderkey::VARCHAR), 1, 3) AS p FROM orders),
h AS (SELECT o_orderpriority, p, sha256(string_agg(i || '=' || d, chr(10) ORDER BY i, d)) AS h FROM o GROUP BY 1, 2)
SELECT o_orderpriority, sha256(string_agg(h, chr(10) ORDER BY p)) AS fingerprint FROM h GROUP BY 1
"""


def q_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nested structs become dotted names, arrays become JSON."""
    nested = _t(spark, sf_dir, "supplier").select(F.struct(F.col("s_suppkey").alias("key"), F.struct(F.col("s_name").alias("text"), F.array("s_nationkey", F.lit(7)).alias("codes")).alias("name")).alias("supplier"), F.col("s_nationkey").alias("nation"))
    flat = nested.select(*tables.flatten(nested))
    return flat.toDF(*(name.replace(".", "__") for name in flat.columns))


SQL_FLATTEN_NESTED = """SELECT s_suppkey AS supplier__key, s_name AS supplier__name__text, '[' || s_nationkey || ',7]' AS supplier__name__codes, s_nationkey AS nation FROM supplier"""


def q_strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their rows, and the labels that strict readers would refuse."""
    marks = _t(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("quality") == 1, 0).otherwise(1_000_000)).alias("doc_id"), "toxic")
    found, refused = audits.strict_join(marks, _t(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])
    return found.select("doc_id", "toxic", "lang").unionByName(refused.select("doc_id", "toxic", F.lit(None).cast("string").alias("lang")))


SQL_STRICT = "WITH m AS (SELECT doc_id + CASE WHEN quality = 1 THEN 0 ELSE 1000000 END AS doc_id, toxic FROM labels) SELECT m.doc_id, toxic, lang FROM m LEFT JOIN documents d ON m.doc_id = d.doc_id"


def q_audit_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: manifest records against images in each split."""
    orders = _t(spark, sf_dir, "orders")
    return datasets.audit_generated(orders.select(F.col("o_orderstatus").alias("split")), orders.where("o_orderstatus = 'F' or o_orderkey % 2 = 0").select(F.col("o_orderstatus").alias("split")))


SQL_GENERATED = "SELECT o_orderstatus AS split, count(*) AS records, count(*) FILTER (o_orderstatus = 'F' OR o_orderkey % 2 = 0) AS images, count(*) = count(*) FILTER (o_orderstatus = 'F' OR o_orderkey % 2 = 0) AS ok FROM orders GROUP BY 1"


def q_audit_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: rules on backgrounds, maps, cut-outs and their splits."""
    grounds, maps = _assets(spark, sf_dir)
    number = F.regexp_extract("name", r"\d+", 0).cast("int")
    sized = lambda f, turn: f.select("name", (number % 7 + 1).alias("width"), F.when(number % turn == 0, number % 7 + 2).otherwise(number % 7 + 1).alias("height"))
    cut = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(1).alias("width"), F.lit(1).alias("height"), (F.col("s_suppkey") % 2).alias("opaque"))
    frozen = _t(spark, sf_dir, "supplier").select(F.lit("cutout").alias("kind"), F.col("s_name").alias("image"), F.lit("train").alias("split"))
    return datasets.audit_assets(sized(grounds, 9), sized(maps, 9), cut, frozen.unionByName(frozen.where("image like '%3'").withColumn("split", F.lit("val"))))


SQL_AUDIT_ASSETS = f"""WITH {_MAPS}, r(rule, actual) AS (SELECT 'backgrounds without map', (SELECT count(*) FROM part) - (SELECT count(*) FROM b) UNION ALL SELECT 'sizes that differ', 0 UNION ALL SELECT 'cutouts without alpha', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0)
UNION ALL SELECT 'assets in both splits', (SELECT count(*) FROM supplier WHERE s_name LIKE '%3') UNION ALL SELECT 'no backgrounds', 0 UNION ALL SELECT 'no cutouts', 0)
SELECT rule, 0::BIGINT AS expected, actual::BIGINT AS actual, actual = 0 AS ok FROM r"""


def q_history_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric column by its odd name, means over seeds."""
    history = _t(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.dayofmonth("ts").cast("string").alias("epoch"), F.col("value").cast("string").alias(" Metrics/mAP50-95(B) "), F.lit("0").alias("metrics/mAP50(B)"))
    name = series.metric_column(history.columns)
    return series.mean_curve(history, ["model"], "epoch", f"`{name}`").withColumn("mean", F.bround("mean", 6))


SQL_HISTORY = "SELECT event_type AS model, day(ts)::VARCHAR AS epoch, round_even(avg(value), 6) AS mean, count(value) AS seeds FROM events GROUP BY 1, 2"


def q_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: the stream's windowed counts, run over the whole table."""
    return progress.tumbling_counts(_t(spark, sf_dir, "events")).withColumn("value", F.bround("value", 4))


SQL_TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2"


def q_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: whether all rules of an audit hold."""
    from gridloom.plans.queries import q_audit_report

    return audits.ready(q_audit_report(spark, sf_dir))


SQL_READY = """
WITH r(ok) AS (SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 UNION ALL SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0
UNION ALL SELECT (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) = 0 UNION ALL SELECT (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') = '') = 0 UNION ALL SELECT (SELECT count(*) = count(DISTINCT doc_id) FROM documents))
SELECT bool_and(ok) AS ready, count(*) FILTER (NOT ok) AS errors FROM r
"""

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_") and f.__module__ == __name__}
ORACLE_SQL = {
    "q_path_helpers": SQL_PATHS, "q_box_conversion": SQL_CONVERSION, "q_label_lines": SQL_LINES, "q_collapse": SQL_COLLAPSE, "q_audit_tree": SQL_TREE, "q_annotations": SQL_ANNOTATIONS,
    "q_import_signals": SQL_SIGNALS, "q_coverage": SQL_COVERAGE, "q_select_by_validation": SQL_SELECT, "q_selected_runs": SQL_SELECTED_RUNS, "q_evaluation_summary": SQL_EVALUATION,
    "q_highlighted": SQL_HIGHLIGHTED, "q_ap_by_iou": SQL_AP, "q_best_confidence": SQL_CONFIDENCE, "q_annotation_stats": SQL_STATS, "q_count_pairs": SQL_COUNT_PAIRS,
    "q_counting_rows": SQL_COUNTING_ROWS, "q_overlay": SQL_OVERLAY, "q_curve_points": SQL_POINTS, "q_sample_seed": SQL_SEED, "q_run_order": SQL_RUN_ORDER, "q_filter_runs": SQL_FILTER_RUNS,
    "q_controlled_set": SQL_CONTROLLED, "q_depth_pairs": SQL_PAIRS, "q_unused_maps": SQL_UNUSED, "q_asset_split": SQL_ASSET_SPLIT, "q_preprocess_assets": SQL_PREPROCESS,
    "q_nested_training_sets": SQL_NESTED_SETS, "q_split_records": SQL_SPLIT_RECORDS, "q_import_summary": SQL_IMPORT, "q_manifest_fingerprint": SQL_FINGERPRINT,
    "q_flatten_nested": SQL_FLATTEN_NESTED, "q_strict_join": SQL_STRICT, "q_audit_generated": SQL_GENERATED, "q_audit_assets": SQL_AUDIT_ASSETS, "q_history_curve": SQL_HISTORY,
    "q_tumbling_counts": SQL_TUMBLING, "q_ready": SQL_READY,
}
