"""The operators on the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import audits, heatmap, labels, selection, series, splits, tables

MULTIPLIERS = [1, 2, 3, 5, 10]
BASE_SIZE = 5
SPLIT_SEED = 42


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_selection_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as models, market segments as conditions, order years as seeds: select, then compare to BUILDING."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("seed"))
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    runs = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("condition"), "seed").agg(F.avg("o_totalprice").alias("metric"))
    means = selection.candidate_means(runs, ["model", "condition"], "metric")
    means = means.withColumns({"mean": F.bround("mean", 2), "std": F.bround("std", 2)})
    best = selection.best_candidates(means, ["model"], "condition").select("model", F.col("condition").alias("selected"))
    out = selection.delta_against(means, ["model"], "condition", "BUILDING", "mean")
    out = out.join(best, "model")
    return out.select("model", "condition", "mean", "std", "runs", F.bround("delta", 2).alias("delta"), (F.col("selected") == F.col("condition")).alias("selected"))


SQL_SELECTION_DELTA = """
WITH r AS (SELECT o_orderpriority AS model, c_mktsegment AS condition, year(o_orderdate) AS seed, avg(o_totalprice) AS metric FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
m AS (SELECT model, condition, round_even(round_even(avg(metric), 6), 2) AS mean, round_even(round_even(coalesce(stddev_samp(metric), 0), 6), 2) AS std, count(*) AS runs FROM r GROUP BY 1, 2),
b AS (SELECT *, max(CASE WHEN condition = 'BUILDING' THEN mean END) OVER (PARTITION BY model) AS base, row_number() OVER (PARTITION BY model ORDER BY mean DESC, std, condition DESC) AS place FROM m)
SELECT model, condition, mean, std, runs, round_even(mean - base, 2) AS delta, place = 1 AS selected FROM b
"""


def q_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"))
    out = selection.metric_summary(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"])
    return out.select("l_returnflag", "l_linestatus", *(F.bround(c, 4).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))), "runs")


SQL_METRIC_SUMMARY = """
SELECT l_returnflag, l_linestatus, round_even(avg(l_quantity), 4) AS l_quantity_mean, round_even(stddev_samp(l_quantity), 4) AS l_quantity_std,
round_even(avg(l_discount), 4) AS l_discount_mean, round_even(stddev_samp(l_discount), 4) AS l_discount_std,
round_even(avg(nullif(l_tax, 0)), 4) AS l_tax_mean, round_even(stddev_samp(nullif(l_tax, 0)), 4) AS l_tax_std, count(*) AS runs FROM lineitem GROUP BY 1, 2
"""


def q_counting_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order against the rounded mean of its priority, as target and prediction."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("target"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    guess = orders.groupBy("o_orderpriority").agg(F.bround(F.avg("target"), 0).alias("predicted"))
    out = selection.counting_errors(orders.join(F.broadcast(guess), "o_orderpriority"), ["o_orderpriority"], "target", "predicted")  # five priorities
    return out.select("o_orderpriority", *(F.bround(c, 6).alias(c) for c in ("mae", "rmse", "bias")), "images")


SQL_COUNTING_ERROR = """
WITH l AS (SELECT l_orderkey, count(*) AS target FROM lineitem GROUP BY 1), o AS (SELECT o_orderpriority, target FROM orders JOIN l ON o_orderkey = l_orderkey),
e AS (SELECT o_orderpriority, round_even(avg(target) OVER (PARTITION BY o_orderpriority), 0) - target AS e FROM o)
SELECT o_orderpriority, round_even(avg(abs(e)), 6) AS mae, round_even(sqrt(avg(e * e)), 6) AS rmse, round_even(avg(e), 6) AS bias, count(*) AS images FROM e GROUP BY 1
"""


def q_alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("size"))
    return splits.largest_remainder(sizes, "c_mktsegment", "size", 26)


SQL_ALLOC = """
WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), q AS (SELECT *, size * 26.0::DOUBLE / sum(size) OVER () AS exact FROM s),
f AS (SELECT *, floor(exact) AS quota, row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, c_mktsegment DESC) AS place FROM q)
SELECT c_mktsegment, size, CAST(quota + CASE WHEN place <= 26 - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocation FROM f
"""


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 26, SPLIT_SEED)


SQL_STRATIFIED = """
WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), q AS (SELECT *, size * 26.0::DOUBLE / sum(size) OVER () AS exact FROM s),
f AS (SELECT *, floor(exact) AS quota, row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, c_mktsegment DESC) AS place FROM q),
a AS (SELECT c_mktsegment, quota + CASE WHEN place <= 26 - sum(quota) OVER () THEN 1 ELSE 0 END AS allocation FROM f),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|split|' || c_custkey), c_custkey) AS k FROM customer)
SELECT r.c_mktsegment, c_custkey, CASE WHEN k <= allocation THEN 'val' ELSE 'train' END AS split FROM r JOIN a ON r.c_mktsegment = a.c_mktsegment
"""


def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout_split(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", 0.8, SPLIT_SEED, "parts")


SQL_HOLDOUT = """
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY sha256('42|parts|' || p_partkey), p_partkey) AS k, count(*) OVER () AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN k <= least(greatest(round_even(n * 0.8::DOUBLE, 0), 1), n - 1) THEN 'train' ELSE 'val' END AS split FROM r
"""


def q_nested_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.nested_subsets(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", BASE_SIZE, MULTIPLIERS).select("multiplier", "doc_id", "lang")


SQL_NESTED = """
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS k FROM documents), m AS (SELECT unnest([1, 2, 3, 5, 10]) AS multiplier)
SELECT multiplier, doc_id, lang FROM r JOIN m ON k <= 5 * multiplier
"""


def _box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file for each part: two lines of text whose numbers come from size and price, some of them out of bounds."""
    p = _t(spark, sf_dir, "part")
    share = lambda m: ((F.col("p_partkey") * m) % 101).cast("double") / 100
    first = F.format_string("%d %.4f %.4f %.4f %.4f", (F.col("p_partkey") % 7 == 0).cast("int"), share(13), share(29), share(7) / 2, share(11) / 2)
    second = F.when(F.col("p_size") % 5 == 0, "0 0.5 x 0.1 0.1").when(F.col("p_size") % 3 == 0, "0 0.5 0.5 0.1").otherwise("0 0.5 0.5 0.25 0.25")
    return p.select("p_partkey", F.concat(first, F.lit("\n\n"), second, F.lit("\n")).alias("text"))


def q_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.validate_label_text(_box_lines(spark, sf_dir), "p_partkey")


SQL_LABEL_AUDIT = """
WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS cls, printf('%.4f', ((p_partkey * 13) % 101)::DOUBLE / 100)::DOUBLE AS x, printf('%.4f', ((p_partkey * 29) % 101)::DOUBLE / 100)::DOUBLE AS y,
printf('%.4f', ((p_partkey * 7) % 101)::DOUBLE / 100 / 2)::DOUBLE AS w, printf('%.4f', ((p_partkey * 11) % 101)::DOUBLE / 100 / 2)::DOUBLE AS h, p_size FROM part),
e AS (SELECT p_partkey, CASE WHEN cls <> 0 THEN 'class' WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1) THEN 'coordinates'
WHEN x - w / 2 < -1e-6 OR x + w / 2 > 1 + 1e-6 THEN 'horizontal' WHEN y - h / 2 < -1e-6 OR y + h / 2 > 1 + 1e-6 THEN 'vertical' END AS one,
CASE WHEN p_size % 5 = 0 THEN 'numeric' WHEN p_size % 3 = 0 THEN 'fields' END AS two FROM f)
SELECT p_partkey, CASE WHEN one IS NULL AND two IS NULL THEN 2::BIGINT END AS boxes, CASE WHEN one IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 3 END::INTEGER AS error_line, coalesce(one, two) AS error FROM e
"""


def q_device_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    given = F.when(F.col("page_id") % 5 == 0, "pixel")
    exif = F.when(F.col("page_id") % 3 == 0, " Apple iPhone 13 ").when(F.col("page_id") % 3 == 1, "Google")
    return pages.select("page_id", labels.infer_device(given, "url", exif).alias("d")).select("page_id", "d.device", "d.device_source")


SQL_DEVICE = """
WITH p AS (SELECT page_id, lower(url) AS u FROM pages), d AS (SELECT page_id, CASE WHEN u LIKE '%iphone%' OR u LIKE '%apple%' THEN 'iphone' WHEN u LIKE '%pixel%' OR u LIKE '%google%' THEN 'pixel' END AS path FROM p)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pixel' WHEN path IS NOT NULL THEN path WHEN page_id % 3 = 0 THEN 'iphone' WHEN page_id % 3 = 1 THEN 'pixel' ELSE 'unknown' END AS device,
CASE WHEN page_id % 5 = 0 THEN 'metadata' WHEN path IS NOT NULL THEN 'path' WHEN page_id % 3 IN (0, 1) THEN 'exif' ELSE 'unavailable' END AS device_source FROM d
"""


def q_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.exact_duplicates(_t(spark, sf_dir, "documents"), "text", "doc_id")


SQL_DUPLICATES = "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def q_pair_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.pair_parity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


SQL_PARITY = "SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS left_only, count(*) FILTER (a.doc_id IS NULL) AS right_only FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id"


def q_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the odd half whose normalised text also stands in the even half."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.lower("text")), 256).alias("sha256"))
    return audits.leakage(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "sha256").select("doc_id", "sha256")


SQL_LEAKAGE = "WITH d AS (SELECT doc_id, sha256(trim(lower(text))) AS sha256 FROM documents) SELECT doc_id, sha256 FROM d WHERE doc_id % 2 = 1 AND sha256 IN (SELECT sha256 FROM d WHERE doc_id % 2 = 0)"


def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order that is finished."""
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey")
    return audits.orphans(customers, urgent, F.col("c_custkey") == F.col("o_custkey"))


SQL_ORPHANS = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


def q_prioritised_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the line that matches it best: returned first, then open, then the earliest order."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("priority"), "l_orderkey", "l_linenumber")
    return audits.prioritised_match(_t(spark, sf_dir, "part").select("p_partkey"), lines, ["p_partkey"], ["p_partkey"], "priority")


SQL_PRIORITISED = """
WITH l AS (SELECT l_partkey AS p_partkey, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS priority, l_orderkey, l_linenumber FROM lineitem)
SELECT p_partkey, priority, l_orderkey, l_linenumber FROM l SEMI JOIN part USING (p_partkey) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority, l_orderkey, l_linenumber) = 1
"""


def q_grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = _t(spark, sf_dir, "region").select(F.col("r_name").alias("condition"))
    models = _t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".pt")).alias("model")).distinct()
    grid = selection.expand_grid([conditions, models, spark.createDataFrame([(41,), (42,)], "seed int")])
    canonical = F.concat(F.lit('{"condition":'), X.json_string("condition"), F.lit(',"model":'), X.json_string("model"), F.lit("}"))
    return grid.select("condition", "model", "seed", X.stable_hash(canonical).alias("candidate_id"), X.run_id("condition", X.stem("model"), "seed", F.sha2(canonical, 256)).alias("run_id"))


SQL_GRID = """
WITH g AS (SELECT r_name AS condition, model, seed FROM region, (SELECT DISTINCT p_brand || '.pt' AS model FROM part), (SELECT unnest([41, 42]) AS seed)),
h AS (SELECT *, sha256('{"condition":"' || condition || '","model":"' || model || '"}') AS digest FROM g)
SELECT condition, model, seed, substr(digest, 1, 12) AS candidate_id, condition || '__' || replace(model, '.pt', '') || '__s' || seed || '__' || substr(digest, 1, 10) AS run_id FROM h
"""


def q_dim_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").alias("width"), F.floor(F.col("p_retailprice") / 100).cast("int").alias("height"))
    return tables.histogram(rows, ["width", "height"]).select(F.concat_ws("x", "width", "height").alias("size"), "width", "height", "n")


SQL_HISTOGRAM = "SELECT p_size || 'x' || floor(p_retailprice / 100)::INTEGER AS size, p_size AS width, floor(p_retailprice / 100)::INTEGER AS height, count(*) AS n FROM part GROUP BY ALL"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_returnflag").alias("dataset"), "l_orderkey", (F.col("l_quantity") / 50).alias("center_x"), (F.col("l_discount") * 10).alias("center_y"), (F.col("l_tax") + 0.01).alias("width"), (F.col("l_linenumber") / 40.0).alias("height"))


def q_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    cells = heatmap.heat(boxes, boxes.select("dataset", "l_orderkey").distinct(), ["dataset"], 16)
    return cells.select("dataset", "y", "x", F.col("boxes").cast("long").alias("boxes"), F.bround("value", 6).alias("value"), F.bround("share", 6).alias("share"))


SQL_HEATMAP = """
WITH b AS (SELECT l_returnflag AS dataset, l_quantity / 50 AS cx, l_discount * 10 AS cy, l_tax + 0.01::DOUBLE AS w, l_linenumber / 40.0::DOUBLE AS h FROM lineitem),
c AS (SELECT dataset, greatest(0, floor((cx - w / 2) * 16))::INTEGER AS l, greatest(0, floor((cy - h / 2) * 16))::INTEGER AS t, ceil((cx + w / 2) * 16)::INTEGER AS r, ceil((cy + h / 2) * 16)::INTEGER AS bt FROM b),
s AS (SELECT dataset, l, t, least(16, greatest(l + 1, r)) AS r, least(16, greatest(t + 1, bt)) AS bt, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT l_returnflag AS dataset, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1),
g AS (SELECT dataset, y, x, files FROM f, (SELECT unnest(range(16))::INTEGER AS y), (SELECT unnest(range(16))::INTEGER AS x)),
v AS (SELECT g.dataset, g.y, g.x, coalesce(sum(n), 0)::BIGINT AS boxes, coalesce(sum(n), 0)::DOUBLE / any_value(files) AS value FROM g LEFT JOIN s ON g.dataset = s.dataset AND x >= l AND x < r AND y >= t AND y < bt GROUP BY 1, 2, 3)
SELECT dataset, y, x, boxes, round_even(value, 6) AS value, round_even(value / max(value) OVER (), 6) AS share FROM v
"""


def q_curve_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return series.mean_curve(events, ["event_type"], "day", "value").withColumn("mean", F.bround("mean", 6))


SQL_CURVE = "SELECT event_type, ts::DATE AS day, round_even(avg(value), 6) AS mean, count(value) AS seeds FROM events GROUP BY 1, 2"


def q_eta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.bround("value", 0).alias("seconds"), (F.col("event_type") != "error").alias("ok"))
    out = series.estimates(events, ["user_id"], ["ts", "event_id"], "seconds", "ok", F.to_date("ts"))
    return out.select("event_id", "user_id", "seconds", "estimate", X.eta("estimate", "seconds").alias("eta"))


SQL_ETA = f"""
WITH e AS (SELECT event_id, user_id, ts, round_even(value, 0) AS seconds, event_type <> 'error' AS ok FROM events),
n AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
l AS (SELECT *, last_value(CASE WHEN ok AND (k = 1 OR seconds >= 60) THEN seconds END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS estimate FROM n),
d AS (SELECT *, (estimate - seconds)::BIGINT AS s FROM l)
SELECT event_id, user_id, seconds, estimate, CASE WHEN estimate IS NULL THEN '{X.NO_HISTORY}' WHEN s <= 0 THEN '{X.OVER_HISTORY}' ELSE printf('~%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) END AS eta FROM d
"""


def q_running_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,4)").alias("value"))
    out = series.running_seconds(events, ["user_id"], ["ts", "event_id"], "value", F.to_date("ts"))
    return out.select("event_id", "user_id", F.col("total_seconds").cast("double").alias("total_seconds"))


SQL_RUNNING = "SELECT event_id, user_id, round_even(sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2)::DOUBLE AS total_seconds FROM events"


def q_flatten_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.json_entries(_t(spark, sf_dir, "events"), ["event_id"], "props")


SQL_FLATTEN = "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)"


def q_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's links as fields of a form, of which a repeated name counts by its last value."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", '<a href="([^"]*)">([^<"]*)', '<input name="$1" value="$2"').alias("html"))
    return pages.select("page_id", F.explode(X.form_fields("html")).alias("name", "value"))


SQL_FORM = r"""
WITH p AS (SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<"]*)', '<input name="\1" value="\2"', 'g') AS html FROM pages),
m AS (SELECT page_id, regexp_extract_all(html, 'name="([^"]+)"\s+value="([^"]*)"', 1) AS n, regexp_extract_all(html, 'name="([^"]+)"\s+value="([^"]*)"', 2) AS v FROM p)
SELECT page_id, n[i] AS name, v[i] AS value FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM m) QUALIFY row_number() OVER (PARTITION BY page_id, n[i] ORDER BY i DESC) = 1
"""


def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _t(spark, sf_dir, "nation")
    return nations.select("n_nationkey", X.slug(F.concat(F.lit(" --"), "n_name", F.lit(" / Região!"))).alias("slug"), X.duration(F.col("n_nationkey") * 1234.5).alias("duration"), X.count_noun("n_nationkey", "image", "images").alias("counted"), X.number(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 8)).alias("number"), X.html_escape(F.concat("n_name", F.lit(" <a href='x'> & \"b\""))).alias("escaped"))


SQL_SLUG = """
SELECT n_nationkey, trim(regexp_replace(lower(' --' || n_name || ' / Região!'), '[^a-z0-9_-]+', '-', 'g'), '-') AS slug,
printf('%02d:%02d:%02d', round_even(n_nationkey * 1234.5, 0)::BIGINT // 3600, (round_even(n_nationkey * 1234.5, 0)::BIGINT // 60) % 60, round_even(n_nationkey * 1234.5, 0)::BIGINT % 60) AS duration,
n_nationkey || ' ' || CASE WHEN n_nationkey = 1 THEN 'image' ELSE 'images' END AS counted, CASE WHEN n_nationkey % 2 = 0 THEN printf('%.4f', n_nationkey / 8::DOUBLE) ELSE '—' END AS number,
n_name || ' &lt;a href=&#x27;x&#x27;&gt; &amp; &quot;b&quot;' AS escaped FROM nation
"""


def q_ordered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.ordered_hash(rows, ["r_name"], ["n_nationkey"], ["n_nationkey", "n_name"])


SQL_ORDERED = """
SELECT r_name, sha256('[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || ']') AS sha256, count(*) AS records FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
"""


def q_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    x, y = (F.col("l_quantity") * 4).alias("x0"), (F.col("l_discount") * 1000).alias("y0")
    boxes = lines.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("ordinal"), x, y).withColumns({"x1": F.col("x0") + 40 + F.col("ordinal"), "y1": F.col("y0") + 30})
    return tables.overlapping_pairs(boxes, "scene", "ordinal").withColumn("area", F.bround("area", 3))


SQL_OVERLAP = """
WITH b AS (SELECT l_orderkey AS scene, l_linenumber AS ordinal, l_quantity * 4 AS x0, l_discount * 1000 AS y0 FROM lineitem), c AS (SELECT *, x0 + 40 + ordinal AS x1, y0 + 30 AS y1 FROM b)
SELECT a.scene, a.ordinal AS earlier, b.ordinal AS later, round_even((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) AS area FROM c a JOIN c b ON a.scene = b.scene AND a.ordinal < b.ordinal
WHERE greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
"""


def q_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.array_statistics(_t(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 0.65, 0.5)
    return out.select("vec_id", *(F.bround(c, 5).alias(c) for c in ("quantile", "median", "mean", "std")), "first", "past_last")


SQL_PIXELS = """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round_even(quantile_cont(v, 0.65), 5) AS quantile, round_even(median(v), 5) AS median, round_even(avg(v), 5) AS mean, round_even(stddev_pop(v), 5) AS std,
min(k) FILTER (v >= 0.5)::INTEGER AS first, (max(k) FILTER (v >= 0.5) + 1)::INTEGER AS past_last FROM e GROUP BY 1
"""


def q_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    customers = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    return tables.union_columns([suppliers, customers], ["name", "nation"])


SQL_UNION = "SELECT s_name AS name, s_nationkey AS nation, NULL AS c_mktsegment, s_acctbal FROM supplier UNION ALL SELECT c_name, c_nationkey, c_mktsegment, NULL FROM customer"


def q_colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("p_size") / 50.0
    parts = _t(spark, sf_dir, "part").select("p_partkey", *(X.colour_ramp(share, k).alias(c) for k, c in enumerate(("red", "green", "blue"))), X.hue_wrap(F.col("p_size") * 5, F.col("p_partkey") % 256).alias("hue"))
    return parts


SQL_RAMP = "WITH p AS (SELECT p_partkey, p_size, p_size / 50.0::DOUBLE AS s FROM part) SELECT p_partkey, " + ", ".join(
    "CAST(round_even(CASE " + " ".join(f"WHEN s < {b[0]} THEN {float(a[k])}::DOUBLE + (s - {a[0]}::DOUBLE) / {b[0] - a[0]}::DOUBLE * {float(b[k] - a[k])}::DOUBLE" for a, b in zip(X.PALETTE, X.PALETTE[1:], strict=False)) + f" ELSE {float(X.PALETTE[-1][k])} END, 0) AS INTEGER) AS {c}"
    for k, c in ((1, "red"), (2, "green"), (3, "blue"))
) + ", ((((p_size * 5 - p_partkey % 256 + 128) % 256) + 256) % 256 - 128)::BIGINT AS hue FROM p"


def q_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks, orders, lines = (_t(spark, sf_dir, n) for n in ("documents", "labels", "orders", "lineitem"))
    orphan_labels = audits.orphans(marks.select("doc_id"), docs.select(F.col("doc_id").alias("d")), F.col("doc_id") == F.col("d"))
    orphan_lines = audits.orphans(lines.select("l_orderkey"), orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    copies = audits.exact_duplicates(docs, "text", "doc_id")
    return audits.report([
        audits.rule("labels without document", orphan_labels, F.count("*"), 0), audits.rule("lines without order", orphan_lines, F.count("*"), 0), audits.rule("repeated texts", copies, F.count("*"), 0),
        audits.rule("documents without text", docs, F.count_if(F.coalesce(F.trim("text"), F.lit("")) == ""), 0), audits.rule("distinct documents", docs, F.count_distinct("doc_id"), F.count("*")),
    ])


SQL_AUDIT = """
WITH r(rule, expected, actual) AS (SELECT 'labels without document', 0::BIGINT, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT
UNION ALL SELECT 'lines without order', 0, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'repeated texts', 0, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1))
UNION ALL SELECT 'documents without text', 0, (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') = '')
UNION ALL SELECT 'distinct documents', (SELECT count(*) FROM documents), (SELECT count(DISTINCT doc_id) FROM documents))
SELECT rule, expected, actual, expected = actual AS ok FROM r
"""

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
ORACLE_SQL = {
    "q_selection_delta": SQL_SELECTION_DELTA, "q_metric_summary": SQL_METRIC_SUMMARY, "q_counting_error": SQL_COUNTING_ERROR, "q_alloc_largest_remainder": SQL_ALLOC,
    "q_stratified_split": SQL_STRATIFIED, "q_holdout_split": SQL_HOLDOUT, "q_nested_prefix": SQL_NESTED, "q_label_audit": SQL_LABEL_AUDIT, "q_device_normalise": SQL_DEVICE,
    "q_exact_duplicates": SQL_DUPLICATES, "q_pair_parity": SQL_PARITY, "q_split_leakage": SQL_LEAKAGE, "q_orphans": SQL_ORPHANS, "q_prioritised_match": SQL_PRIORITISED,
    "q_grid_expand": SQL_GRID, "q_dim_histogram": SQL_HISTOGRAM, "q_heatmap": SQL_HEATMAP, "q_curve_mean": SQL_CURVE, "q_eta_fold": SQL_ETA, "q_running_seconds": SQL_RUNNING,
    "q_flatten_config": SQL_FLATTEN, "q_form_fields": SQL_FORM, "q_slug": SQL_SLUG, "q_ordered_hash": SQL_ORDERED, "q_box_overlap": SQL_OVERLAP, "q_pixel_stats": SQL_PIXELS,
    "q_union_schema": SQL_UNION, "q_colour_ramp": SQL_RAMP, "q_audit_report": SQL_AUDIT,
}
