"""Inputs for the registered queries, derived from the driver tables with
SQL-expressible rules (the same rules appear in the DuckDB oracle SQL).

The driver tables hold no nulls, so nulls are injected by key:
numeric ``o_orderkey % 7 = 0``, categorical ``% 5 = 0``, target ``% 11 = 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators.split import with_split
from tabforge.sources.tables import table  # noqa: F401  (re-exported for queries)

SEED = 42


def orders_ml(spark: SparkSession, sf: str) -> DataFrame:
    """orders with nulls: x (price), c (priority), hc (customer id as text), y (status = 'O'),
    ys (status text), ynull (y with null targets), is_test (hash split on o_orderkey)."""
    return orders_ml_from(table(spark, sf, "orders"))


def orders_ml_from(o: DataFrame) -> DataFrame:
    """Same derivation over any orders-shaped DataFrame (also a stream)."""
    df = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("c"),
        F.col("o_custkey").cast("string").alias("hc"),
        F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0).alias("y"),
        F.col("o_orderstatus").alias("ys"),
        F.when(F.col("o_orderkey") % 11 != 0, F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)).alias("ynull"),
    )
    return with_split(df, ["o_orderkey"], SEED)


ORDERS_ML_SQL = """o AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS c,
         CAST(o_custkey AS VARCHAR) AS hc,
         CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
         o_orderstatus AS ys,
         CASE WHEN o_orderkey % 11 <> 0 THEN (CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) END::DOUBLE AS ynull,
         substr(md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), 1, 8) < '33333333' AS is_test
  FROM orders)"""


def lineitem_ml(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem for multiclass (l_returnflag) and regression (l_extendedprice); split on
    (l_orderkey, l_linenumber, l_partkey, l_suppkey); k5 = constant feature (zero-std branch)."""
    li = table(spark, sf, "lineitem")
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
                   "l_extendedprice", "l_returnflag", "l_linestatus", F.lit(5.0).alias("k5"))
    return with_split(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], SEED)


def lineitem_steps(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem_ml with targets that follow from l_quantity: a band, three levels as text and as numbers, a high price."""
    q = F.col("l_quantity")
    level = F.when(q <= 16, 0).when(q <= 33, 1).otherwise(2)
    return (lineitem_ml(spark, sf).withColumn("band", (level == 1).cast("int"))
            .withColumn("size", F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), level + 1))
            .withColumn("price", F.element_at(F.array(F.lit(10.0), F.lit(25.0), F.lit(70.0)), level + 1))
            .withColumn("dear", (F.col("l_extendedprice") > 40000).cast("int")))


def part_ml(spark: SparkSession, sf: str) -> DataFrame:
    """part with a hash split on p_partkey (one-feature least squares: p_retailprice on p_size)."""
    return with_split(table(spark, sf, "part"), ["p_partkey"], SEED)


LINEITEM_ML_SQL = """li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice,
         l_returnflag, l_linestatus, 5.0::DOUBLE AS k5,
         substr(md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))), 1, 8) < '33333333' AS is_test
  FROM lineitem)"""


LINEITEM_STEPS_SQL = LINEITEM_ML_SQL + """,
steps AS (SELECT *, CASE WHEN level = 1 THEN 1 ELSE 0 END::INTEGER AS band, ['low', 'mid', 'top'][level + 1] AS size,
                 [10.0::DOUBLE, 25.0, 70.0][level + 1] AS price, CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END::INTEGER AS dear
          FROM (SELECT *, CASE WHEN l_quantity <= 16 THEN 0 WHEN l_quantity <= 33 THEN 1 ELSE 2 END AS level FROM li))"""


def runlog_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Run-log tables derived from the driver tables: nation -> datasets, customer -> experiments,
    orders -> trained models (ranked by price within the customer) and status / promotion events."""
    from pyspark.sql import Window

    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    base = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    datasets = n.select(F.col("n_nationkey").cast("bigint").alias("dataset_id"), F.col("n_name").alias("name"),
                        (base + F.make_dt_interval(F.col("n_nationkey"), F.lit(0), F.lit(0), F.lit(0))).alias("created_at"))
    experiments = c.select(
        F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("bigint").alias("dataset_id"),
        F.when(F.col("c_custkey") % 2 == 0, "classification").otherwise("regression").alias("problem_type"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.col("c_custkey"), F.lit(0))).alias("created_at"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rn = F.row_number().over(w)
    models = o.select(
        F.col("o_orderkey").alias("model_id"), F.col("o_custkey").alias("experiment_id"),
        F.element_at(F.array(F.lit("Logistic Regression"), F.lit("Random Forest"), F.lit("Gradient Boosting")),
                     (F.col("o_orderkey") % 3 + 1).cast("int")).alias("algorithm_name"),
        F.col("o_totalprice").alias("primary_metric_value"),
        rn.alias("rn"))
    models = models.select(
        "model_id", "experiment_id", "algorithm_name", "primary_metric_value", "rn",
        F.when(F.col("model_id") % 13 == 0, F.lit(None)).when(F.col("model_id") % 17 == 0, F.lit(0))
        .otherwise(F.col("rn")).cast("int").alias("rank"))
    status = o.select(
        F.col("o_custkey").alias("experiment_id"), F.lit(None).cast("bigint").alias("model_id"), F.lit("status").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "training")
        .otherwise("failed").alias("status"),
        F.lit(None).cast("boolean").alias("deploy_api"), F.lit(None).cast("boolean").alias("deploy_batch"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("error "), F.col("o_orderkey").cast("string"))).alias("message"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    promo = models.where((F.col("rn") <= 2) | ((F.col("rn") == 3) & (F.col("experiment_id") % 3 == 0))).select(
        "experiment_id", "model_id", F.lit("promote").alias("kind"), F.lit(None).cast("string").alias("status"),
        (F.col("rn") != 2).alias("deploy_api"), (F.col("rn") >= 2).alias("deploy_batch"),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("rn").cast("bigint").alias("seq"))
    tomb = (n.where(F.col("n_nationkey") % 4 == 0).select(F.lit("dataset").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"))
            .unionByName(c.where(F.col("c_custkey") % 10 == 0).select(F.lit("experiment").alias("kind"), F.col("c_custkey").alias("id"))))
    return {"datasets": datasets, "experiments": experiments, "models": models.drop("rn"),
            "events": status.unionByName(promo), "tombstones": tomb}


RUNLOG_SQL = """ds AS (SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, n_name AS name,
                      TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS created_at FROM nation),
ex AS (SELECT c_custkey AS experiment_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS dataset_id,
              CASE WHEN c_custkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type,
              TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at FROM customer),
m0 AS (SELECT o_orderkey AS model_id, o_custkey AS experiment_id,
              CASE o_orderkey % 3 WHEN 0 THEN 'Logistic Regression' WHEN 1 THEN 'Random Forest' ELSE 'Gradient Boosting' END
                AS algorithm_name,
              o_totalprice AS primary_metric_value,
              row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
mo AS (SELECT model_id, experiment_id, algorithm_name, primary_metric_value, rn,
              CAST(CASE WHEN model_id % 13 = 0 THEN NULL WHEN model_id % 17 = 0 THEN 0 ELSE rn END AS INTEGER) AS rank
       FROM m0),
st AS (SELECT o_custkey AS experiment_id,
              CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'training' ELSE 'failed' END AS status,
              CASE WHEN o_orderstatus = 'P' THEN 'error ' || CAST(o_orderkey AS VARCHAR) END AS message,
              o_orderdate AS ts, o_orderkey AS seq FROM orders),
pr AS (SELECT experiment_id, model_id, rn <> 2 AS deploy_api, rn >= 2 AS deploy_batch, rn AS seq FROM mo
       WHERE rn <= 2 OR (rn = 3 AND experiment_id % 3 = 0)),
tb AS (SELECT 'dataset' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey % 4 = 0
       UNION ALL SELECT 'experiment', c_custkey FROM customer WHERE c_custkey % 10 = 0)"""


def attempt_log(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """runlog_tables with attempts: an experiment's models fall into three of them (o_orderkey % 3), the third of which
    fails half-way; an attempt commits at its newest model's order date."""
    t = runlog_tables(spark, sf)
    attempt = F.concat(F.lit("a"), (F.col("model_id") % 3).cast("string"))
    models = t["models"].withColumn("attempt_id", attempt)
    when = table(spark, sf, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("ts"))
    commits = (models.where(F.col("attempt_id") != "a2").join(when, "model_id").groupBy("experiment_id", "attempt_id")
               .agg(F.max("ts").alias("ts")).select("experiment_id", "attempt_id", "ts", F.lit("commit").alias("kind"), F.lit(4).cast("bigint").alias("seq")))
    return {**t, "models": models, "events": t["events"].unionByName(commits, allowMissingColumns=True)}


ATTEMPTS_SQL = RUNLOG_SQL + """,
ma AS (SELECT mo.*, 'a' || CAST(model_id % 3 AS VARCHAR) AS attempt_id, o_orderdate AS ts FROM mo JOIN orders ON o_orderkey = model_id),
cm AS (SELECT experiment_id, attempt_id, max(ts) AS ts FROM ma WHERE attempt_id <> 'a2' GROUP BY ALL),
lc AS (SELECT experiment_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ts DESC, attempt_id DESC) AS k
       FROM cm) WHERE k = 1),
vm AS (SELECT ma.* FROM ma JOIN lc USING (experiment_id, attempt_id))"""
