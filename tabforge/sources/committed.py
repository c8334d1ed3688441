"""Results that become visible as a whole (A5, I8): rows, then one commit row with the facts of the write.

``{path}/rows/{attempt}`` holds one attempt's files and ``{path}/commits`` one small row for each
attempt that ended.  Readers go through the commits, so a killed job leaves files but no
result, and a job that runs again is a new attempt; the newest commit is the result.

The facts (row count, nulls, least, greatest and mean of the observed columns, whether any text holds a line break)
are aggregated by the tasks that write the rows (``observe``), so no row is read again to be counted.
They sit in the last stage, where a task that is lost and repeated counts once.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.exprs import na_string_to_null, qcol
from tabforge.sources.csv import read_csv_text, write_csv

COMMITS = T.StructType([
    T.StructField("attempt_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("fmt", T.StringType()),
    T.StructField("num_rows", T.LongType()), T.StructField("facts", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("row_schema", T.StringType()), T.StructField("committed_at", T.TimestampNTZType())])


@dataclass
class Commit:
    attempt_id: str
    path: str
    fmt: str
    num_rows: int
    facts: dict
    row_schema: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.row_schema))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The committed rows in the types they were written with; nothing is read to find types or line breaks."""
        if self.fmt != "csv":
            return spark.read.schema(self.schema).format(self.fmt).load(self.path)
        if not self.num_rows:
            return spark.createDataFrame([], self.schema)
        text = read_csv_text(spark, self.path, multi_line=None if self.facts.get("line_breaks") else False)
        return text.select(*[na_string_to_null(qcol(t)).cast(f.dataType).alias(f.name)
                             for t, f in zip(text.columns, self.schema.fields)])


def _metrics(df: DataFrame, observed: list[str]) -> list:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    broken = [qcol(c).rlike("[\r\n]") for c in text]
    out = [F.count(F.lit(1)).alias("num_rows"),
           F.coalesce(F.max(F.greatest(F.lit(0), *[F.coalesce(b, F.lit(False)).cast("int") for b in broken]) if broken
                            else F.lit(0)), F.lit(0)).alias("line_breaks")]
    for c in observed:
        out.append(F.sum(F.when(qcol(c).isNull(), 1).otherwise(0)).alias(f"nulls:{c}"))
        if isinstance(df.schema[c].dataType, T.NumericType):
            v = qcol(c).cast("double")
            out += [F.min(v).alias(f"min:{c}"), F.max(v).alias(f"max:{c}"), F.avg(v).alias(f"mean:{c}")]
    return out


def write_committed(df: DataFrame, path: str, fmt: str = "parquet", observed: list[str] = ()) -> Commit:
    """Writes all rows of ``df`` as one attempt and commits it.  An empty ``df`` is a result of no rows."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    target = f"{path.rstrip('/')}/rows/{attempt}"
    seen = Observation(f"write-{attempt}")
    watched = df.observe(seen, *_metrics(df, list(observed)))
    if fmt == "csv":
        write_csv(watched, target)
    else:
        watched.write.mode("errorifexists").format(fmt).save(target)
    got = dict(seen.get)
    num_rows = int(got.pop("num_rows", 0) or 0)
    facts = {k: float(v) for k, v in got.items() if v is not None}
    done = Commit(attempt, target, fmt, num_rows, facts, df.schema.json())
    row = (attempt, target, fmt, num_rows, facts, done.row_schema, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")
    return done


def last_commit(spark: SparkSession, path: str) -> Commit | None:
    """The newest commit under ``path`` (of equal times the greatest attempt id), or None where no attempt has ended."""
    from pyspark.errors import AnalysisException
    try:
        r = (spark.read.schema(COMMITS).parquet(f"{path.rstrip('/')}/commits")
             .orderBy(F.desc("committed_at"), F.desc("attempt_id")).first())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Commit(r["attempt_id"], r["path"], r["fmt"], r["num_rows"], dict(r["facts"]), r["row_schema"]) if r else None


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest commit under ``path``."""
    done = last_commit(spark, path)
    if done is None:
        raise FileNotFoundError(f"no committed result under {path}")
    return done.rows(spark)
