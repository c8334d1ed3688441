"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (a few KB of source through Spark's own file service), so that
    tasks import it by name and keep their bounded per-worker caches from task to task.  Rows here are whole
    documents: where the session has Spark's default of 10,000 rows a batch to Python, that becomes ``BATCH_ROWS``."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if getattr(sc, "_tabforge_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join(os.path.basename(top), os.path.relpath(p, top)))
    path = os.path.join(tempfile.mkdtemp(prefix="tabforge-"), "tabforge_src.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._tabforge_shipped = True


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from the stems that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those called like ``names``, in any case of their letters."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    """A column's name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted_column(name: str) -> Column:
    return F.col(quoted(name))


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (the contracts' label folds); null ids are in bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """One 0/1 label per id: null ids and labels other than 0 and 1 are left out, of several the largest counts."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return ok.groupBy("doc_id").agg(F.max(label).cast("int").alias(label))


def md5_long(*cols) -> Column:
    """A 60-bit whole number from the md5 of the columns' texts joined by '|' (null: the word null)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
