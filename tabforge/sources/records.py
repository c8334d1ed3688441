"""JSON records source (A3): a list of objects becomes rows, absent keys are null.

Feature fields are read as *text* and coerced with ``try_cast`` afterwards: a
``double`` field in the read schema would silently turn the text "30" into null.

Where the fields are not listed, one distributed pass finds the union of the records' keys: each key's first place (record,
then position in it) is a grouped minimum, so what comes to the driver is one row a key, and the read
that follows is typed by it.  Objects that are not valid JSON have no keys and give a row of nulls; a key that
an object repeats counts at its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType(), True) for f in fields])


MAX_KEYS = 10_000  # a table with more columns than this is no table: records are keyed by data


def record_keys(df: DataFrame, record: Column, order: list[Column] | None = None) -> list[str]:
    """The union of the keys of a column of JSON objects, in order of first appearance by ``order`` (None: the order of the
    scan, file by file)."""
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    keys = df.select(place.alias("place"), F.posexplode(F.json_object_keys(record)).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("place", "pos")).alias("first"))
    found = [r["key"] for r in first.orderBy("first", "key").limit(MAX_KEYS + 1).collect()]
    if len(found) > MAX_KEYS:
        raise ValueError(f"the records have over {MAX_KEYS} different keys")
    return found


def parse_all_records(df: DataFrame, record: str, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (None: all other columns) and one text column for every key that any record has.  Key columns replace
    kept columns of the same name; of keys that differ only in case the later ones' columns are numbered."""
    keys = record_keys(df, F.col(record), [F.col(c) for c in order] if order else None)
    taken = {k.lower() for k in keys}
    kept = [c for c in (df.columns if keep is None else keep) if c != record and c.lower() not in taken]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    named = column_names(keys)
    alone = [k for k in keys if named[k] == k]
    parsed = df.select(*[quoted(c) for c in kept], F.col(record).alias("__t"), parse_records(F.col(record), alone).alias("__r") if alone else F.lit(None).alias("__r"))
    value = {k: F.col("__r").getField(k) if named[k] == k else F.try_element_at(F.from_json("__t", "map<string,string>"), F.lit(k)) for k in keys}
    return parsed.select(*[quoted(c) for c in kept], *[value[k].alias(named[k]) for k in keys])


def column_names(keys: list[str]) -> dict[str, str]:
    """A column for each key: Spark's names don't differ by case, so a later key that differs from another in nothing else gets a number."""
    taken, named = {k.lower() for k in keys}, {}
    used: set[str] = set()
    for k in keys:
        name, n = k, 2
        while name.lower() in used or (name != k and name.lower() in taken):
            name, n = f"{k}_{n}", n + 1
        used.add(name.lower())
        named[k] = name
    return named


def read_records(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """JSON lines (one object per line) with every listed key read as text; without a list, every key that occurs."""
    if fields is None:
        return parse_all_records(spark.read.text(path), "value", keep=[])
    return spark.read.schema(text_schema(fields)).json(path)


def parse_records(col: Column, fields: list[str]) -> Column:
    """``from_json`` of an object column into a struct of text fields."""
    return F.from_json(col, text_schema(fields))


def payload_schema(fields: list[str]) -> T.StructType:
    """The scoring payload: {"data": [{...}, ...], "return_probabilities": bool}."""
    return T.StructType([T.StructField("data", T.ArrayType(text_schema(fields)), True),
                         T.StructField("return_probabilities", T.BooleanType(), True)])


def explode_payload(df: DataFrame, payload_col: str, fields: list[str]) -> DataFrame:
    """One row per record of each payload (distributed; no payload goes through the driver)."""
    p = F.from_json(F.col(payload_col), payload_schema(fields))
    return (df.select(p.alias("__p")).select(F.posexplode("__p.data").alias("record_index", "__r"),
                                            F.col("__p.return_probabilities").alias("return_probabilities"))
            .select("record_index", "return_probabilities", *[F.col(f"__r.`{f}`").alias(f) for f in fields]))
