"""CSV with newlines in quoted fields, read by all tasks: a quote-state prefix scan over byte ranges.

Whether a line begins inside a quoted field depends on everything before it, but what a line *does* to that state does not: it
maps "outside" and "inside" each to one of the two.  So every byte range (a split of Spark's text reader) composes
its lines' maps without knowing how it begins; a prefix over the few ranges of a file gives each one its beginning, and the
second pass joins the lines of a record inside each range.  Only records that cross from a range into later ones go
through a shuffle, as pieces, one record a range at most.  Lines map the states by built-in expressions; Python sees Arrow
batches of two flags a line in the first pass and joins the lines of records in the second.

Records are then parsed one by one with Spark's CSV parser.  A quote opens a field only where the field begins, a doubled quote
inside is a quote, and what follows a closing quote up to the separator belongs to the field.  Lines end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _class(sep: str) -> str:
    return "[" + ("\\" if sep in "\\^]-[&" else "") + sep + "]"


def opens(line: Column, sep: str) -> Column:
    """Whether a line that begins a record ends inside a quoted field."""
    single = F.regexp_replace(line, '""', "")
    return F.regexp_replace(single, f'(^|{_class(sep)})"[^"]*"', "$1").rlike(f'(^|{_class(sep)})"[^"]*$')


def stays(line: Column, sep: str) -> Column:
    """Whether a line that begins inside a quoted field ends inside one, the same or a later one."""
    single = F.regexp_replace(line, '""', "")
    # what follows the closing quote is not at a field's beginning
    rest = F.concat(F.lit("x"), F.regexp_replace(single, '^[^"]*"', ""))
    again = F.regexp_replace(rest, f'{_class(sep)}"[^"]*"', sep if sep not in "\\$" else "\\" + sep).rlike(f'{_class(sep)}"[^"]*$')
    return ~F.contains(single, F.lit('"')) | again


def lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, start (of the byte range), value, and what the line does to either state; a range's rows in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
                       opens(F.col("value"), sep).alias("opens"), stays(F.col("value"), sep).alias("stays"))


def has_open_quotes(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether some line, read as a record of its own, ends inside a quoted field.  One splittable pass, ended at the first hit."""
    return not lines(spark, path, sep).where("opens").isEmpty()


def after_each(opens_: np.ndarray, stays_: np.ndarray, inside: bool) -> np.ndarray:
    """The state after each line, given the one before the first: a line that doesn't look at the state sets it, others keep
    it or turn it around."""
    n = len(opens_)
    sets = opens_ == stays_
    turns = np.cumsum(opens_ & ~stays_)
    last = np.maximum.accumulate(np.where(sets, np.arange(n), -1))
    base = np.where(last >= 0, opens_[last], inside)
    done = np.where(last >= 0, turns[last], 0)
    return base ^ ((turns - done) % 2 == 1)


def range_maps(marked: DataFrame) -> DataFrame:
    """file, start, from_out, from_in: where each byte range leads from either state, and n_records, out and in: how many
    records begin in it then."""
    follow = after_each

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            starts = b.column("start").to_numpy()
            files = b.column("file").dictionary_encode()
            codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
            o, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
            edge = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
            for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(starts)], strict=True):
                at = state.setdefault((names[codes[a]], int(starts[a])), [False, True, 0, 0])
                for j in (0, 1):
                    after = follow(o[a:z], s[a:z], at[j])
                    at[j + 2] += int((~np.append(at[j], after[:-1])).sum())
                    at[j] = bool(after[-1])
        yield pa.RecordBatch.from_pylist([{"file": f, "start": p, "from_out": x[0], "from_in": x[1], "n_out": x[2], "n_in": x[3]} for (f, p), x in state.items()],
                                         pa.schema([("file", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()),
                                                    ("n_out", pa.int64()), ("n_in", pa.int64())]))

    return marked.select("file", "start", "opens", "stays").mapInArrow(
        compose, "file string, start long, from_out boolean, from_in boolean, n_out long, n_in long")


def range_starts(maps: DataFrame) -> DataFrame:
    """file, start, inside (the state before the range), goes_on (its last record has lines in later ranges), owner (the range in which the record that
    this one begins inside of began).  One group a file, one row a range."""
    def prefix(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values("start")
        inside, owner, out = False, -1, []
        for r in ranges.itertuples():
            began = r.n_in if inside else r.n_out
            after = bool(r.from_in if inside else r.from_out)
            out.append((r.file, r.start, inside, after, owner))
            if began:
                owner = r.start
            inside = after
        return pd.DataFrame(out, columns=["file", "start", "inside", "goes_on", "owner"])

    return maps.groupBy("file").applyInPandas(prefix, "file string, start long, inside boolean, goes_on boolean, owner long")


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """first (whether the record is its file's first) and value: the records' whole texts."""
    marked = lines(spark, path, sep)
    # as many rows as byte ranges: what a file listing has
    known = {(r["file"], r["start"]): (r["inside"], r["goes_on"], r["owner"]) for r in range_starts(range_maps(marked)).collect()}
    shared = spark.sparkContext.broadcast(known)
    follow = after_each

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records (piece null) and pieces of records that cross ranges (owner: the range where the record began)."""
        now, inside, first, waiting, seen, owner = None, False, False, [], 0, -1
        kind = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("value", pa.string())])

        def ended() -> dict | None:
            """What is left of a range at its end: a record, or a piece of one that goes on in the next range."""
            if now is None or not waiting:
                return None
            text = "\n".join(waiting)
            began = seen > 0
            crosses = shared.value[now][1] or not began
            return {"file": now[0] if crosses else None, "owner": (now[1] if began else owner) if crosses else None,
                    "start": now[1], "first": first, "value": text}

        for b in batches:
            out: list[dict] = []
            values, starts = b.column("value"), b.column("start").to_numpy()
            files = b.column("file").dictionary_encode()
            codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
            o, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
            edge = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1 if len(starts) else []
            for a, z in zip([0, *list(edge)], [*list(edge), len(starts)], strict=True) if len(starts) else []:
                here = names[codes[a]], int(starts[a])
                if here != now:
                    if (rest := ended()):
                        out.append(rest)
                    now, waiting, seen = here, [], 0
                    inside, _, owner = shared.value[here]
                    first = here[1] == 0
                after = follow(o[a:z], s[a:z], inside)
                begins = np.flatnonzero(~np.append(inside, after[:-1]))
                inside = bool(after[-1])
                text = values.slice(a, z - a).to_pylist()
                at = 0
                for k in begins.tolist():
                    waiting += text[at:k]
                    at = k
                    if waiting:  # the record before is complete; one that began in an earlier range is its last piece
                        crosses = not seen
                        out.append({"file": now[0] if crosses else None, "owner": owner if crosses else None, "start": now[1],
                                    "first": first and seen == 1, "value": "\n".join(waiting)})
                        waiting = []
                    first = first and seen == 0
                    seen += 1
                waiting += text[at:]
            yield pa.RecordBatch.from_pylist(out, kind)
        if (rest := ended()):
            yield pa.RecordBatch.from_pylist([rest], kind)

    def joined(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(join, "file string, owner long, start long, first boolean, value string")

    inner = joined(marked).where("file IS NULL").select("first", "value")
    # only ranges that a record crosses are looked at again for its pieces, one piece a range
    crossed = [k for k, (inside, goes_on, _) in known.items() if inside or goes_on]
    if not crossed:
        return inner
    some = F.broadcast(spark.createDataFrame(crossed, "file string, start long"))
    pieces = joined(marked.join(some, ["file", "start"])).where("file IS NOT NULL")
    whole = pieces.groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    return inner.unionByName(whole.select("first", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The file or folder as text columns, its first records being headers."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path).columns
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    value = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    rows = records(spark, path, sep).where("NOT first").select(value.alias("value")).where("value <> ''")
    parsed = F.from_csv("value", ddl, {"sep": sep, "escape": '"', "emptyValue": ""})
    return rows.select(parsed.alias("r")).select(*[F.col("r").getField(n).alias(n) for n in names])
