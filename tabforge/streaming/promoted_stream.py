"""Stream scoring that follows promotions (I10 with J5/J6): each record is scored by the model in charge when it happened.

``foreachBatch`` reads the run log anew for every batch, so a promotion takes effect without a restart.  Which model
is in charge of a record follows from the record's event time and the log's promotion times
(half-open intervals), or, without an event time, from the log as the batch begins.  A batch is written under its batch id
by overwriting, so one that runs twice leaves its rows once, and with an event time the same rows.

Records that are no JSON object, and those that no model is in charge of, go to a side table with the reason; no record is lost.

Sizes: a batch is scored once for each model that is in charge within it (normally one, two around a promotion), each over its own
records only; the log of one experiment's promotions is read on the driver, one row a promotion of this experiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import runlog as RL
from tabforge.plans.score import ScoringBundle
from tabforge.sources.records import parse_records

BAD_JSON, NO_MODEL = "not a JSON object", "no model in charge"


def tenures(events: DataFrame, models: DataFrame, experiment_id: int, flag: str = "deploy_api") -> list[tuple]:
    """(model_id or None, from, until) of an experiment in time order; ``until`` of the last is None.  A promotion that carries the
    flag puts its model in charge; one that takes the flag from the model in charge leaves nobody.  Promotions of one moment
    act in order of ``seq``.  Promotions of models that are not in ``models`` (uncommitted attempts) don't count."""
    mine = RL.promotions_of(models, events.where(F.col("experiment_id") == experiment_id))
    log = mine.where(F.col("ts").isNotNull()).select("ts", "seq", "model_id", F.col(flag).alias("on")).orderBy("ts", "seq", "model_id")
    out: list[tuple] = []
    holder = None
    for r in log.collect():  # one row a promotion of one experiment
        new = r["model_id"] if r["on"] else (None if r["model_id"] == holder else holder)
        if new == holder:
            continue
        if out:
            last = out.pop()
            if last[1] < r["ts"]:
                out.append((last[0], last[1], r["ts"]))
        out.append((new, r["ts"], None))
        holder = new
    return out


class PromotedScorer:
    """Scores batches of text records ``record`` (a JSON object) and their other columns by the run log in ``log_dir``."""

    def __init__(self, spark: SparkSession, log_dir: str, experiment_id: int, out_path: str, record: str = "record",
                 event_time: str | None = None, flag: str = "deploy_api"):
        self.spark, self.log_dir, self.experiment_id = spark, log_dir.rstrip("/"), experiment_id
        self.out, self.record, self.event_time, self.flag = out_path.rstrip("/"), record, event_time, flag
        self._bundles: dict[int, ScoringBundle] = {}

    def bundle(self, models: DataFrame, model_id: int) -> ScoringBundle:
        """A model is loaded once a process; a model's files never change after its attempt's commit."""
        if model_id not in self._bundles:
            row = models.where(F.col("model_id") == F.lit(model_id)).select("model_path").first()
            self._bundles[model_id] = ScoringBundle.load(self.spark, row["model_path"] + "_bundle")
        return self._bundles[model_id]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.spark
        models = RL.visible_models(spark, self.log_dir)
        held = tenures(RL.read_log(spark, self.log_dir, "run_events", RL.EVENTS), models, self.experiment_id, self.flag)
        if self.event_time is None:
            held = [(held[-1][0], None, None)] if held else []
        kept = [c for c in batch.columns if c != self.record]
        valid = F.json_object_keys(F.col(self.record)).isNotNull()
        mine = F.lit(None).cast("bigint")
        for model_id, start, end in held:
            here = F.lit(True)
            if start is not None:
                at = F.col(self.event_time).cast("timestamp_ntz")
                here = (at >= F.lit(start)) if end is None else (at >= F.lit(start)) & (at < F.lit(end))
            mine = F.when(here, F.lit(model_id).cast("bigint")).otherwise(mine)
        tagged = batch.withColumn("__model", F.when(valid, mine)).withColumn("__valid", F.coalesce(valid, F.lit(False)))
        scored = None
        for model_id in sorted({m for m, _, _ in held if m is not None}):
            b = self.bundle(models, model_id)
            part = tagged.where(F.col("__model") == F.lit(model_id))
            fields = parse_records(F.col(self.record), list(b.prep.features))
            src = part.select(F.struct(*kept).alias("__kept"), fields.alias("__r")).select("__kept", "__r.*")
            one = b.predict(src, keep=["__kept"]).select("__kept.*", F.col("prediction").cast("string").alias("prediction"),
                                                         F.lit(model_id).cast("bigint").alias("model_id"))
            scored = one if scored is None else scored.unionByName(one)
        if scored is not None:
            scored.write.mode("overwrite").parquet(f"{self.out}/scored/batch={batch_id}")
        reason = F.when(~F.col("__valid"), BAD_JSON).otherwise(NO_MODEL)
        (tagged.where(F.col("__model").isNull()).select(*kept, self.record, reason.alias("reason"))
         .write.mode("overwrite").parquet(f"{self.out}/rejected/batch={batch_id}"))


def run_promoted(scorer: PromotedScorer, stream: DataFrame, checkpoint: str) -> None:
    """Everything available now, then stops; a restart goes on from the checkpoint."""
    q = (stream.writeStream.foreachBatch(scorer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
