"""tabforge: tabular machine-learning data jobs on Spark.

Profile a table, split it reproducibly by key hash, fit leak-free preparation
on the training rows, train three model families with ``pyspark.ml``,
evaluate and rank them, score new rows in batch or as a stream, and keep a
queryable run log.  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"

from tabforge.operators.metrics import (  # noqa: E402,F401
    auc, auc_binary, auc_ovr, classification_metrics, precision_recall_f1, regression_metrics,
)
from tabforge.operators.prep import FittedPrep, fit_transform, prep_full_table  # noqa: E402,F401
from tabforge.operators.profile import profile_table, tally  # noqa: E402,F401
from tabforge.operators.rank import leaderboard  # noqa: E402,F401
from tabforge.operators.schema import (  # noqa: E402,F401
    align_columns, check_schema, drop_null_target, project_features, schema_match,
)
from tabforge.operators.split import split_exact, split_hash, with_split  # noqa: E402,F401
from tabforge.plans.experiment import run_experiment  # noqa: E402,F401
from tabforge.plans.score import ScoringBundle, batch_job  # noqa: E402,F401
from tabforge.plans.train import TrainParams, train_all  # noqa: E402,F401
from tabforge.sources.csv import read_csv, write_csv  # noqa: E402,F401
