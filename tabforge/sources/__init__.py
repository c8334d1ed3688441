from tabforge.sources.csv import infer_types, read_csv, write_csv  # noqa: F401
from tabforge.sources.records import parse_records, read_records  # noqa: F401
from tabforge.sources.tables import TABLES, table  # noqa: F401
