from tabforge.functions.exprs import (  # noqa: F401
    NA_STRINGS, hash_hex, hex_threshold, nan_to_null,
    na_string_to_null, norm_name, qcol, try_double, with_nan_as_null,
)
