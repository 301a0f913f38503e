"""Column expressions; everything here stays inside Spark's generated code."""

from regiometra.functions.numeric import (
    coerce_numeric, missing_to_null, normalize_code, order_bin, round_half_even, trim_all,
)

__all__ = ["coerce_numeric", "missing_to_null", "normalize_code", "order_bin",
           "round_half_even", "trim_all"]
