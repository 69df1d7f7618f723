from cohortlens.functions.expr import (  # noqa: F401
    all_null_guard,
    eq_flag,
    in_flag,
    not_contains_flag_expr,
    round_half_even,
)
from cohortlens.functions.hashing import HASH_RANGE, portable_hash, portable_hash_sql  # noqa: F401
