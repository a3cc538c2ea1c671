from tidewell.functions.columns import (c, hash_text, hash_uniform, minkowski, null_count, r6,
                                       round_half_even, row_max, sql_list)

__all__ = ["c", "hash_text", "hash_uniform", "minkowski", "null_count", "r6",
           "round_half_even", "row_max", "sql_list"]
