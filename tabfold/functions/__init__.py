from tabfold.functions.exprs import (  # noqa: F401
    binary_label, family, hash_unit, hash_hex, planted_label, try_long,
)
