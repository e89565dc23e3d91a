from starlayer.functions.exprs import (  # noqa: F401
    MONEY,
    money,
    ratio,
    in_period,
    period_start,
    lit_date,
)
