from .scalar import (  # noqa: F401
    LiteralMode, and_, compare, date_days, date_object, divide, equal, greater, interpolate, minus, narrow_literal, plus,
    string_contains, string_join, times, year_approx, year_exact,
)
