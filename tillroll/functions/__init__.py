from tillroll.functions.calendar import (calendar_columns, period_label, period_spine,
                                         month_short_name, DAY_ORDER)
from tillroll.functions.numeric import safe_div, pct_change, r6, round_half_even
from tillroll.functions.text import product_label, product_name, category_or_default

__all__ = ["calendar_columns", "period_label", "period_spine", "month_short_name", "DAY_ORDER",
           "safe_div", "pct_change", "r6", "round_half_even",
           "product_label", "product_name", "category_or_default"]
