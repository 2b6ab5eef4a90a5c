"""Label and name columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference output.
PRODUCT_PREFIX = "Producto "
NO_CATEGORY = "Sin categoría"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def product_name(product_id="product_id") -> Column:
    """Synthetic product name used when the data carries none."""
    return F.concat(F.lit(PRODUCT_PREFIX), _c(product_id).cast("string"))


def product_label(product_id="product_id", category_name="category_name") -> Column:
    """'Producto <id> - <category>' or 'Producto <id>' without a category."""
    pid, cat = _c(product_id), _c(category_name)
    return F.when(cat.isNotNull(), F.concat(product_name(pid), F.lit(" - "), cat)) \
            .otherwise(product_name(pid))


def category_or_default(category_name="category_name") -> Column:
    return F.coalesce(_c(category_name), F.lit(NO_CATEGORY))
