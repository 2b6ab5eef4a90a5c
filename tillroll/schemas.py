"""Fixed schemas of the input files and the processed tables."""

from pyspark.sql import types as T

RAW_TRANSACTIONS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("products", T.StringType()),
])

TRANSACTION_COLUMNS = ["date", "store_id", "customer_id", "products"]
CATEGORY_COLUMNS = ["category_id", "category_name"]
PRODUCT_CATEGORY_COLUMNS = ["product_id", "category_id"]

FACT_KEYS = ["transaction_id", "date", "store_id", "customer_id", "product_id", "quantity"]
CALENDAR_COLUMNS = ["year", "month", "day", "day_of_week", "day_name",
                    "week_of_year", "is_weekend", "quarter"]
FACT_COLUMNS = FACT_KEYS + ["category_id", "category_name"] + CALENDAR_COLUMNS
