"""Page compositions return consistent lazy results."""

from pyspark.sql import functions as F

from tillroll.operators import facts
from tillroll.plans import views
from tillroll.sources import testdata

SF = "/root/testdata/sf0.001"


def test_dashboard_and_pages(spark):
    f = testdata.fact(spark, SF).cache()
    pm, cm = facts.product_metrics(f), facts.customer_metrics(f)
    d = views.dashboard(f, pm, cm, date_range=("1995-01-01", "1999-12-31"), store=1)
    k = d["kpis"].first()
    assert k["total_stores"] == 1 and k["start_date"].year >= 1995
    assert d["series_units"].agg(F.sum("value")).first()[0] == k["total_units"]
    top = cm.orderBy(F.desc("frequency"), "customer_id").first()["customer_id"]
    page = views.customer_page(f, top)
    assert page["statistics"].count() == 1
    recs = page["recommendations"].collect()
    assert all(r["customer_id"] == top for r in recs) and len(recs) <= 10
    lines = f.join(testdata.table(spark, SF, "part").select(F.col("p_partkey").alias("product_id"),
                                                            F.col("p_type").alias("item")), "product_id")
    item = lines.groupBy("item").count().orderBy(F.desc("count"), "item").first()["item"]
    pp = views.product_page(lines.withColumn("product_id", F.col("item")), item, min_support=0.02,
                            min_confidence=0.1, min_lift=None)
    assert all(r["product_id"] == item for r in pp["recommendations"].collect())
