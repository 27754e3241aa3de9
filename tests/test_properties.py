"""Properties from the survey's test strategy, checked on real tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import settlement
from ledgerloom.plans.billing_queries import CONFIG, _run
from ledgerloom.sources import adapters as A
from tests.conftest import SF_MID


def test_invoice_numbers_unique_gapless_below_limit(spark):
    inv = _run(spark, SF_MID).invoices.select("number").cache()
    n = inv.count()
    assert n > 1000
    assert inv.distinct().count() == n
    agg = inv.agg(F.min("number").alias("lo"), F.max("number").alias("hi")).first()
    assert agg.hi <= CONFIG.number_limit
    reserved = (A.load(spark, SF_MID, "movements").select(F.trim("factura").try_cast("bigint").alias("number"))
                .filter(F.col("number").between(agg.lo, agg.hi)).distinct().count())
    # every number of [lo, hi] is used unless it is reserved
    assert agg.hi - agg.lo + 1 == n + reserved


def test_split_total_within_a_cent(spark):
    from ledgerloom.operators import billing
    s = billing.with_split(A.load(spark, SF_MID, "movements"))
    bad = s.filter(~F.col("zero_total") & (F.abs(F.col("invoice_total") - F.col("total_charged")) > 0.01))
    assert bad.count() == 0


def test_paid_never_falls_and_one_acceptance_per_key(spark):
    rc = A.load(spark, SF_MID, "receipts")
    out = settlement.receipt_settlement(rc)
    w = Window.partitionBy("casillero", "id").orderBy("arrival", "event_id")
    seq = (out.filter(F.col("paid_after").isNotNull())
           .withColumn("prev", F.lag("paid_after").over(w)))
    assert seq.filter(F.col("prev") > F.col("paid_after")).count() == 0
    keys = settlement.receipt_dedupe(rc).select("event_id", "k_cta", "k_ref", "k_fch", "k_mto")
    applied = (out.filter(F.col("verdict") == "applied").join(keys, "event_id")
               .filter((F.col("k_ref") != "") & F.col("k_mto").isNotNull()))
    per_key = applied.groupBy("casillero", "k_cta", "k_ref", "k_fch", "k_mto").count()
    assert per_key.filter(F.col("count") > 1).count() == 0
