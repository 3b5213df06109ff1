"""Shop tables (orders, stock, promotions, payments ...) derived from the star schema.

They stand in for the demo domain's tables and feed the rule jobs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Shop:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def count(self, name: str) -> int:
        return self.raw(name).count()

    @cached_property
    def as_of(self):
        """Ten days after the last order."""
        return self.raw("orders").agg(F.date_add(F.to_date(F.max("o_orderdate")), 10).alias("d")).first()["d"]

    def regions_of(self, table: str, key: str, nation: str) -> DataFrame:
        places = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("n_nationkey").alias(nation), F.col("r_name").alias("region"))
        return self.raw(table).join(places, nation).select(key, "region")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product"),
            F.col("p_retailprice").alias("price"), (F.col("p_size") / 10).alias("weight_kg"),
            ((F.col("p_partkey") % 3 + 1) * 30).alias("return_window_days"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        base = self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "BUILDING", "vip")
            .when(F.col("c_mktsegment") == "FURNITURE", "gold").otherwise("standard").alias("loyalty_tier"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("+1-"), "c_custkey")).alias("phone"),
            F.element_at(F.array(F.lit("email"), F.lit("sms"), F.lit("both")), (F.col("c_custkey") % 3 + 1).cast("int"))
            .alias("preferred"),
            (F.col("c_acctbal") < 0).alias("opted_out"),
            F.col("c_acctbal").alias("balance"),
        )
        places = self.regions_of("customer", "c_custkey", "c_nationkey").select(
            F.col("c_custkey").alias("customer_id"), "region")
        return base.join(places, "customer_id")

    @cached_property
    def customer_flags(self) -> DataFrame:
        return self.raw("customer").filter(F.col("c_acctbal") < -500).select(
            F.col("c_custkey").alias("customer_id"), F.lit("debt").alias("reason"))

    @cached_property
    def warehouses(self) -> DataFrame:
        return self.regions_of("supplier", "s_suppkey", "s_nationkey").select(
            F.col("s_suppkey").alias("warehouse_id"), "region")

    @cached_property
    def inventory(self) -> DataFrame:
        signed = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
        return self.raw("lineitem").groupBy(
            F.col("l_suppkey").alias("warehouse_id"), F.col("l_partkey").alias("product_id")
        ).agg(F.sum(signed).cast("bigint").alias("quantity_available"))

    @cached_property
    def shipping_rates(self) -> DataFrame:
        regions = self.raw("region")
        n = self.count("region")
        target = regions.select(F.col("r_regionkey").alias("to_key"), F.col("r_name").alias("to_region"))
        apart = F.abs(F.col("r_regionkey") - F.col("to_key"))
        return regions.withColumn("to_key", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(target, "to_key").select(
            F.col("r_name").alias("from_region"), "to_region", (0.5 + 0.25 * apart).alias("rate_per_kg"),
            (2.5 + F.col("r_regionkey")).alias("base_fee"), (2 + apart).alias("delivery_days"))

    @cached_property
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
            (key % self.count("part")).alias("product_id"), (key % 7 + 1).alias("quantity"),
            (key % self.count("supplier")).alias("warehouse_id"),
            F.when(status == "O", "pending").when(status == "F", "fulfilled").otherwise("backordered").alias("status"),
            F.when(status == "O", "processing").when(status == "F", "delivered").otherwise("shipped")
            .alias("delivery_status"),
            F.col("o_totalprice").alias("total"), F.to_date("o_orderdate").alias("order_date"),
            F.datediff(F.lit(self.as_of), F.to_date("o_orderdate")).alias("days_since"),
        )

    @cached_property
    def promotions(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").filter(F.col("p_type") == "PROMO").select(
            key.alias("promotion_id"), key.alias("product_id"),
            F.when(F.col("p_size") % 2 == 0, "percentage").otherwise("fixed").alias("promo_type"),
            (F.col("p_size") / 2).alias("discount_value"), (key % 3 + 1).alias("min_quantity"),
            F.when(key % 3 == 1, "gold").when(key % 3 == 2, "vip").alias("required_tier"),
            F.when(key % 4 != 0, key % 2 + 1).alias("max_uses_per_customer"), (F.col("p_size") > 5).alias("active"))

    @cached_property
    def promotion_usage(self) -> DataFrame:
        return self.orders.filter(F.col("status") == "fulfilled").join(
            self.promotions.select("promotion_id", "product_id"), "product_id"
        ).select("promotion_id", "customer_id", "order_id")

    @cached_property
    def payments(self) -> DataFrame:
        """One wallet charge per order; charges of backordered orders are paid back later."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("transaction_id"), F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("payment_id"),
            F.round(F.col("o_totalprice") / 100 + 1e-9, 2).alias("amount"), F.to_date("o_orderdate").alias("created"))

    @cached_property
    def reservations(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("warehouse_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.when(F.col("l_linestatus") == "O", "active").when(F.col("l_returnflag") == "R", "cancelled")
            .otherwise("fulfilled").alias("status"))

    @cached_property
    def restock_schedule(self) -> DataFrame:
        return self.raw("lineitem").filter(F.col("l_returnflag") == "N").groupBy(
            F.col("l_suppkey").alias("warehouse_id"), F.col("l_partkey").alias("product_id")
        ).agg(F.date_add(F.to_date(F.max("l_shipdate")), 14).alias("expected_date"),
              F.max("l_quantity").cast("bigint").alias("quantity"))

    @cached_property
    def refunds(self) -> DataFrame:
        return self.raw("lineitem").filter(F.col("l_returnflag") == "A").select(
            F.col("l_orderkey").alias("order_id")).distinct()

    @cached_property
    def refund_requests(self) -> DataFrame:
        asked = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
        return self.raw("lineitem").filter(F.col("l_returnflag") == "R").groupBy(
            F.col("l_orderkey").alias("order_id")
        ).agg(asked.alias("asked"), F.max("l_linenumber").alias("n")).select(
            "order_id", F.when(F.col("n") > 2, F.col("asked")).alias("amount"))

    @cached_property
    def tracking(self) -> DataFrame:
        return self.raw("lineitem").filter(F.col("l_linestatus") == "F").groupBy(
            F.col("l_orderkey").alias("order_id")
        ).agg(F.to_date(F.max("l_shipdate")).alias("estimated_delivery"), F.max("l_suppkey").alias("carrier"))
