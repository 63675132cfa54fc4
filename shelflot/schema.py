"""Table schemas of the stock data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

MEDICINES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("composition", T.StringType()),
        T.StructField("uses", T.StringType()),
        T.StructField("dosage", T.StringType()),
        T.StructField("side_effects", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("medicine_id", T.LongType()),
        T.StructField("batch_no", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("mrp", MONEY),
        T.StructField("cost_price", MONEY),
        T.StructField("mfg_date", T.DateType()),
        T.StructField("expiry_date", T.DateType()),
        T.StructField("supplier", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

SALES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("quantity_sold", T.LongType()),
        T.StructField("selling_price", MONEY),
        T.StructField("customer_name", T.StringType()),
        T.StructField("customer_phone", T.StringType()),
        T.StructField("customer_age", T.IntegerType()),
        T.StructField("prescription_number", T.StringType()),
        T.StructField("doctor_name", T.StringType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("sold_on", T.TimestampNTZType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("medicine_id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("priority", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("is_read", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

INTERACTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("drug_a", T.StringType()),
        T.StructField("drug_b", T.StringType()),
        T.StructField("interaction", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("recommendation", T.StringType()),
    ]
)

SYMPTOMS = T.StructType(
    [
        T.StructField("symptoms", T.StringType()),
        T.StructField("medicine", T.StringType()),
    ]
)

CARTS = T.StructType(
    [
        T.StructField("cart_id", T.LongType()),
        T.StructField("cart_time", T.TimestampNTZType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("customer_phone", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("batch_id", T.ArrayType(T.LongType())),
        T.StructField("quantity", T.ArrayType(T.LongType())),
        T.StructField("price", T.ArrayType(MONEY)),
    ]
)

TABLES = {
    "medicines": MEDICINES,
    "batches": BATCHES,
    "sales": SALES,
    "alerts": ALERTS,
    "interactions": INTERACTIONS,
}
