"""Shopping carts: validation, application to stock, receipts."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import day
from shelflot.functions.money import TOTAL, amount
from shelflot.functions.ranks import GROUP_LIMIT, row_numbers, running_total
from shelflot.functions.text import clean
from shelflot.operators.joins import left_join_nullable, small
from shelflot.operators.validate import Checked
from shelflot.session import pinned, spread_over

# Tax and receipt number.
TAX_RATE = "0.05"
RECEIPT_NUMBER = "SA-%06d"

CUSTOMER = (
    "customer_name",
    "customer_phone",
    "customer_age",
    "prescription_number",
    "doctor_name",
    "diagnosis",
    "payment_method",
)


class Applied(NamedTuple):
    """Outcome of applying carts to stock."""

    batches: DataFrame
    decisions: DataFrame
    sales: DataFrame
    taken: DataFrame


class Receipts(NamedTuple):
    """One row per sold cart, and one row per item on its receipt."""

    totals: DataFrame
    items: DataFrame


def cart_lines(carts: DataFrame) -> Checked:
    """Explode carts into numbered lines; carts that cannot be sold keep their reason.

    A cart needs the customer's name and phone, at least one item, and three lists of equal
    length.
    """
    items = F.coalesce(F.size("batch_id"), F.lit(0))
    reason = (
        F.when((clean("customer_name") == "") | (clean("customer_phone") == ""), "customer_missing")
        .when(items <= 0, "cart_empty")
        .when(~F.size("batch_id").eqNullSafe(F.size("quantity")), "cart_mismatch")
        .when(~F.size("batch_id").eqNullSafe(F.size("price")), "cart_mismatch")
    )
    judged = carts.withColumn("reason", reason)
    carried = [c for c in ("cart_id", "cart_time", *CUSTOMER) if c in carts.columns]
    lines = (
        judged.filter(F.col("reason").isNull())
        .select(*carried, F.posexplode(F.arrays_zip("batch_id", "quantity", "price")).alias("pos", "item"))
        .select(
            *carried,
            (F.col("pos") + 1).alias("line"),
            F.col("item.batch_id").alias("batch_id"),
            F.col("item.quantity").alias("quantity"),
            F.col("item.price").alias("price"),
        )
    )
    return Checked(lines, judged.filter(F.col("reason").isNotNull()).select("cart_id", "reason"))


def _judged_demand(batches: DataFrame, lines: DataFrame, as_of, allow_expired: bool) -> DataFrame:
    """Units per cart and batch beside the stock, with what makes the sale impossible, if anything."""
    demand = lines.groupBy("cart_id", "cart_time", "batch_id").agg(
        F.sum("quantity").alias("qty"),
        F.bool_or(F.coalesce(F.col("quantity") <= 0, F.lit(True))).alias("bad"),
    )
    stock = batches.select(F.col("id").alias("__id"), F.col("quantity").alias("stock"), "expiry_date")
    problem = (
        F.when(F.col("bad"), "invalid_quantity")
        .when(F.col("stock").isNull(), "batch_not_found")
        .when(F.col("qty") > F.col("stock"), "insufficient_stock")
    )
    if not allow_expired:
        problem = F.coalesce(problem, F.when(F.col("expiry_date") < day(as_of), "batch_expired"))
    return (
        left_join_nullable(demand, stock, "batch_id", "__id")
        .withColumn("problem", problem)
        .select("cart_id", "cart_time", "batch_id", "qty", "stock", "problem")
    )


def _settle(pending: DataFrame, group_limit: int) -> list[DataFrame]:
    """Carts refused because earlier carts took the stock, as a list of frames of cart ids.

    ``pending`` holds the lines on batches that cannot serve everyone: (cart_id, cart_time,
    batch_id, qty, left, fits). All carts are judged together, in rounds:

    * a line fits once all undecided demand up to and including it is no more than what is
      left, and then keeps fitting, because that demand can only shrink;
    * a cart whose lines all fit is accepted, and its units leave what is left;
    * a line that does not fit has only earlier carts among those accepted on its batch (had a
      later one been accepted, this line would fit too), so if it asks for more than what is
      left now, its cart is refused.

    The earliest undecided cart is always settled, so the rounds end with the same outcome as
    serving the carts one by one; every round settles all carts it can, on all batches.
    """
    refused = []
    while not pending.isEmpty():
        upto = running_total(pending, ["batch_id"], ["cart_time", "cart_id"], "qty", "upto", group_limit)
        tested = upto.withColumn("fits", F.col("fits") | (F.col("upto") <= F.col("left"))).drop("upto")
        whole = tested.groupBy("cart_id").agg(F.bool_and("fits").alias("accepted"))
        marked = pinned(tested.join(whole, "cart_id"))
        taken = marked.filter("accepted").groupBy("batch_id").agg(F.sum("qty").alias("taken"))
        undecided = (
            marked.filter(~F.col("accepted"))
            .join(taken, "batch_id", "left")
            .withColumn("left", F.col("left") - F.coalesce("taken", F.lit(0)))
            .drop("taken", "accepted")
        )
        too_much = ~F.col("fits") & (F.col("qty") > F.col("left"))
        fate = undecided.groupBy("cart_id").agg(F.bool_or(too_much).alias("refused"))
        judged = pinned(undecided.join(fate, "cart_id"))
        refused.append(judged.filter("refused").select("cart_id").distinct())
        pending = judged.filter(~F.col("refused")).drop("refused")
    return refused


def apply_sales(
    batches: DataFrame,
    lines: DataFrame,
    as_of=None,
    allow_expired: bool = True,
    first_id: int | None = 1,
    group_limit: int = GROUP_LIMIT,
) -> Applied:
    """Sell carts against stock, whole carts only, as if one by one in order of time and id.

    Returns the new stock, a decision per cart, the recorded sale lines numbered from
    ``first_id`` (without numbers if it is None), and the units taken per batch. A line without a positive quantity refuses
    its cart. Expired batches may be sold unless ``allow_expired`` is off.
    """
    with spread_over(lines.sparkSession, lines.count()):
        return _applied(batches, lines, as_of, allow_expired, first_id, group_limit)


def _applied(batches: DataFrame, lines: DataFrame, as_of, allow_expired: bool, first_id: int | None, group_limit: int) -> Applied:
    demand = pinned(_judged_demand(batches, lines, as_of, allow_expired))
    impossible = (
        demand.filter(F.col("problem").isNotNull()).groupBy("cart_id").agg(F.min("problem").alias("reason"))
    )
    possible = demand.join(impossible, "cart_id", "left_anti")
    scarce = (
        possible.groupBy("batch_id")
        .agg(F.sum("qty").alias("wanted"), F.first("stock").alias("left"))
        .filter(F.col("wanted") > F.col("left"))
        .select("batch_id", "left")
    )
    pending = pinned(
        possible.join(scarce, "batch_id").select(
            "cart_id", "cart_time", "batch_id", "qty", "left", F.lit(False).alias("fits")
        )
    )
    beaten = _settle(pending, group_limit)
    refused = reduce(
        DataFrame.unionByName,
        [frame.withColumn("reason", F.lit("insufficient_stock")) for frame in beaten],
        impossible,
    )
    decisions = pinned(
        demand.select("cart_id")
        .distinct()
        .join(refused, "cart_id", "left")
        .select("cart_id", F.col("reason").isNull().alias("accepted"), "reason")
    )
    accepted = small(decisions.filter("accepted").select("cart_id"))
    taken = pinned(
        demand.join(accepted, "cart_id", "left_semi")
        .groupBy("batch_id")
        .agg(F.sum("qty").cast("bigint").alias("units"))
    )
    sold = lines.join(accepted, "cart_id", "left_semi")
    ids = []
    if first_id is not None:
        sold = row_numbers(sold, [], ["cart_time", "cart_id", "line"], "__n")
        ids = [(F.col("__n") + (first_id - 1)).cast("bigint").alias("id")]
    sales = sold.select(
        *ids,
        "cart_id",
        "line",
        "batch_id",
        F.col("quantity").alias("quantity_sold"),
        F.col("price").alias("selling_price"),
        *[c for c in CUSTOMER if c in lines.columns],
        F.col("cart_time").alias("sold_on"),
    )
    return Applied(take_stock(batches, taken), decisions, sales, taken)


def take_stock(batches: DataFrame, taken: DataFrame) -> DataFrame:
    """Batches with the taken units (batch_id, units) subtracted."""
    gone = small(taken.select(F.col("batch_id").alias("id"), "units"))
    return (
        batches.join(gone, "id", "left")
        .withColumn("quantity", F.col("quantity") - F.coalesce("units", F.lit(0)))
        .select(*batches.columns)
    )


def receipts(sales: DataFrame, batches: DataFrame, medicines: DataFrame) -> Receipts:
    """Receipt totals per cart and the items on each; the number is that of its last sale line.

    Items stay rows, so a receipt may have any length. A missing medicine shows as Unknown.
    """
    named = batches.select(F.col("id").alias("batch_id"), "batch_no", "medicine_id").join(
        medicines.select(F.col("id").alias("medicine_id"), F.col("name").alias("medicine_name")),
        "medicine_id",
        "left",
    )
    items = sales.join(named, "batch_id").select(
        "cart_id",
        "line",
        F.coalesce("medicine_name", F.lit("Unknown")).alias("medicine_name"),
        "batch_no",
        F.col("quantity_sold").alias("quantity"),
        F.col("selling_price").alias("price"),
        amount().alias("total"),
    )
    tax = F.round(F.col("subtotal") * F.lit(TAX_RATE).cast("decimal(4,2)"), 2).cast(TOTAL)
    grand = F.round(
        F.col("subtotal") * (F.lit(1) + F.lit(TAX_RATE).cast("decimal(4,2)")), 2
    ).cast(TOTAL)
    totals = (
        sales.groupBy("cart_id")
        .agg(
            F.max("id").alias("sale_id"),
            F.count(F.lit(1)).alias("items"),
            F.sum(amount()).cast("decimal(30,2)").alias("subtotal"),
        )
        .select(
            "cart_id",
            "sale_id",
            F.format_string(RECEIPT_NUMBER, "sale_id").alias("receipt_number"),
            "items",
            F.col("subtotal").cast(TOTAL).alias("subtotal"),
            tax.alias("tax_amount"),
            grand.alias("grand_total"),
        )
    )
    return Receipts(totals, items)
