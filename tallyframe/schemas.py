"""Field lists and table schemas shared by sources, operators and sinks. Fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER_FIELDS = [
    "invoice_number", "po_number", "reference", "invoice_date", "currency", "seller_name", "seller_address",
    "buyer_name", "buyer_address", "subtotal", "tax_amount", "total_amount", "payment_terms",
]
MONEY_FIELDS = ["subtotal", "tax_amount", "total_amount"]
REQUIRED_FIELDS = ["invoice_date", "currency", "seller_name", "total_amount"]
LINE_FIELDS = ["line_no", "item_code", "description", "quantity", "unit_price", "amount"]
NUMERIC_LINE_FIELDS = ["quantity", "unit_price", "amount"]

MONEY = T.DecimalType(28, 10)


def _struct(strings: list[str], numbers: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, MONEY if f in numbers else T.StringType()) for f in strings])


LINE = _struct(LINE_FIELDS, NUMERIC_LINE_FIELDS)
INVOICE = _struct(HEADER_FIELDS, MONEY_FIELDS).add("line_items", T.ArrayType(LINE))
PAGE = T.StructType().add("source_file", T.StringType()).add("page_no", T.IntegerType()).add("kind", T.StringType()).add("text", T.StringType()).add("error_class", T.StringType())
ROUTE_RESULT = (
    T.StructType().add("source_file", T.StringType()).add("route_seq", T.IntegerType()).add("route", T.StringType())
    .add("pages", T.ArrayType(T.IntegerType())).add("provider", T.StringType()).add("model", T.StringType()).add("invoice", INVOICE)
)
# Column order of the usage file; its readers may rely on positions.
USAGE = T.StructType([
    T.StructField(name, {"int": T.LongType(), "money": MONEY, "double": T.DoubleType(), "bool": T.BooleanType()}.get(kind, T.StringType()))
    for name, kind in (
        ("run_id", ""), ("source_file", ""), ("route", ""), ("page_range", ""), ("attempt_type", ""), ("ladder_index", "int"), ("requested_model", ""),
        ("actual_model", ""), ("structured_mode", ""), ("input_tokens", "int"), ("output_tokens", "int"), ("reasoning_tokens", "int"), ("total_tokens", "int"),
        ("cost_usd", "money"), ("finish_reason", ""), ("native_finish_reason", ""), ("generation_id", ""), ("latency_ms", "double"), ("accepted", "bool"),
        ("rejection_category", ""), ("http_status", "int"),
    )
])
EVENT = (
    T.StructType().add("job_id", T.StringType()).add("seq", T.LongType()).add("ts", T.StringType()).add("event", T.StringType())
    .add("file_index", T.IntegerType()).add("file_name", T.StringType()).add("chunk_index", T.IntegerType()).add("attempt_index", T.IntegerType())
    .add("status", T.StringType())
)
