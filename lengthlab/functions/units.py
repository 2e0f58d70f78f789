"""Rounding, element sizes and tensor bytes in exact integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per element, by canonical name.
DTYPE_BITS = {
    "float64": 64, "float32": 32, "tfloat32": 32, "bfloat16": 16, "float16": 16, "float8_e4m3fn": 8, "float8_e5m2": 8, "float8_e8m0fnu": 8,
    "int64": 64, "int32": 32, "int16": 16, "int8": 8, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "complex64": 64,
    "bool": 8, "nf4": 4, "fp4": 4, "float4_e2m1": 4, "float6_e2m3": 6, "float6_e3m2": 6,
}
# Header codes and other spellings; all but the codes count in any case.
DTYPE_NAMES = {
    "F64": "float64", "F32": "float32", "BF16": "bfloat16", "F16": "float16", "F8_E4M3": "float8_e4m3fn", "F8_E5M2": "float8_e5m2",
    "I64": "int64", "I32": "int32", "I16": "int16", "I8": "int8", "U8": "uint8", "U16": "uint16", "U32": "uint32", "U64": "uint64",
    "F8_E8M0": "float8_e8m0fnu", "F4": "float4_e2m1", "F6_E2M3": "float6_e2m3", "F6_E3M2": "float6_e3m2", "C64": "complex64",
    "BOOL": "bool", "bf16": "bfloat16", "fp16": "float16", "half": "float16", "fp32": "float32", "float": "float32",
    "fp64": "float64", "double": "float64",
}


def round_up(value: Column, multiple: Column | int | None) -> Column:
    """To a multiple, in integers; null or <= 1 leaves the value."""
    m = F.lit(multiple).cast("long") if not isinstance(multiple, Column) else multiple
    return F.when(m > 1, value + F.pmod(-value, m)).otherwise(value)


def with_bytes(df: DataFrame, dtype: str = "raw_dtype", numel: str = "numel") -> DataFrame:
    """Adds dtype (canonical, null if unknown), bits and nbytes = ceil(numel * bits / 8)."""
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(s, n, DTYPE_BITS[n]) for s, n in (DTYPE_NAMES | {n: n for n in DTYPE_BITS}).items()], "spelled string, dtype string, bits long"
    )
    trimmed = F.trim(F.col(dtype))
    codes = [s for s in DTYPE_NAMES if s.isupper()]
    clean = F.when(trimmed.isin(*codes), trimmed).otherwise(F.regexp_replace(F.lower(trimmed), "^torch\\.", ""))
    out = df.withColumn("spelled", clean).join(F.broadcast(known), "spelled", "left").drop("spelled")
    return out.withColumn("nbytes", F.expr(f"(`{numel}` * bits + 7) div 8"))
