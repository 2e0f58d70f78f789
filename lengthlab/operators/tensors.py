"""Checkpoint inventories as tables: headers, checks, roles, rollups, for many checkpoints at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.functions.patterns import first_match
from lengthlab.functions import names
from lengthlab.functions.units import with_bytes

HEADER = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"
# Endings of tensor names that quantizers leave, and the format each tells of.
QUANT_SUFFIXES = {
    ".qweight": "gptq/awq", ".qzeros": "gptq/awq", ".g_idx": "gptq", ".weight_scale": "fp8", ".weight_scale_inv": "fp8",
    ".absmax": "bitsandbytes", ".quant_map": "bitsandbytes", ".nested_absmax": "bitsandbytes", ".SCB": "bitsandbytes",
}
INTEGERS = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64")
#: Values per 4-bit block, blocks per nested block, and the bytes of the code tables and the offset.
BLOCK, NESTED, CODE, NESTED_CODE, OFFSET = 64, 256, 64, 1024, 4


def explode_headers(headers: DataFrame, json: str = "header") -> DataFrame:
    """One row per tensor of each header; the metadata entry is skipped."""
    text = F.regexp_replace(json, r'"__metadata__"\s*:\s*\{[^}]*\}\s*,?', "")
    parsed = headers.withColumn("_h", F.from_json(text, HEADER))
    rows = parsed.select(*headers.columns, F.explode("_h").alias("name", "t"))
    return rows.drop(json).select("*", F.col("t.dtype").alias("raw_dtype"), F.col("t.shape").alias("shape"), F.col("t.data_offsets").alias("offsets")).drop("t")


def numel(shape: Column | str) -> Column:
    shape = F.col(shape) if isinstance(shape, str) else shape
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def header_checks(tensors: DataFrame) -> DataFrame:
    """Adds problem: unknown_dtype, bad_shape, bad_offsets, size_mismatch; null for a sound tensor."""
    rows = with_bytes(tensors.withColumn("numel", numel("shape")))
    size = F.get("offsets", F.lit(1)) - F.get("offsets", F.lit(0))
    problem = (
        F.when(F.col("bits").isNull(), "unknown_dtype")
        .when(F.col("shape").isNull() | F.exists("shape", lambda x: x < 0), "bad_shape")
        .when((F.size("offsets") != 2) | (size < 0), "bad_offsets")
        .when(size != F.col("nbytes"), "size_mismatch")
    )
    return rows.withColumn("problem", problem)


def contiguous_offsets(tensors: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """Adds gap: how far each tensor starts from where the one before it in the file ended."""
    order = Window.partitionBy(*by).orderBy(begin, end)
    return tensors.withColumn("gap", F.col(begin) - F.lag(end, 1, 0).over(order))


def duplicates(tensors: DataFrame, by: tuple[str, ...] = ("model", "name")) -> DataFrame:
    return tensors.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1")


def classify(tensors: DataFrame, by: str = "model") -> DataFrame:
    """Adds component, layer_index, module and role; ndim says how many dimensions a tensor has."""
    rows = tensors.withColumns({"component": names.component("name"), "layer_index": names.layer_index("name"), "module": names.module("name")})
    weight = names.parameter("name") == "weight"
    same = Window.partitionBy(by, "module")
    rows = rows.withColumns(
        {
            "_conv": F.max(F.coalesce(weight & (F.col("ndim") >= 3), F.lit(False))).over(same),
            "_matrix": F.max(F.coalesce(weight & (F.col("ndim") == 2), F.lit(False))).over(same),
        }
    )
    return rows.withColumn("role", names.role("name", F.col("ndim"), F.col("_conv"), F.col("_matrix"))).drop("_conv", "_matrix")


def rollup(tensors: DataFrame, keys: list[str], tied: Column | None = None) -> DataFrame:
    """Parameters and bytes per key; tied duplicates count in bytes only."""
    own = F.col("numel") if tied is None else F.when(~tied, F.col("numel"))
    return tensors.groupBy(*keys).agg(F.coalesce(F.sum(own), F.lit(0)).alias("params"), F.sum("nbytes").alias("nbytes"), F.count("*").alias("tensors"))


def tied_groups(tensors: DataFrame, by: str = "model") -> DataFrame:
    """(model, embedding, head) where one text embedding and at most one head of equal shape share storage."""
    text = F.col("component") == "text"
    is_embedding, is_head = text & (F.col("role") == "embedding"), text & (F.col("role") == "lm_head")
    found = tensors.groupBy(by).agg(
        F.count_if(is_embedding).alias("embeddings"),
        F.count_if(is_head).alias("heads"),
        F.min(F.when(is_embedding, F.struct("name", "shape_key"))).alias("e"),
        F.min(F.when(is_head, F.struct("name", "shape_key"))).alias("h"),
    )
    one = found.where("embeddings = 1 and heads <= 1 and (heads = 0 or e.shape_key = h.shape_key)")
    return one.select(by, F.col("e.name").alias("embedding"), F.coalesce("h.name", F.lit("lm_head.weight")).alias("head"))


def quantized_evidence(tensors: DataFrame, by: str = "model") -> DataFrame:
    """(model, format, reason): the most decisive evidence that a checkpoint is quantized; null format without any."""
    d = F.col("dtype")
    has = lambda test: F.max(F.coalesce(test, F.lit(False)))
    suffix = F.coalesce(*[F.when(F.endswith("name", F.lit(s)), F.lit(f)) for s, f in QUANT_SUFFIXES.items()])
    matrix = F.col("role").isin("linear_weight", "embedding", "lm_head")
    found = tensors.groupBy(by).agg(
        has(d == "float8_e8m0fnu").alias("mx"),
        has(d.startswith("float4_")).alias("fp4"),
        has(d.startswith("float6_")).alias("fp6"),
        has(d.startswith("float8_") & (d != "float8_e8m0fnu")).alias("fp8"),
        F.min_by(suffix, F.when(suffix.isNotNull(), F.col("name"))).alias("suffix"),
        has(matrix & d.isin(*INTEGERS)).alias("packed"),
    )
    element = F.when(F.col("fp4"), "fp4").when(F.col("fp6"), "fp6").when(F.col("fp8"), "fp8").otherwise("")
    only = F.col("mx") | F.col("fp4") | F.col("fp6")
    form = (
        F.when(only, F.concat(F.when(F.col("mx"), "mx").otherwise(""), element))
        .when(F.col("suffix").isNotNull(), F.col("suffix"))
        .when(F.col("fp8"), "fp8")
        .when(F.col("packed"), "integer-packed")
    )
    reason = F.when(only, "quantized_dtype").when(F.col("suffix").isNotNull(), "prequantized_checkpoint").when(form.isNotNull(), "quantized_dtype")
    return found.select(by, form.alias("format"), reason.alias("reason"))


def linear_modules(tensors: DataFrame, by: str = "model", transposed: tuple[str, ...] = ()) -> DataFrame:
    """(model, module, kind, out_features, in_features, has_bias, layer_type) of two-dimensional linear weights."""
    rows = tensors.where("role = 'linear_weight'").withColumn("kind", names.leaf("name"))
    biases = tensors.where(names.parameter("name") == "bias").select(by, "module").distinct().withColumn("has_bias", F.lit(True))
    swapped = F.col("kind").isin(*transposed) if transposed else F.lit(False)
    kind = F.when(F.col("component") != "text", F.col("component")).when(F.col("kind").isin(*names.MLP) | names.holds("name", names.MLP_PARTS), "mlp")
    return rows.join(biases, [by, "module"], "left").select(
        by, "module", "kind", F.when(swapped, F.col("dim1")).otherwise(F.col("dim0")).alias("out_features"),
        F.when(swapped, F.col("dim0")).otherwise(F.col("dim1")).alias("in_features"), F.coalesce("has_bias", F.lit(False)).alias("has_bias"), kind.alias("layer_type"),
    )


def four_bit_bytes(n: Column, double: bool = True) -> tuple[Column, Column]:
    """(payload, metadata) bytes of a weight of n values in 4-bit blocks."""
    up = lambda a, b: F.floor((a + (b - 1)) / b).cast("long")
    blocks = up(n, BLOCK)
    extra = blocks + 4 * up(blocks, NESTED) + OFFSET + CODE + NESTED_CODE if double else 4 * blocks + CODE
    return up(n, 2), extra


def weight_bytes(tensors: DataFrame, skip: list[str], load_bits: int = 16, by: str = "model") -> DataFrame:
    """Bytes in memory: linear text weights in 4-bit blocks, all else dense.

    The skip list holds regular expressions for the beginning of a module, and bare endings; these stay dense.
    """
    rows = tensors.withColumn("matched", first_match("module", skip, "skip"))
    quantized = (F.col("role") == "linear_weight") & (F.col("component") == "text") & F.col("matched").isNull()
    payload, extra = four_bit_bytes(F.col("numel"))
    dense = F.floor((F.col("numel") * load_bits + 7) / 8).cast("long")
    return rows.groupBy(by).agg(
        F.coalesce(F.sum(F.when(quantized, payload)), F.lit(0)).alias("payload"),
        F.coalesce(F.sum(F.when(quantized, extra)), F.lit(0)).alias("metadata"),
        F.coalesce(F.sum(F.when(~quantized, dense)), F.lit(0)).alias("dense"),
        F.max(F.when(quantized, payload + extra).otherwise(dense)).alias("largest"),
    )


def adapter_params(modules: DataFrame, default_rank: int, patterns: list[tuple[str, int]], by: str = "model") -> DataFrame:
    """Adapter matrices A (rank x in) and B (out x rank) grouped by shape; the first rank pattern that fits decides.

    A pattern is a regular expression for the module, or for a dotted ending of it.
    """
    ranks = F.array(*[F.lit(rank) for _, rank in patterns]) if patterns else F.array().cast("array<int>")
    place = first_match("module", [p for p, _ in patterns], "rank")
    ranked = modules.withColumn("rank", F.coalesce(F.get(ranks, place), F.lit(default_rank)).cast("long"))
    both = F.array(
        F.struct(F.lit("A").alias("matrix"), F.col("rank").alias("d0"), F.col("in_features").alias("d1")),
        F.struct(F.lit("B").alias("matrix"), F.col("out_features").alias("d0"), F.col("rank").alias("d1")),
    )
    each = ranked.select(by, F.explode(both).alias("m")).select(by, "m.*")
    return each.groupBy(by, "matrix", "d0", "d1").agg(F.sum(F.col("d0") * F.col("d1")).alias("params"), F.count("*").alias("matrices"))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")
