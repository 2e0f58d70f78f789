"""Column kinds and the mapping of columns to training roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted column names per role in order of preference, kinds per role, roles per format and their ranks.
SYNONYMS = {
    "prompt": ("prompt", "question", "instruction", "input", "query"),
    "chosen": ("chosen", "preferred", "accepted", "winner"),
    "rejected": ("rejected", "dispreferred", "loser"),
    "system": ("system", "system_prompt"),
    "completion": ("completion", "response", "output", "answer"),
    "messages": ("messages", "conversations", "conversation", "chat"),
    "text": ("text", "content"),
}
KINDS = {
    "system": ("string",), "prompt": ("string", "messages"), "chosen": ("string", "messages"), "rejected": ("string", "messages"),
    "completion": ("string", "messages"), "messages": ("messages",), "text": ("string",),
}
FORMATS = {
    "preference": ("system", "prompt", "chosen", "rejected"),
    "preference_implicit": ("chosen", "rejected"),
    "prompt_completion": ("system", "prompt", "completion"),
    "messages": ("messages",),
    "text": ("text",),
    "prompt_only": ("system", "prompt"),
}
RANKS = {
    None: ("preference", "prompt_completion", "messages", "prompt_only", "text", "preference_implicit"),
    "sft": ("messages", "prompt_completion", "preference", "text"),
    "dpo": ("preference", "preference_implicit"),
    "grpo": ("preference", "prompt_completion", "prompt_only"),
}
REQUIRED = {
    "preference": ("chosen", "rejected"), "prompt_completion": ("prompt", "completion"), "prompt_only": ("prompt",),
    "messages": ("messages",), "text": ("text",),
}


def _is_messages(column: Column, kind: T.DataType) -> Column | None:
    """Every value is an empty list or a list of structs with a textual role (or from); null for other types."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        for name in ("role", "from"):
            if name in kind.elementType.names and isinstance(kind.elementType[name].dataType, T.StringType):
                return F.forall(column, lambda m: m.isNotNull() & m[name].isNotNull())
    return None


def column_kinds(df: DataFrame) -> DataFrame:
    """(position, name, dtype, kind): string, messages, number or other, from types and one aggregate."""
    checks, rows = [], []
    for i, f in enumerate(df.schema.fields):
        fits = _is_messages(F.col(f"`{f.name}`"), f.dataType)
        if fits is not None:
            checks.append(F.coalesce(F.every(fits), F.lit(True)).alias(f"c{i}"))
    found = df.agg(*checks).first().asDict() if checks else {}
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.StringType):
            kind = "string"
        elif isinstance(f.dataType, T.NumericType):
            kind = "number"
        else:
            kind = "messages" if found.get(f"c{i}") else "other"
        rows.append((i, f.name, f.dataType.simpleString(), kind))
    return df.sparkSession.createDataFrame(rows, "position int, name string, dtype string, kind string")


def _synonyms(spark) -> DataFrame:
    rows = [(role, name, rank, kind) for role, names in SYNONYMS.items() for rank, name in enumerate(names) for kind in KINDS[role]]
    return spark.createDataFrame(rows, "role string, synonym string, synonym_rank int, kind string")


def mapping_candidates(kinds: DataFrame, objective: str | None = None) -> DataFrame:
    """All column-to-role combinations that form a format, best first, with usable, place and ambiguous.

    kinds: (dataset, position, name, kind) rows, so that many schemas are mapped at once.
    """
    matches = _matches(kinds)
    part = lambda r: [f"{r}_{c}" for c in ("name", "rank", "position")]
    by_role = {
        r: matches.where(F.col("role") == r).select("dataset", *[F.col(c).alias(n) for c, n in zip(("name", "synonym_rank", "position"), part(r))])
        for r in SYNONYMS
    }
    present = matches.groupBy("dataset").agg(F.collect_set("role").alias("present"))
    found = None
    for name, roles in FORMATS.items():
        rows = present
        for role in roles:
            rows = rows.join(by_role[role], "dataset", "left" if role == "system" else "inner")
        if name == "preference_implicit":
            rows = rows.where(~F.array_contains("present", "prompt"))
        if name == "prompt_only":
            rows = rows.where(~F.arrays_overlap("present", F.array(F.lit("chosen"), F.lit("rejected"), F.lit("completion"))))
        chosen = [
            F.col(c) if r in roles else F.lit(None).cast("string" if c.endswith("_name") else "int").alias(c)
            for r in SYNONYMS
            for c in part(r)
        ]
        rows = rows.select("dataset", F.lit(name).alias("format"), *chosen)
        found = rows if found is None else found.unionByName(rows)
    ranks = RANKS[objective]
    rank = F.coalesce(*[F.when(F.col("format") == f, F.lit(i)) for i, f in enumerate(ranks)], F.lit(99))
    order = ("system", "prompt", "chosen", "rejected", "completion", "messages", "text")
    used = F.array_compact(F.array(*[F.col(f"{r}_name") for r in order]))
    found = found.where(F.size(used) == F.size(F.array_distinct(used)))
    found = found.select(
        "dataset",
        "format",
        F.col("format").isin(*ranks).alias("usable"),
        rank.alias("format_rank"),
        sum((F.coalesce(F.col(f"{r}_rank"), F.lit(0)) for r in order), F.lit(0)).alias("synonym_rank"),
        F.array_compact(F.array(*[F.col(f"{r}_position") for r in order])).alias("positions"),
        _projection(objective).alias("consumes"),
        *[F.col(f"{r}_name").alias(r) for r in order],
    )
    best = Window.partitionBy("dataset").orderBy(F.desc("usable"), "format_rank", "synonym_rank", "positions")
    found = found.withColumn("place", F.row_number().over(best))
    top = F.min(F.struct("place", "format")).over(Window.partitionBy("dataset"))["format"]
    counted = F.col("usable") & (F.lit(objective is not None) | (F.col("format") == top))
    ways = F.size(F.collect_set(F.when(counted, F.col("consumes"))).over(Window.partitionBy("dataset")))
    return found.withColumn("ambiguous", ways > 1).drop("positions", "consumes")


def _matches(kinds: DataFrame) -> DataFrame:
    names = _synonyms(kinds.sparkSession).withColumnRenamed("kind", "role_kind")
    same = (F.lower(F.trim(kinds["name"])) == names["synonym"]) & (kinds["kind"] == names["role_kind"])
    return kinds.join(F.broadcast(names), same).select("dataset", "position", "name", "role", "synonym_rank")


def _projection(objective: str | None) -> Column:
    """The columns that the objective consumes; equal projections give equal analyses."""
    name = lambda *roles: [F.coalesce(F.col(f"{r}_name"), F.lit("-")) for r in roles]
    if objective == "dpo":
        parts = name("system", "prompt", "chosen", "rejected")
    elif objective == "grpo":
        parts = name("system", "prompt")
    elif objective == "sft":
        answer = F.coalesce(F.when(F.col("format") == "preference", F.col("chosen_name")), F.col("completion_name"), F.col("messages_name"), F.col("text_name"), F.lit("-"))
        kind = F.when(F.col("format").isin("preference", "prompt_completion"), "conversation").otherwise(F.col("format"))
        parts = [kind, *name("system", "prompt"), answer]
    else:
        parts = [F.col("format"), *name("system", "prompt", "chosen", "rejected", "completion", "messages", "text")]
    return F.concat_ws("\x1f", *parts)


def suggest(candidates: DataFrame) -> DataFrame:
    """The best usable candidate of each dataset that is not ambiguous."""
    return candidates.where("usable and not ambiguous and place = 1")


def validate_mapping(kinds: DataFrame, requested: dict[str, str], fmt: str) -> DataFrame:
    """(role, name, issue) of an explicit mapping: what is wrong with it, no rows if nothing is.

    With a column `dataset` in kinds the mapping is held against each of the datasets, and the result names them.
    """
    spark = kinds.sparkSession
    rows = spark.createDataFrame(list(requested.items()), "role string, name string")
    if "dataset" in kinds.columns:
        return _validated_each(kinds, rows, fmt)
    roles = spark.createDataFrame(
        [(r, k) for r in FORMATS[fmt] for k in KINDS[r]], "role string, kind string"
    ).groupBy("role").agg(F.collect_set("kind").alias("kinds"))
    missing = spark.createDataFrame([(r,) for r in REQUIRED[fmt]], "role string").join(rows, "role", "left_anti")
    checked = rows.join(roles, "role", "left").join(kinds.select("name", "kind"), "name", "left")
    issue = (
        F.when(F.col("kinds").isNull(), "role_not_in_format")
        .when(F.col("kind").isNull(), "missing_column")
        .when(~F.array_contains("kinds", F.col("kind")), "kind_mismatch")
    )
    out = checked.select("role", "name", issue.alias("issue")).where("issue is not null")
    return out.unionByName(missing.select("role", F.lit(None).cast("string").alias("name"), F.lit("missing_role").alias("issue")))


def _validated_each(kinds: DataFrame, requested: DataFrame, fmt: str) -> DataFrame:
    """(dataset, role, name, issue): a few requested roles against the columns of many datasets, by one join."""
    spark = kinds.sparkSession
    datasets = kinds.select("dataset").distinct()
    required = spark.createDataFrame([(r,) for r in REQUIRED[fmt]], "role string")
    allowed = F.create_map(*[x for r in FORMATS[fmt] for x in (F.lit(r), F.array(*map(F.lit, KINDS[r])))])
    all_roles = requested.join(required, "role", "full")  # a few rows, with a null name where a role was left out
    checked = datasets.crossJoin(F.broadcast(all_roles)).join(kinds.select("dataset", "name", "kind"), ["dataset", "name"], "left")
    fits = F.try_element_at(allowed, "role")
    issue = (
        F.when(F.col("name").isNull(), "missing_role")
        .when(fits.isNull(), "role_not_in_format")
        .when(F.col("kind").isNull(), "missing_column")
        .when(~F.array_contains(fits, F.col("kind")), "kind_mismatch")
    )
    return checked.select("dataset", "role", "name", issue.alias("issue")).where("issue is not null")


def apply_mapping(df: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the mapped columns, under their roles; others are never read."""
    return df.select(*keep, *[F.col(f"`{column}`").alias(role) for role, column in mapping.items()])


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts to a locked schema: structs become JSON for strings, missing columns null; a lost value is schema_mismatch."""
    columns, lost = [], F.lit(False)
    for f in schema.fields:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        have = F.col(f"`{f.name}`")
        kind = df.schema[f.name].dataType
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        out = F.to_json(have) if nested and isinstance(f.dataType, T.StringType) else have.try_cast(f.dataType)
        lost = lost | (have.isNotNull() & out.isNull())
        columns.append(out.alias(f.name))
    return df.select(*columns, F.when(lost, "schema_mismatch").alias("error_code"))


def mixed_types(df: DataFrame, json_columns: list[str], index: str = "row_index") -> DataFrame:
    """(name, first_type, row_index): JSON columns whose values change type, and the first row that differs."""
    kinds = [F.regexp_extract(F.schema_of_variant(F.try_parse_json(F.col(name))), "^[A-Z]+", 0).alias(name) for name in json_columns]
    each = df.select(index, *kinds).unpivot(index, json_columns, "name", "kind").where("kind not in ('', 'VOID')")
    # The first row of every type of a column; the earliest of them has the first type, the next one is the first that differs.
    firsts = each.groupBy("name", "kind").agg(F.min(index).alias(index))
    order = Window.partitionBy("name").orderBy(index)
    placed = firsts.withColumns({"first_type": F.first("kind").over(order), "place": F.row_number().over(order)})
    return placed.where("place = 2").select("name", "first_type", index)
