"""Size-aware heavy-light join of texts by the Jaccard similarity of their n-gram sets.

A text's set holds its distinct 3-word shingles; two texts link where 100 |A and B| >= 90 |A or B|. Small sets are
enumerated: each gives all subsets of the sizes that a partner must share. Large sets scan inverted lists of their
prefixes, in which small sets with a large partner stand too. The boundary is the one with the least cost in rows. See
`set_join` for the keys, the way around heavy lists and the verification on whole sets.

Fewer words than a shingle make one shingle; texts without words and null texts have no set and link with nothing,
not even with one another. Equal sets are one set, so repeated rows and copies cost one row each. A component is named
by its least doc_id, null ones aside; a document without words names itself. Texts are taken whole, however long. Ties
cannot arise. Only the two columns named are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lengthlab.llm.common import look_up, materialise, read
from lengthlab.llm.set_join import Likeness, components_of_sets, distinct_sets, sketched

NEAR = Likeness(words=3, p=9, q=10)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = NEAR, limit: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; limit fixes the boundary between small and large sets."""
    rows = materialise(sketched(docs, id_col, text_col, like), "sketched")
    sets = distinct_sets(rows.where("size > 0"))
    labels = components_of_sets(docs, text_col, sets, like, limit=limit)
    named = sets.select("rid", "digest", "id", F.col("rid").alias("component"))
    if labels is not None:
        named = sets.select("rid", "digest", "id").join(labels, "rid", "left")
        named = named.withColumn("component", F.coalesce("component", "rid"))
    named = materialise(named.select("digest", "id", "component"), "named")
    least = materialise(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    by_set = materialise(look_up(named, least, "component").select("digest", "component_id"), "by_set")
    found = look_up(materialise(rows.select("id", "size", "digest"), "narrow"), by_set, "digest", "left")
    own = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
