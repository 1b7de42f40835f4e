"""Occupation coding: vector top-k, routes, hierarchy paths, parent expansion and explanations."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared, vector_index

SURE = 0.92
USABLE = 0.35
UNKNOWN = ("Unknown", "غير معروف")
DISCOUNT = {2: 0.85, 1: 0.70}


def clamped_k(k: int) -> int:
    return max(1, min(10, k))


def top_k(queries: DataFrame, index: DataFrame | str, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, code, item_id, confidence, rank): the k nearest items of each query, confidence cut to 0..1 and rounded to four places.

    The index is the path of a stored one, or items (item_id, code, embedding) that are stored first. Exact unless ``probes`` says how many lists to read.
    """
    if not isinstance(index, str):
        path = f"{shared.folder(queries.sparkSession)}/index-{uuid4().hex}"
        vector_index.rebuild(index, path)
        index = path
    return vector_index.search(queries, index, k, probes)


def route(best: DataFrame) -> DataFrame:
    """For each query: its best code, the method (semantic, llm_ranked or none) and whether a re-rank is needed."""
    top = best.groupBy("query_id").agg(F.min_by("code", "rank").alias("code"), F.max("confidence").alias("confidence"))
    return top.withColumns({
        "method": F.when(F.col("confidence") >= SURE, "semantic").otherwise("llm_ranked"), "needs_rerank": F.col("confidence") < SURE,
        "usable": F.col("confidence") >= USABLE,
    })


def empty_route(query: Column) -> Column:
    """What a blank title or one without candidates gives."""
    return F.struct(query.alias("query"), F.lit("").alias("code"), F.lit(UNKNOWN[0]).alias("title_en"), F.lit(UNKNOWN[1]).alias("title_ar"),
                    F.lit(0).alias("level"), F.lit(0.0).alias("confidence"), F.lit("semantic").alias("method"))


def with_path(matches: DataFrame, dimension: DataFrame) -> DataFrame:
    """matches with major and sub-major code and titles of their code's prefixes; Unknown where the dimension lacks them."""
    def side(n: int, name: str) -> DataFrame:
        return F.broadcast(dimension.select(F.col("code").alias(f"_{name}"), F.col("title_en").alias(f"{name}_title_en"), F.col("title_ar").alias(f"{name}_title_ar")))

    out = matches.withColumns({"major_code": F.substring("code", 1, 1), "sub_major_code": F.when(F.length("code") >= 2, F.substring("code", 1, 2))})
    for n, name in ((1, "major"), (2, "sub_major")):
        out = out.join(side(n, name), F.col(f"{name}_code") == F.col(f"_{name}"), "left").drop(f"_{name}")
        known = F.col(f"{name}_code").isNotNull()
        out = out.withColumns({
            f"{name}_title_{lang}": F.when(known, F.coalesce(f"{name}_title_{lang}", F.lit(text))) for lang, text in zip(("en", "ar"), UNKNOWN, strict=True)
        })
    return out


def expand(raw: DataFrame, dimension: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, code, confidence, stage, rank, method): retrieved matches (query_id, code, confidence, rank), first of each code, with missing parents.

    A parent takes the confidence of its best level-4 child, discounted by its level; retrieved matches precede parents
    of equal confidence. The method is hierarchical only if a parent is among the k that stay.
    """
    first = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("rank"))
    kept = raw.withColumn("_f", first).where("_f = 1").drop("_f")
    level4 = kept.join(F.broadcast(dimension.where("level = 4").select("code")), "code", "left_semi")
    parents = None
    for n, by in DISCOUNT.items():
        p = level4.groupBy("query_id", F.substring("code", 1, n).alias("code")).agg(
            F.round(F.max("confidence") * by, 4).alias("confidence"), (F.min("rank") * 2 + (0 if n == 2 else 1)).alias("ord"))
        parents = p if parents is None else parents.unionByName(p)
    parents = parents.join(F.broadcast(dimension.select("code")), "code", "left_semi").join(kept.select("query_id", "code"), ["query_id", "code"], "left_anti")
    every = kept.select("query_id", "code", "confidence", F.lit("semantic").alias("stage"), F.lit(0).alias("s"), F.col("rank").alias("ord")).unionByName(
        parents.select("query_id", "code", "confidence", F.lit("hierarchical_expansion").alias("stage"), F.lit(1).alias("s"), "ord"))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "s", "ord")
    out = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    grown = F.max("s").over(Window.partitionBy("query_id")) == 1
    return out.withColumn("method", F.when(grown, "hierarchical").otherwise("semantic_only")).drop("s", "ord")


def retrieve(queries: DataFrame, index: DataFrame | str, dimension: DataFrame, k: int = 5) -> DataFrame:
    """Twice the clamped k are retrieved, parents added, k kept: (query_id, code, confidence, stage, rank, method, total_retrieved).

    A query without candidates gives one row with a null code, no matches and the method semantic_only.
    """
    k = clamped_k(k)
    raw = top_k(queries, index, 2 * k)
    found = raw.groupBy("query_id").agg(F.count("*").alias("total_retrieved"))
    out = expand(raw, dimension, k).join(found, "query_id")
    none = queries.select("query_id").join(found, "query_id", "left_anti")
    return out.unionByName(none.withColumns({"method": F.lit("semantic_only"), "total_retrieved": F.lit(0).cast("long")}), allowMissingColumns=True)


def explained(matches: DataFrame, dimension: DataFrame, replies: Column) -> DataFrame:
    """matches with titles and explanations: those of the reply map (code to en, ar), else generated ones."""
    d = F.broadcast(dimension.select("code", "title_en", "title_ar", "level", "description"))
    out = matches.withColumn("_e", replies).join(d, "code", "left")
    got = F.try_element_at("_e", F.col("code"))
    return out.withColumns({
        "explanation_en": F.coalesce(got["en"], F.format_string("Matches '%s' based on semantic similarity to the query.", "title_en")),
        "explanation_ar": F.when(got.isNotNull(), got["ar"]).otherwise(F.format_string("يطابق '%s' بناءً على التشابه الدلالي مع الاستعلام.", "title_ar")),
    }).drop("_e")


def chosen(topk: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, code, reasoning): a re-ranker's reply (query_id, reply) read against the candidates, the best one if it names none."""
    from ..functions import replies as parse

    codes = topk.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))
    out = codes.join(replies, "query_id", "left").withColumn("s", parse.selection(F.col("reply"), F.col("codes")))
    return out.select("query_id", "s.code", "s.reasoning")
