"""Past cases: similarity, rule distillation, retrieval and recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.functions import scalars as S
from sonde.operators.windows import top_k
from sonde.plans.stages import written


def with_norm(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add the Euclidean norm of a sparse feature map."""
    return df.withColumn("norm", F.sqrt(F.aggregate(F.map_values(pattern), F.lit(0.0), lambda a, v: a + v * v)))


def cosine(a: str, b: str, norm_a: str, norm_b: str):
    """Cosine of two sparse maps over the union of their keys; 0 when one is empty or null."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(
        F.try_element_at(F.col(b), e["key"]), F.lit(0.0)))
    ok = (F.col(norm_a) >= 1e-12) & (F.col(norm_b) >= 1e-12)
    return F.when(ok, dot / F.greatest(F.col(norm_a) * F.col(norm_b), F.lit(1e-300))).otherwise(0.0)


def _same(a, b):
    """Equality in which a null equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def _meet(queries: DataFrame, store: DataFrame, salt) -> DataFrame:
    """Rows of ``queries`` (q_component, q_type) with the rows of ``store`` that are relevant to them.

    Two equi-joins whose second skips what the first already paired. Queries without any
    relevant case are a stated set that meets all of the store in blocks (``salt`` spreads them).
    """
    salts = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_component = queries.join(store, F.col("q_component") == F.col("component"))
    by_type = queries.join(store, F.col("q_type") == F.col("anomaly_type")).filter(~_same(F.col("q_component"), F.col("component")))
    alone = (queries.join(store.select(F.col("component").alias("q_component")).distinct(), "q_component", "left_anti")
             .join(store.select(F.col("anomaly_type").alias("q_type")).distinct(), "q_type", "left_anti")
             .select(*queries.columns, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")))
    rest = alone.join(store.withColumn("_salt", F.pmod(salt, F.lit(salts))), "_salt").drop("_salt")
    return by_component.unionByName(by_type).unionByName(rest)


def relevant_pairs(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Ids of query and case that share component or anomaly type; all cases for a query that shares neither."""
    q = queries.select("query_id", F.col("component").alias("q_component"), F.col("anomaly_type").alias("q_type"))
    return _meet(q, store.select("case_id", "component", "anomaly_type"), F.hash("case_id")).select("query_id", "case_id")


BLOCK = ["component", "anomaly_type", "block"]


def _in_block():
    """Join condition of a case with a visited block; nulls of component and type match themselves."""
    return (F.col("block") == F.col("_b_block")) & F.col("component").eqNullSafe(F.col("_b_component")) & F.col(
        "anomaly_type").eqNullSafe(F.col("_b_anomaly_type"))


def case_blocks(store: DataFrame, rows: int) -> DataFrame:
    """Cases with ``norm``, ``unit`` (absolute weights over the norm) and a ``block`` of about ``rows`` alike cases.

    Cases of a component and type are alike when their heaviest feature and its share, in
    eighths, agree; a shape with more than ``rows`` cases is cut by a hash of case_id.
    """
    s = with_norm(store.select("case_id", "component", "anomaly_type", "pattern"))
    unit = F.when(F.col("norm") >= 1e-12, F.transform(F.map_entries("pattern"), lambda e: F.struct(
        (F.abs(e["value"]) / F.col("norm")).alias("u"), e["key"].alias("f"))))
    s = s.withColumn("unit", F.coalesce(unit, F.array().cast("array<struct<u:double,f:string>>"))).withColumn("_top", F.array_max("unit"))
    shape = F.xxhash64("component", "anomaly_type", "_top.f", F.floor(F.coalesce("_top.u", F.lit(0.0)) * 8))
    s = s.withColumn("_shape", shape)
    parts = s.groupBy("_shape").agg(F.ceil(F.count("*") / rows).cast("bigint").alias("_parts"))
    cut = F.pmod(F.xxhash64("case_id"), F.col("_parts"))
    return s.join(parts, "_shape").withColumn("block", F.xxhash64("_shape", cut)).drop("_top", "_shape", "_parts")


def block_bounds(blocks: DataFrame) -> DataFrame:
    """Per block its number of cases ``n`` and the largest unit weight of each feature."""
    entries = F.concat(F.array(F.struct(F.lit(0.0).alias("u"), F.lit(None).cast("string").alias("f"))), "unit")
    top = blocks.select(*BLOCK, F.inline(entries)).groupBy(*BLOCK, "f").agg(F.max("u").alias("u"), F.count("*").alias("_n"))
    return top.groupBy(*BLOCK).agg(
        F.max(F.when(F.col("f").isNull(), F.col("_n"))).alias("n"),
        F.map_from_entries(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "u")))).alias("most"))


def similar_cases(queries: DataFrame, store: DataFrame, k: int | None = 3, rows: int = 4096, direct: int = 50_000) -> DataFrame:
    """Best ``k`` cases per query: cosine + 0.2 for the component + 0.2 for the type, at most 1 (None: all, ranked).

    Exact, without scoring every relevant pair: no case of a block scores above the sum of the
    query's unit weights times the block's largest ones. Blocks of the highest bounds that
    hold ``k`` cases give the k-th best score so far; of the others only those whose bound
    reaches it are scored. A task scores whole blocks and keeps its best ``k`` of each query,
    so patterns are shuffled per block and never per pair. A store of at most ``direct`` cases,
    for which bounds cost more than they save, is scored whole with the same result.
    ``query_id`` is unique; null patterns score 0, null components or types match nothing.
    """
    q = with_norm(queries).select("query_id", F.col("component").alias("q_component"), F.col("anomaly_type").alias("q_type"),
                                  F.col("pattern").alias("q_pattern"), F.col("norm").alias("q_norm"))
    bonus = (F.when(F.col("q_component") == F.col("component"), 0.2).otherwise(0.0)
             + F.when(F.col("q_type") == F.col("anomaly_type"), 0.2).otherwise(0.0))
    similarity = S.rounded(F.least(F.lit(1.0), cosine("q_pattern", "pattern", "q_norm", "norm") + bonus), 6).alias("similarity")
    order = [F.desc("similarity"), "case_id"]
    if k is None or store.select(F.lit(1)).limit(direct + 1).count() <= direct:
        pairs = _meet(q, with_norm(store.select("case_id", "component", "anomaly_type", "pattern")), F.hash("case_id"))
        return top_k(pairs.select("query_id", "case_id", similarity), ["query_id"], order, k)

    q, blocks = written(q, "asked"), written(case_blocks(store, rows), "blocks")
    reach = F.aggregate(F.map_entries("q_pattern"), F.lit(0.0), lambda acc, e: acc + F.abs(e["value"]) * F.coalesce(
        F.try_element_at("most", e["key"]), F.lit(0.0))) / F.greatest("q_norm", F.lit(1e-300))
    # the slack covers the rounding of scores to six places
    bound = F.least(F.lit(1.0), F.least(F.lit(1.0), F.when(F.col("q_norm") >= 1e-12, reach).otherwise(0.0)) + bonus) + 1e-6
    bounds = _meet(q, written(block_bounds(blocks), "bounds"), F.col("block")).select("query_id", *BLOCK, "n", bound.alias("bound"))
    before = W.partitionBy("query_id").orderBy(F.desc("bound"), *BLOCK).rowsBetween(W.unboundedPreceding, -1)
    bounds = written(bounds.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0)) < k), "reach")

    def scored(visits):
        asked = visits.select("query_id", *[F.col(c).alias(f"_b_{c}") for c in BLOCK]).join(q, "query_id")
        return blocks.join(asked, _in_block()).select("query_id", "case_id", similarity)

    near = written(top_k(scored(bounds.filter("_first")), ["query_id"], order, k), "near")
    reached = near.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("_kth"))
    later = bounds.filter("NOT _first").join(reached, "query_id").filter("bound >= _kth")
    return top_k(near.drop("rank").unionByName(scored(later)), ["query_id"], order, k)


def statistics(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        S.rounded(F.count_if("success") / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"),
        F.count_distinct("component").alias("components"), F.count_distinct("reason").alias("reasons"))


def type_distribution(store: DataFrame) -> DataFrame:
    return store.groupBy("anomaly_type").agg(F.count("*").alias("n"))


def distil_rules(store: DataFrame, keep: float = 0.7, prune: float = 0.3) -> DataFrame:
    """Rules per (component, type): centroid of successes, modal reason, rate and confidence.

    Centroids come from exploded features with partial sums; a feature missing in a case
    counts as zero.
    """
    keys = ["component", "anomaly_type"]
    good = store.filter("success")
    count = store.groupBy(*keys).agg(F.count_if("success").alias("_ok"), F.count("*").alias("sample_count")).filter("_ok > 0")
    reason = good.groupBy(*keys, "reason").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.min_by("reason", F.struct(-F.col("_n"), F.col("reason"))).alias("reason"))
    sums = good.select(*keys, F.explode("pattern").alias("feature", "weight")).groupBy(*keys, "feature").agg(F.sum("weight").alias("_s"))
    centroid = sums.join(count, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("feature", S.rounded(F.col("_s") / F.col("_ok"), 4).alias("w"))))).alias("pattern"))
    rate = F.col("_ok") / F.col("sample_count")
    df = count.join(reason, keys).join(centroid, keys).withColumn("success_rate", rate).withColumn(
        "confidence", rate * F.least(F.lit(1.0), F.col("sample_count") / 5.0))
    return df.filter((F.col("confidence") >= keep) & (F.col("confidence") >= prune)).select(
        *keys, "reason", "pattern", "sample_count", S.rounded(F.col("success_rate"), 4).alias("success_rate"),
        S.rounded(F.col("confidence"), 4).alias("confidence"))


def best_rule(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule of the query's type with the largest positive confidence times cosine."""
    q = with_norm(queries).select("query_id", F.col("anomaly_type"), F.col("pattern").alias("q_pattern"), F.col("norm").alias("q_norm"))
    scored = q.join(with_norm(rules), "anomaly_type").withColumn(
        "score", S.rounded(F.col("confidence") * cosine("q_pattern", "pattern", "q_norm", "norm"), 6)).filter("score > 0")
    return top_k(scored.select("query_id", "component", "anomaly_type", "reason", "score"), ["query_id"], [F.desc("score"), "component"], 1).drop("rank")


def _set(name: str):
    return F.array_distinct(F.coalesce(F.array_compact(name), F.array().cast("array<string>")))


def retrieve_cases(queries: DataFrame, cases: DataFrame, k: int = 3, rare: int = 1000) -> DataFrame:
    """Best ``k`` cases per query: token share + 0.2 for the dataset + 0.1 per shared component, ties by case_id.

    ``queries`` and ``cases`` hold tokens and components (arrays taken as sets; null: none) and dataset. The
    answer is exact without a pair through a token that most cases hold:

    * cases that share no token score alike where dataset and components are alike, so the first ``k``
      of each such class stand for it;
    * the rarest tokens of a query, up to ``rare`` postings, are looked up first and with the classes give
      the k-th best score so far;
    * a case whose rarest shared token comes later shares that token and more common ones at most. Such
      a token is looked up only if all of them together could still reach the k-th best score.
    """
    q = queries.select("query_id", F.col("dataset").alias("q_dataset"), _set("tokens").alias("q_tokens"), _set("components").alias("q_components"))
    c = cases.select("case_id", "dataset", _set("tokens").alias("tokens"), _set("components").alias("components"))
    postings = c.select("case_id", F.explode("tokens").alias("t"))
    w = W.partitionBy("query_id").orderBy("_df", "t")
    asked = (q.select("query_id", F.size("q_tokens").alias("_n"), (0.2 + 0.1 * F.size("q_components")).alias("_bonus"), F.explode("q_tokens").alias("t"))
             .join(postings.groupBy("t").agg(F.count("*").alias("_df")), "t")
             .withColumn("_upto", F.sum("_df").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
             .withColumn("_left", F.count("*").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))))
    asked = written(asked, "asked")

    def looked_up(tokens):
        return tokens.select("query_id", "t").join(postings, "t").select("query_id", "case_id")

    def scored(pairs):
        df = pairs.distinct().join(q, "query_id").join(c, "case_id")
        shared = lambda a, b: F.size(F.array_intersect(a, b))
        score = (shared("q_tokens", "tokens") / F.greatest(F.size("q_tokens"), F.lit(1))
                 + F.when(F.col("dataset") == F.col("q_dataset"), 0.2).otherwise(0.0) + 0.1 * shared("q_components", "components"))
        return df.select("query_id", "case_id", S.rounded(score, 6).alias("score")).filter("score > 0")

    order = [F.desc("score"), "case_id"]
    first = top_k(c.withColumn("_class", F.array_sort("components")).select("case_id", "dataset", "components", "_class"),
                  ["dataset", "_class"], ["case_id"], k)
    alike = q.join(first, F.col("q_dataset") == F.col("dataset")).select("query_id", "case_id").unionByName(
        q.select("query_id", F.explode("q_components").alias("c")).join(first.select("case_id", F.explode("components").alias("c")), "c")
        .select("query_id", "case_id"))
    near = written(scored(alike.unionByName(looked_up(asked.filter(F.col("_upto") <= rare)))), "near")
    reached = top_k(near, ["query_id"], order, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    later = asked.filter(F.col("_upto") > rare).join(reached, "query_id", "left").filter(
        F.col("_left") / F.col("_n") + F.col("_bonus") + 1e-6 >= F.coalesce("_kth", F.lit(0.0)))
    rest = scored(looked_up(later).join(near, ["query_id", "case_id"], "left_anti"))
    return top_k(near.unionByName(rest), ["query_id"], order, k)


def record_cases(cases: DataFrame, path: str) -> None:
    """Append cases to the memory; those scored below 1 also to the failure bank."""
    cases.write.mode("append").json(f"{path}/cases")
    cases.filter("score < 1.0").write.mode("append").json(f"{path}/failures")


def frequent_reasons(cases: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent reasons of the cases scored 1."""
    per = cases.filter("score = 1.0").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "reason").limit(k)
