"""Queries of the operators for language-model training data over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import NO_LABEL
from ..schema import label_key
from . import form_sql, leaks, mixture, neighbours, tokens, topn, unicode_form

DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    real = F.col("AUROC").between(0, 1) & F.col("similarity").between(0, 1)
    return topn.top_n_per_group(table(spark, sf, "dmg_table"), "hypo_in", F.col("AUROC") * F.col("similarity"), "names", "dmg_id", 10, real)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, sf, "adata").select("cell", "X_pca"), "cell", "X_pca", DIM, k=5, least=0.95)
    return neighbours.similar_pairs(found).select(F.col("id_a").alias("cell_a"), F.col("id_b").alias("cell_b"))


def twentieth(adata: DataFrame) -> DataFrame:
    """The query cells: those whose number is divisible by 20."""
    return adata.where(F.pmod(F.regexp_extract("cell", r"(\d+)$", 1).try_cast("long"), F.lit(20)) == 0).select(F.col("cell").alias("id")).distinct()


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar cells of every query cell, against all cells, whatever their similarity."""
    adata = table(spark, sf, "adata").select("cell", "X_pca")
    return neighbours.neighbours(adata, "cell", "X_pca", DIM, k=5, post=4, probe=48, keep=2048, queries=twentieth(adata))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    label = label_key(F.col("groups"))
    return mixture.mixture_members(table(spark, sf, "adata").select("cell", "X_pca", "groups"), "cell", "X_pca", DIM, F.when(~label.isin(*NO_LABEL), label))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.doubtful_labels(_members(spark, sf)).select(F.col("id").alias("cell"), F.col("label").alias("groups"))


def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its size, label and most typical cells."""
    members = _members(spark, sf)
    typical = mixture.typical_members(members).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical"))
    return mixture.cluster_labels(members).join(typical, "cluster").select("cluster", "n", F.col("label").alias("groups"), "n_label", "typical")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without passages of evaluation texts."""
    return leaks.without_leaks(table(spark, sf, "documents").select("doc_id", "text", "lang"), p9_leaks(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = unicode_form.alike_pairs(table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that others read like, with how many."""
    return unicode_form.alike_links(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "links")


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return table(spark, sf, "documents").select("doc_id", unicode_form.consistent_form(F.col("text")).alias("form"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_neighbours, p6_found, p6_clusters, p8_ids, p9_found, p9_leaks, p9_clean, p10_found, p10_links, p10_forms)}

SQL = {
    "p2_found": """
        WITH v AS (SELECT hypo_in, names, left_right, pvals_adj, delta, hyper_in, AUROC, similarity, min(dmg_id) AS dmg_id FROM dmg_table
          WHERE hypo_in IS NOT NULL AND AUROC BETWEEN 0 AND 1 AND similarity BETWEEN 0 AND 1 AND NOT isnan(AUROC) AND NOT isnan(similarity) GROUP BY ALL)
        SELECT hypo_in, dmg_id FROM (SELECT *, row_number() OVER (PARTITION BY hypo_in
          ORDER BY AUROC * similarity DESC, names ASC NULLS LAST, dmg_id ASC) AS k FROM v) WHERE k <= 10
    """,
    "p5_found": """
        WITH u AS (SELECT cell, any_value(X_pca)::DOUBLE[64] AS v FROM adata WHERE cell IS NOT NULL AND len(X_pca) = 64 AND len(list_filter(X_pca, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(X_pca, lambda x: x <> 0)) > 0 GROUP BY 1),
          p AS (SELECT a.cell AS a, b.cell AS b, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.cell <> b.cell WHERE array_cosine_similarity(a.v, b.v) >= 0.95),
          n AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS cell_a, greatest(a, b) AS cell_b FROM n
    """,
    # another method gives the same answer on these tables: the label whose median vector is nearest
    "p6_found": """
        WITH u AS (SELECT cell, any_value(X_pca) AS v FROM adata WHERE cell IS NOT NULL AND len(X_pca) = 64 AND len(list_filter(X_pca, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(X_pca, lambda x: x <> 0)) > 0 GROUP BY 1),
          l AS (SELECT cell, min(lower(trim(groups))) AS label FROM adata WHERE lower(trim(groups)) NOT IN ('', 'na', 'nan', 'none', 'unassigned') GROUP BY 1),
          c AS (SELECT label, list(m ORDER BY i)::DOUBLE[64] AS centre FROM (SELECT label, i, median(x) AS m FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(v)::DOUBLE AS x FROM u JOIN l USING (cell)) GROUP BY 1, 2) GROUP BY 1),
          n AS (SELECT cell, c.label FROM u CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY array_distance(v::DOUBLE[64], centre)) = 1)
        SELECT n.cell, n.label AS groups FROM n LEFT JOIN l USING (cell) WHERE l.label IS NULL OR l.label <> n.label
    """,
    "p9_found": f"WITH {form_sql.passages()} SELECT doc_id, item_id FROM passage",
    "p9_leaks": f"WITH {form_sql.passages()} SELECT doc_id, item_id, words, at_word FROM passage",
    "p9_clean": f"WITH {form_sql.passages()} SELECT doc_id, text, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM passage)",
    "p10_found": f"""
        WITH {form_sql.forms("documents", "doc_id")}, f AS (SELECT doc_id, text, form FROM documents JOIN documents_form USING (doc_id) WHERE regexp_matches(form, '\\S'))
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id
    """,
    "p10_links": f"""
        WITH {form_sql.forms("documents", "doc_id")}, f AS (SELECT doc_id, text, form FROM documents JOIN documents_form USING (doc_id) WHERE regexp_matches(form, '\\S'))
        SELECT a.doc_id, count(*) AS links FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text GROUP BY 1
    """,
    "p10_forms": f"WITH {form_sql.forms('documents', 'doc_id')} SELECT doc_id, form FROM documents LEFT JOIN documents_form USING (doc_id)",
}
