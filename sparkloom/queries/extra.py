"""Targets, guards, repository addresses, symbols, and the prose and tree views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import bindings as B
from sparkloom.functions import paths as P
from sparkloom.operators import graph as G
from sparkloom.operators import symbols as S
from sparkloom.plans import prose as T
from sparkloom.queries import extra_sql as Q
from sparkloom.queries import graphs


def contain_path(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of files seen from a folder, some of which climb out of the root."""
    climb = F.concat(F.lit("src/"), F.repeat(F.lit("../"), (F.col("doc_id") % 4).cast("int")), F.col("path"))
    return B.files(spark, sf).select("doc_id", P.inside(climb).alias("path"))


def limit_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", T.clamp(F.when(F.col("p_size") != 7, F.col("p_size") * 10 - 50), 20, 200).alias("most"))


def join_dir_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Directories by their last one to three parts."""
    return S.directories_by_suffix(B.files(spark, sf))


def repo_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of repositories and owner/name of addresses."""
    url = F.col("url")
    return B.table(spark, sf, "pages").select("page_id", T.repo_name(url).alias("name"), T.host_path(url).alias("path"))


def v_explain_file(spark: SparkSession, sf: str) -> DataFrame:
    return T.explain_files(graphs._facts(spark, sf), B.edges(spark, sf))


def v_overview(spark: SparkSession, sf: str) -> DataFrame:
    return T.overview(B.files(spark, sf), graphs._facts(spark, sf), B.edges(spark, sf))


def v_caveats(spark: SparkSession, sf: str) -> DataFrame:
    skipped = B.files(spark, sf).select(P.skip_reason(F.col("path"), F.length("text")).alias("reason"))
    return T.caveats(graphs.agg_import_tally(spark, sf), skipped)


def v_layers_view(spark: SparkSession, sf: str) -> DataFrame:
    """Every layer with its size and first members."""
    first = Window.partitionBy("layer").orderBy("node")
    ranked = graphs.g_layers(spark, sf).withColumn("k", F.row_number().over(first))
    shown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 6, F.col("node")))).cast("array<string>"), ",")
    return ranked.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), shown.alias("first"))


def v_tree(spark: SparkSession, sf: str) -> DataFrame:
    """parent, node, kind, files and depth of every folder and file."""
    return T.tree(B.files(spark, sf))


def v_hubs_prose(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence for every hub."""
    facts = G.hubs(graphs._facts(spark, sf))
    return facts.select("node", F.format_string("%s has %d dependents and %d imports", F.col("name"), F.col("fan_in"), F.col("fan_out")).alias("line"))


QUERIES = {f.__name__: f for f in (contain_path, limit_clamp, join_dir_suffix, repo_names, v_explain_file, v_overview, v_caveats, v_layers_view, v_tree, v_hubs_prose)}
ORACLES = Q.ORACLES
