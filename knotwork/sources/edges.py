"""Edge lists, labels and query files, from text, Parquet and the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The label of a vertex without one, and those of the derived graphs.
DEFAULT_LABEL, LABELS = "_", "ABCDE"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of each line that isn't a comment; a leading blank makes an empty first token."""
    return spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.split("value", r"\s+").alias("t"))


def edges_from_text(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of each line with exactly two tokens that aren't equal, as written; repeated lines stay. Two tokens
    of which one is no number (a line with a leading blank and one number, say) fail, others are never cast."""

    def vertex(i: int) -> Column:
        token = F.get("t", F.lit(i))
        n = F.expr(f"try_cast(get(t, {i}) AS BIGINT)")
        return F.when(n.isNull(), F.raise_error(F.concat(F.lit("not a vertex id: '"), token, F.lit("'"))).cast("long")).otherwise(n)

    # one conditional holds all tests, as Spark may try filters in any order
    all_ = spark.read.text(path).select("value", F.split("value", r"\s+").alias("t"))
    telling = ~F.startswith("value", F.lit("#")) & (F.size("t") == 2)
    two = all_.select(F.when(telling, F.struct(vertex(0).alias("src"), vertex(1).alias("dst"))).alias("e"))
    return two.filter("e is not null").select("e.src", "e.dst").filter("src <> dst")


def sorted_edge_list(edges: DataFrame) -> DataFrame:
    """``src < dst`` for each row; repeated rows stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, ``src < dst``, without loops and nulls."""
    return sorted_edge_list(edges.filter("src <> dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of canonical edges; doubles the rows, no shuffle."""
    pair = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(pair).alias("e")).select("e.src", "e.dst")


def edges_from_parquet(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return spark.read.parquet(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src <> dst")


def co_occurrence(spark: SparkSession, sf_dir: str, least_quantity: float | None = 40, item: str = "l_partkey", group: str = "l_orderkey") -> DataFrame:
    """Canonical edges between items of one order: by default parts of which at least 40 were ordered together,
    without ``least_quantity`` those of all rows."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = (li if least_quantity is None else li.filter(F.col("l_quantity") >= least_quantity)).select(F.col(group).alias("g"), F.col(item).alias("v")).distinct()
    return li.alias("a").join(li.alias("b"), "g").filter("a.v < b.v").select(F.col("a.v").alias("src"), F.col("b.v").alias("dst")).distinct()


def derived_label(vertex: Column, labels: str = LABELS) -> Column:
    return F.substring(F.lit(labels), (vertex % len(labels) + 1).cast("int"), F.lit(1))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label`` of each part."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), derived_label(F.col("p_partkey")).alias("label"))


def labels_from_text(spark: SparkSession, path: str) -> DataFrame:
    """``id, label``, the first two tokens of each line."""
    return lines(spark, path).filter(F.size("t") >= 2).select(F.col("t")[0].cast("long").alias("id"), F.col("t")[1].alias("label"))


def random_labels(vertices: DataFrame, labels: list[str], seed: int = 0) -> DataFrame:
    """``id, label``: a label by a hash of seed and id, so the same in each run."""
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(len(labels))).cast("int") + 1
    return vertices.select("id", F.element_at(F.array(*map(F.lit, labels)), pick).alias("label"))


def with_labels(vertices: DataFrame, labels: DataFrame | None = None, default: str = DEFAULT_LABEL) -> DataFrame:
    """``id, label`` for each vertex, the default where there is none."""
    if labels is None:
        return vertices.select("id", F.lit(default).alias("label"))
    return vertices.select("id").join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit(default)).alias("label"))
