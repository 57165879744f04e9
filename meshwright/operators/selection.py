"""Selection among trained runs: one named beforehand is frozen at its best validation epoch, and only then is anything tested."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions.aggregates import metrics_by
from meshwright.operators import training
from meshwright.operators.training import Network, Weights
from meshwright.shared import written

FROZEN = "selected_model string, selection_basis string, validation_best_mse double, validation_best_epoch int, test_access_before_freeze boolean, seed int"
#: What a selection says it rests on (fixed value).
BASIS = "pre-specified primary edge-aware GNN; best epoch selected on validation only"


def compared(spark: SparkSession, ledger: str) -> DataFrame:
    """A row for each run of a ledger, by best validation loss: rank, model, best_val_mse, best_epoch, epochs_run.

    The best epoch is the ledger's own, the last that fell by the protocol's least step. Runs of equal loss go by name; a run without
    a finite loss comes last, without an epoch.
    """
    rows = spark.read.schema(training.LEDGER).parquet(ledger).select("run", "epoch", "best", "best_epoch")
    runs = rows.groupBy(F.col("run").alias("model")).agg(F.max_by(F.struct("best", "best_epoch"), "epoch").alias("_b"), F.max("epoch").alias("epochs_run"))
    had = F.col("_b.best_epoch") > 0
    runs = runs.select("model", F.when(had, F.col("_b.best")).alias("best_val_mse"), F.when(had, F.col("_b.best_epoch")).alias("best_epoch"), "epochs_run")
    order = Window.orderBy(F.asc_nulls_last("best_val_mse"), "model")  # a row for each run
    return runs.withColumn("rank", F.row_number().over(order))


def freeze(spark: SparkSession, ledger: str, path: str, primary: str, seed: int = 0, basis: str = BASIS) -> DataFrame:
    """The frozen selection of the run ``primary``, written to ``path`` once.

    The model isn't chosen by its loss: ``primary`` is named beforehand, and only its epoch comes of validation. Raises where the
    ledger hasn't that run or none of its epochs is finite, and where ``path`` has another selection already.
    """
    rows = spark.read.schema(training.LEDGER).parquet(ledger).filter(F.col("run") == primary)
    best = rows.filter("best_epoch = epoch").orderBy(F.desc("epoch")).select("val_loss", "epoch").first()
    if best is None:
        raise ValueError(f"the ledger has no validated epoch of {primary}")
    row = (primary, basis, best["val_loss"], best["epoch"], False, seed)
    if training._exists(spark, path):
        if tuple(frozen(spark, path)) != row:
            raise ValueError(f"{path} holds another selection; a frozen one stays")
    else:
        spark.createDataFrame([row], FROZEN).coalesce(1).write.json(path)
    return spark.read.schema(FROZEN).json(path)


def frozen(spark: SparkSession, path: str):
    """The frozen selection's row; raises where nothing was frozen."""
    if not training._exists(spark, path):
        raise ValueError(f"{path} has no selection: freeze one before the test")
    return spark.read.schema(FROZEN).json(path).first()


def timed(network: Network, weights: Weights, nodes: DataFrame, edges: DataFrame, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """Predictions (sample_id, node, p), and the wall time of each batch of samples: batch, graphs, ms, ms_per_graph.

    Samples are dealt to ``batches`` by a hash; each batch is written, so its time holds the whole forward pass. A pass over
    many graphs has no time for one of them but its share.
    """
    spark = nodes.sparkSession
    edges = edges if "share" in edges.columns else training.prepared(network, edges)
    dealt = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("sample_id"), F.lit(batches)))
    nodes, edges = written(dealt(nodes), "timed-nodes"), written(dealt(edges), "timed-edges")
    graphs = {r["_b"]: r["n"] for r in nodes.groupBy("_b").agg(F.countDistinct("sample_id").alias("n")).collect()}
    parts, times = [], []
    for b, n in sorted(graphs.items()):
        of = F.col("_b") == b
        start = time.perf_counter()
        parts.append(written(training.predict(network, weights, nodes.filter(of).drop("_b"), edges.filter(of).drop("_b")), "timed"))
        ms = (time.perf_counter() - start) * 1000
        times.append((int(b), int(n), ms, ms / n))
    out = reduce(DataFrame.union, parts) if parts else training.predict(network, weights, nodes.drop("_b"), edges.drop("_b"))
    return out, spark.createDataFrame(times, "batch int, graphs int, ms double, ms_per_graph double")


def tested(
    ledger: str,
    path: str,
    networks: dict[str, Network],
    nodes: DataFrame,
    edges: DataFrame,
    targets: list[str],
    inverse: Callable[[int, Column], Column] | None = None,
    batches: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Metrics of runs at their best epochs on test nodes: for each model and target with mean and median times, and for each graph.

    Refuses where nothing is frozen at ``path``. ``selected`` marks the frozen run. ``inverse`` of a target's number and a column
    brings outputs and truths back to physical units.
    """
    spark = nodes.sparkSession
    selected = frozen(spark, path)["selected_model"]
    inverse = inverse or (lambda k, c: c)
    overall, each = [], []
    for run, network in networks.items():
        p, times = timed(network, training.best_weights(spark, ledger, run), nodes.select("sample_id", "node", "x"), edges, batches)
        both = p.join(nodes.select("sample_id", "node", "y"), ["sample_id", "node"])
        values = [F.struct(F.lit(t).alias("target"), inverse(k, F.get("y", F.lit(k))).alias("y"), inverse(k, F.get("p", F.lit(k))).alias("p")) for k, t in enumerate(targets)]
        long = written(both.select("sample_id", F.explode(F.array(*values)).alias("v")).select("sample_id", "v.*"), "tested")
        ms = times.agg(F.expr("sum(ms) / sum(graphs)").alias("mean_inference_ms_per_graph"), F.median("ms_per_graph").alias("median_inference_ms_per_graph"))
        model = [F.lit(run).alias("model"), F.lit(run == selected).alias("selected")]
        overall.append(metrics_by(long, ["target"], "y", "p").crossJoin(F.broadcast(ms)).select(*model, "*"))  # one row of times
        each.append(metrics_by(long, ["sample_id", "target"], "y", "p").select(*model, "*"))
    return reduce(DataFrame.unionByName, overall), reduce(DataFrame.unionByName, each)
