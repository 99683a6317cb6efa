"""Context capsules: the few symbols that fit a query and a token budget, with their neighbourhood.

Pivots are found by full text and vectors, project files before reference files, and shown whole
while the budget lasts (tokens are a quarter of the characters), else as a skeleton. Only a few
rows reach this stage, so the running budget is a fold over one short array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 3


def pivots(ranked: DataFrame, nodes: DataFrame, budget: int, share: float = 0.7) -> DataFrame:
    """ranked: (id, place); nodes: unique (id, fqn, file_path, signature, docstring, raw_body).

    (position, id, fqn, whole, text): at most three, those under references/ last. A pivot is whole
    if the texts before it and itself stay within the share of the budget.
    """
    first = ranked.groupBy("id").agg(F.min("place").alias("place"))
    found = nodes.join(F.broadcast(first), "id")
    best = found.orderBy(F.coalesce(F.startswith("file_path", F.lit("references/")), F.lit(False)).cast("int"), "place", "id").limit(PIVOTS)
    order = [F.coalesce(F.startswith("file_path", F.lit("references/")), F.lit(False)).cast("int"), F.col("place"), F.col("id")]
    short = F.concat_ws("\n", "signature", F.when(F.trim("docstring") != "", F.col("docstring")))
    one = best.select(F.struct(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("position"), "id", "fqn", F.coalesce("raw_body", F.lit("")).alias("body"), F.coalesce(short, F.lit("")).alias("short")).alias("p"))
    rows = one.agg(F.array_sort(F.collect_list("p")).alias("ps"))
    cost = lambda t: F.length(t) / F.lit(4.0)

    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<struct<position:int,id:string,fqn:string,whole:boolean,text:string>>").alias("out"))

    def step(acc, p):
        whole = acc["used"] + cost(p["body"]) <= F.lit(budget * share)
        text = F.when(whole, p["body"]).otherwise(p["short"])
        row = F.struct(p["position"].alias("position"), p["id"].alias("id"), p["fqn"].alias("fqn"), whole.alias("whole"), text.alias("text"))
        return F.struct((acc["used"] + cost(text)).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return rows.select(F.explode(F.aggregate("ps", start, step)["out"]).alias("r")).select("r.*")


def related(found: DataFrame, neighbors: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(fqn, signature) of one-hop neighbours of the pivots, in order of name, while their running cost stays within the budget."""
    near = neighbors.join(F.broadcast(found.select(F.col("fqn").alias("node"))), "node").select(F.col("neighbor").alias("fqn")).distinct()
    near = near.join(found.select("fqn"), "fqn", "left_anti")
    rows = nodes.select("fqn", "signature").where("signature is not null").join(near, "fqn", "left_semi").groupBy("fqn").agg(F.min("signature").alias("signature"))
    spent = F.sum(F.length("signature") / F.lit(4.0)).over(Window.partitionBy(F.lit(0)).orderBy("fqn"))
    # Signatures of a character or more: the budget bounds how many can fit, and no more are numbered. Empty ones cost nothing and fit where their place does.
    costly = rows.where("signature != ''").orderBy("fqn").limit(4 * budget + 1).withColumn("_s", spent)
    last = costly.where(F.col("_s") > budget).agg(F.min("fqn").alias("_end"))
    empty = rows.where("signature = ''").join(F.broadcast(last), F.lit(True)).where("_end is null or fqn < _end").drop("_end")
    return costly.where(F.col("_s") <= budget).drop("_s").unionByName(empty)
