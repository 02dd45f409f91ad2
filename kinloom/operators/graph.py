"""Graphs as edge tables: components, levels, ancestors, families, pruning, coloring."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared checkpoint folder; set to a temporary one only where none is set and one machine
    runs everything."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="kinloom-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node). Labels go to the least of a node's neighbours, then to that one's label."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    label = cut(label)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        hop = new.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        new = cut(new.join(hop, "component", "left").select("node", "old", F.coalesce("hop", "component").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def levels(persons: DataFrame) -> DataFrame:
    """id, depth: the longest way down from a founder, one join for each generation. ValueError on a cycle."""
    edges = cut(parent_edges(persons))
    depth = cut(persons.select("id").join(edges.select(F.col("child").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0)))
    front = depth
    step, most = 0, persons.count()
    while True:
        step += 1
        if step > most:
            raise ValueError("someone is their own ancestor")
        front = cut(edges.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct().withColumn("depth", F.lit(step)))
        if front.isEmpty():
            return depth
        depth = cut(depth.join(front.select("id"), "id", "left_anti").union(front))


def parent_edges(persons: DataFrame) -> DataFrame:
    """parent, child, typ (0 father, 1 mother)."""
    father = persons.where("father <> 0").select(F.col("father").alias("parent"), F.col("id").alias("child"), F.lit(0).alias("typ"))
    return father.union(persons.where("mother <> 0").select("mother", "id", F.lit(1)))


def ancestors(persons: DataFrame, most: int) -> DataFrame:
    """id, ancestor, distance (the least, 0 for oneself) up to ``most`` generations."""
    edges = parent_edges(persons)
    out = front = persons.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    for step in range(1, most + 1):
        front = cut(front.join(edges, front["ancestor"] == edges["child"]).select("id", F.col("parent").alias("ancestor")).distinct().withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        out = out.union(front)
    return out.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def lowest_common_ancestor(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """x, y, lca, distance: the common ancestor of least total distance; ties go to the least id."""
    x = up.select(F.col("id").alias("x"), "ancestor", F.col("distance").alias("dx"))
    y = up.select(F.col("id").alias("y"), "ancestor", F.col("distance").alias("dy"))
    both = pairs.join(x, "x").join(y, ["y", "ancestor"])
    best = both.groupBy("x", "y").agg(F.min(F.struct((F.col("dx") + F.col("dy")).alias("distance"), F.col("ancestor").alias("lca"))).alias("m"))
    return best.select("x", "y", F.col("m.lca").alias("lca"), F.col("m.distance").alias("distance"))


def neighbours(persons: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, neighbour, distance: persons at most ``depth`` parent-child steps from each id of ``start``, itself included."""
    down = parent_edges(persons).select("parent", "child")
    edges = down.union(down.select("child", "parent")).toDF("a", "b").distinct()
    out = front = start.select("id", F.col("id").alias("neighbour"), F.lit(0).alias("distance"))
    for step in range(1, depth + 1):
        front = front.join(edges, front["neighbour"] == edges["a"]).select("id", F.col("b").alias("neighbour")).distinct().withColumn("distance", F.lit(step))
        out = out.union(front)
    return out.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))


def numbered(persons: DataFrame, width: int = 4096) -> DataFrame:
    """persons with ``node``, places from 0, genotyped ones first and then by id. Ids are numbered within bins of ``width``
    and bins moved by the counts before them, so that no task sees all rows."""
    rows = persons.withColumns({"rest__": ~F.col("genotyped"), "bin__": F.floor(F.col("id") / width)})
    counts = rows.groupBy("rest__", "bin__").agg(F.count("*").alias("count__"))
    before = F.coalesce(F.sum("count__").over(W.orderBy("rest__", "bin__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("rest__", "bin__").orderBy("id")) - 1
    out = rows.withColumn("within__", within).join(counts.select("rest__", "bin__", before.alias("before__")), ["rest__", "bin__"])
    return out.select(*persons.columns, (F.col("before__") + F.col("within__")).alias("node"))


def sub_pedigree(persons: DataFrame, ids: DataFrame) -> DataFrame:
    """The pedigree of some ids only, as node, id, father, mother (nodes; null: none or left out), numbered anew."""
    kept = numbered(persons.join(ids.select("id").distinct(), "id", "left_semi"))
    side = lambda p: kept.select(F.col("id").alias(p), F.col("node").alias(f"{p}_node"))
    out = kept.select("node", "id", "father", "mother").join(side("father"), "father", "left").join(side("mother"), "mother", "left")
    return out.select("node", "id", F.col("father_node").alias("father"), F.col("mother_node").alias("mother"))


def families(persons: DataFrame) -> DataFrame:
    """father, mother, children (ascending), n."""
    both = persons.where("father <> 0 and mother <> 0")
    return both.groupBy("father", "mother").agg(F.array_sort(F.collect_set("id")).alias("children"), F.count("*").alias("n"))


def prune(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """One node of each block of linked nodes, the one of highest call rate, then name. nodes: snp, call_rate."""
    label = components(edges.where(F.col("r2") >= least), "snp1", "snp2")
    blocks = nodes.join(label, nodes["snp"] == label["node"], "left").select("snp", "call_rate", F.coalesce("component", "snp").alias("block"))
    return blocks.groupBy("block").agg(F.max(F.struct("call_rate", "snp"))["snp"].alias("kept"), F.count("*").alias("size"))


def greedy_colors(edges: list[tuple[int, int]], nodes: list[int] | None = None) -> dict[int, int]:
    """Colors in order of position: with neighbours' colors sorted, one less than the first that isn't its own rank;
    without such one, the next new color."""
    near: dict[int, set[int]] = {n: set() for n in nodes or []}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    color: dict[int, int] = {}
    for n in sorted(near):
        used = sorted({color[m] for m in near[n] if m in color})
        odd = next((v for k, v in enumerate(used) if k != v), None)
        color[n] = odd - 1 if odd is not None else len(used)
    return color


def frames(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """snp, block, color: unlinked nodes of a block have equal colors. Blocks are colored apart from each other."""
    label = components(edges, "snp1", "snp2")
    blocks = edges.join(label, edges["snp1"] == label["node"]).select("component", "snp1", "snp2")

    def paint(part: pd.DataFrame) -> pd.DataFrame:
        got = greedy_colors(list(zip(part["snp1"].tolist(), part["snp2"].tolist(), strict=True)))
        return pd.DataFrame({"block": int(part["component"].iloc[0]), "snp": list(got), "color": list(got.values())})

    colored = blocks.groupBy("component").applyInPandas(paint, "block long, snp long, color int")
    alone = nodes.select("snp").join(colored.select("snp"), "snp", "left_anti").select(F.col("snp").alias("block"), "snp", F.lit(0).alias("color"))
    return colored.unionByName(alone)


def merge_frames(sizes: list[tuple[int, list[int]]], n: int) -> list[list[tuple[int, int]]]:
    """Distribute blocks' colors over ``n`` frames: the largest color of a block to the frame that is smallest then."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    held = [0] * n
    for block, counts in sizes:
        free = list(range(n))
        for color in sorted(range(len(counts)), key=lambda c: (-counts[c], c)):
            k = min(free, key=lambda f: (held[f], f))
            free.remove(k)
            out[k].append((block, color))
            held[k] += counts[color]
    return out


