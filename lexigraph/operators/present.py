"""Presentation of rows: names for numbers, text blocks, tuples, JSON, expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import expand_tag, name_list
from lexigraph.operators.lexicon import Lexicon
from lexigraph.plans.storage import stored


def named(rows: DataFrame, lexicon: Lexicon, unknown_tag: str = "ign") -> DataFrame:
    """Add tag, name and labels; ``_`` where there is no name or no labels."""
    tags = F.broadcast(lexicon.tags.select("tag_id", "tag"))
    names = F.broadcast(lexicon.names.where("name <> ''"))
    labels = F.broadcast(lexicon.labels.select("labels_id", F.col("labels_str").alias("labels")))
    out = rows.join(tags, "tag_id", "left").join(names, "name_id", "left").join(labels, "labels_id", "left")
    return out.withColumn("tag", F.coalesce("tag", F.lit(unknown_tag))).withColumn("name", F.coalesce("name", F.lit("_"))).withColumn("labels", F.coalesce("labels", F.lit("_")))


def blocks(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", nodes: bool = True) -> DataFrame:
    """(id, block): the text of all rows of an id, ``[]`` for an id without rows."""
    order = ["word_idx", "ord"] if "word_idx" in rows.columns else ["ord"]
    line = Window.partitionBy(id_col).orderBy(*order)
    here = F.struct("start_node", "end_node") if nodes else F.struct(F.lit(0))
    before = F.lag(here).over(line)
    glue = F.when(before.isNull(), F.lit("[")).when(before == here, F.lit("\n ")).otherwise(F.lit("]\n["))
    fields = (["start_node", "end_node"] if nodes else []) + ["orth", "lemma", "tag", "name", "labels"]
    piece = F.concat(glue, F.concat_ws(",", *[F.col(f).cast("string") for f in fields]))
    pieces = rows.select(id_col, F.struct(*order, piece.alias("piece")).alias("p")).groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit("]"))
    return ids.select(id_col).join(pieces.select(id_col, text.alias("block")), id_col, "left").withColumn("block", F.coalesce("block", F.lit("[]")))


def tuples(rows: DataFrame) -> DataFrame:
    """Rows as (start, end, (orth, lemma, tag, names, labels))."""
    inner = F.struct("orth", "lemma", "tag", name_list(F.col("name")).alias("names"), name_list(F.col("labels")).alias("labels"))
    keep = [c for c in ("doc_id", "word_idx", "ord") if c in rows.columns]
    return rows.select(*keep, F.struct("start_node", "end_node", inner.alias("interpretation")).alias("item"))


def with_expanded_tags(rows: DataFrame, expand_dot: bool = True, expand_underscore: bool = True) -> DataFrame:
    """One row for every tag that a row's tag stands for."""
    each = F.posexplode(expand_tag(F.col("tag"), expand_dot, expand_underscore)).alias("tag_no", "tag")
    return rows.select(*[c for c in rows.columns if c != "tag"], each)


def _runs(edges: DataFrame, id_col: str) -> DataFrame:
    """(id, start_node, end_node, items): edges that can only follow one another are one."""
    line = Window.partitionBy(id_col).orderBy("start_node", "item", "end_node")
    count = F.count(F.lit(1))
    degrees = edges.withColumn("out", count.over(Window.partitionBy(id_col, "start_node"))).withColumn("into", count.over(Window.partitionBy(id_col, "end_node")))
    follows = (F.lag("end_node").over(line) == F.col("start_node")) & (F.lag("into").over(line) == 1) & (F.col("out") == 1) & (F.col("start_node") != 0)
    marked = degrees.withColumn("first", F.when(follows, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("first").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    row = F.struct("start_node", "end_node", "item")
    runs = numbered.groupBy(id_col, "run").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return runs.select(id_col, F.col("r")[0]["start_node"].alias("start_node"), F.element_at("r", -1)["end_node"].alias("end_node"), F.transform("r", lambda x: x["item"]).alias("items"))


def all_paths(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, path): every way through the graph of an id from node 0, as arrays of (word_idx, ord, orth, lemma, tag).

    A graph without an edge from node 0 has one empty path.  Runs of edges
    without a choice are one step, so a linear text takes two steps whatever its
    length.  The open paths are written after each step; a cycle raises ValueError.
    """
    item = F.struct("word_idx", "ord", "orth", "lemma", "tag")
    edges = stored(_runs(rows.select(id_col, "start_node", "end_node", item.alias("item")), id_col), "runs")
    most = edges.groupBy(id_col).agg(F.countDistinct("start_node").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    empty = F.array().cast(edges.schema["items"].dataType)
    open_ = rows.select(id_col).distinct().select(id_col, F.lit(0).alias("node"), empty.alias("path"))
    next_ = edges.select(F.col(id_col).alias("own"), "start_node", "end_node", "items")
    out = None
    step = 0
    while out is None or not open_.isEmpty():
        if step > most:  # a path of more steps than nodes came to one of them again
            raise ValueError("the graph has a cycle")
        met = open_.join(next_, (F.col(id_col) == F.col("own")) & (F.col("node") == F.col("start_node")), "left")
        met = stored(met.select(id_col, "end_node", F.when(F.col("items").isNull(), F.col("path")).otherwise(F.concat("path", "items")).alias("path")), "open-paths")
        ended = met.where("end_node is null").select(id_col, "path")
        out = ended if out is None else out.unionAll(ended)
        open_ = met.where("end_node is not null").select(id_col, F.col("end_node").alias("node"), "path")
        step += 1
    return out


def responses(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, response): a JSON object with all rows of an id."""
    order = ["word_idx", "ord"] if "word_idx" in rows.columns else ["ord"]
    fields = [f for f in ("start_node", "end_node", "orth", "lemma", "tag_id", "tag", "name_id", "name", "labels_id", "labels") if f in rows.columns]
    row = F.struct(*order, F.struct(*fields).alias("r"))
    made = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    results = F.coalesce(F.transform("rows", lambda x: x["r"]), F.array().cast(rows.select(F.array(F.struct(*fields)).alias("a")).schema["a"].dataType))
    answer = F.struct(F.lit(True).alias("ok"), results.alias("results"), F.lit(None).cast("string").alias("error"))
    return ids.select(id_col).join(made, id_col, "left").select(id_col, F.to_json(answer, {"ignoreNullFields": "false"}).alias("response"))
