"""Generation: all forms of a lemma."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.config import Config
from lexigraph.errors import InvalidArgument, Unsupported
from lexigraph.functions.text import has_whitespace
from lexigraph.operators.lexicon import Lexicon
from lexigraph.operators.paths import segmentations


def generate(lemmas: DataFrame, lexicon: Lexicon, config: Config = Config(), id_col: str = "doc_id", lemma_col: str = "lemma", tag_id: int | None = None) -> DataFrame:
    """Forms of every lemma row, or the lemma itself as unknown.

    ``a:b`` asks for homonym ``b`` of ``a``.  A lemma with white space has an
    error in the column ``error`` and no forms.  ``tag_id`` filters at the end.
    """
    if not lexicon.generator:
        raise Unsupported("the lexicon was not compiled for generation")
    if tag_id is not None and lexicon.tags.where(F.col("tag_id") == tag_id).isEmpty():
        raise InvalidArgument(f"Invalid tag id (outside of tagset): {tag_id}")
    asked = lemmas.select(F.col(id_col), F.coalesce(F.col(lemma_col), F.lit("")).alias("__asked"))
    asked = asked.withColumn("__error", F.when(has_whitespace(F.col("__asked")), F.lit("Lemma parameter contains whitespace.")))
    asked = asked.withColumn("word", F.substring_index("__asked", ":", 1)).withColumn("__wanted", F.when(F.contains("__asked", F.lit(":")), F.regexp_extract("__asked", r"^[^:]*:([\s\S]*)$", 1)))
    distinct = asked.where("__error is null").select("word").distinct()
    found = segmentations(distinct, lexicon, lexicon.rules.variant(config.aggl, config.praet))
    own = Window.partitionBy("word")
    kept = found.withColumn("strong", F.bool_or(~F.col("weak")).over(own)).where("not weak or not strong")
    kept = kept.withColumn("path_no", F.row_number().over(own.orderBy(F.transform("path", lambda c: F.struct(c["e"], c["seg_type"])))))
    last = F.size("path") - 1
    numbered = F.transform("path", lambda c, i: F.struct(c.alias("c"), i.alias("i"), (c["shift"] & (i < last)).alias("glued")))
    chunks = kept.select("word", "path_no", "path", F.explode(numbered).alias("x")).where("not x.glued")
    # where the run of glued chunks before this one begins
    begin = F.aggregate(F.slice("path", F.lit(1), F.col("x.i")), F.lit(0), lambda a, c: F.when(c["shift"], a).otherwise(c["e"]))
    read = chunks.select("word", "path_no", "x.i", begin.alias("begin"), F.col("x.c.s").alias("s"), F.col("x.c.e").alias("e"), F.col("x.c.seg_type").alias("seg_type"))
    read = read.withColumn("lex_key", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s"))).join(lexicon.groups, ["lex_key", "seg_type"])
    each = read.select("word", "path_no", "i", "begin", "s", "e", "lex_key", F.posexplode("interps").alias("k", "x"))
    ahead = F.substring(F.col("word"), F.col("begin") + 1, F.col("s") - F.col("begin"))
    stem = F.substring(F.col("lex_key"), F.lit(1), F.length("lex_key") - F.col("x.cut"))
    lemma = F.concat(ahead, F.col("lex_key"), F.when(F.col("x.homonym") == "", F.lit("")).otherwise(F.concat(F.lit(":"), F.col("x.homonym"))))
    forms = each.select(
        "word", F.row_number().over(own.orderBy("path_no", "i", "k")).alias("ord"), F.concat(ahead, F.col("x.prefix"), stem, F.col("x.suffix")).alias("orth"),
        lemma.alias("lemma"), F.col("x.homonym").alias("homonym"), "x.tag_id", "x.name_id", "x.labels_id",
    )
    joined = asked.where("__error is null").join(forms, "word").where("__wanted is null or __wanted = homonym")
    shape = [id_col, "ord", "orth", "lemma", "tag_id", "name_id", "labels_id"]
    known = joined.select(*shape, F.col("__error").alias("error"))
    none = asked.join(known.select(id_col).distinct(), id_col, "left_anti")
    ign = none.select(
        id_col, F.lit(1).alias("ord"), F.when(F.col("__error").isNull(), F.col("__asked")).alias("orth"), F.when(F.col("__error").isNull(), F.col("__asked")).alias("lemma"),
        F.when(F.col("__error").isNull(), F.lit(0)).alias("tag_id"), F.lit(0).alias("name_id"), F.lit(0).alias("labels_id"), F.col("__error").alias("error"),
    )
    out = known.unionByName(ign)
    return out if tag_id is None else out.where((F.col("tag_id") == tag_id) | F.col("error").isNotNull())
