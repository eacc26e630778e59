"""Ways to cut a word into segments that the rules accept.

A frontier of partial paths is joined with the lexicon's keys and the rules'
transitions, one segment at a time.  Only starts that a path has reached are
tried, and an end is tried up to the longest key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import lower1
from lexigraph.operators.lexicon import Lexicon
from lexigraph.plans.storage import stored
from lexigraph.sources.rules import Variant

#: Characters that a later segment may begin with, up to which they are looked at before a cut is tried.
_MANY_CHARS = 4096
#: Up to so many segments the steps are one lazy plan; beyond, the frontier is written after each.
_LAZY_STEPS = 4


def fits_case(orth: Column, bits: Column) -> Column:
    """Every place marked in ``bits`` holds an upper-case character of ``orth``."""

    def ok(i: Column) -> Column:
        c = F.substring(orth, i, F.lit(1))
        return (F.substring(bits, i, F.lit(1)) == "0") | ((c != "") & (lower1(c) != c))

    return F.when(~F.contains(bits, F.lit("1")), F.lit(True)).otherwise(F.forall(F.sequence(F.lit(1), F.greatest(F.length(bits), F.lit(1))), ok))


def _later_chars(lexicon: Lexicon, variant: Variant) -> str | None:
    """First characters of the keys that may follow another segment of a word; None where they are many."""
    after = {row[3] for row in variant.rows if not row[6]}
    types = sorted({row[1] for row in variant.rows if row[0] in after})
    first = lexicon.groups.where(F.col("seg_type").isin(types)).select(F.substring("lex_key", 1, 1).alias("c")).where("c <> ''").distinct()
    found = [r["c"] for r in first.limit(_MANY_CHARS + 1).collect()] if types else []
    return "".join(sorted(found)) if len(found) <= _MANY_CHARS else None


def segmentations(words: DataFrame, lexicon: Lexicon, variant: Variant) -> DataFrame:
    """(word, low, path, weak) of every accepted path of the distinct ``word`` rows.

    ``path`` is an array of (e, seg_type, s, shift, ok), which sorts like the order in which paths are found;
    for an analyzer its chunks also hold their ``interps``.
    """
    spark = words.sparkSession
    rules = F.broadcast(lexicon.rules.transitions(spark, variant))  # of the size of the rule file
    word = F.col("word")
    low = word if lexicon.generator else lower1(word)
    interps = "" if lexicon.generator else f",interps:{lexicon.groups.schema['interps'].dataType.simpleString()}"
    chunk = f"array<struct<e:int,seg_type:int,s:int,shift:boolean,ok:boolean{interps}>>"
    later = _later_chars(lexicon, variant)
    frontier = words.select("word", low.alias("low")).select(
        "word", "low", F.length("word").alias("len"), F.lit(0).alias("pos"), F.lit(0).alias("state"), F.array().cast(chunk).alias("path"), F.lit(False).alias("was_weak")
    ).where("len > 0")
    keys = lexicon.groups.select("lex_key", "seg_type", *[] if lexicon.generator else ["interps"])
    lazy = variant.longest is not None and variant.longest <= _LAZY_STEPS
    ended = F.col("pos") == F.col("len")
    step = 0
    while True:
        # finished paths pass through under a key of their own that no entry has
        far = F.least(F.col("len"), F.col("pos") + max(1, lexicon.longest_key))
        each = F.sequence(F.col("pos") + 1, far)
        if later is not None:
            # a cut before a character that no later segment begins with leads nowhere
            some = F.length(F.translate("low", later, "")) < F.col("len")
            cuts = F.filter(each, lambda e: (e == F.col("len")) | F.contains(F.lit(later), F.substring(F.col("low"), e + 1, F.lit(1))))
            each = F.when(some, cuts).when(far == F.col("len"), F.array("len")).otherwise(F.array().cast("array<int>"))
        ends = F.when(ended, F.array(F.lit(0))).otherwise(each)
        part = F.substring(F.col("low"), F.col("pos") + 1, F.col("e") - F.col("pos"))
        tried = frontier.select("*", F.explode(ends).alias("e")).withColumn("lex_key", F.when(ended, F.concat(F.lit("\0"), F.col("word"))).otherwise(part))
        met = tried.join(keys, "lex_key", "left").join(rules, ["state", "seg_type"], "left")
        met = met.where(ended | ((F.col("e") == F.col("len")) & F.col("accepting")) | ((F.col("e") < F.col("len")) & ~F.col("sink")))
        met = met.withColumn("orth", F.substring(word, F.col("pos") + 1, F.col("e") - F.col("pos")))
        ok = F.lit(True) if lexicon.generator else F.exists("interps", lambda x: fits_case(F.col("orth"), x["orth_bits"]))
        piece = F.struct(F.col("e"), F.col("seg_type"), F.col("pos").alias("s"), F.col("shift"), ok.alias("ok"), *[] if lexicon.generator else ["interps"])
        frontier = met.select(
            "word", "low", "len",
            F.when(ended, F.col("pos")).otherwise(F.col("e")).alias("pos"),
            F.when(ended, F.col("state")).otherwise(F.col("next_state")).alias("state"),
            F.when(ended, F.col("path")).otherwise(F.concat("path", F.array(piece))).alias("path"),
            F.when(ended, F.col("was_weak")).otherwise(F.col("weak")).alias("was_weak"),
        )
        step += 1
        if step == variant.longest:
            break
        if not lazy and step % _LAZY_STEPS == 0:
            frontier = stored(frontier, "paths")
            if frontier.where("pos < len").isEmpty():
                break
    # a path that ended in an earlier step has state and weakness of its own
    return frontier.where(ended).select("word", "low", "path", F.col("was_weak").alias("weak"))
