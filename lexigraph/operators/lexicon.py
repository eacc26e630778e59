"""Compilation of dictionary entries to lexicon tables.

An analyzer lexicon maps a lower-case form to groups of interpretations, one
group per segment type; a generator lexicon does so for lemmas.  An
interpretation says how to make the lemma from the form: code points to cut at
both ends, a suffix to add, and which places are upper case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.errors import InvalidDictionary
from lexigraph.functions.text import label_set, lower1, tag_pattern
from lexigraph.plans.storage import stored
from lexigraph.sources.rules import Pattern, RuleSet
from lexigraph.sources.tagset import Tagset

MAX_NAMES, MAX_LABELS = 255, 2048


@dataclass(frozen=True)
class Lexicon:
    """Groups of interpretations by key, with the dimensions and the rules to read them."""

    groups: DataFrame  # lex_key, seg_type, interps array<struct>
    tags: DataFrame
    names: DataFrame
    labels: DataFrame
    rules: RuleSet
    generator: bool
    longest_key: int
    dict_id: str = ""
    copyright: str = ""



def dimensions(rows: DataFrame, tagset: Tagset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, names, labels): names and label sets numbered in sorted order from an empty one."""
    spark = rows.sparkSession
    # both are bounded by the format; one row more than the limit shows the excess
    names = sorted({r[0] for r in rows.select("name").distinct().limit(MAX_NAMES + 2).collect()} | {""})
    sets = sorted({tuple(r[0]) for r in rows.select(label_set(F.col("qualifier"))).distinct().limit(MAX_LABELS + 2).collect()} | {()})
    if len(names) > MAX_NAMES + 1 or len(sets) > MAX_LABELS + 1:
        raise InvalidDictionary("too many names or label sets")
    return (
        tagset.frame(spark).select("tag_id", "tag"),
        spark.createDataFrame(list(enumerate(names)), "name_id int, name string"),
        spark.createDataFrame([(i, list(s), "|".join(s) or "_") for i, s in enumerate(sets)], "labels_id int, labels array<string>, labels_str string"),
    )


def segment_type(patterns: list[Pattern], lemma: Column, homonym: Column, tag: Column, name: Column, labels: Column, tags: list[str]) -> Column:
    """The first pattern that fits: those with lemma and homonym, then with lemma, then the others."""

    def fits(p: Pattern) -> Column:
        good = [t for t in tags if tag_pattern(p.tag).match(t)]
        c = F.lit(True) if len(good) == len(tags) else tag.isin(good)
        if p.lemma is not None:
            c = c & (lemma == p.lemma)
        if p.homonym is not None:
            c = c & (homonym == p.homonym)
        if p.name is not None:
            c = c & (name == p.name)
        if p.labels:
            c = c & (F.size(F.array_except(F.array(*map(F.lit, p.labels)), labels)) == 0)
        return c

    out = None
    for tier in range(3):
        for p in patterns:
            if tier == (0 if p.homonym is not None else 1 if p.lemma is not None else 2):
                out = F.when(fits(p), F.lit(p.seg_type)) if out is None else out.when(fits(p), F.lit(p.seg_type))
    return out


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    least = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1)))
    miss = F.array_position(same, F.lit(False)).cast("int")
    slow = F.when(least == 0, F.lit(0)).when(miss == 0, least).otherwise(miss - 1)
    # a back reference finds the same prefix, where the mark between the two is in neither
    quick = F.length(F.regexp_extract(F.concat(a, F.lit("\0"), b), r"^([^\x00]*)[^\x00]*\x00\1", 1))
    return F.when(a.startswith(b), F.length(b)).when(F.contains(a, F.lit("\0")) | F.contains(b, F.lit("\0")), slow).otherwise(quick)


def upper_bits(text: Column) -> Column:
    """A 1 for every upper-case character, else a 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    bits = F.array_join(F.transform(chars, lambda c: F.when((c == F.upper(c)) & (c != F.lower(c)), F.lit("1")).otherwise(F.lit("0"))), "")
    return F.when(F.lower(text) == text, F.repeat(F.lit("0"), F.length(text))).otherwise(bits)


def _encoded(rows: DataFrame, source: str, target: str, fold: bool, moving: str) -> DataFrame:
    """Add prefix_cut, cut, suffix: the cheapest of up to five prefix lengths of ``moving``.

    The analyzer moves along the form and does not count the best prefix so far;
    the generator moves along the form to make and does.
    """
    low = lower1 if fold else (lambda c: c)

    def prefix(i: int) -> Column:
        a = low(F.substring(F.col(source), i + 1, 2_000_000_000) if moving == source else F.col(source))
        b = low(F.substring(F.col(target), i + 1, 2_000_000_000) if moving == target else F.col(target))
        return _common(a, b)

    rows = rows.withColumn("__lcp", prefix(0)).withColumn("__best", F.lit(0)).withColumn("__suffix", F.length(target) - F.col("__lcp"))
    # with nothing but a character to add no prefix is worth its cost; others are tried one after another
    near = rows.where("__suffix <= 1")
    far = rows.where("__suffix > 1")
    for i in range(1, 5):
        far = far.withColumn("__at", prefix(i))
        rest = F.length(target) - F.col("__at") - (i if moving == target else 0)
        limit = F.col("__suffix") if moving == source else F.col("__suffix") + F.col("__best")
        better = (F.length(moving) > i) & (rest + i < limit)
        far = far.withColumn("__better", better).select(
            *rows.columns[:-3],
            F.when(F.col("__better"), F.col("__at")).otherwise(F.col("__lcp")).alias("__lcp"),
            F.when(F.col("__better"), F.lit(i)).otherwise(F.col("__best")).alias("__best"),
            F.when(F.col("__better"), rest).otherwise(F.col("__suffix")).alias("__suffix"),
        )
    rows = near.unionAll(far)
    lcp, best = F.col("__lcp"), F.col("__best")
    cut = F.length(source) - lcp - (best if moving == source else 0)
    start = lcp + 1 + (best if moving == target else 0)
    return rows.withColumn("lcp", lcp).withColumn("cut", cut).withColumn("suffix", F.substring(F.col(target), start, F.length(target))).withColumn("prefix_cut", best).drop("__lcp", "__best", "__suffix")


def _typed(rows: DataFrame, rules: RuleSet, tagset: Tagset, dims: tuple[DataFrame, DataFrame, DataFrame], lemma: Column, homonym: Column) -> DataFrame:
    """Rows with tag, name and label numbers and their segment type."""
    tags, names, labels = dims
    known = list(tagset.tags)
    with_type = rows.withColumn("labels", label_set(F.col("qualifier"))).withColumn(
        "seg_type", segment_type(rules.patterns, lemma, homonym, F.col("tag"), F.col("name"), F.col("labels"), known)
    )
    sets = labels.select("labels_id", "labels_str")
    joined = (
        with_type.withColumn("labels_str", F.when(F.size("labels") == 0, F.lit("_")).otherwise(F.array_join("labels", "|")))
        .join(F.broadcast(tags), "tag", "left")
        .join(F.broadcast(names), "name", "left")
        .join(F.broadcast(sets), "labels_str", "left")
    )
    checked = F.when(F.col("tag_id").isNull(), F.raise_error(F.concat(F.lit("unknown tag "), F.col("tag")))).otherwise(F.col("tag_id"))
    return joined.withColumn("tag_id", checked.cast("int"))


def _with_extra(rows: DataFrame, rules: RuleSet, orth: str, base: str) -> DataFrame:
    """Types used only glued have the form as lemma; types used both ways get a second, glued row."""
    if rules.lemma_is_orth:
        rows = rows.withColumn(base, F.when(F.col("seg_type").isin(list(rules.lemma_is_orth)), F.col(orth)).otherwise(F.col(base)))
    plain = F.struct(F.col("seg_type").alias("t"), F.col(base).alias("b"))
    if not rules.extra_type:
        return rows
    pairs = F.create_map(*[F.lit(x) for kv in rules.extra_type.items() for x in kv])
    extra = F.struct(pairs[F.col("seg_type")].alias("t"), F.col(orth).alias("b"))
    both = F.when(F.col("seg_type").isin(list(rules.extra_type)), F.array(plain, extra)).otherwise(F.array(plain))
    return rows.withColumn("__v", F.explode(both)).withColumn("seg_type", F.col("__v.t")).withColumn(base, F.col("__v.b")).drop("__v")


def _grouped(rows: DataFrame, key: list[str]) -> DataFrame:
    """Interpretations without repeats (the first source line gives the labels), sorted within their group."""
    once = rows.groupBy("lex_key", "seg_type", *key).agg(F.min_by("labels_id", "src_ord").alias("labels_id"))
    return once.groupBy("lex_key", "seg_type").agg(F.array_sort(F.collect_list(F.struct(*key, "labels_id"))).alias("interps"))


def compile_analyzer(source: DataFrame, tagset: Tagset, rules: RuleSet, meta: dict[str, str] | None = None) -> Lexicon:
    """The analyzer lexicon of ``src_ord, orth, base, tag, name, qualifier`` rows."""
    dims = dimensions(source, tagset)
    split = F.contains("base", F.lit(":")) & (F.regexp_replace("base", ":", "") != "")
    lemma = F.when(split, F.substring_index("base", ":", 1)).otherwise(F.col("base"))
    homonym = F.when(split, F.regexp_extract("base", "^[^:]*:(.*)$", 1))
    typed = _with_extra(_typed(source, rules, tagset, dims, lemma, homonym), rules, "orth", "base")
    coded = _encoded(typed, "orth", "base", True, "orth")
    rows = coded.select(
        "src_ord", lower1(F.col("orth")).alias("lex_key"), "seg_type", "cut", "prefix_cut", "suffix",
        upper_bits(F.substring(F.col("base"), F.lit(1), F.col("lcp"))).alias("case_bits"),
        upper_bits(F.substring(F.col("orth"), F.lit(1), F.length("orth") - F.col("cut"))).alias("orth_bits"),
        "tag_id", "name_id", "labels_id",
    )
    return _lexicon(_grouped(rows, ["cut", "prefix_cut", "suffix", "case_bits", "orth_bits", "tag_id", "name_id"]), dims, rules, False, meta)


def compile_generator(source: DataFrame, tagset: Tagset, rules: RuleSet, meta: dict[str, str] | None = None) -> Lexicon:
    """The generator lexicon; lines without a lemma are left out."""
    dims = dimensions(source, tagset)
    split = F.col("base").rlike("^[^:]+:.+$")
    rows = source.where("base <> ''").withColumn("homonym", F.when(split, F.regexp_extract("base", "^[^:]+:(.+)$", 1)).otherwise(F.lit("")))
    rows = rows.withColumn("base", F.when(split, F.substring_index("base", ":", 1)).otherwise(F.col("base")))
    typed = _with_extra(_typed(rows, rules, tagset, dims, F.col("base"), F.lit(None).cast("string")), rules, "orth", "base")
    coded = _encoded(typed, "base", "orth", False, "orth")
    out = coded.select(
        "src_ord", F.col("base").alias("lex_key"), "seg_type", "homonym", "tag_id", "cut", "suffix", "name_id",
        F.substring(F.col("orth"), F.lit(1), F.col("prefix_cut")).alias("prefix"), "labels_id",
    )
    once = out.groupBy("lex_key", "seg_type", "homonym", "tag_id", "cut", "suffix", "name_id").agg(F.min_by(F.struct("prefix", "labels_id"), "src_ord").alias("x"))
    flat = once.select("lex_key", "seg_type", "homonym", "tag_id", "cut", "suffix", "name_id", "x.prefix", "x.labels_id")
    groups = flat.groupBy("lex_key", "seg_type").agg(F.array_sort(F.collect_list(F.struct("homonym", "tag_id", "cut", "suffix", "name_id", "prefix", "labels_id"))).alias("interps"))
    return _lexicon(groups, dims, rules, True, meta)


def _lexicon(groups: DataFrame, dims: tuple[DataFrame, DataFrame, DataFrame], rules: RuleSet, generator: bool, meta: dict[str, str] | None) -> Lexicon:
    groups = stored(groups, "groups")
    longest = groups.agg(F.max(F.length("lex_key"))).first()[0] or 0
    meta = meta or {}
    return Lexicon(groups, *dims, rules, generator, int(longest), meta.get("dict_id", ""), meta.get("copyright", ""))


def save(lexicon: Lexicon, path: str, buckets: int | None = None) -> None:
    """Persist the tables as parquet, the groups clustered by key."""
    groups = lexicon.groups.repartition(buckets, "lex_key") if buckets else lexicon.groups
    groups.sortWithinPartitions("lex_key").write.mode("overwrite").parquet(f"{path}/groups")
    for name in ("tags", "names", "labels"):
        getattr(lexicon, name).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(lexicon.longest_key, lexicon.dict_id, lexicon.copyright, lexicon.generator, lexicon.rules.to_json())]
    groups.sparkSession.createDataFrame(meta, "longest_key int, dict_id string, copyright string, generator boolean, rules string").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Lexicon:
    """A saved lexicon, with its rules and what is known about its source."""
    groups, *dims = (spark.read.parquet(f"{path}/{n}") for n in ("groups", "tags", "names", "labels"))
    meta = spark.read.parquet(f"{path}/meta").first()
    return Lexicon(groups, *dims, RuleSet.from_json(meta["rules"]), meta["generator"], meta["longest_key"], meta["dict_id"], meta["copyright"])
