"""Analysis of texts: tokens, interpretations of their words, and node numbers.

Distinct words are interpreted once and joined back.  Node numbers inside a
word are ranks of the starts of its segments; the first node of a word is the
running sum of the nodes of the words before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.config import CaseHandling, Config, TokenNumbering, WhitespaceHandling
from lexigraph.functions.text import lower1, parts, runs, words
from lexigraph.operators.lexicon import Lexicon
from lexigraph.operators.paths import fits_case, segmentations
from lexigraph.plans.storage import stored

IGN, SPACE = 0, 1
ROW = ["ord", "src", "dst", "orth", "lemma", "tag_id", "name_id", "labels_id"]


def _raised(low: Column, first: Column, last: Column, bits: Column, moved: Column) -> Column:
    """Code points [first, last) of ``low``, upper case where ``bits`` (moved to the right) says so."""

    def char(i: Column) -> Column:
        c = F.substring(low, i + 1, F.lit(1))
        at = i - moved + 1
        return F.when((at > 0) & (F.substring(bits, at, F.lit(1)) == "1"), F.upper(c)).otherwise(c)

    plain = F.substring(low, first + 1, F.greatest(last - first, F.lit(0)))
    return F.when(~F.contains(bits, F.lit("1")) | (last <= first), plain).otherwise(
        F.array_join(F.transform(F.sequence(first, F.greatest(last - 1, first)), char), "")
    )


def interpret_words(distinct: DataFrame, lexicon: Lexicon, config: Config) -> tuple[DataFrame, DataFrame]:
    """(rows of the words that have a reading, words that have a path at all) of distinct ``word`` rows."""
    variant = lexicon.rules.variant(config.aggl, config.praet)
    # written once: what follows reads it several times
    found = stored(segmentations(distinct, lexicon, variant), "paths")
    reached = found.select("word").distinct()
    case = config.case_handling
    kept = found
    if case == CaseHandling.STRICTLY_CASE_SENSITIVE:
        kept = kept.where(F.forall("path", lambda c: c["ok"]))
    own = Window.partitionBy("word")
    weak = F.col("weak")
    if case == CaseHandling.CONDITIONALLY_CASE_SENSITIVE:
        weak = weak | F.exists("path", lambda c: ~c["ok"])
    kept = kept.withColumn("weak", weak).withColumn("strong", F.bool_or(~F.col("weak")).over(own)).where("not weak or not strong")
    kept = kept.withColumn("path_no", F.row_number().over(own.orderBy(F.transform("path", lambda c: F.struct(c["e"], c["seg_type"])))))

    # an edge is a run of glued chunks and the chunk after it
    number = F.transform("path", lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice("path", F.lit(1), i), lambda d: ~d["shift"])).alias("edge"), i.alias("i")))
    chunks = kept.select("word", "low", "path_no", F.size("path").alias("chunks"), F.explode(number).alias("x")).select(
        "word", "low", "path_no", "chunks", "x.edge", "x.i", "x.c.s", "x.c.e", "x.c.seg_type", "x.c.interps", (F.col("x.c.shift") & (F.col("x.i") < F.col("chunks") - 1)).alias("glued")
    )
    # a column of its own: lambdas below refer to it
    read = chunks.withColumn("spelt", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")))
    if case == CaseHandling.IGNORE_CASE:
        usable = F.col("interps")
    else:
        usable = F.filter("interps", lambda x: fits_case(F.col("spelt"), x["orth_bits"]))
        if case == CaseHandling.CONDITIONALLY_CASE_SENSITIVE:
            usable = F.when(F.size(usable) == 0, F.col("interps")).otherwise(usable)
    read = read.withColumn("usable", usable)
    first = F.get("usable", F.lit(0))
    part = F.substring(F.col("low"), F.col("s") + 1, F.col("e") - F.col("s"))
    ahead = F.when(F.col("glued"), F.struct("i", _raised(part, first["prefix_cut"], F.length(part), first["case_bits"], F.lit(0)).alias("lemma"), F.col("usable").isNotNull().alias("there")))
    edges = read.groupBy("word", "low", "path_no", "edge").agg(
        F.min("s").alias("start"),
        F.max("e").alias("end"),
        F.max(F.when(~F.col("glued"), F.struct("s", "seg_type", "usable"))).alias("main"),
        F.array_sort(F.collect_list(ahead)).alias("before"),
    )
    edges = edges.where(F.forall("before", lambda b: b["lemma"].isNotNull()))
    whole = (F.col("start") == 0) & (F.col("end") == F.length("word"))
    same = Window.partitionBy("word", "start", "end", F.col("main.s"), F.col("main.seg_type")).orderBy("path_no")
    edges = edges.withColumn("again", F.row_number().over(same)).where(whole | (F.col("again") == 1))
    # rows are parted by word since the paths were numbered, so nothing here moves them
    starts, place_of = F.array_sort(F.collect_set("start").over(own)), lambda c: F.array_position("starts", F.col(c)).cast("int")
    edges = edges.withColumn("starts", starts).withColumn("src", place_of("start") - 1).withColumn("nodes", F.size("starts"))
    edges = edges.withColumn("dst", F.when(place_of("end") > 0, place_of("end") - 1).otherwise(F.col("nodes")))
    # node 0 keeps the order of paths; a later node lists its first edge, then the others backwards
    here = Window.partitionBy("word", "src")
    place = F.when((F.col("src") == 0) | (F.col("path_no") == F.min("path_no").over(here)), F.col("path_no")).otherwise(F.lit(1 << 30) - F.col("path_no"))
    edges = edges.withColumn("place", place)
    lines = edges.select("word", "low", "start", "end", "src", "dst", "nodes", "place", F.col("main.s").alias("ms"), "before", F.posexplode("main.usable").alias("k", "x"))
    moved = F.when(F.contains("x.case_bits", F.lit("1")) & F.contains("x.orth_bits", F.lit("1")), F.col("ms") - F.col("start")).otherwise(F.lit(0))
    spelt = F.substring(F.col("low"), F.col("start") + 1, F.col("end") - F.col("start"))
    body = _raised(spelt, F.col("ms") - F.col("start") + F.col("x.prefix_cut"), F.length(spelt) - F.col("x.cut"), F.col("x.case_bits"), moved)
    lemma = F.concat(F.array_join(F.transform("before", lambda b: b["lemma"]), ""), body, F.col("x.suffix"))
    rows = lines.select(
        "word",
        F.row_number().over(own.orderBy("src", "place", "dst", "k")).alias("ord"),
        "src", "dst", "nodes",
        F.substring(F.col("word"), F.col("start") + 1, F.col("end") - F.col("start")).alias("orth"),
        lemma.alias("lemma"),
        "x.tag_id", "x.name_id", "x.labels_id",
    )
    return rows, reached


def word_table(counted: DataFrame, lexicon: Lexicon, config: Config) -> DataFrame:
    """``word, n, nodes, rows`` of all words of a written table of distinct words, known or not; stored tables."""
    separators = lexicon.rules.separators
    known, reached = interpret_words(counted.select("word"), lexicon, config)
    row = F.struct("nodes", *ROW)
    none = F.lit(None).cast(known.select(row.alias("r")).schema["r"].dataType)
    nothing = F.lit(None).cast("bigint")
    # one pass by word says which have rows, which only paths, and which nothing
    every = counted.select("word", "n", F.lit(False).alias("met"), none.alias("row"))
    every = every.unionAll(reached.select("word", nothing, F.lit(True), none)).unionAll(known.select("word", nothing, F.lit(True), row))
    by_word = every.repartition("word").groupBy("word").agg(F.max("n").alias("n"), F.bool_or("met").alias("met"), F.collect_list("row").alias("found"))
    ign = F.array(
        F.struct(
            F.lit(1).alias("ord"), F.lit(0).alias("src"), F.lit(1).alias("dst"), F.col("word").alias("orth"), F.col("word").alias("lemma"), F.lit(IGN).alias("tag_id"), F.lit(0).alias("name_id"), F.lit(0).alias("labels_id")
        )
    )
    read = F.array_sort(F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in ROW])))
    # a word with paths of which none is left is unknown as a whole
    whole = F.col("met") | (F.size(parts(F.col("word"), separators)) == 1)
    rows = F.when(F.size("found") > 0, read).when(whole, ign)
    nodes = F.when(F.size("found") > 0, F.get("found", F.lit(0))["nodes"]).otherwise(F.lit(1))
    table = stored(by_word.select("word", "n", nodes.alias("nodes"), rows.alias("rows")), "words")
    rest = table.where("rows is null")
    if rest.isEmpty():
        return table
    cut = rest.select("word", "n", F.posexplode(parts(F.col("word"), separators)).alias("part_no", "part"))
    inner, _ = interpret_words(cut.select(F.col("part").alias("word")).distinct(), lexicon, config)
    pieces = cut.join(inner.withColumnRenamed("word", "part"), "part", "left")
    filled = pieces.select(
        "word", "n", "part_no",
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("ord", 1), ("src", 0), ("dst", 1), ("nodes", 1), ("tag_id", IGN), ("name_id", 0), ("labels_id", 0))],
        F.coalesce("orth", "part").alias("orth"), F.coalesce("lemma", "part").alias("lemma"),
    )
    own = Window.partitionBy("word")
    upto = own.orderBy("part_no", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce(F.lag("part_no").over(own.orderBy("part_no", "ord")) != F.col("part_no"), F.lit(True))
    sized = filled.withColumn("own", F.when(first, F.col("nodes")).otherwise(0))
    summed = sized.withColumn("upto", F.sum("own").over(upto).cast("int")).withColumn("total", F.sum("own").over(own).cast("int"))
    shift = F.col("upto") - F.col("nodes")
    split = summed.select(
        "word", "n", F.row_number().over(own.orderBy("part_no", "ord")).alias("ord"), (F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"),
        F.col("total").alias("nodes"), "orth", "lemma", "tag_id", "name_id", "labels_id",
    )
    made = split.groupBy("word").agg(F.first("n").alias("n"), F.first("nodes").alias("nodes"), F.array_sort(F.collect_list(F.struct(*ROW))).alias("rows"))
    return table.where("rows is not null").unionAll(stored(made, "cut-words"))


def tokens(texts: DataFrame, whitespace: WhitespaceHandling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_idx, token, space, lead, trail): words, and runs of white space where they are kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if whitespace == WhitespaceHandling.SKIP:
        # the outer form: for the inner one the planner adds a filter that works out the array twice
        cut = texts.select(id_col, F.posexplode_outer(words(text)).alias("word_idx", "token"))
        return cut.where("token is not null").withColumn("space", F.lit(False))
    cut = texts.select(id_col, F.posexplode(runs(text)).alias("word_idx", "token"))
    cut = cut.withColumn("space", F.size(words(F.col("token"))) == 0)
    if whitespace == WhitespaceHandling.KEEP:
        return cut
    line = Window.partitionBy(id_col).orderBy("word_idx")
    beside = cut.withColumn("lead", F.when(F.lag("word_idx", 2).over(line).isNull() & F.lag("space").over(line), F.lag("token").over(line)))
    beside = beside.withColumn("trail", F.when(F.lead("space").over(line), F.lead("token").over(line))).where("not space")
    return beside


def analyze(texts: DataFrame, lexicon: Lexicon, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", session: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Interpretations of all texts: id, word_idx, ord, start_node, end_node, orth, lemma and the three numbers.

    With continuous numbering nodes run on over the texts of a session: rows with
    equal ``session`` columns, in the order of ``order`` columns.
    """
    extra = list(dict.fromkeys([*(session or []), *(order or [])]))
    carried = [c for c in extra if c != id_col]
    table = vocabulary(texts, lexicon, config, id_col, text_col)
    total = table.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * FREQUENT))
    if config.token_numbering == TokenNumbering.CONTINUOUS and session is not None:
        by, along = session, [*(order or []), id_col, "word_idx"]
    else:
        by, along = [id_col], ["word_idx"]
    if config.whitespace == WhitespaceHandling.SKIP:
        # texts are small until they are cut, so parts go by tokens
        spread = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PART_TOKENS))
        return _numbered_texts(texts, table, least, spread, id_col, text_col, carried, by, along)
    cut = tokens(texts, config.whitespace, id_col, text_col)
    if carried:
        cut = cut.join(texts.select(id_col, *carried).distinct(), id_col)
    return number(cut, table, least, config, id_col, by, along)


#: A word of at least this share of all tokens is looked up by broadcast: at most its inverse many words, of 64 characters.
FREQUENT = 1 / 200_000
#: Tokens of a task that numbers them, on average: they are sorted in its memory.
PART_TOKENS = 2_000_000


def vocabulary(texts: DataFrame, lexicon: Lexicon, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, nodes, rows``: the distinct words of all texts, how often they occur, and their interpretations."""
    cut = tokens(texts, config.whitespace, id_col, text_col)
    counted = stored(cut.where("not space").groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n")), "distinct")
    return word_table(counted, lexicon, config)


def _by_frequency(table: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(frequent words, all others); a frequent word is not long, so that the first are of bounded size."""
    frequent = (F.col("n") >= least) & (F.length("word") <= 64)
    return table.where(frequent), table.where(~frequent)


def _before(by: list[str], along: list[str]) -> Column:
    """Nodes of the words before a word."""
    span = Window.partitionBy(*by).orderBy(*along)
    return F.coalesce(F.sum("nodes").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")


def _numbered_texts(texts: DataFrame, table: DataFrame, least: int, spread: int, id_col: str, text_col: str, carried: list[str], by: list[str], along: list[str]) -> DataFrame:
    """Join words without the blanks with their rows, and number the nodes.

    Only rare words move to their readings.  They meet their texts again, which move as they are, and
    are cut where they are numbered; frequent words meet their readings there, by broadcast.
    """
    often, rare = _by_frequency(table, least)
    often = often.withColumnRenamed("word", "token")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [id_col, *carried]
    cut = texts.select(*keys, F.posexplode_outer(words(text)).alias("word_idx", "token")).where("token is not null")
    cut = cut.join(F.broadcast(often.select("token")), "token", "left_anti")
    met = cut.join(rare.withColumnRenamed("word", "token"), "token").select(*keys, "word_idx", F.struct("nodes", "rows").alias("rare"))
    none = F.lit(None)
    both = met.withColumn("text", none.cast("string")).unionAll(texts.select(*keys, none.cast("int"), none.cast(met.schema["rare"].dataType), text))
    here = F.when(F.col("rare").isNull(), words(F.col("text"))).otherwise(F.array(none.cast("string")))
    each = both.repartition(spread, *by).select(*keys, "rare", F.col("word_idx").alias("own_idx"), F.posexplode_outer(here).alias("at", "token"))
    # the width of a row counts until it is placed: a frequent word's readings come after that
    sized = each.join(F.broadcast(often.select("token", F.col("nodes").alias("some"))), "token", "left").where("rare is not null or some is not null")
    sized = sized.select(*keys, F.coalesce("own_idx", "at").alias("word_idx"), F.coalesce("rare.nodes", "some").alias("nodes"), F.col("rare.rows").alias("rows"), "token")
    placed = sized.withColumn("base", _before(by, along))
    read = placed.join(F.broadcast(often.select("token", F.col("rows").alias("some"))), "token", "left")
    out = read.select(id_col, "word_idx", "base", F.explode(F.coalesce("rows", "some")).alias("x"))
    return out.select(
        id_col, "word_idx", "x.ord", (F.col("base") + F.col("x.src")).alias("start_node"), (F.col("base") + F.col("x.dst")).alias("end_node"), "x.orth", "x.lemma", "x.tag_id", "x.name_id", "x.labels_id"
    )


def number(cut: DataFrame, table: DataFrame, least: int, config: Config, id_col: str, by: list[str], along: list[str]) -> DataFrame:
    """Join tokens, blanks among them, with the rows of their words (``word, nodes, rows, n``), and number the nodes.

    Tokens of frequent words meet theirs by broadcast, and spread over all partitions of the join of the others.
    """
    often, rare = _by_frequency(table, least)
    often = often.select(F.col("word").alias("token"), F.struct("nodes", "rows").alias("often"))
    rare = rare.select(F.col("word").alias("key"), F.struct("nodes", "rows").alias("rare"))
    looked = cut.join(F.broadcast(often), "token", "left")
    # \0 is white space, so no word begins with it
    key = F.when(F.col("often").isNull() & ~F.col("space"), F.col("token")).otherwise(F.concat(F.lit("\0"), (F.xxhash64("token", "word_idx", id_col) % 1_000_000).cast("string")))
    met = looked.withColumn("key", key).join(rare, "key", "left").withColumn("met", F.coalesce("often", "rare")).drop("often", "rare", "key")
    sized = met.withColumn("nodes", F.coalesce("met.nodes", F.lit(1)))
    placed = sized.withColumn("base", _before(by, along))
    rows = placed.where("not space").withColumn("x", F.explode("met.rows")).select(*[c for c in placed.columns if c != "met"], "x.*")
    orth = F.col("orth")
    if config.whitespace == WhitespaceHandling.APPEND:
        # blanks belong to the rows at the word's first and last node
        orth = F.concat(
            F.when(F.col("src") == 0, F.coalesce("lead", F.lit(""))).otherwise(F.lit("")), orth,
            F.when(F.col("dst") == F.col("nodes"), F.coalesce("trail", F.lit(""))).otherwise(F.lit("")),
        )
    out = rows.select(id_col, "word_idx", "ord", (F.col("base") + F.col("src")).alias("start_node"), (F.col("base") + F.col("dst")).alias("end_node"), orth.alias("orth"), "lemma", "tag_id", "name_id", "labels_id")
    if config.whitespace != WhitespaceHandling.KEEP:
        return out
    blank = placed.where("space").select(
        id_col, "word_idx", F.lit(1).alias("ord"), F.col("base").alias("start_node"), (F.col("base") + 1).alias("end_node"), F.col("token").alias("orth"), F.col("token").alias("lemma"),
        F.lit(SPACE).alias("tag_id"), F.lit(0).alias("name_id"), F.lit(0).alias("labels_id"),
    )
    return out.unionByName(blank)
