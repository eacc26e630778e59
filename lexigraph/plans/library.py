"""The engine's queries over the driver's tables, each with its SQL.

The tables hold no dictionary, so a lexicon is made from the documents: the
distinct alphabetic words, with a lemma two characters shorter and a tag by
length; other words stay unknown.  Rules accept a word, a mark, or a word and a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.config import Charset, Config, TokenNumbering, WhitespaceHandling
from lexigraph.functions import charsets, text as tx
from lexigraph.operators import analyze as an
from lexigraph.operators import generate as gn
from lexigraph.operators import lexicon as lx
from lexigraph.operators import present as pr
from lexigraph.plans.registry import register
from lexigraph.plans.storage import stored
from lexigraph.sources import rules as rl
from lexigraph.sources.tagset import Tagset

RULES = """
[options]
aggl=strict permissive isolated
praet=split composite
[combinations]
word
mark
word mark
[segment types]
word
mark
[lexemes]
[tags]
mark\tinterp
word\t%
[separator chars]
44
46
"""
TAGS = Tagset("made.up", {"ign": 0, "sp": 1, "interp": 2, "adj:sg.pl:nom": 10, "adv:pos": 11, "subst:sg:_": 12, "verb:fin": 13})
_WS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in tx.WHITESPACE) + "]+"
_LETTERS = "^[a-zäöüßéèêëàâçîïôûùñáíóúì]+$"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries made from the documents, and the two marks."""
    docs = _table(spark, sf_dir, "documents")
    # the outer form: for the inner one the planner adds a filter that works out the array twice
    word = docs.select(F.explode_outer(tx.words(F.col("text"))).alias("t")).where("t is not null").select(F.lower("t").alias("orth")).distinct()
    word = word.where(F.col("orth").rlike(_LETTERS))
    n = F.length("orth")
    tag = F.get(F.array(*map(F.lit, ["adj:sg.pl:nom", "adv:pos", "subst:sg:_", "verb:fin"])), n % 4)
    made = word.select(
        F.xxhash64("orth").alias("src_ord"), "orth", F.substring(F.col("orth"), F.lit(1), F.greatest(n - 2, F.lit(1))).alias("base"), tag.alias("tag"),
        F.when(n % 5 == 0, F.lit("five")).otherwise(F.lit("")).alias("name"), F.when(n >= 8, F.lit("long|word")).otherwise(F.lit("")).alias("qualifier"),
    )
    marks = spark.createDataFrame([(0, m, m, "interp", "", "") for m in ",."], made.schema)
    return made.unionAll(marks)


def analyzer(spark: SparkSession, sf_dir: str) -> lx.Lexicon:
    return lx.compile_analyzer(stored(entries(spark, sf_dir), "entries"), TAGS, rl.compile_rules(RULES))


_LEX = rf"""
lexicon AS (
  SELECT orth, left(orth, greatest(length(orth) - 2, 1)::INT) AS base, (ARRAY['adj:sg.pl:nom', 'adv:pos', 'subst:sg:_', 'verb:fin'])[length(orth) % 4 + 1] AS tag,
    [10, 11, 12, 13][length(orth) % 4 + 1]::INT AS tag_id, CASE WHEN length(orth) % 5 = 0 THEN 'five' ELSE '_' END AS name, CASE WHEN length(orth) >= 8 THEN 'long|word' ELSE '_' END AS labels
  FROM (SELECT DISTINCT lower(t) AS orth FROM (SELECT unnest(string_split_regex(text, '{_WS}')) AS t FROM documents))
  WHERE regexp_matches(orth, '{_LETTERS}')
  UNION ALL SELECT m, m, 'interp', 2, '_', '_' FROM (VALUES (','), ('.')) v(m))"""


def _rows_sql(source: str, key: str, order: str = "") -> str:
    """SQL of the rows of an analysis with blanks left out: every part of a word is an edge of its own."""
    return rf"""{_LEX},
tok AS (
  SELECT {key}, i - 1 AS word_idx, w[i] AS token FROM (
    SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w FROM {source}), range(1, len(w) + 1) r(i)),
part AS (SELECT {key}, word_idx, j AS ord, p[j] AS part FROM (SELECT *, regexp_extract_all(token, '[^,.]+|[,.]') AS p FROM tok), range(1, len(p) + 1) r(j)),
rows AS (
  SELECT {key}, word_idx::INT AS word_idx, ord::INT AS ord,
    (row_number() OVER (PARTITION BY {order or key} ORDER BY {key}, word_idx, ord) - 1)::INT AS start_node, row_number() OVER (PARTITION BY {order or key} ORDER BY {key}, word_idx, ord)::INT AS end_node,
    part AS orth, coalesce(base, part) AS lemma, coalesce(tag_id, 0)::INT AS tag_id, coalesce(tag, 'ign') AS tag, coalesce(name, '_') AS name, coalesce(labels, '_') AS labels
  FROM part LEFT JOIN lexicon ON lexicon.orth = lower(part))"""


_SHOWN = ["word_idx", "ord", "start_node", "end_node", "orth", "lemma", "tag_id", "tag", "name", "labels"]


def _shown(rows: DataFrame, lexicon: lx.Lexicon, *key: str) -> DataFrame:
    return pr.named(rows, lexicon).select(*key, *_SHOWN)


@register("analyze_documents", f"WITH {_rows_sql('documents', 'doc_id')} SELECT doc_id, {', '.join(_SHOWN)} FROM rows")
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = analyzer(spark, sf_dir)
    return _shown(an.analyze(_table(spark, sf_dir, "documents"), lexicon), lexicon, "doc_id")


@register("tag_counts", f"WITH {_rows_sql('documents', 'doc_id')} SELECT lang, tag, count(*)::BIGINT AS n, count(DISTINCT lemma)::BIGINT AS lemmas FROM rows JOIN documents USING (doc_id) GROUP BY lang, tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, docs = analyzer(spark, sf_dir), _table(spark, sf_dir, "documents")
    # counts need no nodes: words are counted before they meet their readings.  The join is the SQL's, for rows that share an id
    texts = docs.select("doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    words = texts.select("lang", F.explode_outer(tx.words(F.col("text"))).alias("word")).where("word is not null").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("times"))
    rows = words.join(an.vocabulary(docs, lexicon).select("word", F.explode("rows").alias("x")), "word").select("lang", "times", "x.*")
    return pr.named(rows, lexicon).groupBy("lang", "tag").agg(F.sum("times").alias("n"), F.countDistinct("lemma").alias("lemmas"))


@register("continuous_numbering", f"WITH {_rows_sql('conversations', 'conv_id, turn', 'conv_id')} SELECT conv_id, turn, {', '.join(_SHOWN)} FROM rows")
def continuous_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes run on over the turns of a conversation."""
    lexicon = analyzer(spark, sf_dir)
    turns = _table(spark, sf_dir, "conversations").withColumn("line", F.struct("conv_id", "turn"))
    rows = an.analyze(turns, lexicon, Config(token_numbering=TokenNumbering.CONTINUOUS), id_col="line", session=["conv_id"], order=["turn"])
    return _shown(rows.select("*", "line.conv_id", "line.turn"), lexicon, "conv_id", "turn")


_ITEM_BLOCKS = f"""WITH {_rows_sql('benchmark', 'item_id')},
piece AS (SELECT item_id, word_idx, ord, '[' || concat_ws(',', start_node, end_node, orth, lemma, tag, name, labels) || ']' AS p FROM rows)
SELECT b.item_id, coalesce((SELECT string_agg(p, chr(10) ORDER BY word_idx, ord) FROM piece WHERE piece.item_id = b.item_id), '[]') AS block FROM benchmark b"""


@register("format_blocks", _ITEM_BLOCKS)
def format_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, items = analyzer(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    return pr.blocks(pr.named(an.analyze(items, lexicon, id_col="item_id"), lexicon), items, "item_id")


@register("count_blanks_kept", rf"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '{_WS}|[^{_WS[1:-2]}]+')) AS x FROM benchmark)
SELECT item_id, count(*) FILTER (WHERE regexp_full_match(x, '{_WS}'))::BIGINT AS blanks, coalesce(sum(length(x)) FILTER (WHERE regexp_full_match(x, '{_WS}')), 0)::BIGINT AS blank_chars FROM t GROUP BY item_id""")
def count_blanks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, items = analyzer(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    rows = an.analyze(items, lexicon, Config(whitespace=WhitespaceHandling.KEEP), id_col="item_id")
    blank = F.col("tag_id") == an.SPACE
    return rows.groupBy("item_id").agg(F.sum(blank.cast("long")).alias("blanks"), F.sum(F.when(blank, F.length("orth")).otherwise(0)).cast("long").alias("blank_chars"))


@register("append_blanks", rf"""WITH t AS (SELECT item_id, regexp_extract_all(text, '{_WS}|[^{_WS[1:-2]}]+') AS x FROM benchmark),
u AS (SELECT item_id, x[i] AS token, CASE WHEN i = 2 THEN x[1] ELSE '' END AS lead, coalesce(x[i + 1], '') AS trail FROM t, range(1, len(x) + 1) r(i) WHERE NOT regexp_full_match(x[i], '{_WS}')),
p AS (SELECT item_id, lead, trail, regexp_extract_all(token, '[^,.]+|[,.]') AS p FROM u)
SELECT item_id, count(*)::BIGINT AS edges, sum(length(CASE WHEN j = 1 THEN lead ELSE '' END || p[j] || CASE WHEN j = len(p) THEN trail ELSE '' END))::BIGINT AS chars FROM p, range(1, len(p) + 1) r(j) GROUP BY item_id""")
def append_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, items = analyzer(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    rows = an.analyze(items, lexicon, Config(whitespace=WhitespaceHandling.APPEND), id_col="item_id")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.length("orth")).alias("chars"))


@register("unknown_words", f"WITH {_rows_sql('documents', 'doc_id')} SELECT orth, count(*)::BIGINT AS n FROM rows WHERE tag_id = 0 GROUP BY orth")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a word's rows are the same wherever it is, so they count as often as the word
    words = an.vocabulary(_table(spark, sf_dir, "documents"), analyzer(spark, sf_dir))
    rows = words.select("n", F.explode("rows").alias("x")).where(F.col("x.tag_id") == an.IGN)
    return rows.groupBy("x.orth").agg(F.sum("n").alias("n"))


@register("compile_lexicon", f"WITH {_LEX} SELECT lower(orth) AS lex_key, (length(orth) - length(base))::INT AS cut, tag_id, name, labels FROM lexicon")
def compile_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = analyzer(spark, sf_dir)
    rows = made.groups.select("lex_key", F.explode("interps").alias("x")).select("lex_key", "x.cut", "x.tag_id", "x.name_id", "x.labels_id")
    return pr.named(rows, made).select("lex_key", "cut", "tag_id", "name", "labels")


@register("generate_forms", f"""WITH {_LEX}, w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS lemma FROM part)
SELECT w.lemma AS asked, coalesce(l.orth, w.lemma) AS orth, coalesce(l.base, w.lemma) AS lemma, coalesce(tag, 'ign') AS tag FROM w LEFT JOIN lexicon l ON l.base = w.lemma""")
def generate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lx.compile_generator(stored(entries(spark, sf_dir), "entries"), TAGS, rl.compile_rules(RULES, generator=True))
    asked = _table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("lemma")).distinct()
    rows = gn.generate(asked.withColumn("asked", F.col("lemma")), made, id_col="asked")
    return pr.named(rows, made).select("asked", "orth", "lemma", "tag")


@register("generate_documents", f"""WITH {_LEX} SELECT k.base AS asked, l.orth, l.base AS lemma, l.tag FROM (SELECT DISTINCT base FROM lexicon) k JOIN lexicon l ON l.base = k.base""")
def generate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stored(entries(spark, sf_dir), "entries")
    made = lx.compile_generator(source, TAGS, rl.compile_rules(RULES, generator=True))
    rows = gn.generate(source.select(F.col("base").alias("lemma")).distinct().withColumn("asked", F.col("lemma")), made, id_col="asked")
    return pr.named(rows, made).select("asked", "orth", "lemma", "tag")


@register("expanded_tags", rf"""WITH {_LEX}, t AS (SELECT DISTINCT tag FROM lexicon),
a AS (SELECT tag, unnest(CASE WHEN string_split(tag, ':')[1] IS NULL THEN [] ELSE string_split(string_split(tag, ':')[1], '.') END) AS x FROM t),
b AS (SELECT tag, x, CASE WHEN len(string_split(tag, ':')) < 2 THEN [NULL] ELSE string_split(string_split(tag, ':')[2], '.') END AS y FROM a),
c AS (SELECT tag, x, unnest(y) AS y, CASE WHEN len(string_split(tag, ':')) < 3 THEN [NULL] ELSE string_split(replace(string_split(tag, ':')[3], '_', 'm1.m2.m3.f.n'), '.') END AS z FROM b),
d AS (SELECT tag, x, y, unnest(z) AS z FROM c)
SELECT tag, concat_ws(':', x, y, z) AS expanded FROM d""")
def expanded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = entries(spark, sf_dir).select("tag").distinct()
    return tags.select("tag", F.explode(tx.expand_tag(F.col("tag"))).alias("expanded"))


@register("whitespace_runs", rf"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '{_WS}|[^{_WS[1:-2]}]+') AS x FROM documents)
SELECT doc_id, len(x)::BIGINT AS runs, len(list_filter(x, lambda y: regexp_full_match(y, '{_WS}')))::BIGINT AS blanks FROM r""")
def whitespace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _table(spark, sf_dir, "documents").select("doc_id", tx.runs(F.col("text")).alias("x"))
    return cut.select("doc_id", F.size("x").cast("long").alias("runs"), F.size(F.filter("x", tx.has_whitespace)).cast("long").alias("blanks"))


@register("separator_parts", rf"""SELECT item_id, unnest(regexp_extract_all(w, '[^,.]+|[,.]')) AS part FROM (SELECT item_id, unnest(string_split_regex(text, '{_WS}')) AS w FROM benchmark)""")
def separator_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("w"))
    return words.select("item_id", F.explode(tx.parts(F.col("w"), ",.")).alias("part"))


@register("lowered_words", rf"SELECT lower(t) AS word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split_regex(text, '{_WS}')) AS t FROM documents) WHERE t <> '' GROUP BY 1")
def lowered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("w"))
    return words.groupBy("w").count().groupBy(tx.lower1(F.col("w")).alias("word")).agg(F.sum("count").alias("n"))


@register("canonical_label_sets", """SELECT event_id, CASE WHEN trim(e) = '' THEN '_' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(e, '|'), lambda x: trim(x)), lambda x: x <> ''))), '|') END AS labels
FROM (SELECT event_id, event_type || '| ' || (user_id % 3) || ' |' || event_type AS e FROM events)""")
def canonical_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.col("event_type"), F.lit("| "), (F.col("user_id") % 3).cast("string"), F.lit(" |"), F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", tx.canonical_labels(made).alias("labels"))


@register("roman_and_digits", r"""SELECT o_orderkey, c, regexp_matches(upper(c), '^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$') AND c <> '' AS roman, regexp_matches(c, '^[0-9]+$') AS digits
FROM (SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', 'IVXLCDMixv') AS c FROM orders UNION ALL SELECT o_orderkey, o_orderkey::VARCHAR FROM orders)""")
def roman_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    both = F.explode(F.array(F.translate(key, "0123456789", "IVXLCDMixv"), key)).alias("c")
    return _table(spark, sf_dir, "orders").select("o_orderkey", both).select("o_orderkey", "c", tx.is_roman(F.col("c")).alias("roman"), tx.is_digits(F.col("c")).alias("digits"))


@register("prefix_keys", rf"""WITH {_LEX}, w AS (SELECT DISTINCT lower(t) AS w FROM (SELECT unnest(string_split_regex(text, '{_WS}')) AS t FROM benchmark) WHERE t <> '')
SELECT w AS word, count(*)::BIGINT AS keys, max(length(orth))::INT AS longest FROM (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: left(w, i::INT))) AS p FROM w) JOIN lexicon ON orth = p GROUP BY w""")
def prefix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon keys that begin a word: substrings up to the longest key, then an equi-join."""
    made = analyzer(spark, sf_dir)
    words = _table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("w")).select(tx.lower1(F.col("w")).alias("word")).distinct()
    ends = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(made.longest_key)))
    tried = words.select("word", F.explode(ends).alias("e")).withColumn("lex_key", F.substring(F.col("word"), F.lit(1), F.col("e")))
    return tried.join(made.groups.select("lex_key"), "lex_key").groupBy("word").agg(F.count(F.lit(1)).alias("keys"), F.max("e").alias("longest"))


@register("key_letters", f"WITH {_LEX}, c AS (SELECT unnest(string_split(orth, '')) AS ch FROM lexicon) SELECT ch, count(*)::BIGINT AS n FROM c GROUP BY ch")
def key_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = entries(spark, sf_dir).select(F.explode(F.filter(F.split("orth", ""), lambda c: c != "")).alias("ch"))
    return keys.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@register("dimension_ids", f"""WITH {_LEX}, n AS (SELECT DISTINCT CASE WHEN name = '_' THEN '' ELSE name END AS v FROM lexicon UNION SELECT ''),
l AS (SELECT DISTINCT CASE WHEN labels = '_' THEN '' ELSE labels END AS v FROM lexicon UNION SELECT '')
SELECT 'name' AS kind, (row_number() OVER (ORDER BY v) - 1)::INT AS id, v AS value FROM n UNION ALL SELECT 'labels', (row_number() OVER (ORDER BY v) - 1)::INT, v FROM l""")
def dimension_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, labels = lx.dimensions(stored(entries(spark, sf_dir), "entries"), TAGS)
    return names.select(F.lit("name").alias("kind"), F.col("name_id").alias("id"), F.col("name").alias("value")).unionAll(
        labels.select(F.lit("labels").alias("kind"), F.col("labels_id").alias("id"), F.array_join("labels", "|").alias("value"))
    )


@register("graph_paths", f"WITH {_rows_sql('benchmark', 'item_id')} SELECT item_id, count(*)::BIGINT AS edges, string_agg(orth, ' ' ORDER BY word_idx, ord) AS orths FROM rows GROUP BY item_id")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways through the graph of a whole item (texts are linear here, so one each)."""
    lexicon, items = analyzer(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    rows = pr.named(an.analyze(items, lexicon, id_col="item_id"), lexicon)
    paths = pr.all_paths(stored(rows, "edges"), "item_id")
    return paths.select("item_id", F.size("path").cast("long").alias("edges"), F.array_join(F.transform("path", lambda x: x["orth"]), " ").alias("orths"))


@register("json_responses", f"""WITH {_rows_sql('benchmark', 'item_id')}
SELECT b.item_id, true AS ok, (SELECT count(*) FROM rows r WHERE r.item_id = b.item_id)::BIGINT AS results, (SELECT r.lemma FROM rows r WHERE r.item_id = b.item_id ORDER BY word_idx, ord LIMIT 1) AS first_lemma FROM benchmark b""")
def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, items = analyzer(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    made = pr.responses(pr.named(an.analyze(items, lexicon, id_col="item_id"), lexicon), items, "item_id")
    read = F.from_json("response", "ok boolean, results array<struct<lemma string>>")
    return made.select("item_id", read.alias("r")).select("item_id", "r.ok", F.size("r.results").cast("long").alias("results"), F.get("r.results", F.lit(0))["lemma"].alias("first_lemma"))


@register("one_byte_round_trip", "SELECT s_suppkey, s_name AS text, length(s_name)::BIGINT AS bytes FROM supplier")
def one_byte_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = charsets.encode(F.col("s_name"), Charset.CP1250)
    coded = _table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"))
    return coded.select("s_suppkey", charsets.decode(F.col("raw"), Charset.CP1250).alias("text"), F.length("raw").cast("long").alias("bytes"))
