import pytest
import toy
from pyspark.sql import functions as F

from lexigraph.config import CaseHandling, Config, TokenNumbering, WhitespaceHandling
from lexigraph.operators import analyze as an
from lexigraph.operators import generate as gn
from lexigraph.operators import paths as ps
from lexigraph.operators import present as pr


@pytest.fixture(scope="module")
def lexicon(spark):
    return toy.analyzer(spark)


def shown(spark, lexicon, texts, config=Config(), **more):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, s int")
    rows = pr.named(an.analyze(df, lexicon, config, **more), lexicon)
    return [r["block"] for r in pr.blocks(rows, df).orderBy("doc_id").collect()]


def test_blocks(spark, lexicon):
    got = shown(spark, lexicon, ["house", "rehouse", "121", "xyz", "xyz,house", "Houses!!", "", None, "   "])
    assert got == [
        "[0,1,house,house,noun:sg,common,a|b]",
        "[0,1,rehouse,rehouse,noun:sg,common,a|b]",
        "[0,1,121,121,num,_,_]",
        "[0,1,xyz,xyz,ign,_,_]",
        "[0,1,xyz,xyz,ign,_,_]\n[1,2,,,,,interp,_,_]\n[2,3,house,house,noun:sg,common,a|b]",
        "[0,1,Houses,house,noun:sg,_,_]\n[1,2,!,!,interp,_,_]\n[2,3,!,!,interp,_,_]",
        "[]",
        "[]",
        "[]",
    ]


def test_case_modes(spark, lexicon):
    weak = shown(spark, lexicon, ["Bonn", "bonn", "BONN"])
    assert weak[0] == "[0,1,Bonn,Bonn,noun:sg,place,_\n 0,1,Bonn,bonn,verb:past,_,_]"
    assert weak[1] == "[0,1,bonn,bonn,verb:past,_,_]"
    strict = shown(spark, lexicon, ["house", "bonn"], Config(case_handling=CaseHandling.STRICTLY_CASE_SENSITIVE))
    assert strict[1] == "[0,1,bonn,bonn,verb:past,_,_]"
    ignore = shown(spark, lexicon, ["bonn"], Config(case_handling=CaseHandling.IGNORE_CASE))
    assert ignore[0] == "[0,1,bonn,Bonn,noun:sg,place,_\n 0,1,bonn,bonn,verb:past,_,_]"


def test_ambiguous_segmentation_and_variants(spark, lexicon):
    both = shown(spark, lexicon, ["rant"], Config(aggl="permissive"))[0]
    assert set(both.strip("[]").replace("]\n[", "\n").replace("\n ", "\n").split("\n")) == {
        "0,1,ra,ra,verb:past,_,_", "0,2,ran,run,verb:past,_,_", "1,3,nt,be,ending,_,_", "2,3,t,be:x,ending,_,_",
    }
    assert shown(spark, lexicon, ["rant"], Config(aggl="strict"))[0] == "[0,1,rant,rant,ign,_,_]"


def test_numbering_and_blanks(spark, lexicon):
    run_on = shown(spark, lexicon, ["house ran", "house"], Config(token_numbering=TokenNumbering.CONTINUOUS), session=["s"], order=["doc_id"])
    assert run_on[1].startswith("[2,3,house")
    kept = shown(spark, lexicon, [" house  ran"], Config(whitespace=WhitespaceHandling.KEEP))[0]
    assert [x.split(",")[6 - 2] for x in kept.strip("[]").split("]\n[")] == ["sp", "noun:sg", "sp", "verb:past"]
    added = shown(spark, lexicon, [" house  ran\t"], Config(whitespace=WhitespaceHandling.APPEND))[0]
    assert added == "[0,1, house  ,house,noun:sg,common,a|b]\n[1,2,ran\t,run,verb:past,_,_]"


def test_generation(spark):
    lexicon = toy.generator(spark)
    df = spark.createDataFrame([(0, "house"), (1, "rehouse"), (2, "be:x"), (3, "nothing"), (4, "a b"), (5, None)], "doc_id bigint, lemma string")
    rows = pr.named(gn.generate(df, lexicon, Config(aggl="permissive")), lexicon).collect()
    got = {i: sorted((r["orth"], r["lemma"], r["tag"]) for r in rows if r["doc_id"] == i) for i in range(6)}
    assert got[0] == [("house", "house", "noun:sg"), ("houses", "house", "noun:sg")]
    assert got[1] == [("rehouse", "rehouse", "noun:sg"), ("rehouses", "rehouse", "noun:sg")]
    assert got[2] == [("t", "be:x", "ending")]
    assert got[3] == [("nothing", "nothing", "ign")]
    assert [r["error"] for r in rows if r["doc_id"] == 4] == ["Lemma parameter contains whitespace."]
    assert got[5] == [("", "", "ign")]


def test_tag_expansion_and_paths(spark, lexicon):
    df = spark.createDataFrame([(1, "a.b:c._")], "doc_id bigint, tag string")
    assert [r["tag"] for r in pr.with_expanded_tags(df).orderBy("tag_no").collect()][:3] == ["a:c", "a:_", "b:c"]
    rows = spark.createDataFrame(
        [(1, 0, 1, 0, 1, "x", "x", "t"), (1, 0, 2, 0, 2, "xy", "xy", "t"), (1, 0, 3, 1, 2, "y", "y", "t")],
        "doc_id bigint, word_idx int, ord int, start_node int, end_node int, orth string, lemma string, tag string",
    )
    paths = {tuple(x["orth"] for x in r["path"]) for r in pr.all_paths(rows).collect()}
    assert paths == {("xy",), ("x", "y")}


EDGES = "doc_id bigint, word_idx int, ord int, start_node int, end_node int, orth string, lemma string, tag string"


def test_long_paths(spark):
    edge = lambda doc, i, low, high: (doc, i, 0, low, high, f"{low}-{high}", "x", "t")
    linear = [edge(1, i, i, i + 1) for i in range(200)]
    forks = [edge(2, i, i, i + 1) for i in range(100)] + [edge(2, 100, 3, 5), edge(2, 101, 70, 100)]
    elsewhere = [edge(3, 0, 4, 5)]
    got = pr.all_paths(spark.createDataFrame(linear + forks + elsewhere, EDGES)).collect()
    ways = {k: sorted([x["orth"] for x in r["path"]] for r in got if r["doc_id"] == k) for k in (1, 2, 3)}
    assert ways[1] == [[f"{i}-{i + 1}" for i in range(200)]] and ways[3] == [[]]
    assert sorted(map(len, ways[2])) == [70, 71, 99, 100] and all(w[0] == "0-1" and w[-1].endswith("-100") for w in ways[2])
    for cycle in ([edge(1, 0, 0, 1), edge(1, 1, 1, 0)], [edge(1, 0, 0, 1), edge(1, 1, 1, 2), edge(1, 2, 2, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            pr.all_paths(spark.createDataFrame(cycle, EDGES))


def test_cuts_that_lead_nowhere_are_not_tried(spark, lexicon, monkeypatch):
    """The same paths with and without a look at the character after a cut."""
    words = spark.createDataFrame([(w,) for w in ("house", "rehouse", "Houses!!", "121", "rant", "Bonn", "xyz", "1x", "re", "!", "12re", "ünt")], "word string")
    for aggl in ("strict", "permissive"):
        variant = lexicon.rules.variant(aggl, "split")
        assert ps._later_chars(lexicon, variant) == ("!,12bh" if aggl == "strict" else "!,12bhnt")
        got = sorted(map(str, ps.segmentations(words, lexicon, variant).collect()))
        with monkeypatch.context() as m:
            m.setattr(ps, "_later_chars", lambda *_: None)
            assert got == sorted(map(str, ps.segmentations(words, lexicon, variant).collect())) and len(got) > 6


@pytest.mark.parametrize("frequent", [1.0, 1 / 200_000])
def test_numbers_of_repeated_and_null_ids(spark, lexicon, monkeypatch, frequent):
    """Words meet their readings in their texts, by broadcast or not; texts that share an id are one."""
    monkeypatch.setattr(an, "FREQUENT", frequent)
    texts = [(1, "house xyz,house ran"), (1, "xyz ran ran"), (None, "ran house"), (2, None), (3, " "), (4, "house house xyz house")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("s", F.coalesce("doc_id", F.lit(4)))
    got = an.analyze(df, lexicon).select("doc_id", "word_idx", "ord", "orth", "start_node", "end_node").collect()
    assert sorted(r["start_node"] for r in got if r["doc_id"] == 1) == list(range(8)) and {r["end_node"] - r["start_node"] for r in got} == {1}
    assert sorted(map(tuple, got[:0] + [r for r in got if r["doc_id"] is None]))[:2] == [(None, 0, 1, "ran", 0, 1), (None, 1, 1, "house", 1, 2)]
    assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == 4) == [(i, 1, o, i, i + 1) for i, o in enumerate(["house", "house", "xyz", "house"])]
    run_on = an.analyze(df, lexicon, Config(token_numbering=TokenNumbering.CONTINUOUS), session=["s"], order=["doc_id"]).collect()
    assert sorted(r["start_node"] for r in run_on if r["doc_id"] in (None, 4)) == list(range(6))
