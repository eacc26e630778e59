import json

import pytest
import toy

from lexigraph import cli
from lexigraph.config import Config, Usage
from lexigraph.engine import Engine, OutOfRange, Repository, Results
from lexigraph.errors import InvalidArgument, NotFound, Unsupported
from lexigraph.operators import lexicon as lx
from lexigraph.sources import dictionary as dc
from lexigraph.sources import rules as rl
from lexigraph.sources import tagset as tg
from lexigraph.streaming.service import Service


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('lexicons')}"
    repository = Repository(spark, ["file:///nowhere", folder])
    repository.save(Engine(toy.analyzer(spark), toy.generator(spark)), folder, "toy")
    return repository


def test_loading_and_guards(spark, saved):
    with pytest.raises(NotFound, match="generator"):
        saved.load("other", Usage.GENERATE_ONLY)
    with pytest.raises(NotFound):
        Repository(spark, []).load("toy")
    both = saved.load("toy")
    assert both.usage == Usage.BOTH and both.analyzer.dict_id == "toy" and both.counts()["tags"] == 8
    lemmas = spark.createDataFrame([(1, "house")], "doc_id bigint, lemma string")
    with pytest.raises(Unsupported, match="generate"):
        saved.load("toy", Usage.ANALYSE_ONLY).generate(lemmas)
    only = saved.load_path(saved.search_paths[1] + "/toy-generator")
    with pytest.raises(Unsupported, match="analyse"):
        only.analyze(lemmas)
    assert only.usage == Usage.GENERATE_ONLY and {r["orth"] for r in only.generate(lemmas).collect()} == {"house", "houses"}
    assert both.with_options(aggl="permissive").metadata()["aggl"] == "permissive"
    with pytest.raises(InvalidArgument):
        both.with_options(aggl="isolated")


def test_results(spark):
    found = Results(spark.range(3))
    assert found.peek() == found.next() and found.has_next() and [r["id"] for r in found] == [1, 2]
    with pytest.raises(OutOfRange):
        found.next()


def test_control_messages(spark, saved):
    service = Service(saved.load("toy"), saved)
    assert json.loads(service.control('{"mode": "metadata", "aggl": "permissive", "case_handling": "strict"}'))["metadata"]["case_handling_id"] == 101
    assert service.engine.config.aggl == "permissive"
    for bad in ('{"mode": "metadata", "aggl": "odd"}', '{"mode": "set_dictionary", "dict": "none"}', "text", '{"mode": "analyze"}'):
        answer = json.loads(service.control(bad))
        assert not answer["ok"] and answer["error"]
    assert service.engine.config.aggl == "permissive" and json.loads(service.control('{"mode": "set_dictionary", "dict": "toy"}'))["ok"]


def test_command_line(spark, saved, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"house xyz\r\n\nran")
    cli.run(spark, ["analyze", f"{tmp_path}/in.txt", "--lexicon", "toy", "--path", saved.search_paths[1], "--out", f"{tmp_path}/out", "--token-numbering", "continuous"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "[0,1,house,house,noun:sg,common,a|b]\n[1,2,xyz,xyz,ign,_,_]\n[]\n[2,3,ran,run,verb:past,_,_]\n"


def test_lexicon_without_rules(spark):
    source = dc.entries(spark.createDataFrame([(0, "ran\trun\tverb:past"), (1, "re\tre\tpref")], "src_ord bigint, line string"))
    made = [f(source, tg.parse_tagset(toy.TAGSET), rl.whole_words(g)) for f, g in ((lx.compile_analyzer, False), (lx.compile_generator, True))]
    engine = Engine(*made, Config())
    texts = spark.createDataFrame([(1, "ran reran")], "doc_id bigint, text string")
    assert [(r["orth"], r["lemma"], r["tag"]) for r in engine.analyze(texts).orderBy("word_idx").collect()] == [("ran", "run", "verb:past"), ("reran", "reran", "ign")]
    lemmas = spark.createDataFrame([(1, "run"), (2, "x")], "doc_id bigint, lemma string")
    assert sorted((r["orth"], r["tag"]) for r in engine.generate(lemmas).collect()) == [("ran", "verb:past"), ("x", "ign")]


def test_copyright_blocks_of_two_sources(spark):
    lines = ["#<COPYRIGHT>", "a", "#</COPYRIGHT>", "one\tone\tpref", "#<COPYRIGHT>", "b", "#</COPYRIGHT>", "two\ttwo\tpref"]
    assert [r["orth"] for r in dc.entries(spark.createDataFrame(list(enumerate(lines)), "src_ord bigint, line string")).orderBy("src_ord").collect()] == ["one", "two"]
