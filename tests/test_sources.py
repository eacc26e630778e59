import pytest
import toy

from lexigraph.config import CaseHandling, Charset, Config, parse_option
from lexigraph.errors import InvalidArgument, InvalidDictionary
from lexigraph.functions import charsets
from lexigraph.functions import text as tx
from lexigraph.sources import dictionary as dc
from lexigraph.sources import rules as rl
from lexigraph.sources import tagset as tg
from pyspark.sql import functions as F


def test_tagset_errors():
    assert tg.parse_tagset(toy.TAGSET).tags["interp"] == 2
    for bad in ("no id\n[TAGS]\n1\ta", "#!TAGSET-ID x\n[TAGS]\n1\ta\n1\tb", "#!TAGSET-ID x\n[TAGS]\n1\ta\n2\ta", "#!TAGSET-ID x\n1\ta"):
        with pytest.raises(InvalidDictionary):
            tg.parse_tagset(bad)
    assert tg.parse_tagset("[X]\nfoo\n[TAGS]\n1 a\n2 a", strict=False).tags == {"a": 2}


def test_entries_and_header(spark):
    lines = ["#!DICT-ID d", "#<COPYRIGHT>", "text\ta\tb", "#</COPYRIGHT>", "a\tb\tc", "", "x y\tb\tc", " d\te\tf\tg\th\r"]
    assert dc.metadata(lines) == {"dict_id": "d", "copyright": "text\ta\tb"}
    got = dc.entries(spark.createDataFrame(list(enumerate(lines)), "src_ord bigint, line string")).orderBy("src_ord").collect()
    assert [tuple(r)[1:] for r in got] == [("a", "b", "c", "", ""), ("d", "e", "f", "g", "h")]
    with pytest.raises(Exception, match="3 to 5 fields"):
        dc.entries(spark.createDataFrame([(0, "a\tb")], "src_ord bigint, line string")).collect()
    with pytest.raises(InvalidDictionary):
        dc.lines_of(spark, [])


def test_rules():
    rules = rl.compile_rules(toy.RULES)
    assert rules.separators == "," and len(rules.variants) == 4
    assert rules.option_values("aggl") == ["permissive", "strict"]
    assert rules.variant().options == {"aggl": "strict", "praet": "split"} and rules.variant().longest is None
    with pytest.raises(InvalidArgument):
        rules.variant(aggl="isolated")
    base = "[options]\na=x\n[combinations]\n%s\n[segment types]\np\nq\n[lexemes]\n[tags]\np\t%%\n"
    assert rl.compile_rules(base % "p{1,3} q").variants[0].longest == 4
    for bad in ("p*", "p>|q", "p q>", "(p", "p {0}", "z", "p q !weak\np q"):
        with pytest.raises(InvalidDictionary):
            rl.compile_rules(base % bad)
    weak = rl.compile_rules(base % "p q !weak").variants[0].rows
    assert any(r[5] for r in weak)


def test_options():
    assert parse_option(CaseHandling, " Strict ") == CaseHandling.STRICTLY_CASE_SENSITIVE
    assert parse_option(CaseHandling, 102) == CaseHandling.IGNORE_CASE
    for bad in ("what", 7):
        with pytest.raises(InvalidArgument):
            parse_option(CaseHandling, bad)
    with pytest.raises(InvalidArgument):
        Config(aggl="no")


def test_text_functions(spark):
    assert len(tx.WHITESPACE) == 33
    odd = "a⁠b​c d\x00e "
    df = spark.createDataFrame([(odd, "İSTANBUL Ł"), (None, None)], "t string, u string")
    row = df.select(tx.words(F.col("t")).alias("w"), tx.lower1(F.col("u")).alias("l")).first()
    assert row["w"] == ["a", "b", "c", "d", "e"] and row["l"] == "istanbul ł"
    values = [("", "_"), (" b | a|b", "a|b"), (None, "_")]
    got = spark.createDataFrame([(v,) for v, _ in values], "x string").select(tx.canonical_labels(F.col("x"))).collect()
    assert [r[0] for r in got] == [w for _, w in values]
    tags = spark.createDataFrame([("subst:sg.pl:_",)], "t string")
    assert len(tags.select(tx.expand_tag(F.col("t"))).first()[0]) == 10
    assert tags.select(tx.expand_tag(F.col("t"), expand_dot=False)).first()[0] == ["subst:sg.pl:m1.m2.m3.f.n"]
    assert tx.tag_pattern("subst:%").match("subst") and not tx.tag_pattern("subst:%").match("substx")


def test_charsets(spark):
    for charset, raw in ((Charset.ISO8859_2, "BFF3B3E6"), (Charset.CP1250, "BFF3B3E6"), (Charset.CP852, "BEA28886")):
        df = spark.createDataFrame([("żółć", bytes.fromhex(raw)), ("😀", b"\xf7")], "t string, b binary")
        got = df.select(charsets.encode(F.col("t"), charset).alias("b"), charsets.decode(F.col("b"), charset).alias("t")).collect()
        assert bytes(got[0]["b"]) == bytes.fromhex(raw) and got[0]["t"] == "żółć" and bytes(got[1]["b"]) == b"\xf7"
