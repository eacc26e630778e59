"""A toy dictionary with glued prefixes, capitals, marks and two readings of a word."""

from lexigraph.operators import lexicon as lx
from lexigraph.sources import dictionary as dc
from lexigraph.sources import rules as rl
from lexigraph.sources import tagset as tg

TAGSET = "#!TAGSET-ID toy\n\n[TAGS]\n0\tign\n1\tsp\n2\tinterp\n3\tnoun:sg\n4\tverb:past\n5\tpref\n6\tending\n7\tnum\n"
RULES = """[options]
aggl=strict permissive
praet=split composite
[combinations]
#define body (noun|verb)
#ifdef permissive
verb ending
#endif
pre> noun
digit>* digit
body mark*
mark
[segment types]
noun
verb
pre
ending
digit
mark
[lexemes]
mark\t!\tinterp
[tags]
pre\tpref
verb\tverb:%
ending\tending
digit\tnum
mark\tinterp
noun\t%
[separator chars]
# comma
44
"""
LINES = """#!DICT-ID toy
house\thouse\tnoun:sg\tcommon\tb|a
houses\thouse\tnoun:sg
Bonn\tBonn\tnoun:sg\tplace
bonn\tbonn\tverb:past
ran\trun\tverb:past
ra\tra\tverb:past
nt\tbe\tending
t\tbe:x\tending
re\tre\tpref
!\t!\tinterp
,\t,\tinterp
1\t1\tnum
2\t2\tnum
two words\ttwo\tnoun:sg"""


def source(spark):
    return dc.entries(spark.createDataFrame(list(enumerate(LINES.split("\n"))), "src_ord bigint, line string"))


def analyzer(spark):
    return lx.compile_analyzer(source(spark), tg.parse_tagset(TAGSET), rl.compile_rules(RULES), dc.metadata(LINES.split("\n")))


def generator(spark):
    return lx.compile_generator(source(spark), tg.parse_tagset(TAGSET), rl.compile_rules(RULES, generator=True))
