"""Command line: ``python -m lexigraph.cli analyze|generate --lexicon NAME --path DIR INPUT... --out DIR``.

Lines are read from text files in the order given, a carriage return at a line's
end is dropped, and the blocks are written in the order of the lines, one block
a line of input, as text files whose names sort in that order.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.config import AGGL, PRAET, CaseHandling, Config, TokenNumbering, Usage, WhitespaceHandling, parse_option
from lexigraph.engine import Engine, Repository
from lexigraph.operators.present import blocks
from lexigraph.sources.dictionary import lines_of


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigraph")
    p.add_argument("mode", choices=("analyze", "generate"))
    p.add_argument("inputs", nargs="+")
    p.add_argument("--lexicon", required=True)
    p.add_argument("--path", action="append", help="folder to search, may be repeated")
    p.add_argument("--out", required=True)
    p.add_argument("--aggl", choices=AGGL)
    p.add_argument("--praet", choices=PRAET)
    p.add_argument("--case-handling", default="weak")
    p.add_argument("--token-numbering", default="separate")
    p.add_argument("--whitespace", default="skip")
    return p


def config(args: argparse.Namespace) -> Config:
    return Config(
        parse_option(CaseHandling, args.case_handling), parse_option(TokenNumbering, args.token_numbering), parse_option(WhitespaceHandling, args.whitespace), args.aggl, args.praet
    )


def lined(engine: Engine, lines: DataFrame, mode: str) -> DataFrame:
    """(src_ord, block) of ``src_ord, line`` rows; node numbers run on over all lines where the options say so."""
    texts = lines.select("src_ord", F.regexp_replace("line", "\r$", "").alias("text"), F.lit(0).alias("all"))
    if mode == "generate":
        return blocks(engine.generate(texts, id_col="src_ord", lemma_col="text"), texts, "src_ord", nodes=False)
    return blocks(engine.analyze(texts, id_col="src_ord", session=["all"], order=["src_ord"]), texts, "src_ord")


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    usage = Usage.ANALYSE_ONLY if args.mode == "analyze" else Usage.GENERATE_ONLY
    engine = Repository(spark, args.path).load(args.lexicon, usage, config(args))
    engine.with_options(aggl=args.aggl, praet=args.praet)
    made = lined(engine, lines_of(spark, args.inputs), args.mode)
    made.orderBy("src_ord").select("block").write.mode("overwrite").text(args.out)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
