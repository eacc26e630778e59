"""Requests as lines of JSON; a line that is not JSON is a text to analyse."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.config import CaseHandling, Config, TokenNumbering, WhitespaceHandling, parse_option
from lexigraph.engine import Engine, Repository
from lexigraph.errors import LexigraphError
from lexigraph.operators.analyze import analyze
from lexigraph.operators.generate import generate
from lexigraph.operators.lexicon import Lexicon
from lexigraph.streaming.session import SessionStream
from lexigraph.operators.present import named, responses

REQUEST = "mode string, text string, lemma string, tag_id int"
#: Modes that ask about the engine; the options they may carry are applied by ``Service``.
CONTROL = ("metadata", "set_dictionary")
OPTIONS = {"case_handling": CaseHandling, "token_numbering": TokenNumbering, "whitespace": WhitespaceHandling}


def requests(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(id columns, mode, text, lemma, tag_id) of the lines that are not blank."""
    rest = [c for c in lines.columns if c != value_col]
    raw = F.col(value_col)
    read = lines.where(F.trim(raw) != "").select(*rest, raw.alias("raw"), F.from_json(raw, REQUEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    json = F.trim("raw").startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    mode = F.when(json, F.coalesce(F.lower("r.mode"), F.when(F.col("r.lemma").isNotNull(), F.lit("generate")).otherwise(F.lit("analyze")))).otherwise(F.lit("analyze"))
    return read.select(
        *rest,
        F.when(mode == "analyse", F.lit("analyze")).otherwise(mode).alias("mode"),
        F.when(json, F.col("r.text")).otherwise(F.col("raw")).alias("text"),
        F.when(json, F.col("r.lemma")).alias("lemma"),
        F.when(json, F.col("r.tag_id")).alias("tag_id"),
    )


def serve(lines: DataFrame, analyzer: Lexicon, generator: Lexicon, config: Config = Config(), id_col: str = "id", value_col: str = "value") -> DataFrame:
    """(id, response) for every request; what cannot be answered has ``ok`` false and an error."""
    asked = requests(lines, value_col)
    texts = asked.where("mode = 'analyze' and text is not null")
    lemmas = asked.where("mode = 'generate' and coalesce(lemma, text) is not null").withColumn("lemma", F.coalesce("lemma", "text"))
    rows = named(analyze(texts, analyzer, config, id_col), analyzer, "_")
    done = responses(rows, texts, id_col)
    forms = named(generate(lemmas, generator, config, id_col), generator, "_")
    blank = forms.where("error is not null")
    made = responses(forms.where("error is null"), lemmas.join(blank, id_col, "left_anti"), id_col)

    def failed(df: DataFrame, error) -> DataFrame:
        answer = F.struct(F.lit(False).alias("ok"), F.array().cast("array<string>").alias("results"), error.alias("error"))
        return df.select(id_col, F.to_json(answer, {"ignoreNullFields": "false"}).alias("response"))

    lost = asked.join(texts.select(id_col).unionAll(lemmas.select(id_col)), id_col, "left_anti")
    return done.unionAll(made).unionAll(failed(blank, F.col("error"))).unionAll(failed(lost, F.concat(F.lit("cannot answer mode "), F.col("mode"))))


class Service:
    """Control messages on the driver: they change what later batches of requests are answered with.

    ``metadata`` and ``set_dictionary`` are single JSON objects, not data: a client sends them between
    batches.  Options they name stay in force; a change of lexicon or options starts node numbers anew.
    """

    def __init__(self, engine: Engine, repository: Repository | None = None):
        self.engine, self.repository = engine, repository

    def control(self, request: str) -> str:
        """The response to one control message."""
        answer: dict[str, object] = {"ok": True, "results": [], "error": None}
        try:
            asked = json.loads(request)
            mode = asked.get("mode")
            if mode not in CONTROL:
                raise LexigraphError(f"not a control message: {mode}")
            engine = self.engine
            if mode == "set_dictionary":
                if self.repository is None:
                    raise LexigraphError("no repository to open a lexicon from")
                if "dict" in asked:
                    engine = self.repository.load(asked["dict"], engine.usage, engine.config)
                elif "dictionary" in asked:
                    engine = self.repository.load_path(asked["dictionary"], engine.usage, engine.config)
                else:
                    raise LexigraphError("set_dictionary needs dict or dictionary")
            options = {k: parse_option(kind, asked[k]) for k, kind in OPTIONS.items() if asked.get(k) is not None}
            options |= {k: asked[k] for k in ("aggl", "praet") if asked.get(k) is not None}
            self.engine = engine.with_options(**options) if options else engine
            if mode == "metadata":
                answer["metadata"] = self.engine.metadata()
        except (LexigraphError, ValueError) as failed:
            answer |= {"ok": False, "error": str(failed)}
        return json.dumps(answer)

    def answer(self, lines: DataFrame, id_col: str = "id", value_col: str = "value") -> DataFrame:
        """(id, response) of a batch of requests under the options now in force."""
        return serve(lines, self.engine.analyzer, self.engine.generator, self.engine.config, id_col, value_col)

    def session(self, out: str) -> SessionStream:
        """A stream under the options now in force; its node numbers begin at 0."""
        return SessionStream(self.engine.analyzer.groups.sparkSession, self.engine.analyzer, out, self.engine.config)
