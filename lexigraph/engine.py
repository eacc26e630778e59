"""Opening saved lexicons by name or path, guarded use of them, and a reader of results.

A saved lexicon is a folder of tables.  ``Repository`` looks for
``<name>-analyzer`` and ``<name>-generator`` in its search paths, first hit first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession

from lexigraph.config import Config, Usage
from lexigraph.errors import LexigraphError, NotFound, Unsupported
from lexigraph.operators import lexicon as lx
from lexigraph.operators.analyze import analyze
from lexigraph.operators.generate import generate
from lexigraph.operators.present import named

_SUFFIX = {"analyzer": "-analyzer", "generator": "-generator"}


class OutOfRange(LexigraphError):
    """Results that were asked for beyond their end."""


class Results(Iterator[Row]):
    """Rows one after another, with a look at the next one; partitions are fetched as they are needed."""

    def __init__(self, rows: DataFrame | Iterable[Row]):
        self._rows = iter(rows.toLocalIterator()) if isinstance(rows, DataFrame) else iter(rows)
        self._held: list[Row] = []

    def has_next(self) -> bool:
        if not self._held:
            self._held = [row for _, row in zip(range(1), self._rows)]
        return bool(self._held)

    def peek(self) -> Row:
        if not self.has_next():
            raise OutOfRange("there is no further result")
        return self._held[0]

    def next(self) -> Row:
        row = self.peek()
        self._held = []
        return row

    def __next__(self) -> Row:
        if not self.has_next():
            raise StopIteration
        return self.next()


@dataclass
class Engine:
    """An analyzer, a generator or both, with the options of their use."""

    analyzer: lx.Lexicon | None = None
    generator: lx.Lexicon | None = None
    config: Config = field(default_factory=Config)

    @property
    def usage(self) -> Usage:
        if self.analyzer is None:
            return Usage.GENERATE_ONLY
        return Usage.ANALYSE_ONLY if self.generator is None else Usage.BOTH

    def _any(self) -> lx.Lexicon:
        found = self.analyzer or self.generator
        if found is None:
            raise Unsupported("no lexicon is open")
        return found

    def with_options(self, **options) -> "Engine":
        """The same lexicons under changed options; segmentation options must be ones of the rules."""
        changed = replace(self.config, **options)
        if "aggl" in options or "praet" in options:
            self._any().rules.variant(changed.aggl, changed.praet)
        return replace(self, config=changed)

    def analyze(self, texts: DataFrame, **more) -> DataFrame:
        if self.analyzer is None:
            raise Unsupported("Cannot analyse: only a generator is open.")
        return named(analyze(texts, self.analyzer, self.config, **more), self.analyzer)

    def generate(self, lemmas: DataFrame, **more) -> DataFrame:
        if self.generator is None:
            raise Unsupported("Cannot generate: only an analyzer is open.")
        return named(generate(lemmas, self.generator, self.config, **more), self.generator)

    def counts(self) -> dict[str, int]:
        """Numbers of tags, names and label sets."""
        own = self._any()
        return {"tags": own.tags.count(), "names": own.names.count(), "labels": own.labels.count()}

    def metadata(self) -> dict[str, object]:
        """What a client can ask about the open lexicon and the options in force."""
        own, c = self._any(), self.config
        options = own.rules.variant(c.aggl, c.praet).options
        return {
            "dict_id": own.dict_id, "dict_copyright": own.copyright,
            "aggl": options.get("aggl", ""), "praet": options.get("praet", ""),
            "available_aggl_options": own.rules.option_values("aggl"), "available_praet_options": own.rules.option_values("praet"),
            "case_handling": c.case_handling.name.lower(), "case_handling_id": int(c.case_handling),
            "token_numbering": c.token_numbering.name.lower(), "token_numbering_id": int(c.token_numbering),
            "whitespace": c.whitespace.name.lower(), "whitespace_id": int(c.whitespace),
        }


class Repository:
    """Saved lexicons in folders that are searched in their order; an empty list finds nothing."""

    def __init__(self, spark: SparkSession, search_paths: list[str] | None = None):
        self.spark = spark
        self.search_paths = ["."] if search_paths is None else [p.rstrip("/") for p in search_paths]

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def find(self, name: str) -> dict[str, str | None]:
        """Path of the analyzer and of the generator; each is the first hit of its own."""
        return {kind: next((p for p in (f"{d}/{name}{suffix}" for d in self.search_paths) if self._exists(p)), None) for kind, suffix in _SUFFIX.items()}

    def load(self, name: str, usage: Usage = Usage.BOTH, config: Config = Config()) -> Engine:
        paths = self.find(name)
        wanted = [k for k in _SUFFIX if usage == Usage.BOTH or usage == (Usage.ANALYSE_ONLY if k == "analyzer" else Usage.GENERATE_ONLY)]
        for kind in wanted:
            if paths[kind] is None:
                raise NotFound(f'there is no {kind} lexicon "{name}"')
        return Engine(**{k: lx.load(self.spark, paths[k]) for k in wanted}, config=config)

    def load_path(self, path: str, usage: Usage = Usage.BOTH, config: Config = Config()) -> Engine:
        """One folder; where both uses are asked for, its name tells which it is."""
        path = path.rstrip("/")
        if not self._exists(path):
            raise NotFound(f'there is no lexicon in "{path}"')
        generator = usage == Usage.GENERATE_ONLY or (usage == Usage.BOTH and path.endswith(_SUFFIX["generator"]))
        return Engine(**{"generator" if generator else "analyzer": lx.load(self.spark, path)}, config=config)

    def save(self, engine: Engine, directory: str, name: str, buckets: int | None = None) -> None:
        for kind, suffix in _SUFFIX.items():
            own = getattr(engine, kind)
            if own is not None:
                lx.save(own, f"{directory.rstrip('/')}/{name}{suffix}", buckets)
