"""Tagset files: a line with the id, then ``[TAGS]`` and lines of number and tag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexigraph.errors import InvalidDictionary


@dataclass(frozen=True)
class Tagset:
    name: str
    tags: dict[str, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(number, tag, place) for place, (tag, number) in enumerate(self.tags.items())]
        return spark.createDataFrame(rows, "tag_id int, tag string, file_ord int")


def parse_tagset(text: str, strict: bool = True) -> Tagset:
    """Read a tagset; the lenient way skips unknown sections and lets later lines win."""
    lines = text.split("\n")
    name, section, tags = "", "", {}
    if strict and not lines[0].startswith("#!TAGSET-ID "):
        raise InvalidDictionary("the first line must name the tagset")
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if line.startswith("#!TAGSET-ID"):
            name = line.split(None, 1)[1].strip() if " " in line else ""
        elif line.startswith("[") and line.endswith("]"):
            section = line
            if strict and section != "[TAGS]":
                raise InvalidDictionary(f"line {number}: unknown section {section}")
        elif line and not line.startswith("#"):
            if section != "[TAGS]":
                if strict:
                    raise InvalidDictionary(f"line {number}: text outside [TAGS]")
                continue
            fields = line.split("\t") if strict else line.split()
            if len(fields) != 2 or not fields[0].isdigit():
                raise InvalidDictionary(f"line {number}: expected a number and a tag")
            tag, tag_id = fields[1], int(fields[0])
            if strict and tag in tags:
                raise InvalidDictionary(f"line {number}: tag {tag} is there twice")
            if strict and tag_id in tags.values():
                raise InvalidDictionary(f"line {number}: number {tag_id} is there twice")
            tags[tag] = tag_id
    return Tagset(name, tags)
