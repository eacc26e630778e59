"""Dictionary sources: tab-separated lines of form, lemma, tag, name and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.errors import InvalidDictionary

_BEGIN, _END = "#<COPYRIGHT>", "#</COPYRIGHT>"
#: Copyright blocks of all sources together.
MAX_BLOCKS = 10_000


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(src_ord, line) of text files, in order of the list and of the lines."""
    if not paths:
        raise InvalidDictionary("a dictionary needs at least one source")
    each = [
        spark.read.text(p).select((F.lit(i).cast("bigint") * F.lit(1 << 52) + F.monotonically_increasing_id()).alias("src_ord"), F.col("value").alias("line"))
        for i, p in enumerate(paths)
    ]
    out = each[0]
    for more in each[1:]:
        out = out.unionAll(more)
    return out


def metadata(lines: list[str]) -> dict[str, str]:
    """DICT-ID and COPYRIGHT of the header lines, the first of each."""
    found: dict[str, str] = {}
    block: list[str] | None = None
    for line in lines:
        line = line.strip()
        if line.startswith("#!DICT-ID"):
            words = line.split()
            if len(words) != 2:
                raise InvalidDictionary("DICT-ID takes one word")
            found.setdefault("dict_id", words[1])
        elif line == _BEGIN:
            if block is not None:
                raise InvalidDictionary("a copyright block begins inside another")
            block = []
        elif line == _END:
            if block is None:
                raise InvalidDictionary("a copyright block ends before it begins")
            found.setdefault("copyright", "\n".join(block))
            block = None
        elif block is not None:
            block.append(line)
    if block is not None:
        raise InvalidDictionary("a copyright block is not closed")
    return found


def _blocks(trimmed: DataFrame) -> list[tuple[int, int]]:
    """(first, last) src_ord of every copyright block."""
    marks = trimmed.where(F.col("line").isin(_BEGIN, _END)).orderBy("src_ord").limit(MAX_BLOCKS * 2 + 1).collect()
    if len(marks) > MAX_BLOCKS * 2:
        raise InvalidDictionary("too many copyright blocks")
    found, begin = [], None
    for row in marks:
        if (row["line"] == _BEGIN) == (begin is not None):
            raise InvalidDictionary("a copyright block begins inside another" if begin is not None else "a copyright block ends before it begins")
        if begin is not None:
            found.append((begin, row["src_ord"]))
        begin = row["src_ord"] if begin is None else None
    if begin is not None:
        raise InvalidDictionary("a copyright block is not closed")
    return found


def entries(lines: DataFrame) -> DataFrame:
    """(src_ord, orth, base, tag, name, qualifier) of the lines that are entries.

    A line is trimmed, then split.  Lines of a copyright block, empty lines and
    lines with a blank in form or lemma are left out; any other arity than three
    to five fields is an error when the rows are read.
    """
    trimmed = lines.select("src_ord", F.trim("line", F.lit(" \t\r\n")).alias("line"))
    blocks = _blocks(trimmed)
    spans = trimmed.sparkSession.createDataFrame(blocks, "a bigint, b bigint")
    outside = trimmed.join(F.broadcast(spans), (F.col("src_ord") >= F.col("a")) & (F.col("src_ord") <= F.col("b")), "left_anti") if blocks else trimmed
    f = F.split("line", "\t")
    fields = outside.where("line <> ''").select("src_ord", "line", f.alias("f"))
    kept = fields.where(~F.contains(F.concat(F.get("f", F.lit(0)), F.coalesce(F.get("f", F.lit(1)), F.lit(""))), F.lit(" ")))
    n = F.size("f")
    orth = F.when((n >= 3) & (n <= 5), F.get("f", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("a dictionary line has 3 to 5 fields: "), F.col("line"))))
    return kept.select(
        "src_ord",
        orth.alias("orth"),
        F.get("f", F.lit(1)).alias("base"),
        F.get("f", F.lit(2)).alias("tag"),
        F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("name"),
        F.coalesce(F.get("f", F.lit(4)), F.lit("")).alias("qualifier"),
    )
