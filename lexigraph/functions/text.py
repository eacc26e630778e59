"""String expressions; all are built-in functions and run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the engine: 33 code points, neither Java's nor Unicode's set.
WHITESPACE = "".join(map(chr, [0, *range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000]))


def char_class(chars: str) -> str:
    """The inside of a regular expression's class of these characters, for Java; neighbours are one range."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, set(chars))):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


_WS = char_class(WHITESPACE)


def has_whitespace(text: Column) -> Column:
    return text.rlike(f"[{_WS}]")


def runs(text: Column) -> Column:
    """Alternating maximal runs of white space and of other characters."""
    return F.regexp_extract_all(text, F.lit(f"[{_WS}]+|[^{_WS}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs without white space; without a regular expression, which would take several times as long."""
    return F.filter(F.split(F.translate(text, WHITESPACE, " " * len(WHITESPACE)), " "), lambda w: w != "")


def parts(word: Column, separators: str) -> Column:
    """Maximal runs of other characters, and every separator by itself."""
    if not separators:
        return F.array(word)
    c = char_class(separators)
    return F.regexp_extract_all(word, F.lit(f"[^{c}]+|[{c}]"), F.lit(0))


def _pairs() -> tuple[str, str]:
    upper, lower = [], []
    for cp in range(0x110000):
        c = chr(cp)
        low = "i" if cp == 0x130 else c.lower()
        if low != c and len(low) == 1 and not 0xD800 <= cp < 0xE000:
            upper.append(c)
            lower.append(low)
    return "".join(upper), "".join(lower)


UPPER, LOWER = _pairs()
_LOWER_OF = dict(zip(UPPER, LOWER))


def lower1(text: Column) -> Column:
    """Lower case, one code point for one: lengths and places stay. ASCII takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lower1_py(text: str) -> str:
    return "".join(_LOWER_OF.get(c, c) for c in text)


def canonical_labels(text: Column) -> Column:
    """Labels trimmed, sorted and without repeats; ``_`` for none."""
    each = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("_")).otherwise(F.array_join(each, "|"))


def label_set(text: Column) -> Column:
    """Labels as a sorted array of distinct strings; empty for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(text, r"\|"))))


def name_list(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).isin("", "_"), F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def is_roman(text: Column) -> Column:
    """Roman numerals up to 3999, in any case."""
    return (text != "") & F.upper(text).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def title_first(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def tag_pattern(pattern: str) -> re.Pattern[str]:
    """``%`` is any run, ``.`` any one character; ``x:%`` also fits ``x``."""

    def body(p: str) -> str:
        return "".join(".*" if c == "%" else "." if c == "." else re.escape(c) for c in p)

    both = body(pattern)
    if pattern.endswith(":%"):
        both = f"(?:{both}|{body(pattern[:-2])})"
    return re.compile(f"^{both}$", re.S)


GENDERS = ("m1", "m2", "m3", "f", "n")


def expand_tag(tag: Column, expand_dot: bool = True, expand_underscore: bool = True) -> Column:
    """All tags that a tag with alternatives stands for, the first part varying slowest."""
    shown = F.lit(".".join(GENDERS))
    chunks = F.split(tag, ":")
    if expand_underscore:
        chunks = F.transform(chunks, lambda c: F.when(c == "_", shown).otherwise(c))
    if not expand_dot:
        return F.array(F.array_join(chunks, ":"))
    choices = F.transform(chunks, lambda c: F.split(c, r"\."))
    return F.aggregate(
        F.slice(choices, 2, F.greatest(F.size(choices), F.lit(1))),
        F.get(choices, F.lit(0)),
        lambda acc, options: F.flatten(F.transform(acc, lambda a: F.transform(options, lambda o: F.concat(a, F.lit(":"), o)))),
    )
