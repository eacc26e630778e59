"""Options of an analysis; values are those of the public interface."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from lexigraph.errors import InvalidArgument


class Charset(IntEnum):
    UTF8 = 11
    ISO8859_2 = 12
    CP1250 = 13
    CP852 = 14


class CaseHandling(IntEnum):
    CONDITIONALLY_CASE_SENSITIVE = 100
    STRICTLY_CASE_SENSITIVE = 101
    IGNORE_CASE = 102


class TokenNumbering(IntEnum):
    SEPARATE = 201
    CONTINUOUS = 202


class WhitespaceHandling(IntEnum):
    SKIP = 301
    APPEND = 302
    KEEP = 303


class Usage(IntEnum):
    ANALYSE_ONLY = 401
    GENERATE_ONLY = 402
    BOTH = 403


_ALIASES = {
    CaseHandling: {"weak": 100, "conditional": 100, "conditionally_case_sensitive": 100, "strict": 101, "strictly_case_sensitive": 101, "ignore": 102, "ignore_case": 102},
    TokenNumbering: {"separate": 201, "separate_numbering": 201, "continuous": 202, "continuous_numbering": 202},
    WhitespaceHandling: {"skip": 301, "skip_whitespaces": 301, "append": 302, "append_whitespaces": 302, "keep": 303, "keep_whitespaces": 303},
}
AGGL = ("strict", "permissive", "isolated")
PRAET = ("split", "composite")


def parse_option(kind: type[IntEnum], value: str | int) -> IntEnum:
    """An option from its number, or from a name in any case with blanks or hyphens for underscores."""
    if isinstance(value, str):
        word = value.strip().lower().replace("-", "_").replace(" ", "_")
        value = _ALIASES.get(kind, {}).get(word, int(word) if word.isdigit() else -1)
    try:
        return kind(value)
    except ValueError as bad:
        raise InvalidArgument(f"{kind.__name__} has no such value") from bad


@dataclass(frozen=True)
class Config:
    """How texts are analysed. ``aggl`` and ``praet`` unset mean the rules' first variant."""

    case_handling: CaseHandling = CaseHandling.CONDITIONALLY_CASE_SENSITIVE
    token_numbering: TokenNumbering = TokenNumbering.SEPARATE
    whitespace: WhitespaceHandling = WhitespaceHandling.SKIP
    aggl: str | None = None
    praet: str | None = None
    charset: Charset = Charset.UTF8

    def __post_init__(self) -> None:
        if self.aggl is not None and self.aggl not in AGGL:
            raise InvalidArgument(f'Invalid "aggl" option: "{self.aggl}". Possible values: {", ".join(sorted(AGGL))}')
        if self.praet is not None and self.praet not in PRAET:
            raise InvalidArgument(f'Invalid "praet" option: "{self.praet}". Possible values: {", ".join(sorted(PRAET))}')
