"""Segmentation rules: files of a few lines, compiled on the driver to small tables.

A rule is a regular expression over segment types.  ``a>`` glues a segment to
the next one.  Every combination of the options is a variant with an automaton
of its own; its transitions are rows that queries join.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lexigraph.errors import InvalidArgument, InvalidDictionary

_SECTIONS = ("options", "combinations", "tags", "lexemes", "segment types", "separator chars")
_TOKEN = re.compile(r"\s*(\{\s*\d+\s*(?:,\s*\d*\s*)?\}|[A-Za-z0-9_]+|[()|*+?>])")


@dataclass(frozen=True)
class Rule:
    """A node of a rule: ``tag``, ``cat``, ``or``, ``star``, ``opt`` or ``sink``."""

    kind: str
    children: tuple["Rule", ...] = ()
    name: str = ""
    shift: bool = False
    weak: bool = False
    auto: bool = False
    line: int = 0

    def is_shift(self) -> bool:
        if self.kind == "tag":
            return self.shift
        return self.kind != "sink" and all(c.is_shift() for c in self.children)

    def empty(self) -> bool:
        if self.kind in ("star", "opt"):
            return True
        if self.kind == "or":
            return any(c.empty() for c in self.children)
        return self.kind == "cat" and all(c.empty() for c in self.children)

    def glued(self) -> "Rule":
        """The rule with every segment glued to the next."""
        return replace(self, shift=True) if self.kind == "tag" else replace(self, children=tuple(c.glued() for c in self.children))

    def atoms(self) -> set[tuple[str, bool]]:
        if self.kind == "tag":
            return {(self.name, self.shift)}
        return set().union(*(c.atoms() for c in self.children)) if self.children else set()

    def check(self) -> None:
        for c in self.children:
            c.check()
        if self.kind == "cat" and self.children[-1].is_shift() and not self.is_shift():
            raise InvalidDictionary(f"line {self.line}: a sequence that ends glued must be glued throughout")
        if self.kind == "or" and len({c.is_shift() for c in self.children}) > 1:
            raise InvalidDictionary(f"line {self.line}: alternatives must all be glued or none")

    def for_generator(self) -> "Rule":
        """The part of the rule that yields one inflected segment, maybe after glued ones."""
        sink = Rule("sink", line=self.line)
        if self.kind in ("tag", "sink"):
            return self
        if self.kind == "star":
            return self if self.is_shift() else sink
        if self.kind == "opt":
            return self if self.is_shift() else self.children[0].for_generator()
        kept = [c.for_generator() for c in self.children if not c.empty() or c.is_shift()]
        if self.kind == "or":
            kept = [c for c in kept if c.kind != "sink"]
            return replace(self, children=tuple(kept)) if kept else sink
        full = False
        for c in kept:
            if c.kind == "sink" or full:
                return sink
            full = full or not c.is_shift()
        return replace(self, children=tuple(kept)) if kept else sink

    def atomic(self) -> list["Rule"]:
        """Every segment by itself, behind the glued ones that precede it."""
        if self.kind == "tag":
            return [replace(self, auto=True)]
        if self.kind != "cat":
            return [r for c in self.children for r in c.atomic()]
        out: list[Rule] = []
        glued: list[Rule] = []
        for c in self.children:
            if c.is_shift():
                glued.append(c)
            else:
                for r in c.atomic():
                    out.append(replace(Rule("cat", (*glued, r), line=c.line) if glued else r, auto=True))
                glued = []
        return out


def _parse_rule(text: str, line: int, types: dict[str, int]) -> Rule:
    weak = False
    if text.rstrip().lower().endswith("!weak"):
        text, weak = text.rstrip()[:-5], True
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidDictionary(f"line {line}: cannot read {text[at:].strip()!r}")
        tokens.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def several(r: Rule, n: int) -> Rule:
        return r if n == 1 else Rule("cat", (r,) * n, line=line)

    def unit() -> Rule:
        t = take() if peek() else ""
        if t == "(":
            r = sequence()
            if not peek() or take() != ")":
                raise InvalidDictionary(f"line {line}: a parenthesis is not closed")
        elif t and (t[0].isalnum() or t[0] == "_"):
            if t not in types:
                raise InvalidDictionary(f"line {line}: unknown segment type {t}")
            r = Rule("tag", name=t, line=line)
        else:
            raise InvalidDictionary(f"line {line}: a segment type or group is missing")
        if peek() == ">":
            take()
            r = r.glued()
        q = peek()
        if q in ("*", "+", "?"):
            take()
            if q == "?":
                return Rule("opt", (r,), line=line)
            star = Rule("star", (r,), line=line)
            return star if q == "*" else Rule("cat", (r, star), line=line)
        if q.startswith("{"):
            take()
            low, comma, high = q[1:-1].replace(" ", "").partition(",")
            n = int(low)
            if not comma or not high:
                if n < 1:
                    raise InvalidDictionary(f"line {line}: a count must be positive")
                return several(r, n) if not comma else Rule("cat", (*([r] * n), Rule("star", (r,), line=line)), line=line)
            m = int(high)
            if m < max(n, 1):
                raise InvalidDictionary(f"line {line}: the upper count is below the lower")
            options = [several(r, k) for k in range(max(n, 1), m + 1)]
            if n == 0:
                options[0] = Rule("opt", (options[0],), line=line)
            return options[0] if len(options) == 1 else Rule("or", tuple(options), line=line)
        return r

    def choice() -> Rule:
        options = [unit()]
        while peek() == "|":
            take()
            options.append(unit())
        return options[0] if len(options) == 1 else Rule("or", tuple(options), line=line)

    def sequence() -> Rule:
        items = [choice()]
        while peek() and peek() != ")":
            items.append(choice())
        return items[0] if len(items) == 1 else Rule("cat", tuple(items), line=line)

    rule = sequence()
    if place < len(tokens):
        raise InvalidDictionary(f"line {line}: text after the end of the rule")
    return replace(rule, weak=weak)


def _macros(lines: list[tuple[int, str]], defined: set[str]) -> list[tuple[int, str]]:
    """Rule lines of the active branches with their macros expanded."""
    values: dict[str, tuple[str | None, str]] = {}
    stack: list[bool] = []
    out = []
    for number, line in lines:
        m = re.match(r"#define\s+([A-Za-z0-9_]+)(?:\(\s*([A-Za-z0-9_]+)\s*\))?\s*(.*)$", line)
        if m:
            values[m[1]] = (m[2], m[3])
        elif m := re.match(r"#ifdef\s+([A-Za-z0-9_]+)\s*$", line):
            stack.append(m[1] in defined)
        elif line.startswith("#else"):
            if not stack:
                raise InvalidDictionary(f"line {number}: #else without #ifdef")
            stack[-1] = not stack[-1]
        elif line.startswith("#endif"):
            if not stack:
                raise InvalidDictionary(f"line {number}: #endif without #ifdef")
            stack.pop()
        elif not line.startswith("#") and all(stack):
            out.append((number, _expand(line, number, values)))
    return out


def _expand(line: str, number: int, values: dict[str, tuple[str | None, str]]) -> str:
    for _ in range(128):
        before = line
        at = 0
        built = []
        for m in re.finditer(r"[A-Za-z0-9_]+", line):
            if m.start() < at or m[0] not in values:
                continue
            argument, value = values[m[0]]
            end = m.end()
            if argument is not None:
                open_ = re.match(r"\s*\(", line[end:])
                if not open_:
                    continue
                depth, k = 1, end + open_.end()
                start = k
                while k < len(line) and depth:
                    depth += {"(": 1, ")": -1}.get(line[k], 0)
                    k += 1
                if depth:
                    raise InvalidDictionary(f"line {number}: a macro call is not closed")
                value = re.sub(rf"\b{re.escape(argument)}\b", lambda _, a=line[start : k - 1]: a, value)
                end = k
            built += [line[at : m.start()], value]
            at = end
        line = "".join(built) + line[at:]
        if line == before:
            return line
    raise InvalidDictionary(f"line {number}: macros refer to each other without end")


@dataclass(frozen=True)
class Pattern:
    section: str
    seg_type: int
    lemma: str | None
    homonym: str | None
    tag: str
    name: str | None
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Variant:
    options: dict[str, str]
    rows: list[tuple[int, int, bool, int, bool, bool, bool]]

    @property
    def longest(self) -> int | None:
        """Most segments of a word, or None where the automaton has a cycle."""
        following: dict[int, set[int]] = {}
        for state, _, _, nxt, *_ in self.rows:
            following.setdefault(state, set()).add(nxt)
        known: dict[int, int] = {}
        open_: set[int] = set()

        def depth(s: int) -> int | None:
            if s in open_:
                return None
            if s not in known:
                open_.add(s)
                best = 0
                for n in following.get(s, ()):
                    d = depth(n)
                    if d is None:
                        return None
                    best = max(best, d + 1)
                open_.discard(s)
                known[s] = best
            return known[s]

        return depth(0)


@dataclass
class RuleSet:
    """Compiled rules for one use (analysis or generation)."""

    segment_types: list[str]
    separators: str
    patterns: list[Pattern]
    variants: list[Variant]
    lemma_is_orth: set[int] = field(default_factory=set)
    extra_type: dict[int, int] = field(default_factory=dict)

    def variant(self, aggl: str | None = None, praet: str | None = None) -> Variant:
        wanted = dict(self.variants[0].options)
        for key, value in (("aggl", aggl), ("praet", praet)):
            if value is not None:
                wanted[key] = value
        for v in self.variants:
            if v.options == wanted:
                return v
        raise InvalidArgument(f"the rules have no variant {wanted}")

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"lemma_is_orth": sorted(self.lemma_is_orth), "extra_type": sorted(self.extra_type.items())})

    @staticmethod
    def from_json(text: str) -> "RuleSet":
        read = json.loads(text)
        patterns = [Pattern(**p | {"labels": tuple(p["labels"])}) for p in read["patterns"]]
        variants = [Variant(v["options"], [tuple(r) for r in v["rows"]]) for v in read["variants"]]
        return RuleSet(read["segment_types"], read["separators"], patterns, variants, set(read["lemma_is_orth"]), {k: v for k, v in read["extra_type"]})

    def option_values(self, key: str) -> list[str]:
        return sorted({v.options[key] for v in self.variants if key in v.options})

    def transitions(self, spark: SparkSession, variant: Variant) -> DataFrame:
        schema = "state int, seg_type int, shift boolean, next_state int, accepting boolean, weak boolean, sink boolean"
        return spark.createDataFrame(variant.rows, schema)


def _sections(text: str) -> dict[str, list[tuple[int, str]]]:
    found: dict[str, list[tuple[int, str]]] = {}
    current = None
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        m = re.match(r"^\[([a-z ]+)\]$", line)
        if m:
            current = m[1]
            if current not in _SECTIONS:
                raise InvalidDictionary(f"line {number}: unknown section {current}")
            if current in found:
                raise InvalidDictionary(f"line {number}: section {current} is there twice")
            found[current] = []
        elif line:
            if current is None:
                if not line.startswith("#"):
                    raise InvalidDictionary(f"line {number}: text outside a section")
                continue
            found[current].append((number, line))
    for name in _SECTIONS:
        if name != "separator chars" and name not in found:
            raise InvalidDictionary(f"section {name} is missing")
    return found


def _plain(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [(n, x) for n, x in lines if not x.startswith("#")]


def _pattern(number: int, line: str, section: str, types: dict[str, int]) -> Pattern:
    fields = line.split("\t") if "\t" in line else line.split()
    fields = [f.strip() for f in fields if f.strip()]
    least = 3 if section == "lexemes" else 2
    if not least <= len(fields) <= least + 2:
        raise InvalidDictionary(f"line {number}: a pattern has {least} to {least + 2} fields")
    name, labels = None, ()
    for extra in fields[least:]:
        key, eq, value = extra.partition("=")
        if not eq or key not in ("name", "labels"):
            raise InvalidDictionary(f"line {number}: unknown constraint {extra}")
        if key == "name":
            name = value
        else:
            labels = tuple(sorted(set(value.split("|"))))
    if fields[0] not in types:
        raise InvalidDictionary(f"line {number}: unknown segment type {fields[0]}")
    lemma = homonym = None
    if section == "lexemes":
        lemma, homonym = fields[1], None
        if ":" in lemma and lemma.strip(":"):
            lemma, _, homonym = lemma.partition(":")
    tag = fields[least - 1]
    if not (tag[0].islower() or tag[0] in "_.:%"):
        raise InvalidDictionary(f"line {number}: a tag pattern cannot start with {tag[0]}")
    return Pattern(section, types[fields[0]], lemma, homonym, tag, name, labels)


def _automaton(rules: list[Rule], types: dict[str, int]) -> list[tuple[int, int, bool, int, bool, bool, bool]]:
    """Rows (state, seg_type, shift, next_state, accepting, weak, sink) of the deterministic automaton."""
    edges: list[list[tuple[tuple[int, bool] | None, int]]] = []
    finals: dict[int, Rule] = {}

    def node() -> int:
        edges.append([])
        return len(edges) - 1

    def build(r: Rule, a: int) -> int:
        if r.kind == "tag":
            b = node()
            edges[a].append(((types[r.name], r.shift), b))
            return b
        if r.kind == "cat":
            for c in r.children:
                a = build(c, a)
            return a
        b = node()
        if r.kind == "or":
            for c in r.children:
                s = node()
                edges[a].append((None, s))
                edges[build(c, s)].append((None, b))
        elif r.kind in ("star", "opt"):
            s = node()
            edges[a].append((None, s))
            e = build(r.children[0], s)
            edges[e].append((None, b))
            edges[a].append((None, b))
            if r.kind == "star":
                edges[e].append((None, s))
        return b

    start = node()
    for r in rules:
        if r.kind != "sink":
            s = node()
            edges[start].append((None, s))
            finals[build(r, s)] = r

    def closed(nodes: frozenset[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for label, b in edges[todo.pop()]:
                if label is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    first = closed(frozenset([start]))
    numbers, order, moves = {first: 0}, [first], []
    for state in order:
        targets: dict[tuple[int, bool], set[int]] = {}
        for n in state:
            for label, b in edges[n]:
                if label is not None:
                    targets.setdefault(label, set()).add(b)
        for label in sorted(targets):
            nxt = closed(frozenset(targets[label]))
            if nxt not in numbers:
                numbers[nxt] = len(order)
                order.append(nxt)
            moves.append((numbers[state], label, numbers[nxt]))
    leaving = {a for a, _, _ in moves}
    accepting, weak = {}, {}
    for state, number in numbers.items():
        ends = [finals[n] for n in state if n in finals]
        accepting[number] = bool(ends)
        firm = {r.weak for r in ends if not r.auto}
        if len(firm) > 1:
            raise InvalidDictionary("a sequence of segments is accepted by a weak and by another rule")
        weak[number] = firm.pop() if firm else any(r.weak for r in ends)
    return [(a, t, s, b, accepting[b], weak[b], b not in leaving) for a, (t, s), b in moves]


def compile_rules(text: str, generator: bool = False) -> RuleSet:
    """Compile a rule file for analysis, or for generation."""
    sections = _sections(text)
    options = []
    for number, line in _plain(sections["options"]):
        key, eq, values = line.partition("=")
        if not eq:
            raise InvalidDictionary(f"line {number}: an option needs values")
        options.append((key.strip(), values.split()))
    names = [x for _, x in _plain(sections["segment types"])]
    if len(set(names)) != len(names) or not all(re.fullmatch(r"\w+", n, re.A) for n in names):
        raise InvalidDictionary("segment types must be distinct words")
    types = {n: i for i, n in enumerate(names)}
    patterns = [_pattern(n, x, "lexemes", types) for n, x in _plain(sections["lexemes"])]
    of_tags = [_pattern(n, x, "tags", types) for n, x in _plain(sections["tags"])]
    everything = [p.tag == "%" and p.name is None and not p.labels for p in of_tags]
    if not everything or not everything[-1] or any(everything[:-1]):
        raise InvalidDictionary("the last line of [tags], and no other, must match everything")
    separators = "".join(sorted({chr(int(x)) for _, x in _plain(sections.get("separator chars", []))})) if not generator else ""
    parsed = []
    for combination in itertools.product(*(v for _, v in options)):
        rules = []
        for number, line in _macros(sections["combinations"], set(combination)):
            rule = _parse_rule(line, number, types)
            rule.check()
            if generator:
                rules += [replace(r, weak=rule.weak) for r in rule.atomic()]
                rule = rule.for_generator()
            if rule.kind != "sink" and rule.empty():
                raise InvalidDictionary(f"line {number}: a rule must not accept an empty sequence")
            rules.append(rule)
        parsed.append(({k: v for (k, _), v in zip(options, combination)}, rules))
    atoms = set().union(*(r.atoms() for _, rules in parsed for r in rules))
    lemma_is_orth, extra, labels = set(), {}, {}
    for name, number in types.items():
        glued, free = (name, True) in atoms, (name, False) in atoms
        labels[(name, False)] = labels[(name, True)] = number
        if glued and free:
            extra[number] = len(names) + len(extra)
            labels[(name, True)] = extra[number]
        elif glued:
            lemma_is_orth.add(number)

    def relabel(r: Rule) -> Rule:
        return replace(r, name=str(labels[(r.name, r.shift)])) if r.kind == "tag" else replace(r, children=tuple(map(relabel, r.children)))

    numbers = {str(n): n for n in range(len(names) + len(extra))}
    variants = [Variant(o, _automaton([relabel(r) for r in rules], numbers)) for o, rules in parsed]
    extended = names + [names[k] + ">" for k in extra]
    return RuleSet(extended, separators, patterns + of_tags, variants, lemma_is_orth, extra)


_WHOLE_WORDS = "[options]\naggl=strict\npraet=split\n[combinations]\nany\n[segment types]\nany\n[lexemes]\n[tags]\nany\t%\n"


def whole_words(generator: bool = False) -> RuleSet:
    """For a lexicon without rules: a word is one segment, so analysis and generation are plain lookups."""
    return compile_rules(_WHOLE_WORDS, generator)
