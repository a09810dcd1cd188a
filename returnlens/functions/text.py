"""Text expressions: stripping, case folding, masking, splitting."""

from __future__ import annotations

from collections.abc import Iterable

from returnlens.functions import rules
from returnlens.functions.marks import Marks
from returnlens.functions.regex import is_plain, java_any, java_regex, java_replacement, required_words
from returnlens.functions.sqltext import (
    Ref,
    Stage,
    any_of,
    bind,
    case,
    contains_any,
    each,
    keep,
    text,
)

# Every Unicode whitespace character, control separators included.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
ANY_SPACE = r"[\s\x1c-\x1f]"
IGNORE_CASE = "(?i)"


def strip(value: str) -> str:
    """Trim Unicode whitespace (``trim`` alone removes only blanks)."""
    return f"btrim({value}, {text(WHITESPACE)})"


def rlike(value: str, regex: str) -> str:
    return f"{value} RLIKE {text(regex)}"


def fold(value: str) -> str:
    """Lower case in the sense of case-insensitive matching: letters that match i or s without
    lower-casing to them are replaced first."""
    odd = f"translate({value}, 'İıſ', 'iis')"
    return f"lower(if({contains_any(value, 'İıſ')}, {odd}, {value}))"


def fold_lowered(value: str, lowered: str) -> str:
    """``fold(value)`` where ``lower(value)`` is at hand."""
    return f"if({contains_any(value, 'İıſ')}, {fold(value)}, {lowered})"


class Text:
    """What a folded or lowered text holds, asked word by word; ``Marks`` has the answers ready."""

    def __init__(self, folded: str) -> None:
        self.folded = folded

    def words(self, words: Iterable[str]) -> str:
        """Whether one of the words occurs."""
        return contains_any(self.folded, words)

    def pattern(self, pattern: str) -> str:
        """What every match of a pattern needs."""
        word = required_word(pattern)
        return "true" if word is None else self.words((word,))


def has_negation(lowered: Text | Marks) -> str:
    """Whether a lower-cased message holds a word that rules success out."""
    return lowered.words(rules.NEGATIONS)


def required_word(pattern: str) -> str | None:
    """The longest piece of text that every match of the pattern contains."""
    words = [w for w in required_words(pattern) or () if len(w) > 1 or not w.isalnum()]
    return max(words, key=len, default=None)


def matches_any(value: str, folded: Text | Marks, patterns: Iterable[str]) -> str:
    """Whether one of the patterns is found anywhere; ``folded`` tells what ``fold(value)`` holds.

    Case-insensitive plain words need no pattern at all, and the others run, as one
    alternation, only on a text that holds what one of them requires.
    """
    patterns = tuple(patterns)
    plain = [p.removeprefix(IGNORE_CASE) for p in patterns if is_plain(p) and p.startswith(IGNORE_CASE)]
    others = [p for p in patterns if not (is_plain(p) and p.startswith(IGNORE_CASE))]
    hits = [folded.words(plain)] if plain else []
    if others:
        needed = dict.fromkeys(folded.pattern(p) for p in others)
        found = rlike(value, java_any(others))
        hits.append(found if "true" in needed else f"({any_of(needed)} AND {found})")
    return any_of(hits)


def matches_prefix(value: str, patterns: Iterable[str]) -> str | None:
    """Whether one of the patterns matches from the start, ignoring case; ``None`` for always."""
    patterns = tuple(patterns)
    if patterns == rules.ANY:
        return None
    return rlike(value, java_regex(rf"\A(?:{'|'.join(patterns)})", ignore_case=True))


def _replace(value: str, steps: Iterable[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        value = f"regexp_replace({value}, {text(java_regex(pattern))}, {text(java_replacement(replacement))})"
    return value


def _substitution(column: str, steps: tuple[tuple[str, str], ...], condition: Ref) -> Stage:
    """Stage of ordered substitutions under a cheap necessary condition."""
    return lambda r: {column: f"if({condition(r)}, {_replace(r(column), steps)}, {r(column)})"}


# A run that is one blank already is not touched.
_BLANKS = java_regex(f"(?: {ANY_SPACE}|(?! ){ANY_SPACE}){ANY_SPACE}*")


def marked_mask_stages(source: str, target: str) -> list[Stage]:
    """``mask_stages`` where marks tell what ``fold(source)`` holds: each pattern runs where its own words
    and shapes may be. No pattern of numbers cuts a run of digits, so what is left of them has the shapes of the source."""
    shapes = ((rules.MASK_DATES, ("date_slash",), ("date_dash",)), (rules.MASK_PLATE, ("plate",)), (rules.MASK_FORMATTED, ("cnpj",), ("cpf",)),
              (rules.MASK_LONG_NUMBERS, ("run14",), ("run11",)), (rules.MASK_LABELLED, ("digit",)), (rules.MASK_BARE, ("run8_12",)),
              (rules.MASK_POSTCODES, ("postcode",), ("run8",)), (rules.MASK_PROTOCOL, ()), (rules.MASK_AMOUNTS, ("comma",), ("point",)))

    def one(step: tuple[str, str], wanted: tuple[str, ...]) -> Stage:
        def condition(r: Ref) -> str:
            needed = [Marks(r).shapes(*wanted)] if wanted else []
            return " AND ".join([*needed, Marks(r).pattern(step[0])]) if step[0].startswith(IGNORE_CASE) or not needed else needed[0]

        return _substitution(target, (step,), condition)

    def twice(step: tuple[str, str]) -> Stage:
        mark = text(step[1])
        return _substitution(target, (step,), lambda r: f"contains({r(target)}, {mark}) AND substring_index({r(target)}, {mark}, 2) != {r(target)}")

    return [
        lambda r: {target: r(source)},
        _substitution(target, rules.MASK_OBJECTS, lambda r: Marks(r).words("@")),
        _substitution(target, rules.MASK_PREFIX, lambda r: Marks(r).pattern(rules.MASK_PREFIX[0][0])),
        *(one(step, wanted) for steps, *each_wanted in shapes for step, wanted in zip(steps, each_wanted, strict=True)),
        *(twice(step) for step in rules.MASK_LISTS),
        lambda r: {target: f"trim(if({Marks(r).shapes('blanks')}, regexp_replace({r(target)}, {text(_BLANKS)}, ' '), {r(target)}))"},
    ]


def mask_stages(source: str, target: str) -> list[Stage]:
    """Template of a stripped message: identifiers, dates and amounts become placeholders.

    The substitutions keep their order; they are grouped only under conditions that all members
    of a group need. Placeholders hold no digit and, with their braces, join no letters to a word, so the
    digits and words that a pattern needs are looked for once, in the source. The columns ``<target>_dobrada``,
    ``fold(source)``, and ``<target>_digito`` are added too.
    """
    low, some_digit = f"{target}_dobrada", f"{target}_digito"
    digit, eight, code = (text(java_regex(p)) for p in (r"\d", r"\d{8}", r"\d-\d|\d{8}"))

    def word(steps: tuple[tuple[str, str], ...]) -> Ref:
        return lambda r: f"contains({r(low)}, {text(required_word(steps[0][0]))})"

    def number(condition: str) -> Ref:
        return lambda r: f"({r(some_digit)} AND {condition.replace('@', r(target))})"

    return [
        lambda r: {target: r(source), some_digit: f"{r(source)} RLIKE {digit}", low: fold(r(source))},
        _substitution(target, rules.MASK_OBJECTS, lambda r: f"contains({r(target)}, '@')"),
        _substitution(target, rules.MASK_PREFIX, lambda r: f"contains({r(low)}, 'rejei')"),
        _substitution(target, rules.MASK_DATES, number("(contains(@, '/') OR contains(@, '-'))")),
        _substitution(target, rules.MASK_PLATE, lambda r: r(some_digit)),
        _substitution(target, rules.MASK_FORMATTED, number("contains(@, '-')")),
        _substitution(target, rules.MASK_LONG_NUMBERS, number(f"@ RLIKE {eight}")),
        _substitution(target, rules.MASK_LABELLED, lambda r: f"({r(some_digit)} AND {word(rules.MASK_LABELLED)(r)})"),
        _substitution(target, rules.MASK_BARE, number(f"@ RLIKE {eight}")),
        _substitution(target, rules.MASK_POSTCODES, number(f"@ RLIKE {code}")),
        _substitution(target, rules.MASK_PROTOCOL, word(rules.MASK_PROTOCOL)),
        _substitution(target, rules.MASK_AMOUNTS, number("(contains(@, ',') OR contains(@, '.'))")),
        _substitution(target, rules.MASK_LISTS, lambda r: f"contains({r(target)}, '}}')"),
        lambda r: {target: f"trim(regexp_replace({r(target)}, {text(_BLANKS)}, ' '))"},
    ]


def _peel(value: str, openers: str, pairs: Iterable[tuple[str, str]]) -> str:
    """Strip enclosing bracket or quote layers until none is left.

    Each layer uses up at least one character of the leading run of openers, which bounds the
    number of rounds; a text without such a run is returned as it is.
    """
    run = text(java_regex(f"^(?:{ANY_SPACE}|[{openers}])*"))
    enclosed = any_of(f"(startswith(acc, {text(a)}) AND endswith(acc, {text(b)}))" for a, b in pairs)
    inner = strip("substring(acc, 2, length(acc) - 2)")
    rounds = f"array_repeat(0, length(regexp_extract({value}, {run}, 0)))"
    return f"aggregate({rounds}, {value}, (acc, n) -> if({enclosed}, {inner}, acc))"


def split_message(message: str) -> str:
    """Array of the single messages of a text that may hold a quoted, comma-separated list.

    Only a comma between quotes separates; parts that are empty after unquoting are dropped. A
    text without quotes and without a leading bracket is its own and only part.
    """
    quotes = (('"', '"'), ("'", "'"))
    separator = text(java_regex(rules.MESSAGE_SEPARATOR.replace(r"\s", ANY_SPACE)))

    def full(value: str) -> str:
        unescaped = f"replace(replace({value}, {text(chr(92) + chr(34))}, {text(chr(34))}), {text(chr(92) + chr(39))}, {text(chr(39))})"
        body = bind(strip(unescaped), lambda t: _peel(t, "\\[\"'", (("[", "]"), *quotes)))
        parts = each(f"split({body}, {separator}, -1)",
                     lambda p, _: bind(strip(p), lambda t: _peel(t, "\"'", quotes)))
        return keep(parts, lambda p: f"{p} != ''")

    def split(value: str) -> str:
        plain = f"NOT ({contains_any(value, chr(34) + chr(39))} OR startswith({value}, '['))"
        alone = f"if({value} = '', CAST(array() AS ARRAY<STRING>), array({value}))"
        return case([(f"{value} IS NULL", "CAST(array() AS ARRAY<STRING>)"), (plain, alone)], full(value))

    return bind(strip(message), split)
