"""Regular-expression dialect: the rule tables are written for a Unicode-aware engine in which
``.`` excludes only the line feed. Java needs flags to behave the same way."""

from __future__ import annotations

import re
from collections.abc import Sequence

IGNORE_CASE = "(?i)"
# What ends a run of required text: groups (innermost first), classes, class escapes, the dot,
# and any character that a quantifier makes optional.
_GROUP = re.compile(r"(?<!\\)\((?:\?:)?[^()]*\)(?:[*+?]|\{[\d,]+\})?")
_BREAK = re.compile(r"\[[^\]]*\](?:[*+?]|\{[\d,]+\})?|\\[a-zA-Z](?:[*+?]|\{[\d,]+\})?|\.(?:[*+?])?|[^\\][*?]|[\^$+]")


# A Unicode word boundary costs more than the character behind it, which it needs in any case.
_BEFORE_DIGIT = re.compile(r"(?<!\\)\\b(?=\(?\\d(?![*?]|\{0))")
_BEFORE_LETTER = re.compile(r"(?<!\\)\\b(?=([A-Za-z])(?![*?]|\{0))")
_BEFORE_PLATE = re.compile(r"(?<!\\)\\b(?=(?:\(\?:)?\[A-Za-z\]\{3\}\[- \]\?\[0-9\])")


def _cheap_first(pattern: str) -> str:
    """The same pattern, with a look at what must follow before each boundary: both take no characters,
    so their order does not matter."""
    pattern = _BEFORE_LETTER.sub(lambda m: rf"(?={m[1]})\b", pattern) if "|" not in pattern else pattern
    return _BEFORE_PLATE.sub(r"(?=[A-Za-z]{2,3}[- ]?[0-9])\\b", _BEFORE_DIGIT.sub(r"(?=\\d)\\b", pattern))


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """One pattern with the flags that give it Unicode classes, Unicode case folding and a
    ``.`` that stops only at ``\\n``."""
    pattern = _cheap_first(pattern)
    if pattern.startswith(IGNORE_CASE):
        return "(?idU)" + pattern.removeprefix(IGNORE_CASE)
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def java_any(patterns: Sequence[str], ignore_case: bool = False) -> str:
    """Alternation of patterns that share their case sensitivity: one scan instead of many."""
    folded = {p.startswith(IGNORE_CASE) for p in patterns}
    if len(folded) != 1:
        raise ValueError("patterns of one alternation must share their case sensitivity")
    body = "|".join(p.removeprefix(IGNORE_CASE) for p in patterns)
    return java_regex(f"(?:{body})", ignore_case or folded.pop())


def java_replacement(replacement: str) -> str:
    """Group references: ``\\1`` becomes ``$1``."""
    return replacement.replace("\\1", "$1")


def required_words(pattern: str) -> tuple[str, ...] | None:
    """Pieces of plain text that every match of the pattern contains; ``None`` where the
    pattern offers top-level alternatives.

    A cheap substring test on them tells most texts apart without running the pattern.
    """
    body = pattern.removeprefix(IGNORE_CASE)
    while (reduced := _GROUP.sub("\0", body)) != body:
        body = reduced
    if "|" in body:
        return None
    runs = re.sub(r"\\([^a-zA-Z])", r"\1", _BREAK.sub("\0", body)).split("\0")
    return tuple(dict.fromkeys(run.lower() for run in runs if run))


def is_plain(pattern: str) -> bool:
    """Whether the pattern is nothing but letters, digits, blanks and underscores."""
    return re.fullmatch(r"(?:\(\?i\))?[\w ]+", pattern) is not None


# Two alternatives within a word, with the letters around them.
_CHOICE = re.compile(r"(?<![\\\w])([^\W\d_]*)\(\?:([^()|\\\[]*)\|([^()|\\\[]*)\)(?![*+?{])([^\W\d_]*)(?![*?{])")


def required_alternatives(pattern: str) -> list[tuple[str, ...]]:
    """Lists of texts; every match of the pattern contains one of each list, in lower case."""
    body = pattern.removeprefix(IGNORE_CASE)
    words = [(w,) for w in required_words(pattern) or () if len(w) > 1 or not w.isalnum()]
    choices = [tuple((before + c + behind).lower() for c in (a, b)) for before, a, b, behind in _CHOICE.findall(body)] if words else []
    own = [w for w in words if not any(all(w[0] in c for c in choice) for choice in choices)]
    return list(dict.fromkeys([*own, *(c for c in choices if min(map(len, c)) > 1)]))
