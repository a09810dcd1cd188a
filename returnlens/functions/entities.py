"""Domain entities found in a rejection message."""

from __future__ import annotations

from returnlens.functions import rules
from returnlens.functions.marks import Marks
from returnlens.functions.regex import java_regex
from returnlens.functions.sqltext import Ref, Stage, each, struct, text
from returnlens.functions.text import fold, required_word

KINDS = tuple(rule.kind for rule in rules.ENTITY_RULES)
FOUND_TYPE = "ARRAY<STRUCT<tipo: STRING, valores: ARRAY<STRING>>>"


def entity_values(message: str, kind: str, folded: str | None = None) -> str:
    """Distinct values of one entity kind, in order of first occurrence. ``folded`` is ``fold(message)``,
    stripped or not, where it is at hand."""
    return _distinct(matches(message, kind, folded), kind)


def matches(message: str, kind: str, folded: str | None = None) -> str:
    """What the pattern of a kind finds, in order; no lambda, so it runs in generated code."""
    rule = next(r for r in rules.ENTITY_RULES if r.kind == kind)
    found = f"regexp_extract_all({message}, {text(java_regex(rule.pattern))}, 0)"
    if rule.pattern.startswith("(?i)") and (word := required_word(rule.pattern)):
        found = f"if(contains({folded or fold(message)}, {text(word)}), {found}, CAST(array() AS ARRAY<STRING>))"
    return found


def _distinct(found: str, kind: str) -> str:
    rule = next(r for r in rules.ENTITY_RULES if r.kind == kind)

    def clean(value: str, _: str) -> str:
        value = f"upper({value})" if rule.upper else value
        return f"regexp_replace({value}, {text(java_regex(rule.strip))}, '')"

    return f"array_distinct({each(found, clean) if rule.strip else found})"


# The shapes of numbers that the pattern of a kind needs, and a word where the pattern does not tell.
_SHAPES = {"CEP": ("postcode", "run8"), "PLACA": ("plate",), "RNTRC": ("run8_12",), "CPF": ("cpf", "run11"), "CNPJ": ("cnpj", "run14"),
           "CIOT": ("run12_16",), "EIXOS": ("digit",), "MUNICIPIO": ("run7",)}
_WORDS = {"EIXOS": "eixo"}


def matches_stage(condition: Ref) -> Stage:
    """A column per kind, ``achado_<kind>``, of what its pattern finds in a message under a condition; its
    marks tell which messages are to be scanned at all."""

    def found(r: Ref, rule: rules.EntityRule) -> str:
        own, kind = Marks(r), rule.kind
        needed = [condition(r), own.shapes(*_SHAPES[kind])]
        if kind in _WORDS:
            needed.append(own.words((_WORDS[kind],)))
        if rule.pattern.startswith("(?i)"):
            needed.append(own.pattern(rule.pattern))
        scan = f"regexp_extract_all({r('mensagem')}, {text(java_regex(rule.pattern))}, 0)"
        return f"if({' AND '.join(needed)}, {scan}, CAST(array() AS ARRAY<STRING>))"

    return lambda r: {f"achado_{rule.kind}": found(r, rule) for rule in rules.ENTITY_RULES}


def found_stage(r: Ref) -> dict[str, str]:
    """``achados``, ``array<struct<tipo, valores>>`` of every kind that was found."""
    none = f"CAST(array() AS {FOUND_TYPE})"

    def one(kind: str) -> str:
        found = r(f"achado_{kind}")
        return f"if(size({found}) > 0, array({struct(tipo=text(kind), valores=_distinct(found, kind))}), {none})"

    return {"achados": f"concat({', '.join(one(k) for k in KINDS)})"}


def entity_rows(found: str, rejection_id: str) -> str:
    """Entities of one rejection, with deterministic ids."""

    def rows(kind: str, _: str) -> str:
        return each(
            f"{kind}.valores",
            lambda value, i: struct(
                entidade_id=f"concat_ws('_', {rejection_id}, 'ent', {kind}.tipo, {i})",
                entidade_tipo=f"{kind}.tipo",
                entidade_valor=value,
            ),
        )

    return f"flatten({each(found, rows)})"
