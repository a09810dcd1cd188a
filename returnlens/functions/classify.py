"""Rule application: semantic labels, contextual result, success, operational result.

A rule hit is kept as the position of the rule; labels are looked up in one literal table at
the end. The stages expect the columns ``mensagem``, ``codigo`` and
``funcionalidade``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from returnlens.functions import rules
from returnlens.functions.sqltext import Ref, Stage, case, contains_any, text, text_list
from returnlens.functions.marks import LOWERED, MaskedMarks, Marks, marks_stages
from returnlens.functions.text import Text, fold_lowered, has_negation, marked_mask_stages, matches_any, matches_prefix, strip

# Positions in the label table: the rules, then the two outcomes without a rule.
UNCATEGORISED_INDEX = len(rules.SEMANTIC_RULES)
EMPTY_INDEX = UNCATEGORISED_INDEX + 1

LABEL_FIELDS = ("categoria", "template", "descricao", "severidade", "orientacao", "causa", "codigo", "rotulo_severidade")
RESULT_FIELDS = ("resultado_operacional", "tipo_erro_tecnico", "severidade")


def _table(rows: list[tuple], names: tuple[str, ...]) -> str:
    """Array of structs as one literal; the optimizer folds the parsing away."""
    fields = ",".join(f"{name}:string" for name in names)
    return f"from_json({text(json.dumps([dict(zip(names, row)) for row in rows]))}, 'array<struct<{fields}>>')"


def _lookup(table: Mapping[str, str], key: str, default: str) -> str:
    entries = "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in table.items()) + ")"
    return f"coalesce(try_element_at({entries}, {key}), {text(default)})"


def category_severity(category: str) -> str:
    """Severity word of a category."""
    return _lookup(rules.SEVERITY_BY_CATEGORY, category, rules.DEFAULT_SEVERITY)


def category_guidance(category: str) -> str:
    """Corrective action of a category."""
    return _lookup(rules.GUIDANCE_BY_CATEGORY, category, rules.DEFAULT_GUIDANCE)


def severity_label(severity: str) -> str:
    """Normalised severity: CRITICO, ALTO, MEDIO, BAIXO or INFO."""
    branches = [(f"contains(upper({severity}), {text(part)})", text(label)) for part, label in rules.SEVERITY_LABELS]
    return case(branches, text(rules.DEFAULT_SEVERITY_LABEL))


def _label_of(severity: str) -> str:
    """The same on a known word."""
    return next((label for part, label in rules.SEVERITY_LABELS if part in severity), rules.DEFAULT_SEVERITY_LABEL)


def _label_rows() -> list[tuple]:
    other = rules.UNCATEGORISED
    rows = []
    for r in rules.SEMANTIC_RULES:
        severity = r.severity or rules.SEVERITY_BY_CATEGORY.get(r.category, rules.DEFAULT_SEVERITY)
        guidance = r.guidance or rules.GUIDANCE_BY_CATEGORY.get(r.category, rules.DEFAULT_GUIDANCE)
        rows.append((r.category, r.template, r.description, severity, guidance, r.cause or r.category, r.code,
                     _label_of(severity)))
    severity = rules.SEVERITY_BY_CATEGORY[other]
    rows.append((other, other, None, severity, rules.GUIDANCE_BY_CATEGORY[other], other, None, _label_of(severity)))
    rows.append((other, other, rules.EMPTY_DESCRIPTION, rules.EMPTY_SEVERITY,
                 rules.GUIDANCE_BY_CATEGORY[rules.EMPTY_GUIDANCE_CATEGORY], other, rules.UNCATEGORISED_CODE,
                 _label_of(rules.EMPTY_SEVERITY)))
    return rows


def semantic_labels(index: str) -> str:
    """Struct of ``LABEL_FIELDS`` at a rule position."""
    return f"get({_table(_label_rows(), LABEL_FIELDS)}, {index})"


def _positions(predicate) -> str:
    """SQL list of the label positions whose row satisfies the predicate."""
    return ", ".join(str(i) for i, row in enumerate(_label_rows()) if predicate(dict(zip(LABEL_FIELDS, row))))


def semantic_index(clean: str, scanned: str, folded: Marks, code: str) -> str:
    """Position of the semantic rule of a stripped message: first pattern hit, else by code.

    ``scanned`` holds the raw and the masked message, ``folded`` tells what its case-folded form holds.
    """
    by_code: dict[str, list[int]] = {}
    for i, rule in enumerate(rules.SEMANTIC_RULES):
        if rule.code is not None:
            by_code.setdefault(rule.code, []).append(i)
    axle = next(i for i in by_code[rules.AMBIGUOUS_CODE] if rules.SEMANTIC_RULES[i].category == rules.AXLE_CATEGORY)
    other = next(i for i in by_code[rules.AMBIGUOUS_CODE] if i != axle)
    branches = [(f"{clean} IN ('', 'None', 'nan')", str(EMPTY_INDEX))]
    branches += [(matches_any(scanned, folded, r.patterns), str(i)) for i, r in enumerate(rules.SEMANTIC_RULES)]
    branches += [(f"{code} = {text(c)}", str(ix[0])) for c, ix in by_code.items() if len(ix) == 1]
    branches += [
        (f"{code} = {text(rules.AMBIGUOUS_CODE)} AND {contains_any(f'lower({clean})', rules.AXLE_WORDS)}", str(axle)),
        (f"{code} = {text(rules.AMBIGUOUS_CODE)}", str(other)),
    ]
    return case(branches, str(UNCATEGORISED_INDEX))


def context_index(clean: str, folded: Marks, negated: str, code: str, functionality: str) -> str:
    """Position of the first contextual rule that matches functionality, code and message, or NULL."""
    branches = []
    for i, rule in enumerate(rules.CONTEXT_RULES):
        applies = [matches_prefix(code, rule.codes)]
        if rule.patterns != rules.ANY:
            applies.append(matches_any(clean, folded, rule.patterns))
        applies.append(matches_prefix(functionality, rule.functionalities))
        if rule.outcome == "SUCESSO":
            applies.append(f"NOT {negated}")
        branches.append((" AND ".join(a for a in applies if a is not None), str(i)))
    return case(branches)


def success_text(lowered: str, functionality: str, held: Marks | None = None) -> str:
    """Lookup hit or success wording in a lower-cased message; ``held`` tells what it holds, where that is known."""
    held = held or Text(lowered)
    lookup = contains_any(f"lower({functionality})", rules.LOOKUP_FUNCTIONALITIES)
    worded = matches_any(lowered, held, rules.SUCCESS_PATTERNS)
    return f"(({held.words(rules.LOOKUP_HITS)} AND {lookup}) OR {worded})"


# What decides a result, in order of precedence: the outcomes without and with a rule table.
_SERVER_ERROR = ("ERRO_TECNICO", "HTTP_500", "CRITICO")
_INTEGRATION = ("ERRO_INFRAESTRUTURA", "CONEXAO", "CRITICO")
_SYSTEM = ("ERRO_TECNICO", "CONEXAO", "CRITICO")
_SUCCESS = ("SUCESSO", None, "INFO")
_REJECTED_BY_RULE = ("REJEICAO_NEGOCIO", None, None)
_REJECTED = ("REJEICAO_NEGOCIO", None, rules.DEFAULT_SEVERITY_LABEL)
_UNREADABLE = ("ERRO_TECNICO", "PARSE", rules.DEFAULT_SEVERITY_LABEL)


def _outcomes() -> list[tuple]:
    """All outcomes: the contextual rules first, so that their positions coincide."""
    context = [(r.outcome, r.technical_type, r.severity) for r in rules.CONTEXT_RULES]
    groups = [(g.outcome, g.technical_type, g.severity) for g in rules.KEYWORD_GROUPS]
    return [*context, *groups, _SERVER_ERROR, _INTEGRATION, _SYSTEM, _SUCCESS, _REJECTED_BY_RULE, _REJECTED, _UNREADABLE]


def contextual_result(index: str) -> str:
    """Result struct of a contextual rule position, or NULL."""
    return f"get({_table(_outcomes(), RESULT_FIELDS)}, {index})"


def outcome_index(r: Ref, functionality: str) -> str:
    """Position of the outcome of a prepared message, by strict precedence."""
    outcomes = _outcomes()
    first_group = len(rules.CONTEXT_RULES)

    def at(outcome: tuple) -> str:
        return str(outcomes.index(outcome, first_group + len(rules.KEYWORD_GROUPS)))

    def context_in(*results: str) -> str:
        positions = ", ".join(str(i) for i, c in enumerate(rules.CONTEXT_RULES) if c.outcome in results)
        return f"{r('contexto')} IN ({positions})"

    clean, code, held = r("limpa"), r("codigo_limpo"), Marks(r, LOWERED)
    semantic, context = r("semantica"), r("contexto")
    branches = [
        (f"{code} = {text(rules.SERVER_ERROR_CODE)} OR {held.words(rules.SERVER_ERROR_WORDS)}", at(_SERVER_ERROR)),
        (context_in(*rules.TECHNICAL_RESULTS), context),
    ]
    for i, group in enumerate(rules.KEYWORD_GROUPS):
        hit = held.words(group.keywords)
        if group.technical_type == rules.JAVA_OBJECT_GROUP:
            hit = f"({hit} OR {matches_any(clean, held, (rules.JAVA_OBJECT,))})"
        branches.append((hit, str(first_group + i)))
    system = _positions(lambda row: row["categoria"] == rules.EMPTY_GUIDANCE_CATEGORY)
    if system:
        branches.append((f"{semantic} IN ({system})", at(_SYSTEM)))
    integration = _positions(lambda row: row["categoria"] in rules.INTEGRATION_CATEGORIES)
    success = _positions(lambda row: row["categoria"] == "SUCESSO")
    confirmed = (f"{semantic} IN ({success}) OR coalesce({context_in('SUCESSO')}, false)"
                 f" OR ({clean} != '' AND {success_text(r('minuscula'), functionality, held)})")
    branches += [
        (f"{semantic} IN ({integration})", at(_INTEGRATION)),
        (f"{code} IN ({text_list(rules.SUCCESS_CODES)})", at(_SUCCESS)),
        (f"NOT {r('negada')} AND ({confirmed})", at(_SUCCESS)),
        (context_in("SUCESSO_COM_ALERTA", "ALERTA_OPERACIONAL"), context),
        (f"{semantic} < {UNCATEGORISED_INDEX}", at(_REJECTED_BY_RULE)),
        (f"{code} RLIKE '^2[0-9]*$' OR NOT {r('negada')}", at(_REJECTED)),
    ]
    return case(branches, at(_UNREADABLE))


def prepare_stages() -> list[Stage]:
    """Stripped, lowered and masked forms of a message, and the marks of its folded and its lowered form."""
    return [
        lambda r: {"limpa": strip(r("mensagem")), "codigo_limpo": strip(r("codigo"))},
        lambda r: {"minuscula": f"lower({r('limpa')})"},
        lambda r: {"dobrada": fold_lowered(r("limpa"), r("minuscula"))},
        *marks_stages("dobrada", "minuscula"),
        lambda r: {"negada": has_negation(Marks(r, LOWERED))},
        *marked_mask_stages("limpa", "mascara"),
    ]


def semantic_stages() -> list[Stage]:
    """Position of the semantic rule.

    No rule pattern crosses a line feed, so the raw and the masked message are scanned in one go.
    """
    return [
        lambda r: {"varrida": f"if({r('limpa')} = {r('mascara')}, {r('limpa')}, concat({r('limpa')}, '\\n', {r('mascara')}))"},
        lambda r: {"semantica": semantic_index(r("limpa"), r("varrida"), MaskedMarks(r, r("mascara")), r("codigo_limpo"))},
    ]


def context_stages(functionality: str = "funcionalidade") -> list[Stage]:
    """Position of the contextual rule."""
    function = strip(functionality)
    return [
        lambda r: {"contexto": context_index(r("limpa"), Marks(r), r("negada"), r("codigo_limpo"), function)}
    ]


def result_stages(functionality: str = "funcionalidade") -> list[Stage]:
    """``resultado_operacional``, ``tipo_erro_tecnico`` and ``severidade``."""

    def outcome(r: Ref) -> str:
        return f"get({_table(_outcomes(), RESULT_FIELDS)}, {r('desfecho')})"

    return [
        lambda r: {"desfecho": outcome_index(r, functionality)},
        lambda r: {"resultado": outcome(r), "rotulo": semantic_labels(r("semantica"))},
        lambda r: {
            "resultado_operacional": f"{r('resultado')}.resultado_operacional",
            "tipo_erro_tecnico": f"{r('resultado')}.tipo_erro_tecnico",
            "severidade": f"coalesce({r('resultado')}.severidade, {r('rotulo')}.rotulo_severidade)",
        },
    ]


def classification_stages(functionality: str = "funcionalidade") -> list[Stage]:
    """The whole classification of one message."""
    return [*prepare_stages(), *semantic_stages(), *context_stages(functionality), *result_stages(functionality)]


def semantic_columns(r: Ref) -> dict[str, str]:
    """The nine semantic labels of a message after the semantic stages and the label lookup."""
    label, index = r("rotulo"), r("semantica")
    code = f"if(coalesce({r('codigo')}, '') = '', {text(rules.UNCATEGORISED_CODE)}, {r('codigo')})"
    return {
        "categoria_operacional": f"{label}.categoria",
        "tipo_rejeicao_semantica": f"{label}.template",
        "subtipo_rejeicao": description(index, label, r("limpa")),
        "severidade_semantica": f"{label}.severidade",
        "orientacao_operacional": f"{label}.orientacao",
        "causa_raiz": f"{label}.causa",
        "codigo_oficial": f"if({index} = {UNCATEGORISED_INDEX}, {code}, {label}.codigo)",
        "template_oficial": f"{label}.template",
        "mensagem_normalizada": f"if({index} = {EMPTY_INDEX}, '', {r('mascara')})",
    }


def description(index: str, label: str, clean: str) -> str:
    """Subtype text; an unmatched message carries itself."""
    own = f"concat({text(rules.UNCATEGORISED_PREFIX)}, {clean})"
    return f"if({index} = {UNCATEGORISED_INDEX}, {own}, {label}.descricao)"


def is_success_message(message: str, code: str, functionality: str) -> str:
    """Whether a message without negation confirms success by code, lookup hit or wording."""
    low = strip(f"lower({message})")
    by_code = f"coalesce({strip(code)} IN ({text_list(rules.SUCCESS_CODES)}), false)"
    return (f"(coalesce({message}, '') != '' AND NOT {has_negation(Text(low))} AND ({by_code} OR "
            f"{success_text(low, f'''coalesce({functionality}, '')''')}))")


def _result_order() -> str:
    return f"array({text_list(rules.RESULT_ORDER)})"


def result_rank(result: str) -> str:
    """How bad a result is."""
    return f"CAST(array_position({_result_order()}, {result}) AS INT) - 1"


def worst_result(rank: str) -> str:
    """The result of the largest rank; SUCESSO where there is none."""
    return f"coalesce(get({_result_order()}, {rank}), {text(rules.RESULT_ORDER[0])})"


def general_status(result: str) -> str:
    """SUCESSO or ERRO of an operational result."""
    return f"if({result} IN ({text_list(rules.SUCCESS_RESULTS)}), 'SUCESSO', 'ERRO')"


def evitability_class(category: str) -> str:
    """How far a rejection of this category can be avoided at the source."""
    branches = [(f"{category} IN ({text_list(members)})", text(name)) for name, members, _ in rules.EVITABILITY_CLASSES]
    return case(branches, text(rules.EVITABILITY_DEFAULT[0]))


def evitability_description(name: str) -> str:
    """Explanation of an evitability class."""
    return _lookup({c[0]: c[2] for c in rules.EVITABILITY_CLASSES}, name, rules.EVITABILITY_DEFAULT[1])


