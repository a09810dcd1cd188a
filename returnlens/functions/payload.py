"""Return payloads: codes, messages and protocol out of JSON or free text."""

from __future__ import annotations

from returnlens.functions import rules
from returnlens.functions.regex import java_regex
from returnlens.functions.sqltext import bind, case, contains_any, each, keep, struct, text, text_list
from returnlens.functions.text import rlike, split_message, strip

NO_VALUES = "CAST(array() AS ARRAY<STRING>)"


def json_object(value: str) -> str:
    """The text as a VARIANT object, or NULL where it is anything else.

    The JSON parser stops after the first value, so the text is parsed inside an array: content
    after the object then breaks the syntax or shows as a second element. A text that could
    close that array by itself must hold inside an object as well.
    """

    def parse(t: str) -> str:
        whole = f"(NOT {rlike(t, chr(125) + r'\s*\]')} OR try_parse_json(concat('{{\"k\":', {t}, '}}')) IS NOT NULL)".replace("{{", "{").replace("}}", "}")
        document = bind(
            f"try_parse_json(concat('[', {t}, ']'))",
            lambda v: f"if(try_variant_get({v}, '$[1]', 'variant') IS NULL, try_variant_get({v}, '$[0]', 'variant'), NULL)",
        )
        return f"if(startswith({t}, '{{') AND endswith({t}, '}}') AND {whole}, {document}, NULL)"

    return bind(strip(value), parse)


def _first_key(doc: str, *keys: str) -> str:
    """Value of the first key that exists; an explicit JSON null counts as existing."""
    return "coalesce(" + ", ".join(f"try_variant_get({doc}, '$.{key}', 'variant')" for key in keys) + ")"


def _truthy(value: str) -> str:
    """Whether a VARIANT is neither null, false, zero nor empty; quoted text only has to be non-empty."""
    return bind(
        f"CAST({value} AS STRING)",
        lambda t: f"{t} IS NOT NULL AND {t} != '' AND ({t} NOT IN ('0', 'false', '[]', '{{}}')"
        f" OR schema_of_variant({value}) = 'STRING')",
    )


def _items(value: str) -> str:
    """Stripped texts of a JSON list, falsy elements dropped; NULL where the value is no list."""
    elements = f"try_variant_get({value}, '$', 'array<variant>')"
    return each(keep(elements, _truthy), lambda e, _: strip(f"CAST({e} AS STRING)"))


def comma_list(value: str) -> str:
    """Stripped, non-empty parts between commas."""
    return keep(each(f"split({value}, ',', -1)", lambda c, _: strip(c)), lambda c: f"{c} != ''")


def _no_text(value: str) -> str:
    return f"({value} IS NULL OR {value} IN ('None', 'nan'))"


def parse_payload(code: str, response: str) -> str:
    """``struct<codes array<string>, messages array<string>>``, each with one element at least.

    A JSON object in the response wins, then one in the code field, else both are plain text:
    codes separated by commas and the response as one message. ``code`` and ``response`` are
    plain references.
    """
    one_code = f"if(contains({code}, ','), {comma_list(code)}, array({strip(code)}))"
    plain = struct(
        codes=f"if({_no_text(code)}, array(''), {one_code})",
        messages=f"if({_no_text(response)}, array(''), array({strip(response)}))",
    )

    def from_json(raw: str) -> str:
        def value(field: str, read: str) -> str:
            return f"if({raw}.{field} IS NULL OR is_variant_null({raw}.{field}), {NO_VALUES}, {read})"

        string = f"CAST({raw}.{{}} AS STRING)"
        return struct(
            codes=value("c", f"coalesce({_items(raw + '.c')}, if(startswith(schema_of_variant({raw}.c), 'OBJECT'),"
                             f" array({string.format('c')}), {comma_list(string.format('c'))}))"),
            messages=value("m", f"coalesce({_items(raw + '.m')}, array({strip(string.format('m'))}))"),
        )

    def read(doc: str) -> str:
        keys = struct(c=_first_key(doc, "Codigo", "codigo"), m=_first_key(doc, "Mensagem", "mensagem"))
        return f"if({doc} IS NULL, {plain}, {bind(keys, from_json)})"

    def at_least_one(p: str) -> str:
        return struct(
            **{f: f"if(size({p}.{f}) > 0, {p}.{f}, array(''))" for f in ("codes", "messages")}
        )

    brace = f"(contains({code}, '{{') OR contains({response}, '{{'))"
    parsed = bind(f"coalesce({json_object(response)}, {json_object(code)})", read)
    # One code and one message, the most frequent case, need no lambda and so run in generated code.
    single = struct(codes=f"array(if({_no_text(code)}, '', {strip(code)}))", messages=f"array(if({_no_text(response)}, '', {strip(response)}))")
    return f"if({brace}, {bind(parsed, at_least_one)}, if(contains({code}, ','), {bind(plain, at_least_one)}, {single}))"


def pair_messages(payload: str) -> str:
    """``array<struct<pos, mensagem, codigo>>`` of a payload struct: each message with the code
    of its position, else the first code, split into single messages. An empty message stays; a
    message with nothing left after unquoting yields no pair."""

    def expand(message: str, index: str) -> str:
        singles = f"if({message} = '', array(''), {split_message(message)})"
        code = f"coalesce(get({payload}.codes, {index}), get({payload}.codes, 0))"
        return each(singles, lambda m, _: struct(mensagem=m, codigo=code))

    pairs = f"flatten({each(payload + '.messages', expand)})"
    numbered = each(pairs, lambda p, i: struct(pos=i, mensagem=f"{p}.mensagem", codigo=f"{p}.codigo"))
    # The messages of a payload are stripped; an only one that cannot be a list is its own pair, without lambdas.
    only = f"{payload}.messages[0]"
    alone = f"size({payload}.messages) = 1 AND NOT ({contains_any(only, chr(34) + chr(39))} OR startswith({only}, '['))"
    return f"if({alone}, array({struct(pos='0', mensagem=only, codigo=f'{payload}.codes[0]')}), {numbered})"


def _protocol_in_json(value: str) -> str:
    def lookup(doc: str) -> str:
        entries = f"map_entries(from_json({doc}, 'map<string,variant>'))"
        return bind(entries, first_truthy)

    def first_truthy(entries: str) -> str:
        # Of a key that repeats the last value counts, of keys that differ in case the first.
        names = f"filter(array_distinct(transform({entries}, x -> x.key)), k -> lower(k) = 'protocolo')"
        values = f"transform({names}, k -> element_at(filter({entries}, x -> x.key = k), -1).value)"
        return strip(f"CAST(get({keep(values, _truthy)}, 0) AS STRING)")

    return case([(f"contains(lower({value}), 'protocolo') AND {json_object(value)} IS NOT NULL", lookup(strip(value)))])


def _protocol_in_column(value: str) -> str:
    return case([(f"{strip(value)} != '' AND {value} NOT IN ({text_list(['None', 'nan', rules.NO_PROTOCOL])})",
                  strip(value))])


def _protocol_in_text(value: str) -> str:
    found = f"regexp_extract({value}, {text(java_regex(rules.PROTOCOL_IN_TEXT))}, 1)"
    return case([(f"length({found}) >= {rules.PROTOCOL_MIN_LENGTH}", found)])


def extract_protocol(code: str, response: str, protocol_code: str | None = None, protocol: str | None = None) -> str:
    """Protocol of a request: JSON key, code column, text, original column, then the default."""
    candidates = [_protocol_in_json(response), _protocol_in_json(code)]
    if protocol_code is not None:
        candidates.append(_protocol_in_column(protocol_code))
    candidates += [_protocol_in_text(response), _protocol_in_text(code)]
    if protocol is not None:
        candidates.append(_protocol_in_column(protocol))
    return f"coalesce({', '.join(candidates)}, {text(rules.NO_PROTOCOL)})"
