"""JSON Schemas as column expressions over VARIANT values."""

from __future__ import annotations

import itertools
import json

_KINDS = {
    "object": "schema_of_variant({v}) like 'OBJECT<%'", "array": "schema_of_variant({v}) like 'ARRAY<%'", "string": "schema_of_variant({v}) = 'STRING'", "boolean": "schema_of_variant({v}) = 'BOOLEAN'", "null": "is_variant_null({v})",
    "number": "schema_of_variant({v}) rlike '^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)'",
    "integer": "(schema_of_variant({v}) = 'BIGINT' or schema_of_variant({v}) rlike '^(?:DECIMAL|DOUBLE|FLOAT)' and try_variant_get({v}, '$', 'double') = floor(try_variant_get({v}, '$', 'double')))",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(value, v: str) -> str:
    """Whether a value equals a constant; numbers are equal by value, objects and arrays by their text with sorted names."""
    if value is None:
        return _KINDS["null"].format(v=v)
    if isinstance(value, bool):
        return f"({_KINDS['boolean'].format(v=v)} and try_variant_get({v}, '$', 'boolean') = {str(value).lower()})"
    if isinstance(value, (int, float)):
        return f"({_KINDS['number'].format(v=v)} and try_variant_get({v}, '$', 'double') = double('{value}'))"
    if isinstance(value, str):
        return f"({_KINDS['string'].format(v=v)} and try_variant_get({v}, '$', 'string') = {_text(value)})"
    return f"(to_json({v}) = to_json(parse_json({_text(json.dumps(value))})))"


def compiled(schema: dict | bool | str, value: str) -> str:
    """SQL: whether a VARIANT expression meets a schema; a value that is SQL null doesn't.

    Understood are type, enum, const, properties, required, additionalProperties, minProperties, maxProperties, items,
    prefixItems, minItems, maxItems, uniqueItems, contains, minimum, maximum, exclusiveMinimum, exclusiveMaximum,
    multipleOf, minLength, maxLength, pattern, patternProperties, propertyNames, allOf, anyOf, oneOf, not, if, then, else,
    $ref into the same document ($defs, definitions) unless it comes back to itself, and notes that check nothing.
    Another keyword is an error.
    """
    root = json.loads(schema) if isinstance(schema, str) else schema
    numbers = itertools.count()

    def bound(expression: str, make) -> str:
        """The check on a name for the expression, so that it stands in the text once."""
        name = f"x{next(numbers)}"
        return f"forall(array({expression}), {name} -> {make(name)})"

    def only(kind: str, v: str, test: str) -> str:
        return f"(not ({_KINDS[kind].format(v=v)}) or {test})"

    def check(s: dict | bool, v: str, within: tuple = ()) -> str:
        if isinstance(s, bool):
            return str(s).lower()
        parts = []
        members = f"try_variant_get({v}, '$', 'map<string,variant>')"
        elements = f"try_variant_get({v}, '$', 'array<variant>')"
        number, string = f"try_variant_get({v}, '$', 'double')", f"try_variant_get({v}, '$', 'string')"
        each = lambda values, test: f"forall({values}, {(n := f'x{next(numbers)}')} -> {test(n)})"
        for word, a in s.items():
            match word:
                case "type":
                    parts.append("(" + " or ".join(_KINDS[k].format(v=v) for k in ([a] if isinstance(a, str) else a)) + ")")
                case "enum":
                    parts.append("(" + " or ".join(_literal(x, v) for x in a) + ")" if a else "false")
                case "const":
                    parts.append(_literal(a, v))
                case "required":
                    parts += [only("object", v, f"map_contains_key({members}, {_text(p)})") for p in a]
                case "properties":
                    for p, sub in a.items():
                        parts.append(only("object", v, f"(not map_contains_key({members}, {_text(p)}) or {bound(f'{members}[{_text(p)}]', lambda n, sub=sub: check(sub, n, within))})"))
                case "patternProperties":
                    for p, sub in a.items():
                        parts.append(only("object", v, each(f"map_entries({members})", lambda n, p=p, sub=sub: f"(not {n}.key rlike {_text(p)} or {check(sub, f'{n}.value', within)})")))
                case "propertyNames":
                    parts.append(only("object", v, each(f"map_keys({members})", lambda n, a=a: bound(f"variant_get(parse_json(to_json(array({n}))), '$[0]', 'variant')", lambda m: check(a, m, within)))))
                case "additionalProperties":
                    named = "array(" + ", ".join(map(_text, s.get("properties", {}))) + ")" if s.get("properties") else "cast(array() as array<string>)"
                    forms = "".join(f" or {{n}}.key rlike {_text(p)}" for p in s.get("patternProperties", {}))
                    parts.append(only("object", v, each(f"map_entries({members})", lambda n, a=a: f"(array_contains({named}, {n}.key){forms.format(n=n)} or {check(a, f'{n}.value', within)})")))
                case "minProperties" | "maxProperties":
                    parts.append(only("object", v, f"size({members}) {'>=' if word[1] == 'i' else '<='} {int(a)}"))
                case "prefixItems":
                    for k, sub in enumerate(a):
                        parts.append(only("array", v, f"(size({elements}) <= {k} or {bound(f'get({elements}, {k})', lambda n, sub=sub: check(sub, n, within))})"))
                case "items":
                    first = len(s.get("prefixItems", []))
                    rest = f"slice({elements}, {first + 1}, size({elements}))" if first else elements
                    parts.append(only("array", v, each(rest, lambda n, a=a: check(a, n, within))))
                case "contains":
                    n = f"x{next(numbers)}"
                    parts.append(only("array", v, f"exists({elements}, {n} -> {check(a, n, within)})"))
                case "minItems" | "maxItems":
                    parts.append(only("array", v, f"size({elements}) {'>=' if word[1] == 'i' else '<='} {int(a)}"))
                case "uniqueItems":
                    n = f"x{next(numbers)}"
                    texts = f"transform({elements}, {n} -> to_json({n}))"
                    parts += [only("array", v, f"size(array_distinct({texts})) = size({texts})")] if a else []
                case "minimum" | "maximum" | "exclusiveMinimum" | "exclusiveMaximum":
                    sign = {"minimum": ">=", "maximum": "<=", "exclusiveMinimum": ">", "exclusiveMaximum": "<"}[word]
                    parts.append(only("number", v, f"{number} {sign} double('{a}')"))
                case "multipleOf":
                    parts.append(only("number", v, f"{number} / double('{a}') = floor({number} / double('{a}'))"))
                case "minLength" | "maxLength":
                    parts.append(only("string", v, f"length({string}) {'>=' if word[1] == 'i' else '<='} {int(a)}"))
                case "pattern":
                    parts.append(only("string", v, f"{string} rlike {_text(a)}"))
                case "allOf":
                    parts += [check(x, v, within) for x in a]
                case "anyOf":
                    parts.append("(" + " or ".join(check(x, v, within) for x in a) + ")")
                case "oneOf":
                    parts.append("(" + " + ".join(f"if({check(x, v, within)}, 1, 0)" for x in a) + " = 1)")
                case "not":
                    parts.append(f"(not {check(a, v, within)})")
                case "if":
                    parts.append(f"if({check(a, v, within)}, {check(s.get('then', True), v, within)}, {check(s.get('else', True), v, within)})")
                case "$ref":
                    if a in within or not a.startswith("#"):
                        raise ValueError(f"a schema that comes back to itself or lies elsewhere: {a}")
                    target = root
                    for step in a[1:].strip("/").split("/") if a != "#" else []:
                        target = target[step.replace("~1", "/").replace("~0", "~")]
                    parts.append(check(target, v, (*within, a)))
                case "then" | "else" | "$schema" | "$id" | "$defs" | "definitions" | "title" | "description" | "default" | "examples" | "$comment" | "format":
                    pass
                case _:
                    raise ValueError(f"unknown keyword {word!r} in a JSON Schema")
        return "(" + " and ".join(parts) + ")" if parts else "true"

    return f"coalesce({bound(value, lambda n: f'({n} is not null and {check(root, n)})')}, false)"
