"""Predicates as data (nested dicts) turned into Spark columns.

Two dialects: search predicates over stored events and rule predicates of
detection rules.  Both are plain Column expressions, so Catalyst can push
them down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

import re

from siemspark.functions.scalars import UUID_V7

MAX_IN_VALUES = 32


class PredicateError(ValueError):
    """The predicate does not fit the field catalog."""


# --- search ----------------------------------------------------------------

@dataclass(frozen=True)
class SearchField:
    column: str
    kind: str               # "string" or "number"
    nullable: bool = False
    uuid: bool = False
    from_json: bool = False  # promoted from the event object; missing means ''


SEARCH_FIELDS: dict[str, SearchField] = {
    "user.name": SearchField("user_name", "string", from_json=True),
    "src_endpoint.ip": SearchField("src_ip", "string", from_json=True),
    "service.name": SearchField("service_name", "string", from_json=True),
    "status": SearchField("status", "string", from_json=True),
    "message": SearchField("message", "string", from_json=True),
    "class_uid": SearchField("class_uid", "number"),
    "category_uid": SearchField("category_uid", "number"),
    "activity_id": SearchField("activity_id", "number", nullable=True),
    "severity_id": SearchField("severity", "number", nullable=True),
    "normalized_event_id": SearchField("normalized_event_id", "string", uuid=True),
    "raw_event_id": SearchField("raw_event_id", "string", uuid=True),
    "parser_id": SearchField("parser_id", "string"),
    "parser_version": SearchField("parser_version", "string"),
    "mapping_id": SearchField("mapping_id", "string"),
    "mapping_version": SearchField("mapping_version", "string"),
    "execution_mode": SearchField("execution_mode", "string"),
}

_TEXT_OPS = ("contains", "starts_with", "ends_with")
_NUMBER_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def search_predicate(spec: dict, fields: dict[str, SearchField] = SEARCH_FIELDS) -> Column:
    """``{"and"|"or": [..]}``, ``{"not": ..}`` or ``{"field", "op", "value"}``."""
    if "and" in spec or "or" in spec:
        name = "and" if "and" in spec else "or"
        parts = [search_predicate(p, fields) for p in spec[name]]
        if not parts:
            raise PredicateError(f"{name} needs at least one predicate")
        return reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), parts)
    if "not" in spec:
        return ~search_predicate(spec["not"], fields)
    if "field" not in spec or "op" not in spec:
        raise PredicateError("a predicate needs field and op")
    known = fields.get(spec["field"])
    if known is None:
        raise PredicateError(f"unknown field {spec['field']!r}")
    return _search_leaf(known, spec)


def _literal(f: SearchField, value):
    text = isinstance(value, str)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if (f.kind == "string" and not text) or (f.kind == "number" and not number):
        raise PredicateError("literal type does not match the field")
    if f.uuid and not re.match(UUID_V7, value):
        raise PredicateError("this field takes a UUIDv7 literal")
    return value


def _text_equals(f: SearchField, value: str) -> Column:
    # A missing promoted string counts as ''.  Null-safe equality keeps the
    # test free of functions on the column, so it can be pushed down.
    if not f.from_json:
        return F.col(f.column) == value
    if value == "":
        return F.col(f.column).isNull() | (F.col(f.column) == "")
    return F.col(f.column).eqNullSafe(value)


def _search_leaf(f: SearchField, spec: dict) -> Column:
    op, c = spec["op"], F.col(f.column)
    if op == "exists":
        if f.nullable:
            return c.isNotNull()
        if f.kind != "string":
            raise PredicateError(f"exists is not meaningful for {f.column}")
        return c.isNotNull() & (c != "") if f.from_json else c != ""
    if op in _TEXT_OPS:
        value = spec["value"]
        if f.kind != "string" or not isinstance(value, str):
            raise PredicateError(f"{op} takes a string field and literal")
        test = {"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[op]
        if not f.from_json:
            return test(value)
        return F.lit(True) if value == "" else c.isNotNull() & test(value)
    if op == "in":
        values = spec["value"]
        if not 1 <= len(values) <= MAX_IN_VALUES:
            raise PredicateError(f"in takes 1 to {MAX_IN_VALUES} values")
        values = [_literal(f, v) for v in values]
        if f.kind == "string" and f.from_json:
            filled = [v for v in values if v != ""]
            test = c.isNotNull() & c.isin(filled) if filled else F.lit(False)
            return test | _text_equals(f, "") if "" in values else test
        return c.isin(values)
    if op in ("==", "!="):
        value = _literal(f, spec["value"])
        equal = _text_equals(f, value) if f.kind == "string" else c == value
        return equal if op == "==" else ~equal
    if op in _NUMBER_OPS:
        if f.kind != "number":
            raise PredicateError(f"{op} is not valid for a string field")
        return getattr(c, _NUMBER_OPS[op])(_literal(f, spec["value"]))
    raise PredicateError(f"unsupported operator {op!r}")


# --- rules -----------------------------------------------------------------

# Rule field -> promoted column.
RULE_FIELDS = {
    "activity_name": "activity_name",
    "status": "status",
    "user.name": "user_name",
    "src_endpoint.ip": "src_ip",
    "service.name": "service_name",
    "message": "message",
    "user_name": "user_name",
    "src_ip": "src_ip",
}

RULE_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "starts_with",
            "ends_with", "matches")


def rule_fields(spec: dict) -> list[str]:
    """Fields a rule reads, each once, in order of appearance."""
    if "not" in spec:
        return rule_fields(spec["not"])
    for name in ("and", "or"):
        if name in spec:
            return list(dict.fromkeys(f for p in spec[name] for f in rule_fields(p)))
    return [spec["field"]]


def rule_predicate(spec: dict, columns: dict[str, str] | None = None) -> Column:
    """Boolean column that is never NULL: an unset field makes a leaf false."""
    columns = RULE_FIELDS if columns is None else columns
    for name, combine in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if name in spec:
            if not spec[name]:
                raise PredicateError(f"{name} needs at least one child")
            return reduce(combine, [rule_predicate(p, columns) for p in spec[name]])
    if "not" in spec:
        return ~rule_predicate(spec["not"], columns)
    if spec.get("field") not in columns:
        raise PredicateError(f"unknown field {spec.get('field')!r}")
    c, op = F.col(columns[spec["field"]]), spec.get("op")
    if op == "exists":
        return c.isNotNull()
    if op not in RULE_OPS:
        raise PredicateError(f"unsupported operator {op!r}")
    value = spec.get("value")
    wants_list = op in ("in", "not_in")
    values = value if wants_list else [value]
    if (wants_list and not isinstance(value, (list, tuple))) or not values or \
            not all(isinstance(v, str) for v in values):
        raise PredicateError(f"{op} takes string literals")
    test = {
        "eq": lambda: c == value, "ne": lambda: c != value,
        "gt": lambda: c > value, "gte": lambda: c >= value,
        "lt": lambda: c < value, "lte": lambda: c <= value,
        "in": lambda: c.isin(list(values)), "not_in": lambda: ~c.isin(list(values)),
        "contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value),
        "ends_with": lambda: c.endswith(value), "matches": lambda: c.rlike(value),
    }[op]()
    return c.isNotNull() & test


def rule_errors(spec: dict, v: Column) -> Column:
    """First reason the rule cannot be evaluated on the event object ``v``."""
    from siemspark.functions.fields import string_field_error

    return F.coalesce(*[string_field_error(v, f) for f in rule_fields(spec)])
