"""Reading dotted fields out of a JSON object without losing their state.

A field is PRESENT, ABSENT (some key on the way is missing), NULL (a JSON
null at the leaf or on the way) or MALFORMED (empty path or segment, or a
value on the way is not an object).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENT, ABSENT, NULL, MALFORMED = "PRESENT", "ABSENT", "NULL", "MALFORMED"
MAX_SAFE_INTEGER = 9_007_199_254_740_991
_NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _quoted(segments) -> str:
    return "$" + "".join("['" + s.replace("'", "\\'") + "']" for s in segments)


def _at(v: Column, segments) -> Column:
    return F.try_variant_get(v, _quoted(segments), "variant")


def _walk(v: Column, path: str, malformed, absent, null, present) -> Column:
    """One CASE from the root to the leaf; each step looks at a value's type once.

    ``present`` gets the type name of the leaf value.
    """
    segments = path.split(".")
    if not path or any(s == "" for s in segments):
        return malformed
    root = F.schema_of_variant(v)
    out = F.when(root.isNull() | ~root.startswith("OBJECT"), malformed)
    for depth in range(1, len(segments) + 1):
        kind = F.schema_of_variant(_at(v, segments[:depth]))
        out = out.when(kind.isNull(), absent).when(kind == "VOID", null)
        if depth < len(segments):
            out = out.when(~kind.startswith("OBJECT"), malformed)
    return out.otherwise(present(kind))


def field_state(v: Column, path: str) -> Column:
    """State of ``path`` in the variant column ``v``."""
    return _walk(v, path, F.lit(MALFORMED), F.lit(ABSENT), F.lit(NULL), lambda _: F.lit(PRESENT))


def strict_string(v: Column, path: str) -> Column:
    """The string at ``path``; SQL NULL unless the JSON value is a string."""
    here = _at(v, path.split("."))
    return F.when(F.schema_of_variant(here) == "STRING", F.try_variant_get(here, "$", "string"))


def is_number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(_at(v, path.split(".")))
    return kind.rlike(_NUMERIC)


def integral_number(v: Column, path: str) -> Column:
    """A whole number within the exactly representable range, else NULL."""
    number = F.when(is_number(v, path),
                    F.try_variant_get(_at(v, path.split(".")), "$", "double"))
    whole = (F.floor(number) == number) & (F.abs(number) <= F.lit(float(MAX_SAFE_INTEGER)))
    return F.when(whole, number.cast("long"))


def string_field_error(v: Column, path: str) -> Column:
    """Why a rule cannot use ``path`` as text; NULL when it can (or it is unset)."""
    none = F.lit(None).cast("string")
    return _walk(v, path, F.lit(f"field {path} is malformed"), none, none,
                 lambda kind: F.when(kind != "STRING", F.lit(f"field {path} is not a string")))


def number_field_error(v: Column, path: str) -> Column:
    """Why a rule cannot use ``path`` as a whole number; NULL when it can."""
    none = F.lit(None).cast("string")
    number = F.try_variant_get(_at(v, path.split(".")), "$", "double")
    whole = (F.floor(number) == number) & (F.abs(number) <= F.lit(float(MAX_SAFE_INTEGER)))
    return _walk(v, path, F.lit(f"field {path} is malformed"), none, none,
                 lambda kind: F.when(~kind.rlike(_NUMERIC), F.lit(f"field {path} is not numeric"))
                 .when(~whole, F.lit(f"field {path} is not an integral number")))
