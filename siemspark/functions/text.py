"""Strict text helpers shared by the parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siemspark.functions.scalars import col

# The Unicode White_Space characters.
WHITE_SPACE = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_space(c) -> Column:
    return F.btrim(col(c), F.lit(WHITE_SPACE))


#: Ends the array in which a text is read; a text that holds it is read another way.
_END = "end-of-text-5c1f"


def strict_json(text) -> Column:
    """The JSON value of the whole text, SQL NULL when the text is not JSON.

    ``parse_json`` stops after the first value.  The text is read as the first of two elements of an array: if anything
    but white space follows its value, the second one is not where it must be.
    """
    text = col(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    whole = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    # Inside both an object and an array only white space can follow a value.
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(~text.contains(_END), F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))).otherwise(
        F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant")))


# --- canonical JSON --------------------------------------------------------

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# From the end of the last match over strings and all that is no number, to a whole number that is no key.
_NUMBER = (r"(?s)\G((?:[^\"0-9\-]++|" + _STRING + r")*+)"
           r"((?>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?))(?!\s*+:)")
# Numbers that a JSON value does not keep as they are written (or digits in a string that look so).
_RESPELLED = r"[0-9][.eE]|-0|[0-9]{19}"
_MARKS = ("\\u0001", "\\u0002", "\\u0003", "\\u0004", "\\u0005", "\\u0006", "\\u0007")


def once(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used, and not copied into the generated code."""
    return F.transform(F.array(value), use)[0]


def _spelled(text: Column) -> Column:
    """Canonical JSON whose numbers go through the parser as strings that begin with a mark; NULL if no mark is left."""
    mark = F.filter(F.lit(list(_MARKS)), lambda m: ~text.contains(m))
    inside = F.regexp_replace(text, F.lit(_NUMBER), F.concat(F.lit('$1"\\'), F.get(mark, F.lit(0)), F.lit('$2"')))
    pattern = F.concat(F.lit('"\\'), F.get(mark, F.lit(0)), F.lit('(-?[0-9.eE+-]++)"'))
    return F.regexp_replace(F.to_json(F.try_parse_json(inside)), pattern, F.lit("$1"))


def _small_escapes(text: Column) -> Column:
    """Control characters are escaped with small letters; pairs of backslashes before them are characters of their own."""
    codes = [f"u00{c}" for c in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")]
    return F.aggregate(F.lit(codes), text, lambda t, code: F.regexp_replace(
        t, F.concat(F.lit(r"(?<!\\)((?:\\\\)*+)\\"), code), F.concat(F.lit(r"$1\\"), F.lower(code))))


def canonical_json(text, value: Column | None = None) -> Column:
    """Keys sorted at every level, no white space, strings with the shortest escapes, numbers as they are written.

    ``value`` may hold the text's JSON value already; NULL where the text is not JSON.  Numbers
    keep their spelling unless the text spells out all seven control characters from 1 to 7 as escapes.
    """
    text = col(text)

    def written(value):
        plain = F.to_json(value)
        out = F.when(~text.rlike(_RESPELLED), plain).otherwise(F.coalesce(_spelled(text), plain))
        return F.when(value.isNotNull(), F.when(text.contains("\\u00"), _small_escapes(out)).otherwise(out))

    return once(strict_json(text), written) if value is None else written(value)


# --- the shape of JSON -----------------------------------------------------

_PLAIN = r"[^\[\]{}]"
_INNERMOST = rf"[\[{{]{_PLAIN}*+[\]}}]"
_STEP = 8


def _up_to(levels: int) -> str:
    """A collection with at most so many levels, as a pattern that never steps back."""
    inside = _PLAIN
    for _ in range(levels - 1):
        inside = rf"(?:{_PLAIN}++|[\[{{]{inside}*+[\]}}])"
    return rf"[\[{{]{inside}*+[\]}}]"


def count_of(text: Column, marks: str) -> Column:
    """How often any of some ASCII characters occurs; a list of all matches would be many times slower."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit(""))) for m in marks), F.lit(0))


def brackets(text: Column) -> Column:
    """How many collections a text can hold at most."""
    return count_of(text, "[{")


def _rounds(shape: Column, levels: int, most: int) -> Column:
    """A number for each of ``most`` rounds that take away ``levels`` levels, but no more than the shape has levels."""
    needed = F.least(F.lit(most), F.ceil(brackets(shape) / levels).cast("int"))
    return F.sequence(F.lit(1), F.greatest(F.lit(1), needed))


def json_shape(text: Column) -> Column:
    """A JSON text whose strings are an x each, so all brackets, commas and colons are marks."""
    return F.regexp_replace(text, F.lit("(?s)" + _STRING), F.lit("x"))


def collapsed(shape: Column, times: int) -> Column:
    """The shape after its innermost collections were replaced by an x so many times.

    Replacing all collections of up to ``_STEP`` levels at once is as many rounds of replacing the innermost ones.
    """
    steps, rest = divmod(times, _STEP)
    if steps:
        shape = F.aggregate(_rounds(shape, _STEP, steps), shape,
                            lambda s, _: F.regexp_replace(s, F.lit(_up_to(_STEP)), F.lit("x")))
    return F.regexp_replace(shape, F.lit(_up_to(rest)), F.lit("x")) if rest else shape


def widest_over(shape: Column, times: int, limit: int) -> Column:
    """Whether any collection of ``shape``, at most ``times`` deep, has more than ``limit`` members."""
    own = r"[^,\[\]{}]*+"
    wide = rf"[\[{{]{own}(?:,{own}){{{limit}}}+"
    start = F.struct(shape.alias("s"), F.lit(False).alias("over"))
    return F.aggregate(_rounds(shape, 1, times), start, lambda a, _: F.struct(
        F.regexp_replace(a["s"], F.lit(_INNERMOST), F.lit("x")).alias("s"),
        (a["over"] | a["s"].rlike(wide)).alias("over")))["over"]


def long_string_in(text: Column, limit: int) -> Column:
    """Whether a string of a JSON text has more than ``limit`` bytes, its escapes read."""
    def too_long(token):
        value = F.try_variant_get(F.try_parse_json(token), "$", "string")
        return (F.octet_length(token) > limit + 2) & (F.octet_length(value) > limit)

    return F.exists(F.regexp_extract_all(text, F.lit("(?s)" + _STRING), F.lit(0)), too_long)


_RFC3339 = ("^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?"
            "([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$")


def is_rfc3339(text) -> Column:
    """Shape, calendar and clock of an absolute RFC 3339 time."""
    text = col(text)
    local = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8))
    return F.coalesce(
        text.rlike(_RFC3339)
        & F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), F.lit(False))


def unsigned(text, maximum: int) -> Column:
    """Digits with an optional plus sign, at most ``maximum``; else NULL."""
    text = col(text)
    number = F.when(text.rlike("^\\+?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(number <= maximum, number.cast("long"))
