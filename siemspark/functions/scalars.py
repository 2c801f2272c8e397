"""Column helpers: identifiers, hashes, (seconds, nanos) times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical UUIDv7 text, lower-hex SHA-256 text, Protobuf
# timestamp range.
UUID_V7 = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}"
           "-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")
SHA256_HEX = "^[0-9a-f]{64}$"
TIMESTAMP_MIN_SECONDS = -62_135_596_800
TIMESTAMP_MAX_SECONDS = 253_402_300_799
TIMESTAMP_MAX_NANOS = 999_999_999

MODES = ("LIVE", "REPLAY", "TEST")
# Codes of the enums that take part in logical keys.
MODE_CODES = {"LIVE": 1, "REPLAY": 2, "TEST": 3}
RULE_TYPE_CODES = {"EVENT": 1, "THRESHOLD": 2, "CORRELATION": 3}
INPUT_TYPE_CODES = {"NORMALIZED_EVENT": 1, "SIGNAL": 2, "ENTITY": 3}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_uuid_v7(c) -> Column:
    return F.coalesce(col(c).rlike(UUID_V7), F.lit(False))


def is_sha256(c) -> Column:
    return F.coalesce(col(c).rlike(SHA256_HEX), F.lit(False))


def has_text(c) -> Column:
    """True for a value that is more than white space."""
    return F.coalesce(F.trim(col(c)) != "", F.lit(False))


def in_timestamp_range(seconds, nanos) -> Column:
    ok = (col(seconds).between(TIMESTAMP_MIN_SECONDS, TIMESTAMP_MAX_SECONDS)
          & col(nanos).between(0, TIMESTAMP_MAX_NANOS))
    return F.coalesce(ok, F.lit(False))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def floor_div(c, divisor) -> Column:
    """Whole-number division rounding down, also for negatives."""
    c, d = col(c).cast("long"), F.lit(divisor).cast("long")
    return F.call_function("div", c - F.pmod(c, d), d)


def millis(seconds, nanos) -> Column:
    return col(seconds).cast("long") * 1000 + floor_div(nanos, 1_000_000)


def seconds_of_millis(ms) -> Column:
    return floor_div(ms, 1000)


def nanos_of_millis(ms) -> Column:
    return (F.pmod(col(ms), F.lit(1000)) * 1_000_000).cast("int")


def rfc3339(seconds, nanos) -> Column:
    """UTC text with the shortest fraction that keeps all nanoseconds."""
    fraction = F.rtrim(F.lpad(col(nanos).cast("string"), 9, "0"), F.lit("0"))
    base = F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(col(nanos) == 0, "").otherwise(F.concat(F.lit("."), fraction)),
                    F.lit("Z"))


def enum_code(c, codes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails, NULL when all hold.

    ``checks`` are (name, condition that must hold); a NULL condition fails.
    """
    expr = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        expr = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(expr)
    return expr


def epoch_micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def settle(df, names):
    """Marks ``names`` as computed: later filters on them stay above.

    Catalyst moves a filter below a projection by copying the projected
    expressions into it.  For columns built in many layers that copy grows
    with every layer; a one-element ``inline`` keeps it from happening.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
