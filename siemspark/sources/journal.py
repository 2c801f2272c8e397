"""Journal export text as canonical JSON entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD_NAME = "^[A-Z0-9_]{1,64}$"
DEFAULT_MAX_ENTRY = 1_048_576


def read_journal_export(spark: SparkSession, path: str) -> DataFrame:
    """Entries of export files: blocks separated by an empty line."""
    return (spark.read.option("lineSep", "\n\n").text(path)
            .where(F.trim(F.translate("value", "\n", "")) != "")
            .select(F.col("value").cast("binary").alias("entry")))


def _escape_html(text: Column) -> Column:
    # Characters the writer escapes besides the JSON minimum.
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026"),
                       (chr(0x2028), "2028"), (chr(0x2029), "2029")):
        text = F.replace(text, F.lit(char), F.lit("\\u" + code))
    return text


def journal_entries(df: DataFrame, entry: str, version_key: str = "journald_version",
                    max_entry: int = DEFAULT_MAX_ENTRY) -> DataFrame:
    """Adds ``cursor``, ``canonical`` and ``error`` to rows of export blocks.

    Bytes are viewed as Latin-1 while splitting, so values that are not UTF-8
    keep their exact bytes and are written as base64.
    """
    lines = F.filter(F.split(F.decode(F.col(entry), "ISO-8859-1"), "\n"), lambda x: x != "")

    def parts(line):
        at = F.instr(line, "=")
        value = F.encode(F.substring(line, at + 1, F.length(line)), "ISO-8859-1")
        return F.struct(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).alias("name"),
                        value.alias("value"))

    def shown(p):
        text = p["value"].cast("string")
        utf8 = F.is_valid_utf8(text)
        return F.struct(p["name"].alias("name"),
                        F.when(utf8, "utf8").otherwise("base64").alias("encoding"),
                        F.when(utf8, text).otherwise(F.base64(p["value"])).alias("value"))

    cursors = F.filter("_fields", lambda f: (f["name"] == "__CURSOR") & (f["encoding"] == "utf8")
                       & (f["value"] != ""))
    bad_name = F.exists("_fields", lambda f: ~F.coalesce(f["name"].rlike(FIELD_NAME), F.lit(False)))
    body = F.to_json(F.struct(F.lit(1).alias(version_key), F.col("cursor"),
                              F.col("_fields").alias("fields")), {"ignoreNullFields": "false"})
    return (df.withColumn("_fields", F.transform(F.transform(lines, parts), shown))
            .withColumn("cursor", F.try_element_at(cursors, F.lit(-1))["value"])
            .withColumn("error", F.when(F.octet_length(entry) > max_entry, "entry too large")
                        .when(F.size("_fields") == 0, "empty entry")
                        .when(bad_name, "invalid field name"))
            .withColumn("canonical", F.when(F.col("error").isNull(), _escape_html(body)))
            .drop("_fields"))


def one_evidence_form(fields: str, raw: str) -> Column:
    """Exactly one of the original field map and the raw form, and not empty."""
    has_fields, has_raw = F.col(fields).isNotNull(), F.col(raw).isNotNull()
    filled = (F.when(has_fields, (F.size(fields) > 0)
                     & ~F.exists(F.map_keys(fields), lambda k: k == ""))
              .otherwise(F.octet_length(raw) > 0))
    return F.coalesce((has_fields != has_raw) & filled, F.lit(False))
