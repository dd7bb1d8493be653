"""Column builders on names, times and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters that have others in their place in ASCII headers, and these; all else beyond ASCII is dropped.
ACCENTED = "áàãâäéèêëíìîïóòõôöúùûüçÇñÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucCnN"


# The mosaics a camera may have.
MOSAICS = ("RGGB", "BGGR", "GRBG", "GBRG")


def mosaic(*cards: Column) -> Column:
    """The first card that names a mosaic, in capitals; null if none does."""
    names = [F.upper(F.regexp_replace(F.trim(c), "^'+|'+$", "")) for c in cards]
    return F.coalesce(*(F.when(n.isin(*MOSAICS), n) for n in names))


def json_safe(fields: dict[str, Column]) -> Column:
    """JSON of an object of numbers, where those that aren't finite are null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.to_json(F.struct(*(finite(c.cast("double")).alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def natural_key(name: Column) -> Column:
    """Sorts names with numbers in them by number: an array of (is text, number, text)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"))
    number = lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)"))
    return F.transform(parts, lambda p: F.struct(number(p).isNull().cast("int").alias("kind"), F.coalesce(number(p), F.lit(0)).alias("number"), p.alias("text")))


def sequence_key(name: Column) -> tuple[Column, Column, Column]:
    """Names that end in ``_<number>.<ext>`` first, by number; then the others by name."""
    digits = F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1)
    return (digits == "").cast("int"), F.when(digits != "", digits.cast("bigint")), F.lower(name)


def ascii_fold(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x20-\x7e]", "")


def timestamp_state(text: Column) -> tuple[Column, Column, Column]:
    """(epoch microseconds, state, zone text) of an ISO time; without a zone it is UTC."""
    basic = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})"
    extended = F.regexp_replace(F.trim(text), basic, "$1-$2-$3T$4:$5:$6")
    time = F.when(extended.rlike(r"^\d{4}-\d{2}-\d{2}"), extended.try_cast("timestamp"))
    zone = F.nullif(F.regexp_extract(extended, r"\d{2}:\d{2}[0-9:.]*(Z|[+-]\d{2}:?\d{2})$", 1), F.lit(""))
    return F.unix_micros(time), F.when(time.isNull(), "unknown").otherwise("valid"), F.when(time.isNotNull(), zone)


def fingerprint(*values: Column, length: int = 16) -> Column:
    """The head of the SHA-256 of the values' canonical text."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256), 1, length)
