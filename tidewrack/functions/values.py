"""Value normalisers and date functions: raw text to one struct (``RESULT``), without UDFs.

Every normaliser gives the same struct, in which the fields that do not apply are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import unit

RESULT = {"num": "double", "num2": "double", "flag": "boolean", "text": "string", "unit": "string", "kind": "string", "status": "string", "error": "string"}
#: Patterns of values.
NUMBER_UNIT = r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"
PAIR = r"^\s*([+-]?\d+\.?\d*)\s*[,/\s]\s*([+-]?\d+\.?\d*)\s*$"
COMPASS = r"(?i)^\s*(\d+\.?\d*)\s*°?\s*([NS])\s*[,/\s]+\s*(\d+\.?\d*)\s*°?\s*([EW])\s*$"
RANGE = r"^\s*([+-]?\d*\.?\d+)\s*(?:[-~–—]|to)\s*([+-]?\d*\.?\d+)\s*([^\s,]*)\s*"
RATIO = r"^\s*([+-]?\d*\.?\d+)\s*:\s*([+-]?\d*\.?\d+)\s*$"
#: Date formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "yyyy-M", "yyyy/M", "yyyy", "MMM yyyy", "MMMM yyyy"]


def made(kind: str, **fields: Column) -> Column:
    return F.struct(*[fields.get(n, F.lit(kind) if n == "kind" else F.lit(None)).cast(t).alias(n) for n, t in RESULT.items()])


def failed(kind: str, why: str) -> Column:
    return made(kind, status=F.lit("failed"), error=F.lit(why))


def ok(kind: str, **fields: Column) -> Column:
    return made(kind, status=F.lit("ok"), **fields)


def part(c: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def number(c: Column) -> Column:
    return c.try_cast("double")


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def float_with_unit(c: Column, preferred: Column | None = None) -> Column:
    """M4: leading number and canonical unit; ``preferred``: array of units that are asked for."""
    n, u = number(part(c, NUMBER_UNIT, 1)), unit(F.regexp_extract(c, NUMBER_UNIT, 2))
    wanted = F.transform(preferred, unit) if preferred is not None else F.array().cast("array<string>")
    status = F.when((F.size(wanted) == 0) | ((u != "") & F.array_contains(wanted, u)), "ok").when(u == "", "failed").otherwise("out_of_preferred")
    found = made("measurement", num=n, unit=u, status=status, error=F.when(status == "failed", "unit missing"))
    return F.when(F.coalesce(c, F.lit("")) == "", failed("measurement", "empty value")).when(n.isNull(), failed("measurement", "no leading number")).otherwise(found)


def float_only(c: Column) -> Column:
    """M5: what ANSI text-to-double casts read, which leaves out underscores between digits."""
    n = number(F.trim(c))
    return F.when(n.isNull(), failed("number", "not a number")).otherwise(ok("number", num=n))


def integer(c: Column) -> Column:
    """M6: truncated towards zero; infinities and not-a-number fail."""
    n = number(F.trim(c))
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) > 9e18), failed("integer", "not an integer")).otherwise(ok("integer", num=whole))


def boolean(c: Column) -> Column:
    """M7."""
    s = F.lower(clean(c))
    return F.when(s.isin("true", "yes", "1", "y", "t"), ok("boolean", flag=F.lit(True))).when(s.isin("false", "no", "0", "n", "f"), ok("boolean", flag=F.lit(False))).otherwise(failed("boolean", "not a boolean"))


def lat_lon(c: Column) -> Column:
    """M8: decimal pair or compass form (num: latitude, num2: longitude); no range check."""
    s = clean(c)
    sign = lambda n, low: F.when(F.upper(part(s, COMPASS, n)) == low, -1.0).otherwise(1.0)
    pair = ok("coordinate", num=number(part(s, PAIR, 1)), num2=number(part(s, PAIR, 2)))
    compass = ok("coordinate", num=number(part(s, COMPASS, 1)) * sign(2, "S"), num2=number(part(s, COMPASS, 3)) * sign(4, "W"))
    return F.when(s.rlike(PAIR), pair).when(s.rlike(COMPASS), compass).otherwise(failed("coordinate", "unrecognized"))


def value_range(c: Column) -> Column:
    """M9: first range (num: least, num2: greatest); a comma after it makes it out_of_preferred."""
    s = clean(c)
    more = F.ltrim(F.regexp_replace(s, RANGE, "")).startswith(",")
    found = made("range", num=number(part(s, RANGE, 1)), num2=number(part(s, RANGE, 2)), unit=unit(F.regexp_extract(s, RANGE, 3)), status=F.when(more, "out_of_preferred").otherwise("ok"))
    return F.when(s.rlike(RANGE), found).otherwise(failed("range", "not a range"))


def enum(c: Column, syntax: Column) -> Column:
    """Exact option, else the first that contains the value or is contained in it; without options any text."""
    s = F.lower(clean(c))
    inside = part(syntax, r"\[([^\]]+)\]", 1)
    options = F.transform(F.split(inside, r"\|"), lambda o: F.lower(F.trim(o)))
    near = F.filter(options, lambda o: F.contains(s, o) | F.contains(o, s))
    return (
        F.when(s == "", failed("enum", "empty")).when(inside.isNull(), ok("enum", text=F.trim(c))).when(F.array_contains(options, s), ok("enum", text=s))
        .when(F.size(near) > 0, ok("enum", text=F.try_element_at(near, F.lit(1)))).otherwise(failed("enum", "not an option"))
    )


def ratio(c: Column) -> Column:
    """M11."""
    s = clean(c)
    return F.when(s.rlike(RATIO), ok("ratio", num=number(part(s, RATIO, 1)), num2=number(part(s, RATIO, 2)))).otherwise(failed("ratio", "not a ratio"))


def compound(c: Column, preferred: Column | None = None) -> Column:
    """``text;number unit``."""
    s = clean(c)
    rest = float_with_unit(F.trim(F.regexp_replace(s, "^[^;]*;", "")), preferred)
    return F.when(~F.contains(s, F.lit(";")), ok("compound", text=s)).otherwise(rest.withField("text", F.trim(F.substring_index(s, ";", 1))).withField("kind", F.lit("compound")))


def passthrough(c: Column) -> Column:
    """M13."""
    return ok("text", text=clean(c))


def timestamp(c: Column) -> Column:
    """D3: the first format that fits, day before month; a year or month alone is its first day."""
    s = clean(c)
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]
    t = F.coalesce(*tries)
    return F.when(s == "", failed("datetime", "empty")).when(t.isNull(), failed("datetime", "unrecognized date format")).otherwise(ok("datetime", text=F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")))


def duration(c: Column) -> Column:
    """ISO 8601; whole numbers lose their decimals, others keep six."""
    s = F.lower(clean(c))
    pattern = r"^([+-]?\d+\.?\d*)\s*([a-z]+)?\s*$"
    n, u = number(part(s, pattern, 1)), unit(F.regexp_extract(s, pattern, 2))
    digits = F.regexp_replace(F.format_string("%.6f", n), r"\.000000$", "")
    iso = F.when(u == "second", F.concat(F.lit("PT"), digits, F.lit("S"))).when(u == "minute", F.concat(F.lit("PT"), digits, F.lit("M"))).when(u == "hour", F.concat(F.lit("PT"), digits, F.lit("H"))).when(u == "day", F.concat(F.lit("P"), digits, F.lit("D")))
    return F.when(n.isNull(), failed("duration", "unrecognized")).when(iso.isNull(), failed("duration", "unsupported unit")).otherwise(ok("duration", text=iso))


def normalized(c: Column, normalizer: Column, syntax: Column, preferred: Column) -> Column:
    """By the name of the normaliser; unknown names pass the text through."""
    by_name = {
        "float_with_unit": float_with_unit(c, preferred), "float": float_only(c), "integer": integer(c), "boolean": boolean(c), "lat_lon": lat_lon(c), "range": value_range(c),
        "enum": enum(c, syntax), "ratio": ratio(c), "compound": compound(c, preferred), "timestamp": timestamp(c), "duration": duration(c),
    }
    return F.coalesce(*[F.when(normalizer == n, x) for n, x in by_name.items()], passthrough(c))


def year_bin(c: Column) -> Column:
    """Half-open five-year bins from 2000, the last one 2020 to 2026 with both ends; else ``unknown``."""
    y = c.try_cast("int")
    low = (F.floor(y / 5) * 5).cast("int")
    return F.when((y >= 2020) & (y <= 2026), "2020-2026").when((y >= 2000) & (y < 2020), F.concat(low.cast("string"), F.lit("-"), (low + 5).cast("string"))).otherwise("unknown")


def era(year: Column) -> Column:
    """D2."""
    return F.when(year <= 2015, "early").when(year <= 2020, "middle").when(year > 2020, "late").otherwise("unknown")
