"""Cleaning expressions: every function maps Column -> Column.

All of them are built-in Spark expressions (no Python UDF), so they stay inside
whole-stage codegen. ANSI mode is on in Spark 4, hence ``try_*`` everywhere:
a bad value becomes null (and then the documented default), never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

# --- fixed values (must equal the exports' conventions) -----------------------
DEFAULT_TEXT = "Non défini"          # placeholder for empty / missing text
NAN_TEXT = "nan"                     # literal text treated as missing
ZERO_DATE = "00000000"               # "no date" sentinel in compact dates
BYTES_PER_MIB = 1024 * 1024
MS_PER_SECOND = 1000.0
SHORT_LABEL_CHARS = 70
SHORT_LABEL_SUFFIX = "..."
# -------------------------------------------------------------------------------

# Text accepted as a number: optional sign, digits with an optional fraction,
# optional exponent, or inf / infinity / nan. Anything else (``1d``, ``0x1A``,
# ``1_000``, ``1,5``, ``True``) is not a number, although Spark's cast would
# accept some of it.
# (a decimal number may be padded with whitespace; inf / infinity / nan may not)
_NUMBER_RE = r"^(\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?(?i:inf|infinity|nan))$"
_NUM = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
# ``MM:SS`` or a single number, each part optionally padded with whitespace
_MM_SS_RE = rf"^\s*{_NUM}\s*(?::\s*{_NUM}\s*)?$"
# Unicode whitespace as Python's str.isspace() defines it (what the exports'
# cleaning treats as blank), written out as an explicit class for SQL engines.
WHITESPACE_CLASS = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same set for Java regexes: the Unicode White_Space property (``\s`` under
# UNICODE_CHARACTER_CLASS) plus U+001C..U+001F. Java matches a property class
# about 20x faster than the explicit list of ranges.
JAVA_WHITESPACE_CLASS = r"\s\x{1C}-\x{1F}"
# Whitespace at either end (str.strip semantics).
EDGE_SPACE_RE = rf"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$"
# Runs of characters that are neither printable ASCII nor whitespace.
NON_PRINTABLE_RE = rf"[^\x{{20}}-\x{{7E}}{WHITESPACE_CLASS}]+"
NUMBER_RE = _NUMBER_RE
_NON_PRINTABLE_RE = rf"(?U)[^\x{{20}}-\x{{7E}}{JAVA_WHITESPACE_CLASS}]+"
# The same set as characters, for trim(): ASCII controls 09-0D and 1C-1F, space,
# U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE_CHARS = "".join(map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_strip(c: Column | str) -> Column:
    """Strip Unicode whitespace at both ends (plain ``trim`` only strips ASCII space).

    ``trim`` with a character set works on the UTF-8 bytes directly, no regex."""
    return F.trim(_col(c), F.lit(WHITESPACE_CHARS))


def clean_string(c: Column | str, default: str = DEFAULT_TEXT) -> Column:
    """Strip, replace non-printable runs by a space, strip again; missing -> default.

    null, the text ``nan`` and text that ends up empty all become ``default``.
    Accented letters count as non-printable (an export convention), a
    non-breaking space inside the text is kept.

    The replacement never touches whitespace, so one strip after it gives the
    same text as stripping before and after. ``nullif`` evaluates its argument
    once, so the regex runs once per value.
    """
    text = unicode_strip(F.regexp_replace(_col(c).cast("string"), _NON_PRINTABLE_RE, " "))
    return F.coalesce(F.nullif(F.nullif(text, F.lit("")), F.lit(NAN_TEXT)), F.lit(default))


def to_double(c: Column | str, source_type: DataType | None = None) -> Column:
    """Numeric coercion: unparsable, null or NaN -> 0.0; +-inf is kept."""
    c = _col(c)
    if isinstance(source_type, NumericType):
        v = c.cast("double")
    else:
        s = c.cast("string")
        v = F.when(s.rlike(_NUMBER_RE), _tc(F.trim(s), "double"))
        # an overflowing literal (1e1000) is not a number; only an explicit inf text is infinite
        # (the right-hand test only runs for infinite values)
        v = F.when((F.abs(v) == F.lit(float("inf"))) & ~s.rlike("(?i)inf"), F.lit(None)).otherwise(v)
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def _tc(c: Column, to: str) -> Column:
    # Column.try_cast exists since Spark 4.0.
    return c.try_cast(to)


def eu_number(c: Column | str, source_type: DataType | None = None) -> Column:
    """European number text ``1.234,5`` / ``1 234,5`` -> 1234.5; invalid -> 0.

    Spaces and dots (thousands separators) are dropped, the comma becomes the
    decimal point. Numeric input passes through unchanged.
    """
    if isinstance(source_type, NumericType):
        return to_double(c, source_type)
    s = F.translate(_col(c).cast("string"), " .", "")
    return to_double(F.translate(s, ",", "."))


def mm_ss_seconds(c: Column | str, source_type: DataType | None = None) -> Column:
    """``MM:SS`` -> whole seconds (truncated toward zero) as double.

    One part -> that number truncated; three or more parts, invalid parts,
    non-text input, null or non-finite -> 0.
    """
    if source_type is not None and not isinstance(source_type, StringType):
        return F.lit(0.0)
    s = _col(c).cast("string")
    parts = F.split(s, ":")
    first = _tc(F.trim(parts.getItem(0)), "double")
    total = F.when(F.size(parts) == 2, first * 60 + _tc(F.trim(parts.getItem(1)), "double")).otherwise(first)
    # one anchored regex validates the whole text (one or two numeric parts)
    return F.coalesce(F.when(s.rlike(_MM_SS_RE), _tc(total, "bigint")), F.lit(0)).cast("double")


def compact_datetime(date_c: Column | str, time_c: Column | str) -> Column:
    """``yyyyMMdd`` + unpadded ``Hmmss`` -> timestamp_ntz; invalid -> null.

    The time is left-padded to six digits only when shorter (never truncated);
    the 14-digit result is parsed strictly, so hour 25 or a 7-digit time gives null.
    """
    t = _col(time_c).cast("string")
    t = F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)
    s = F.concat(_col(date_c).cast("string"), t)
    ok = s.rlike(r"^[0-9]{14}$")

    def num(start: int, length: int) -> Column:
        return F.substring(s, start, length).cast("int")

    ts = F.try_make_timestamp_ntz(num(1, 4), num(5, 2), num(7, 2), num(9, 2), num(11, 2),
                                  num(13, 2).cast("decimal(8,6)"))
    # make_timestamp rolls second 60 over to the next minute; a strict parse rejects it
    return F.when(ok & (num(13, 2) < 60), ts)


def parse_datetime_text(c: Column | str) -> Column:
    """A date-time text in ISO form -> timestamp_ntz (invalid -> null); see ``parse_datetime_column`` for other forms."""
    return _tc(_col(c).cast("string"), "timestamp_ntz")


# fixed values: the written forms of a date-time column that are told apart, in the order that settles ties (a date that
# can be read either way is month first); None is the ISO form. The time part may be missing.
_TIME = "[ H:m[:s]]"
DATETIME_FORMS = (
    None,
    f"M/d/yyyy{_TIME}", f"d/M/yyyy{_TIME}", f"d.M.yyyy{_TIME}", f"M-d-yyyy{_TIME}", f"d-M-yyyy{_TIME}",
    f"yyyy/M/d{_TIME}", f"yyyy.M.d{_TIME}",
    f"d MMM yyyy{_TIME}", f"d MMMM yyyy{_TIME}", f"MMM d, yyyy{_TIME}", f"MMMM d, yyyy{_TIME}", f"d-MMM-yyyy{_TIME}",
    "M/d/yyyy h:m[:s] a", "d/M/yyyy h:m[:s] a",
    f"M/d/yy{_TIME}", f"d/M/yy{_TIME}", f"d.M.yy{_TIME}", f"d-MMM-yy{_TIME}",
)
#: Two-digit years from here on belong to the century before.
PIVOT_YEAR = 2069


# What a field of a form can look like at most: the parser takes leading zeros, no sign but a year's, and
# values in range.
_FIELDS = {"yyyy": r"[+-]?[0-9]{4,}", "yy": r"[0-9]{2}", "M": r"0*(?:[1-9]|1[0-2])",
           "d": r"0*(?:[1-9]|[12][0-9]|3[01])", "H": r"0*(?:1?[0-9]|2[0-3])", "h": r"0*(?:[1-9]|1[0-2])",
           "m": r"0*[1-5]?[0-9]", "s": r"0*[1-5]?[0-9]", "MMM": r"[^0-9]+?", "MMMM": r"[^0-9]+?", "a": r"[^0-9]+"}
_PART_RE = re.compile(r"(?P<field>([A-Za-z])\2*)|(?P<open>\[)|(?P<close>\])|(?P<mark>.)")


def form_guard(form: str) -> str:
    """A regular expression that every text of a form matches; the form's parser, which raises an exception inside for
    each text it refuses, then sees hardly any other (the 31st of a short month)."""
    out = []
    for m in _PART_RE.finditer(form):
        if m["field"]:
            out.append(_FIELDS[m["field"]])
        else:
            out.append("(?:" if m["open"] else ")?" if m["close"] else re.escape(m["mark"]))
    return "^" + "".join(out) + "$"


def form_shapes(form: str) -> list[str]:
    """What ``cell_shape`` can give for texts of a form: with and without its optional parts."""
    shape = "".join("a" if m["field"] in ("MMM", "MMMM", "a") else "9" if m["field"] else m[0] for m in _PART_RE.finditer(form))
    shapes = [shape]
    while any("[" in x for x in shapes):  # from the innermost optional part outwards
        shapes = [re.sub(r"\[([^\[\]]*)\]", keep, x, count=1) for x in shapes for keep in (r"\1", "")]
    return sorted({re.sub("9+", "9", x.replace("-", "")) for x in shapes})


def cell_shape(text: Column) -> Column:
    """A text without signs, each number as ``9`` and each run of other characters than separators as ``a``: what most
    forms can be told apart by, worked out once per cell."""
    numbers = F.regexp_replace(F.translate(text, "+-", ""), "[0-9]+", "9")
    return F.regexp_replace(numbers, "[^9/.,: ]+", "a")


def _by_form(text: Column, form: str | None, shape: Column | None = None) -> Column:
    if form is None:
        return _tc(text, "timestamp_ntz")
    fits = text.rlike(form_guard(form))
    if shape is not None:
        fits = shape.isin(form_shapes(form)) & fits
    ts = F.when(fits, F.try_to_timestamp(text, F.lit(form))).cast("timestamp_ntz")
    if "yyyy" in form:
        return ts
    return F.when(F.year(ts) >= PIVOT_YEAR, ts - F.expr("INTERVAL 100 YEARS")).otherwise(ts)


def datetime_form(df: DataFrame, column: str) -> Column:
    """The form that parses most cells of a text column, as its number in DATETIME_FORMS: a scalar subquery.

    One pass with a partial aggregate counts for every form the cells that it parses; ties go to the form listed first.
    Null if no cell has any of the forms. A form is the column's, not the cell's: 3/4 is read like the rest of its column.
    """
    text = F.trim(F.col(f"`{column}`").cast("string"))
    cells = df.select(text.alias("t"), cell_shape(text).alias("shape"))
    votes = [F.count(_by_form(F.col("t"), form, F.col("shape"))).alias(f"n{i}") for i, form in enumerate(DATETIME_FORMS)]
    ranked = [F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(DATETIME_FORMS))]
    best = F.array_max(F.array(*ranked))
    return cells.agg(*votes).select(F.when(best["n"] > 0, -best["i"]).alias("form")).scalar()


def parse_datetime_column(df: DataFrame, column: str) -> Column:
    """A text column read in the form that most of its cells have -> timestamp_ntz; cells of another form -> null.

    Lazy: the vote is evaluated with the output. Each cell is parsed once, by the winner.
    """
    text = F.trim(F.col(f"`{column}`").cast("string"))
    # the vote stands in the plan once, not once per form: planning costs more than reading where tables are small.
    # ``elt`` works out the chosen text alone
    chosen = F.elt(datetime_form(df, column) + 1, *[_by_form(text, f).cast("string") for f in DATETIME_FORMS])
    return _tc(chosen, "timestamp_ntz")


def compact_date(c: Column | str) -> Column:
    """``yyyyMMdd`` -> date; the ``00000000`` sentinel and invalid text -> null."""
    s = F.nullif(_col(c).cast("string"), F.lit(ZERO_DATE))
    return F.when(s.rlike(r"^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))


def short_label(c: Column | str, n: int = SHORT_LABEL_CHARS, suffix: str = SHORT_LABEL_SUFFIX) -> Column:
    """First ``n`` characters + ``...`` when the text is longer than ``n``."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def thousands_label(c: Column | str) -> Column:
    """Integer part with a space every three digits: 1234567.9 -> ``1 234 567``."""
    return F.replace(F.format_number(_tc(_col(c), "bigint"), 0), F.lit(","), F.lit(" "))


def ms_to_seconds(c: Column | str) -> Column:
    return _col(c) / F.lit(MS_PER_SECOND)


def bytes_to_mib(c: Column | str) -> Column:
    return _col(c) / F.lit(float(BYTES_PER_MIB))


def as_text(c: Column | str) -> Column:
    """Key copy as text for display."""
    return _col(c).cast("string")


# --- column names (driver-side metadata only; no job) ----------------------------

def clean_column_name(name: object) -> str:
    """The ASCII letters and digits of a name, each run of anything else between them as one ``_``.

    Control characters (C0, DEL, C1) vanish without separating what stands around them.
    """
    visible = (ch for ch in str(name) if not (ch < " " or "\x7f" <= ch <= "\x9f"))
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in visible).split(" ")
    return "_".join(w for w in words if w)


def clean_column_names(names: list[str]) -> list[str]:
    """Clean every name; two raw names that clean to the same name are an error."""
    cleaned = [clean_column_name(n) for n in names]
    seen: dict[str, str] = {}
    for raw, new in zip(names, cleaned):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {raw!r} both clean to {new!r}")
        seen[new] = raw
    return cleaned
