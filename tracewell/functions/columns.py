"""Scalar rules as column expressions: they stay in the JVM and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no provenance, one list for quirks and one for residuals.
QUIRK_STOP = (
    "self none true false return returns this that with from into list dict type value data name args kwargs param params default object string bytes "
    "index result using used will when each also they class method function number count length size"
).split()
RESIDUAL_STOP = (
    "self none true false return with from this that list dict type value data name args kwargs param default object string bytes index result using used "
    "will when each also class method function number count length size text char characters sequence"
).split()

# Spellings of encoding labels, folded by the agreement report.
REPORT_ALIASES = {
    "ascii": "ascii",
    "windows-1252": "windows-1252",
    "cp1252": "windows-1252",
    "iso-8859-1": "iso-8859-1",
    "latin-1": "iso-8859-1",
    "shift_jis": "shift_jis",
    "shift-jis": "shift_jis",
    "sjis": "shift_jis",
    "cp932": "shift_jis",
    "gb18030": "gb18030",
    "gb2312": "gb18030",
    "gbk": "gb18030",
    "utf-8": "utf-8",
    "utf8": "utf-8",
    "utf-16": "utf-16",
    "utf-16le": "utf-16le",
    "utf-16be": "utf-16be",
    "euc-jp": "euc-jp",
    "euc-kr": "euc-kr",
    "big5": "big5",
}
# Spellings folded by the pilot, after lower-casing, `_` to `-` and dropping spaces.
PILOT_ALIASES = {
    "utf8": "utf-8",
    "latin1": "iso-8859-1",
    "latin-1": "iso-8859-1",
    "iso8859-1": "iso-8859-1",
    "cp1252": "windows-1252",
    "us-ascii": "ascii",
    "gb2312": "gb18030",
    "gbk": "gb18030",
    "sjis": "shift-jis",
    "shiftjis": "shift-jis",
}


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b; `otherwise` if b is zero or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def rel_diff(a: Column, b: Column) -> Column:
    """|a - b| / (|a| + |b|); 0 for two zeros."""
    return safe_div(F.abs(a - b), F.abs(a) + F.abs(b))


def normalised_text(text: Column) -> Column:
    """Lines without white space at their ends, blank lines dropped, joined by line feeds."""
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""), "\n")


def words(text: Column, least: int = 4) -> Column:
    """Lower-cased runs of at least `least` ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), 1)


def shingles(items: Column, size: int) -> Column:
    """Every run of `size` items, joined by spaces; none if there are fewer.

    The items are bound to a lambda's variable: an expression would be worked out again for every run.
    """
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, size), " "))
    return F.element_at(F.transform(F.array(items), lambda x: F.when(F.size(x) >= size, runs(x)).otherwise(F.array().cast("array<string>"))), 1)


def is_message(text: Column) -> Column:
    """Human-readable: 8 to 200 characters, a space, nothing unprintable."""
    return F.length(text).between(8, 200) & text.contains(" ") & ~text.rlike(r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}")


def message(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_distinctive(name: Column) -> Column:
    """A compound identifier: six characters or more, no leading dunder, snake or camel."""
    return (F.length(name) >= 6) & ~name.startswith("__") & name.rlike("_|[a-z][A-Z]")


def degree_bucket(degree: Column) -> Column:
    """0 for 0, else one more than the floor of the binary logarithm."""
    return F.when(degree <= 0, F.lit(0)).otherwise((F.floor(F.log2(degree.cast("double"))) + 1).cast("int"))


def band(cyclomatic: Column) -> Column:
    return F.when(cyclomatic >= 8, "load-bearing").when(cyclomatic >= 5, "substantive").when(cyclomatic >= 3, "minor").otherwise("trivial")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence >= 0.9, "high").when(confidence >= 0.5, "med").otherwise("low")


def _folded(key: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def report_label(label: Column) -> Column:
    """Null or empty: null; else trimmed, lower-cased, folded."""
    return F.when(F.length(label) > 0, _folded(F.lower(F.trim(label)), REPORT_ALIASES))


def report_bucket(label: Column, confidence: Column) -> Column:
    """Folded label; sure answers of ASCII and its two supersets are one."""
    folded = report_label(label)
    return F.when((confidence_bucket(confidence) == "high") & folded.isin("ascii", "windows-1252", "iso-8859-1"), "ascii_or_latin_family").otherwise(folded)


def pilot_label(label: Column) -> Column:
    """Null, empty and error labels as they are; else folded the pilot's way."""
    folded = _folded(F.replace(F.replace(F.lower(label), F.lit("_"), F.lit("-")), F.lit(" "), F.lit("")), PILOT_ALIASES)
    return F.when(label.isNull() | (label == "") | label.startswith("ERR"), label).otherwise(folded)


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two map<string,int> histograms of one row."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: zero(x) * zero(y))), F.lit(0.0), lambda s, x: s + x)
    return safe_div(dot, F.sqrt(total(a)) * F.sqrt(total(b)))


def pair_distance(cosine: Column, depth_a: Column, depth_b: Column, stmts_a: Column, stmts_b: Column) -> Column:
    return 0.6 * (1 - cosine) + 0.2 * rel_diff(depth_a, depth_b) + 0.2 * rel_diff(stmts_a, stmts_b)


def number_after(text: Column, key: str) -> Column:
    """The first number in `key=number`; null if there is none."""
    return F.regexp_extract(text, rf"\b{key}=(-?[0-9.]+)", 1).try_cast("double")


def hash_index(*parts: Column, modulus: int | Column) -> Column:
    """A number below `modulus` that depends on the parts alone: any engine with md5 can repeat the draw."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    return digest % (F.lit(modulus) if isinstance(modulus, int) else modulus)
