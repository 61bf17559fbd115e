"""Text functions over symbols, documentation and source, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Budgets, markers and patterns that results depend on.
MAX_TOKENS = 8000
CHARS_PER_TOKEN = 4
MARKER = "\n// ... truncated ..."
METHODS_NOTE = "\n    // ... ({} methods, chunked for embedding)\n\n"
PREFIX_LINES = 20
PREFIX_MARGIN = 100
PROPERTY_TYPE = r"(?:public|protected|private)?\s*(?:static\s+)?(?:readonly\s+)?(\S+)\s+\$"
MODIFIERS = r"\b(?:public|protected|private|static|final|abstract)\s+"
ATTRIBUTES = r"#\[[^\]]*\]\s*"


def display_name(kind: Column, name: Column) -> Column:
    """name() for methods and functions, $name for properties."""
    return F.when(kind.isin("Method", "Function"), F.concat(name, F.lit("()"))).when((kind == "Property") & ~name.startswith("$"), F.concat(F.lit("$"), name)).otherwise(name)


def method_fqn(fqn: Column, kind: Column) -> Column:
    """fqn with () at its end if it is a method's."""
    return F.when((kind == "Method") & ~fqn.endswith("()"), F.concat(fqn, F.lit("()"))).otherwise(fqn)


def parameter_name(parameter: Column) -> Column:
    """$name of App\\C::m().$name; the whole string where there is no such part."""
    tail = F.regexp_extract(parameter, r"\.(\$[^.]*)$", 1)
    return F.when(tail != "", tail).otherwise(parameter)


def _bare(doc: Column) -> Column:
    return F.trim(F.replace(F.replace(doc, F.lit("```php"), F.lit("")), F.lit("```"), F.lit("")))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def signature(kind: Column, documentation: Column) -> Column:
    """From the first document with ``function `` in it: its lines up to the first ), on one line, without
    modifiers and attributes; ``name(...)`` where the parenthesis never closes; null for other kinds."""
    def of(doc: Column) -> Column:
        lines = _lines(doc)
        start = F.array_position(F.transform(lines, lambda x: x.contains("function ")), F.lit(True))
        rest = F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))
        end = F.array_position(F.transform(rest, lambda x: x.contains(")")), F.lit(True))
        taken = F.slice(rest, F.lit(1), F.when(end > 0, end).otherwise(F.size(rest)).cast("int"))
        one = F.array_join(taken, " ")
        one = F.regexp_replace(one, MODIFIERS, "")
        one = F.regexp_replace(one, ATTRIBUTES, "")
        one = F.trim(F.regexp_replace(one, r"\s+", " "))
        return F.when(one.contains("(") & ~one.contains(")"), F.concat(F.substring_index(one, "(", 1), F.lit("(...)"))).otherwise(one)

    docs = F.filter(F.transform(F.coalesce(documentation, F.array().cast("array<string>")), _bare), lambda d: d.contains("function "))
    return F.when(kind.isin("Method", "Function") & (F.size(docs) > 0), of(F.get(docs, 0)))


def property_facts(documentation: Column, name: Column) -> Column:
    """struct(visibility, readonly, static, type) from the first documentation line that names the property."""
    docs = F.transform(F.coalesce(documentation, F.array().cast("array<string>")), _bare)
    lines = F.flatten(F.transform(docs, _lines))
    line = F.get(F.filter(lines, lambda x: x.contains(name)), 0)
    seen = F.regexp_extract(line, r"^(public|protected|private) ", 1)
    kind = F.regexp_extract(line, PROPERTY_TYPE, 1)
    short = F.element_at(F.split(F.regexp_replace(kind, r"^\\+", ""), r"\\"), -1)
    return F.struct(
        F.nullif(seen, F.lit("")).alias("visibility"),
        F.coalesce(line.rlike(r"( |^)readonly "), F.lit(False)).alias("readonly"),
        F.coalesce(line.rlike(r"( |^)static "), F.lit(False)).alias("static"),
        F.when((kind != "") & ~kind.isin("public", "protected", "private", "static", "readonly"), short).alias("type"),
    )


def is_abstract(documentation: Column) -> Column:
    lines = F.flatten(F.transform(F.coalesce(documentation, F.array().cast("array<string>")), lambda d: _lines(_bare(d))))
    return F.exists(lines, lambda x: x.contains("function ") & x.contains("abstract "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def truncated(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    most = max_tokens * CHARS_PER_TOKEN
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(MARKER))).otherwise(text)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text (from 0, both included), clamped to it; null where start lies beyond."""
    lines = F.split(text, "\n")
    first, last = F.greatest(start, F.lit(0)), F.least(end, F.size(lines) - 1)
    return F.when(first <= last, F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))


def shorten_parameter(parameter: Column) -> Column:
    """A parameter's key in output: no constructor part, App\\C::$x for App\\C::__construct().$x."""
    return F.regexp_replace(parameter, r"::__construct\(\)\.", "::")


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of that many characters; null if there is none."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size)))))
