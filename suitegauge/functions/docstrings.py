"""Docstrings of Python source, read line by line with array expressions: no parser, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from suitegauge.functions.text import bound

# Strings of a line; the first group is the quotes of one that goes on. Possessive repetition needs no stack for long lines.
_STRINGS = (r'"""(?:[^"\\]++|\\.|"(?!""))*+"""' r"|'''(?:[^'\\]++|\\.|'(?!''))*+'''" r"""|("{3}|'{3}).*$"""
            r'|"(?:[^"\\]++|\\.)*+"' r"|'(?:[^'\\]++|\\.)*+'")
# What stands before the end of a string, and behind it, by its quotes.
_ENDS = {
    '"""': r'^((?:[^"\\]++|\\.|"(?!""))*+)"""(.*)$', "'''": r"^((?:[^'\\]++|\\.|'(?!''))*+)'''(.*)$",
    '"': r'^((?:[^"\\]++|\\.)*+)"(.*)$', "'": r"^((?:[^'\\]++|\\.)*+)'(.*)$"}
_OPENS = r"""^\s*[rRuU]?("{3}|'{3}|"|')(.*)$"""
_INLINE = r"""^.*:\s*[rRuU]?("{3}|'{3}|"|')(.*)\1\s*(?:#.*)?$"""

#: States: between statements, inside a def's header, before its first statement, inside its docstring, inside another string.
_BETWEEN, _HEADER, _FIRST, _DOC, _STRING = range(5)
_STATE = "struct<mode:int,depth:int,indent:int,quote:string,doc:array<string>,found:array<struct<indent:int,nth:int,doc:string>>>"


def _by_quote(quote: Column, line: Column, group: int) -> Column:
    found = F.lit(None).cast("string")
    for mark, pattern in _ENDS.items():
        found = F.when(quote == mark, F.regexp_extract(line, pattern, group)).otherwise(found)
    return found


def _ends(quote: Column, line: Column) -> Column:
    found = F.lit(False)
    for mark, pattern in _ENDS.items():
        found = F.when(quote == mark, line.rlike(pattern)).otherwise(found)
    return found


def _step(state: Column, line: Column) -> Column:
    # The line without its strings and its comment.
    code = F.rtrim(F.regexp_replace(F.regexp_replace(line, _STRINGS, "0$1"), r"#.*$", ""))
    return bound(code, lambda code: _next(state, line, code))


def _next(state: Column, line: Column, code: Column) -> Column:
    mode, indent = state["mode"], state["indent"]
    opened = F.regexp_extract(code, r"""("{3}|'{3})""", 1)
    is_def = mode.isin(_BETWEEN, _FIRST) & line.rlike(r"^\s*def\s+\w+\s*[(\[]")
    depth = (F.when(mode == _HEADER, state["depth"]).otherwise(0)
             + F.length(F.translate(code, ")]}", "")) - F.length(F.translate(code, "([{", "")))
    inline = F.when(code.rlike(r":\s*[rRuU]?0$"), F.regexp_extract(line, _INLINE, 2)).otherwise("")
    starts = (mode == _FIRST) & line.rlike(_OPENS)
    quote = F.when(mode == _DOC, state["quote"]).otherwise(F.regexp_extract(line, _OPENS, 1))
    rest = F.when(mode == _DOC, line).otherwise(F.regexp_extract(line, _OPENS, 2))
    ends = _ends(quote, rest)
    text = F.concat(state["doc"], F.array(F.when(ends, _by_quote(quote, rest, 1)).otherwise(rest)))

    def now(mode: Column | int, depth: Column | int = 0, indent: Column = indent, quote: Column | None = None, doc: Column | None = None,
            new: Column | None = None) -> Column:
        found = state["found"]
        if new is not None:
            found = F.concat(found, F.array(F.struct(indent.alias("indent"), F.size(found).alias("nth"), new.alias("doc"))))
        return F.struct(F.lit(mode) if isinstance(mode, int) else mode, F.lit(depth) if isinstance(depth, int) else depth, indent,
                        F.lit("") if quote is None else quote, F.array().cast("array<string>") if doc is None else doc, found).cast(_STATE)

    own = F.when(is_def, F.length(F.regexp_extract(line, r"^(\s*)", 1))).otherwise(indent)
    unfinished = (depth > 0) | code.endswith("\\")
    header = (F.when(unfinished, now(_HEADER, depth, own)).when(code.endswith(":"), now(_FIRST, 0, own))
              .when(inline != "", now(_BETWEEN, 0, own, new=inline)).otherwise(now(_BETWEEN)))
    # A string is a docstring only if nothing is done with it.
    alone = _by_quote(quote, rest, 2).rlike(r"^\s*(?:[#;].*)?$")
    doc = (F.when(ends & alone, now(_BETWEEN, new=F.array_join(text, "\n"))).when(ends | (F.length(quote) < 3), now(_BETWEEN))
           .otherwise(now(_DOC, 0, indent, quote, text)))
    other = F.when(opened != "", now(_STRING, quote=opened)).otherwise(now(_BETWEEN))
    return (F.when(is_def | (mode == _HEADER), header)
            .when((mode == _DOC) | starts, doc)
            .when(mode == _STRING, F.when(_ends(state["quote"], line), now(_BETWEEN)).otherwise(state.cast(_STATE)))
            .when((mode == _FIRST) & (F.trim(code) == ""), state.cast(_STATE))
            .otherwise(other))


def _found(spec: Column) -> Column:
    """Every function's docstring as {indent, nth, doc}, as written."""
    start = F.struct(F.lit(_BETWEEN), F.lit(0), F.lit(0), F.lit(""), F.array().cast("array<string>"),
                     F.array().cast("array<struct<indent:int,nth:int,doc:string>>")).cast(_STATE)
    return F.aggregate(F.split(F.regexp_replace(spec, r"\r\n?", "\n"), "\n"), start, _step, lambda s: s["found"])


def dedented(doc: Column) -> Column:
    """The text without its margin: the first line from its first letter, the others less what they all are indented by, no blank ends."""
    def shifted(lines: Column) -> Column:
        others = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
        margin = F.coalesce(F.array_min(F.transform(
            F.filter(others, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
        return bound(margin, lambda margin: F.concat(
            F.array(F.ltrim(F.get(lines, F.lit(0)))), F.transform(others, lambda x: F.substring(x, margin + 1, F.length(x)))))

    # A text's lines are found once: an expression inside a lambda is worked out for each of its items.
    lines = F.transform(F.split(doc, "\n"), lambda x: F.replace(x, F.lit("\t"), F.lit(" " * 8)))
    return F.regexp_replace(F.array_join(bound(lines, shifted), "\n"), r"\A\n+|\n+\z", "")


def _first(spec: Column, cleaned: bool) -> Column:
    full = F.filter(_found(spec), lambda d: F.trim(F.replace(d["doc"], F.lit("\n"), F.lit(""))) != "")
    # Outer functions come before those inside others.
    doc = F.array_min(full)["doc"]
    return F.when(spec.isNotNull(), F.coalesce(dedented(doc) if cleaned else doc, F.lit("")))


def docstring(spec: Column) -> Column:
    """Dedented text of the first documented function, outer functions first; '' if there is none, null for a null source.

    A state machine over lines: a docstring is the string that is the first statement behind a ``def``'s header, however
    many lines the header has. Strings in headers, above functions or within expressions are none. Escapes stay as written.
    """
    return _first(spec, True)


def raw_docstring(spec: Column) -> Column:
    """The same with its margin, as it stands between the quotes."""
    return _first(spec, False)
