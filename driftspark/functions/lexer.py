"""A token pass over source text, in built-in functions.

:func:`lexed` puts stand-ins for comments and literals, so that what is left is code: patterns on it meet no
text of a comment or string, and its brackets can be matched by their running depth (:func:`after_close`,
:func:`statement`, :func:`second_argument`). Each is a scan of the file's own row. Loops of the patterns are
possessive, so long tokens do not recurse.

Limits: a template inside a template's expression is not followed; apostrophes in markup text pair up within
a line as strings would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|//[^\n]*+"
_STRING = r'''"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+\''''
_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
# A slash begins a regular expression only where an operand may stand. The slash comes first, so that nothing is
# looked back for at other characters.
_REGEX = r"/(?<=[(,=:\[!&|?{};]\s{0,4}/)(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
TOKEN = f"{_COMMENT}|{_STRING}|{_TEMPLATE}|{_REGEX}"
_EXPRESSION = r"\$\{((?:[^{}`]++|\{[^{}`]*+\})*+)\}"

# Stand-ins hold the text of a string or doc comment in hexadecimal digits.
STRING = '"([0-9A-F]*)"'
DOC = r"/\*([0-9A-F]*)\*/"

_BRACKET = r"(?=[(){}\[\]])"
_DECLARED = r"(?=\n\s*(?:export|import|function|async\s+function|const|let|var|class|type|interface|enum)\s)"


def _inner(token: Column, cut: int) -> Column:
    return F.substring(token, F.lit(cut + 1), F.length(token) - 2 * cut)


def _replaced(source: Column, stand_in) -> Column:
    """``source`` with ``stand_in(token)`` for each token."""
    zipped = F.arrays_zip(F.split(source, TOKEN, -1), F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)))
    return F.array_join(
        F.transform(zipped, lambda z: F.concat(z["0"], F.when(z["1"].isNull(), "").otherwise(stand_in(z["1"])))), ""
    )


def _open_template(token: Column) -> Column:
    """A template's expressions stand in for it, in parentheses; other tokens stay."""
    inside = F.array_join(F.regexp_extract_all(token, F.lit(_EXPRESSION), F.lit(1)), ",")
    return F.when(token.startswith("`") & token.contains("${"), F.concat(F.lit("("), inside, F.lit(")"))).otherwise(token)


def _stand_in(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    text = F.regexp_replace(_inner(token, 1), r"\\([\s\S])", "$1")
    doc = F.regexp_replace(F.regexp_replace(token, r"\A/\*\*", ""), r"\*/\z", "")
    return (
        F.when(first.isin('"', "'"), F.concat(F.lit('"'), F.hex(text), F.lit('"')))
        .when(first == "`", F.lit("``"))
        .when(token.startswith("/**") & (token != "/**/"), F.concat(F.lit("/*"), F.hex(doc), F.lit("*/")))
        .when(token.startswith("/*") | token.startswith("//"), F.when(token.contains("\n"), "\n").otherwise(" "))
        .otherwise(F.lit("0"))
    )


def lexed(source: Column) -> Column:
    """Code of a file: plain comments are white space, strings and doc comments hold hexadecimal digits,
    templates are their expressions or two backquotes, regular expressions are a number. Null stays null."""
    opened = F.when(source.contains("${"), _replaced(source, _open_template)).otherwise(source)
    return _replaced(opened, _stand_in)


def text_of(digits: Column) -> Column:
    """The text that a stand-in holds."""
    return F.decode(F.unhex(digits), "UTF-8")


def _step(piece: Column) -> Column:
    """How a piece changes the depth: it begins with at most one bracket."""
    first = F.substring(piece, 1, 1)
    return F.when(first.isin("(", "[", "{"), 1).when(first.isin(")", "]", "}"), -1).otherwise(0)


def _end(pieces: Column, ends) -> Column:
    """Number of pieces before the first one for which ``ends(piece, depth after it)``; all of them if none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def merge(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + _step(piece)
        end = F.when((acc["end"] < 0) & ends(piece, depth), acc["at"]).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), end.alias("end"))

    return F.aggregate(pieces, start, merge, lambda acc: F.when(acc["end"] < 0, acc["at"]).otherwise(acc["end"]))


def after_close(code: Column) -> Column:
    """``code`` begins behind an opening bracket: what follows the bracket that closes it; empty if none does."""
    pieces = F.split(code, _BRACKET, -1)
    end = _end(pieces, lambda piece, depth: depth < 0)
    return F.substring(F.array_join(F.slice(pieces, end + 1, F.size(pieces)), ""), 2, 2**31 - 1)


def statement(code: Column) -> Column:
    """``code`` begins with a declaration: its text up to the next declaration outside all brackets, the next
    export at any depth, or a bracket that it did not open."""
    pieces = F.split(code, f"{_BRACKET}|{_DECLARED}", -1)
    end = _end(
        pieces,
        lambda piece, depth: (depth < 0)
        | (piece.startswith("\n") & ((depth == 0) | piece.rlike(r"\A\n\s*export\s"))),
    )
    return F.array_join(F.slice(pieces, F.lit(1), end), "")


def second_argument(call: Column) -> Column:
    """``call`` begins behind the opening parenthesis of a call: its second argument with the comma before it,
    without what stands in brackets inside an outer bracket; empty if there is none."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("commas"), F.lit("").alias("text"), F.lit(False).alias("done")
    )

    def merge(acc: Column, piece: Column) -> Column:
        step = _step(piece)
        depth = acc["depth"] + step
        done = acc["done"] | (depth < 0)
        commas = acc["commas"] + F.when((acc["depth"] == 0) & piece.startswith(","), 1).otherwise(0)
        more = F.when((step < 0) & (depth == 1), F.substring(piece, 2, 2**31 - 1)).otherwise(piece)
        text = F.when(~done & (commas == 1) & (depth <= 1), F.concat(acc["text"], more)).otherwise(acc["text"])
        return F.struct(depth.alias("depth"), commas.alias("commas"), text.alias("text"), done.alias("done"))

    return F.aggregate(F.split(call, r"(?=[(){}\[\],])", -1), start, merge, lambda acc: acc["text"])
