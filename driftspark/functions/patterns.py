"""Patterns that find routes and handler signals in source text.

Fixed values: the syntax looked for is that of file-routed web frameworks. ``\\b`` is spelled out as
ASCII look-arounds because the meaning of ``\\b`` for other letters depends on the regex engine.
"""

from __future__ import annotations

WORD = "[A-Za-z0-9_]"
WORD_END = f"(?!{WORD})"

# Directories never searched for routes, and those never searched for consumers.
ROUTE_SKIP_DIRS = ["node_modules", ".git", ".next"]
CONSUMER_SKIP_DIRS = ["node_modules", "dist", ".git", ".next", "build", "out", ".turbo"]
CONSUMER_EXTENSIONS = ["ts", "tsx", "js", "jsx"]

APP_ROUTE_FILE = r"^app/api/.*route\.(ts|js)$"
PAGES_ROUTE_FILE = r"^pages/api/.*\.(ts|js)$"

PATH_PARAMETER = r"\[([^\]]+)\]"

DEFAULT_EXPORT = [
    r"export\s+default\s+(async\s+)?function",
    r"export\s+default\s+(async\s+)?\(",
    r"export\s+default\s+handler",
    r"exports\.default\s*=",
]
METHOD_COMPARED = r"""req\.method\s*[!=]==?\s*['"]([A-Z]+)['"]"""
METHOD_CASE = r"""case\s+['"]([A-Z]+)['"]"""

# What follows is looked for in lexed code, where a string holds hexadecimal digits.
SEARCH_PARAMETER = r'searchParams[A-Za-z0-9_$]*[\s)]*[?!]?\.\s*get\(\s*"([0-9A-F]*)"'
QUERY_PROPERTY = r"(?<![A-Za-z0-9_$.])req\??\.query\??\.([A-Za-z_$][A-Za-z0-9_$]*)"
QUERY_DESTRUCTURED = r"\{([^{}]*)\}\s*(?::[^=;]*)?=\s*req\.query(?!\s*(?:as\s|[?\[.A-Za-z0-9_$]))"

# A response call; the text after it holds its arguments.
APP_RESPONSE = r"(?:(?<![A-Za-z0-9_$])NextResponse|(?<![A-Za-z0-9_$.])Response)\.json\("
APP_STATUS = r"(?s)\A,\s*\{(?:.*,)?\s*status\s*:\s*(\d+)\s*(?:,.*)?\}\s*\z"
PAGES_RESPONSE = r"(?<![A-Za-z0-9_$.])res\s*(?:\.status\(([^()]*)\)\s*)?\.json\(\s*[^\s)]"


def exported_method(method: str) -> str:
    return rf"export\s+(?:async\s+)?function\s+{method}{WORD_END}|export\s+const\s+{method}\s*="


def from_export(method: str) -> str:
    """From the export of ``method`` to the end of the file."""
    return rf"(?s)(?:{exported_method(method)}).*"


# The export of a method, where it starts the text: a function, a function expression or an arrow function of
# one bare name; an arrow function with a parameter list up to the opening of that list; what follows the list.
EXPORTED_FUNCTION = r"\Aexport\s+(?:async\s+)?function(?![A-Za-z0-9_])"
EXPORTED_EXPRESSION = r"\Aexport\s+const\s+[A-Z]+\s*=\s*(?:async\s*)?(?:function(?![A-Za-z0-9_])|[A-Za-z_$][A-Za-z0-9_$]*\s*=>)"
EXPORTED_LIST = r"\Aexport\s+const\s+[A-Z]+\s*=\s*(?:async\s*)?(?:<[^>]*>\s*)?\("
ARROW = r"\A\s*(?::[^=;]*)?=>"
EXPORTED_CALL = r"\Aexport\s+const\s+[A-Z]+\s*=\s*(?!async\s*\()[A-Za-z_$][A-Za-z0-9_$.]*\s*(?:<[^>]*>)?\("


def comment_before(start: str) -> str:
    """The doc comment, as lexed, that directly precedes ``start``."""
    return rf"/\*([0-9A-F]*)\*/\s*(?:{start})"
