r"""Regular expressions of the filter language for Java's engine.

The language is that of linear-time engines: no look-around, no back-references, Unicode classes, ``.`` stops at ``\n``
only, ``$`` is the end of the text. Java's engine is told so by flags and a rewriting of ``$``.
"""

from __future__ import annotations

import re

import regex

from siltstone import messages as M
from siltstone.errors import InvalidQuery
from siltstone.limits import MAX_REGEX_BYTES

_TOKEN = re.compile(r"\\.|\[\^?\]?|\]|\(\?P<|\(\?[=!]|\(\?<[=!]|\(\?>|\(\?[a-zA-Z-]+[:)]|\$|[*+?}]\+|.", re.DOTALL)


def translate(pattern: str) -> str:
    """The Java pattern for a search with ``pattern``; raises InvalidQuery for what the language lacks."""
    if len(pattern.encode()) > MAX_REGEX_BYTES:
        raise InvalidQuery(M.REGEX_LENGTH.format(MAX_REGEX_BYTES))
    out, depth, lines = [], 0, False
    for token in _TOKEN.findall(pattern):
        if depth == 0 and (re.fullmatch(r"\\[1-9k]", token) or token in ("(?=", "(?!", "(?<=", "(?<!", "(?>") or re.fullmatch(r"[*+?}]\+", token)):
            raise InvalidQuery(M.REGEX.format(pattern))
        if token[0] == "[":
            depth += 1
        elif token == "]" and depth:
            depth -= 1
        elif token == "$" and not depth:
            token = "$" if lines else r"\z"
        elif token == "(?P<":
            token = "(?<"
        elif flags := re.fullmatch(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?[:)]", token):
            lines = ("m" in flags[1] or lines) and "m" not in (flags[2] or "")
        out.append(token)
    try:
        regex.compile(pattern, regex.V0)
    except regex.error as e:
        raise InvalidQuery(M.REGEX.format(pattern)) from e
    return "(?dU)" + "".join(out)
