"""Text helpers: Python-style regular expressions, whitespace and number parsing in Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}
_BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def unicode_regex(pattern: str) -> str:
    r"""A pattern whose \w \d \s \b and (?i) follow Unicode, written for Spark's regex functions.

    Spark's own classes are ASCII-only; rule lists here assume Unicode text.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i:i + 2]
        if ch == "\\" and len(pair) == 2:
            kind = pair[1]
            if kind in _CLASSES:
                out.append(_CLASSES[kind] if in_class else f"[{_CLASSES[kind]}]")
            elif kind.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[kind.lower()]}]")
            elif kind == "b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if in_class and ch in "[&":
            out.append("\\" + ch)
        else:
            out.append(ch)
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "]" and in_class:
                in_class = False
        i += 1
    return "".join(out).replace("(?i)", "(?iu)")


def squeeze(col: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """True if ``col`` contains any of a fixed list of literals."""
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col, F.lit(needle))
    return out


def clip(col: Column, limit: int, suffix: str) -> Column:
    """First ``limit`` characters plus ``suffix`` when longer."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit(suffix))).otherwise(col)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT = (r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?"
          r"|(?i:inf|infinity|nan))$")


def safe_int(col: Column) -> Column:
    """Text to long; blank or unparsable gives null."""
    clean = strip(col)
    return F.when(clean.rlike(_INT), F.replace(clean, F.lit("_"), F.lit("")).try_cast("bigint"))


def safe_float(col: Column) -> Column:
    """Text to double, with ``inf`` / ``nan`` and digit underscores; unparsable gives null."""
    clean = strip(col)
    return F.when(clean.rlike(_FLOAT), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))


def glob_regex(pattern: str) -> str:
    """An anchored, case-sensitive regex for a shell pattern with ``*``, ``?`` and ``[seq]``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("(?s:.*)")
        elif ch == "?":
            out.append("(?s:.)")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", "\\^")) + "]")
            i = close
        else:
            out.append("\\Q" + ch + "\\E")
        i += 1
    return "^" + "".join(out) + "\\z"


def matches_patterns(col: Column, patterns: Iterable[str]) -> Column:
    """Any pattern matches: shell match if it holds ``*`` or ``?``, else equality."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | (col.rlike(glob_regex(pattern)) if set("*?") & set(pattern) else col == F.lit(pattern))
    return out


def base64_text(raw: Column) -> Column:
    """Base64 in one line, whatever line length the session's encoder uses."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))
