"""Outlines of source code: one row per symbol."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import language_of

# How the languages declare things. '@' is a name, ' ' blanks, '~' blanks or nothing, [x] an optional
# word, {a|b} one of some words, <ab> one of some characters, '?' what may be missing.
# Kinds with the shape of their line, and what is shown for the names $1, $2, ...
_GO = [
    ("method", "func (@ *?@) @~(", "($1 $2) $3()"), ("function", "func @~(", "$1()"), ("struct", "type @ struct~{", "type $1 struct"),
    ("interface", "type @ interface~{", "type $1 interface"), ("type", "type @ ", "type $1"), ("var", "var @ ", "var $1"),
    ("command", " @~=~&cobra.Command", "command $1"),
]
_PYTHON_FUNCTIONS = [
    ("function", f"{indent}{word}def @~(", f"{word}{'method ' if indent else ''}$1()") for word in ("async ", "") for indent in (" ", "")
]
_EXPORTED = [("class", "class @", "class $1"), ("function", "function @~<(<>", "$1()"), ("var", "{const|let} @", "$1")]
_PLAIN = [("function", "function @~<(<>", "$1()"), ("class", "class @", "class $1"), ("interface", "interface @", "interface $1")]
_RUST = {"function": "fn", "struct": "struct", "interface": "trait"}
ARROW = r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])*=>"


def _pattern(shape: str) -> str:
    """The pattern of a line that begins like the shape."""
    marks = {"@": r"(\w+)", " ": r"\s+", "~": r"\s*", "?": "?"}
    out = "^"
    for part in re.findall(r"\[[^\]]*\]|\{[^}]*\|[^}]*\}|<[^>]+>|.", shape):
        if len(part) > 1:
            inner = part[1:-1]
            out += {"[": rf"(?:{inner}\s+)?", "{": f"(?:{inner})", "<": f"[{inner}]"}[part[0]]
        else:
            out += marks.get(part) or re.escape(part)
    return out


def _patterns() -> dict[str, list[tuple[str, str, str]]]:
    """By language and in order (kind, pattern, name): the first pattern that fits a line counts."""
    shaped = lambda rows: [(kind, _pattern(shape), shown) for kind, shape, shown in rows]
    exported = [(kind, f"export [default]{shape}", shown) for kind, shape, shown in _EXPORTED] + [("type", "export {interface|type} @", "type $1")]
    rust = [(kind, f"{pub}{word} @", f"{pub}{word} $1" + "()" * (word == "fn")) for kind, word in _RUST.items() for pub in ("pub ", "")]
    python = [("class", r"^class\s+(\w+)[\s(:]", "class $1"), *shaped(_PYTHON_FUNCTIONS), *shaped([("var", "@~=~", "$1")])]
    return {
        "go": shaped(_GO),
        "python": python,
        "typescript": [*shaped(exported), ("function", ARROW, "$1()"), *shaped(_PLAIN)],
        "rust": [*shaped(rust), *shaped([("type", "pub enum @", "pub enum $1")]), ("impl", r"^impl(?:<[^>]+>)?\s+(\w+)", "impl $1")],
    }


PATTERNS = _patterns()


def outline(files: DataFrame) -> DataFrame:
    """(path, language, line, kind, name, signature) of files (path, content), for languages known by extension.
    Content is cut into lines and matched inside the JVM; files spread like any rows."""
    lines = files.select("path", language_of(F.col("path")).alias("language"), F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, patterns in PATTERNS.items():
        for symbol, pattern, shown in reversed(patterns):
            fits = (F.col("language") == language) & F.col("text").rlike(pattern)
            kind = F.when(fits, symbol).otherwise(kind)
            name = F.when(fits, F.regexp_replace(F.regexp_extract("text", pattern, 0), f"(?s){pattern}.*", shown)).otherwise(name)
    found = lines.where("language <> ''").withColumns({"kind": kind, "name": name}).where("kind is not null")
    return found.select("path", "language", (F.col("at") + 1).alias("line"), "kind", "name", F.trim("text").alias("signature"))


def symbol_counts(files: DataFrame) -> DataFrame:
    """(path, language, n_symbols) of files in known languages, also of those without a symbol."""
    known = files.select("path", language_of(F.col("path")).alias("language")).where("language <> ''").distinct()
    counts = outline(files).groupBy("path").agg(F.count("*").alias("n_symbols"))
    return known.join(counts, "path", "left").fillna(0, ["n_symbols"])
