"""Language records and how paths and heads of files are classified with them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import base_name, extension


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    test_globs: tuple[str, ...] = ()
    test_dirs: tuple[str, ...] = ()
    test_paths: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    prose: bool = False


_JS_TESTS = tuple(f"*.{kind}.{e}" for kind in ("test", "spec") for e in ("ts", "tsx", "js", "jsx", "mjs"))
_JS_DIRS = ("__tests__", "__mocks__", "__snapshots__", "e2e")
_MARKS = ("@generated", "DO NOT EDIT")
_C_MARKS = (*_MARKS, "Generated by the protocol buffer compiler", "automatically generated")

LANGUAGES: tuple[Language, ...] = (
    Language("go", (".go",), ("*_test.go",), ("testdata",), (), ("Code generated by", "Code generated ")),
    Language("python", (".py", ".pyi"), ("test_*.py", "*_test.py", "conftest.py"), ("tests",), (), (*_MARKS, "Generated by the protocol buffer compiler")),
    Language("typescript", (".ts", ".mts", ".cts"), _JS_TESTS, _JS_DIRS, (), _MARKS),
    Language("tsx", (".tsx",), _JS_TESTS, _JS_DIRS, (), _MARKS),
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), _JS_TESTS, _JS_DIRS, (), _MARKS),
    Language("rust", (".rs",), ("*_test.rs", "tests.rs"), ("tests", "benches"), (), (*_MARKS, "Generated by")),
    Language("java", (".java",), ("*Test.java", "*Tests.java", "*IT.java", "*TestCase.java"), (), ("src/test",), ("@Generated", "DO NOT EDIT", "This file was automatically generated")),
    Language("c", (".c", ".h"), ("*_test.c", "test_*.c", "*_tests.c"), ("tests",), (), _C_MARKS),
    Language("cpp", (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"), ("*_test.cc", "*_test.cpp", "*_unittest.*", "test_*.*"), (), (), _C_MARKS),
    Language("markdown", (".md", ".markdown"), prose=True),
    Language("text", (".txt", ".rst"), prose=True),
    Language("data", (".json", ".yaml", ".yml"), generated=("DO NOT EDIT", "@generated"), prose=True),
)
CPP_MARKS = ("\nclass ", "\nnamespace ", "template <", "template<", "::", "\npublic:", 'extern "C"')
COMMENT_SIGNS = ("//", "#", "/*", "*", "--", ";", "<!--")
HEAD_LINES = 20


def by_extension() -> dict[str, Language]:
    out: dict[str, Language] = {}
    for one in LANGUAGES:
        for e in one.extensions:
            if e in out:
                raise ValueError(f"{e} is claimed by {out[e].name} and {one.name}")
            out[e] = one
    return out


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def language(path: Column, content: Column | None = None) -> Column:
    """The language of a path by its extension; a .h file with a sign of C++ in it is C++; null if none claims it."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for one in reversed(LANGUAGES):
        out = F.when(ext.isin(*one.extensions), F.lit(one.name)).otherwise(out)
    if content is not None:
        out = F.when((ext == ".h") & _any([content.contains(m) for m in CPP_MARKS]), F.lit("cpp")).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    return "^" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def is_test(path: Column) -> Column:
    """By base name, a directory of that name, or a part of the path; only for files that a language claims."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    ext, base = extension(path), base_name(path)
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    out = F.lit(False)
    for one in LANGUAGES:
        own = [base.rlike(glob_pattern(g)) for g in one.test_globs] + [F.array_contains(folders, d) for d in one.test_dirs]
        own += [F.concat(F.lit("/"), path).contains(f"/{p}/") for p in one.test_paths]
        out = out | (ext.isin(*one.extensions) & _any(own))
    return out


def head(content: Column, lines: int = HEAD_LINES) -> Column:
    """The blank and comment lines that a file begins with, trimmed and joined, from the first ``lines`` lines."""
    trimmed = F.transform(F.slice(F.split(content, "\n"), 1, lines), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    comment = lambda x: (x == "") | _any([x.startswith(s) for s in COMMENT_SIGNS])
    first = lambda t: F.coalesce(F.get(F.filter(F.transform(t, lambda x, i: F.when(~comment(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(t))
    cut = F.get(F.transform(F.array(trimmed), lambda t: F.slice(t, F.lit(1), first(t))), F.lit(0))
    return F.array_join(cut, "\n")


def is_generated(path: Column, head_text: Column) -> Column:
    ext = extension(path)
    return _any([ext.isin(*one.extensions) & _any([head_text.contains(m) for m in one.generated]) for one in LANGUAGES if one.generated])


def is_skipped(path: Column, content: Column) -> Column:
    return is_test(path) | is_generated(path, head(content))
