"""Source code into chunks along its declarations, so that every meaningful line is in some chunk.

Python is read with the standard parser; for languages with braces a tolerant scanner finds declarations.
What lies between declarations is kept in pieces of neighbouring blocks; what is too long is cut into
windows of lines that repeat the header in the text to be embedded.
"""

from __future__ import annotations

import ast
import functools
import io
import itertools
import re
import tokenize
from dataclasses import dataclass

import numpy as np

from ..config import Settings

_TOKEN = re.compile(r"[A-Za-z0-9_]{1,4}|[^A-Za-z0-9_ \t\n\r]")
_MEANING = re.compile(r"\w")
#: Kinds of characters: 0 white, 1 of words, 2 any other.
_KINDS = np.array([0 if chr(c) in " \t\n\r" else 1 if re.match(r"[A-Za-z0-9_]", chr(c)) else 2 for c in range(128)] + [2], np.int8)


@dataclass
class Unit:
    """Lines first..last (from zero, inclusive) of a declaration; scopes hold others and are no chunks."""

    first: int
    last: int
    name: str
    scope: bool = False
    drop: bool = False


def tokens(text: str) -> int:
    """About how many model tokens a text has."""
    return len(_TOKEN.findall(text))


class Source:
    """A file and what is known about it; each thing is found out once, and only if a chunk needs it."""

    def __init__(self, content: str, language: str):
        self.content, self.language, self.lines = content, language, content.split("\n")

    @functools.cached_property
    def sums(self) -> list[int]:
        """How many tokens the lines before each line have; the last entry is that of the whole text."""
        code = np.frombuffer(self.content.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KINDS[np.minimum(code, 128)]
        at = np.arange(len(code))
        # a token begins at every fourth letter of a word
        before = np.maximum.accumulate(np.where(kind == 1, -1, at)) if len(code) else at
        begun = np.concatenate([[0], np.cumsum((kind == 2) | ((kind == 1) & ((at - before) % 4 == 1)))])
        return [0, *begun[np.flatnonzero(code == 10)].tolist(), int(begun[-1])]

    def tokens(self, first: int, last: int) -> int:
        if len(self.content) < 2000:  # counted sooner than summed
            return tokens("\n".join(self.lines[first : last + 1]))
        return self.sums[last + 1] - self.sums[first]

    @functools.cached_property
    def sizes(self) -> list[int]:
        return [b - a for a, b in itertools.pairwise(self.sums)]

    @functools.cached_property
    def tree(self) -> ast.Module | None:
        try:
            return ast.parse(self.content)
        except (SyntaxError, ValueError, RecursionError):
            return None

    @functools.cached_property
    def bodies(self) -> dict[int, list[ast.stmt]]:
        """Python declarations by their last lines (from zero)."""
        out: dict[int, list[ast.stmt]] = {}
        todo = [self.tree] if self.tree else []
        for n in todo:  # statements, outer ones first; no expression holds a declaration
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.setdefault(n.end_lineno - 1, []).append(n)
            for held in ("body", "handlers", "orelse", "finalbody", "cases"):
                if isinstance(inner := getattr(n, held, None), list):
                    todo.extend(inner)
        return out

    @functools.cached_property
    def quiet(self) -> list[str]:
        """The lines with blanks for strings and comments."""
        return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), self.content).split("\n")

    @functools.cached_property
    def torn(self) -> set[int]:
        return torn_lines(self.content, self.language)


def python_units(source: Source) -> list[Unit] | None:
    tree = source.tree
    if tree is None:
        return None
    out: list[Unit] = []

    def visit(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]]) - 1
                out.append(Unit(first, n.end_lineno - 1, n.name, isinstance(n, ast.ClassDef)))
                if isinstance(n, ast.ClassDef):
                    visit(n.body)

    visit(tree.body)
    return out


_DECLARATIONS: dict[str, list[tuple[re.Pattern, bool]]] = {
    "go": [(re.compile(r"^func\s+(?:\([^)]*?\*?\s*(?P<of>\w+)(?:\[[^\]]*\])?\)\s*)?(?P<name>\w+)"), False), (re.compile(r"^(?:type|var|const)\s+\(?\s*(?P<name>\w*)"), False)],
    "rust": [
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:impl|trait|mod)\b(?:<[^>]*>)?\s*(?:[\w:<>&' ]+\s+for\s+)?(?P<name>\w*)"), True),
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*(?:fn|struct|enum|union|type|const|static|macro_rules!)\s+(?:mut\s+)?(?P<name>\w+)"), False),
    ],
    "java": [
        (re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|@interface)\s+(?P<name>\w+)"), True),
        (re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:record\s+|[\w<>\[\], .?]+\s+)?(?P<name>\w+)\s*\([^;]*$"), False),
    ],
    "javascript": [
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), True),
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w*)"), False),
        (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]*)?=>"), False),
        (re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type|enum)\s+(?P<name>\w+)"), False),
        (re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*\*?(?P<name>(?!if\b|for\b|while\b|switch\b|return\b|catch\b)\w+)\s*\([^;]*\)\s*(?::[^{]*)?\{\s*$"), False),
    ],
    "cpp": [
        (re.compile(r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|namespace)\s+(?P<name>\w*)[^;]*$"), True),
        (re.compile(r"^(?P<name>(?!if|for|while|switch|return|else)[A-Za-z_][\w:<>*&~\s]*?)\s*\([^;]*$"), False),
        (re.compile(r"^\s*(?:typedef|enum|union|using)\b.*?(?P<name>\w+)\s*[;{=]"), False),
    ],
}
_DECLARATIONS["typescript"] = _DECLARATIONS["tsx"] = _DECLARATIONS["javascript"]
_DECLARATIONS["c"] = [(re.compile(r"^(?:typedef\s+)?(?:struct|union|enum)\s+(?P<name>\w*)[^;(]*\{?\s*$"), False), *_DECLARATIONS["cpp"][1:], (re.compile(r"^#\s*define\s+(?P<name>\w+)\("), False)]
_QUIET = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'|`[^`]*`|//[^\n]*|/\*.*?\*/', re.S)
_LEADING = re.compile(r"^\s*(?://|/\*|\*|#\[|#!\[|@\w|#\s)")


def brace_units(source: Source) -> list[Unit]:
    """Declarations by their first lines; each ends where its braces close, or with the statement."""
    quiet, lines, language = source.quiet, source.lines, source.language
    out: list[Unit] = []

    def end(i: int) -> int:
        depth, opened = 0, False
        for k in range(i, len(quiet)):
            for c in quiet[k]:
                if c in "{([":
                    depth, opened = depth + 1, opened or c == "{"
                elif c in "})]":
                    depth -= 1
            if depth <= 0 and (opened or quiet[k].rstrip().endswith(";") or language == "go" or not quiet[k].rstrip().endswith((",", "\\", "=", "("))):
                return k
        return len(quiet) - 1

    def scan(i: int, stop: int, nested: bool) -> None:
        while i < stop:
            for pattern, scope in _DECLARATIONS[language]:
                m = pattern.match(quiet[i])
                if m and (nested or not quiet[i][:1].isspace()):
                    last, first = min(end(i), stop), i
                    while first > 0 and _LEADING.match(lines[first - 1]) and not (out and out[-1].last >= first - 1 and not out[-1].scope):
                        first -= 1
                    of = m.groupdict().get("of")
                    name = (m["name"] or "").strip().split()[-1:] or [""]
                    is_drop = scope and language == "rust" and any("cfg(test)" in x for x in lines[first:i])
                    out.append(Unit(first, last, f"{of}.{name[0]}" if of else name[0], scope and not is_drop, is_drop))
                    if scope and not is_drop:
                        scan(i + 1, last, True)
                    i = last
                    break
            i += 1

    scan(0, len(lines), False)
    return out


def _worth(text: str, least: int) -> bool:
    t = text.strip()
    return bool(t) and _MEANING.search(t) is not None and t.count("\n") + 1 >= least


def paragraph_spans(lines: list[str], first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    out, start = [], None
    last = len(lines) - 1 if last is None else last
    for k in range(first, last + 1):
        if lines[k].strip():
            start = k if start is None else start
        elif start is not None:
            out.append((start, k - 1))
            start = None
    if start is not None:
        out.append((start, last))
    return out


def _signature(lines: list[str], first: int, last: int) -> str:
    """The declaration up to its body, on one line, at most 200 bytes and no half character."""
    head: list[str] = []
    for line in lines[first : last + 1]:
        head.append(line)
        if re.search(r"[{:;]\s*(?:(?://|#).*)?$", line):
            break
    text = " ".join(" ".join(head).split()).encode()[:200]
    return text.decode("utf-8", "ignore")


def chunk_source(path: str, content: str, s: Settings = Settings(), provider: str = "syntax") -> list[tuple]:
    """Rows (path, ord, start_line, end_line, symbol, content, embed_text) of one file."""
    from .languages import CPP_MARKS, by_extension

    found = re.search(r"(\.[^./]*)$", path)
    known = by_extension().get(found[1].lower()) if found else None
    language = known.name if known else ""
    if language == "c" and path.lower().endswith(".h") and any(m in content for m in CPP_MARKS):
        language = "cpp"
    source = Source(content, language)
    lines = source.lines
    units: list[Unit] | None = None
    if provider == "declarations" and language != "go":
        units = None
    elif language == "python":
        units = python_units(source)
    elif language in _DECLARATIONS:
        units = brace_units(source)
    rows: list[tuple] = []
    if not units or not any(not u.scope and not u.drop for u in units):
        for a, b in paragraph_spans(lines):
            rows.append((a, b, "", "\n".join(lines[a : b + 1]).strip("\n"), None))
    else:
        scopes = [u for u in units if u.scope]
        drops = [u for u in units if u.drop]
        leaf = sorted((u for u in units if not u.scope and not u.drop), key=lambda u: (u.first, -u.last))
        outer: list[Unit] = []
        for u in leaf:
            if not any(d.first <= u.first and u.last <= d.last for d in drops) and (not outer or u.last > outer[-1].last):
                outer.append(u)
        around = lambda a, b: sorted((x for x in scopes if x.name and x.first <= a and b <= x.last), key=lambda x: (x.first, -x.last))
        covered = sorted([(u.first, u.last) for u in outer] + [(d.first, d.last) for d in drops])
        for u in outer:
            name = ".".join([*[x.name for x in around(u.first, u.last) if x is not u], u.name]) if u.name else ".".join(x.name for x in around(u.first, u.last))
            rows.extend(_fit(path, source, u.first, u.last, name, s, True))
        at = 0
        for a, b in [*covered, (len(lines), len(lines))]:
            rows.extend(_gap(path, source, at, a - 1, around, s))
            at = max(at, b + 1)
    rows.sort(key=lambda r: r[0])
    return [(path, k, a + 1, b + 1, name, text, embed) for k, (a, b, name, text, embed) in enumerate(rows)]


def _gap(path: str, source: Source, first: int, last: int, around, s: Settings) -> list[tuple]:  # noqa: ANN001
    """Blocks between declarations; neighbours of one scope are put together while they fit."""
    out: list[list] = []
    lines = source.lines
    for a, b in paragraph_spans(lines, first, last) if first <= last else []:
        inner = around(a, b)
        name = inner[-1].name if inner else ""
        if out and out[-1][2] == name and source.tokens(out[-1][0], b) <= s.max_tokens:
            out[-1][1] = b
        else:
            out.append([a, b, name])
    return [r for a, b, n in out if _worth("\n".join(lines[a : b + 1]), s.min_gap_lines) for r in _fit(path, source, a, b, n, s, False)]


def _header(language: str, path: str, name: str, signature: str, most: int | None) -> str:
    """Language, path, name and signature; to get under ``most`` tokens outer folders go first, then the signature."""
    while True:
        header = f"{language} {path}\n" + "".join(f"{x}\n" for x in (name, signature) if x)
        if most is None or tokens(header) <= most:
            return header
        outer, _, rest = path.partition("/")
        if rest:
            path = rest
        elif signature:
            signature = ""
        else:
            return header


def torn_lines(content: str, language: str) -> set[int]:
    """Lines (from zero) that begin inside a string or a comment: no place to cut."""
    out: set[int] = set()
    if language == "python":
        try:
            for t in tokenize.generate_tokens(io.StringIO(content).readline):
                if t.type == tokenize.STRING or tokenize.tok_name[t.type] in ("FSTRING_MIDDLE", "FSTRING_END"):
                    out.update(range(t.start[0], t.end[0]))
        except (tokenize.TokenError, SyntaxError):
            pass
        return out
    for m in _QUIET.finditer(content):
        if "\n" in m[0]:
            line = content.count("\n", 0, m.start())
            out.update(range(line + 1, line + 1 + m[0].count("\n")))
    return out


def statement_cuts(content: str, language: str, first: int, last: int, source: Source | None = None) -> list[int]:
    """Lines within a declaration at which a statement of its body begins, but the body's first one."""
    source = source or Source(content, language)
    if language == "python":
        for n in source.bodies.get(last, ()):
            if first <= n.lineno - 1:
                starts = [min([x.lineno, *[d.lineno for d in getattr(x, "decorator_list", [])]]) - 1 for x in n.body]
                return [k for k in starts[1:] if first < k <= last]
        return []
    quiet = source.quiet
    depth, inner, cuts, ended = 0, 0, [], False
    for k in range(first, last + 1):
        text = quiet[k].strip()
        # at the body's own depth, and where the statement before is complete
        if text and depth == 1 and inner == 0 and ended and not text.startswith(("}", ")", "]", ".", "?", ":", "else", "catch", "finally")):
            cuts.append(k)
        for c in text:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c in "([":
                inner += 1
            elif c in ")]":
                inner -= 1
        if text:
            ended = text.endswith((";", "{", "}", ",")) or (language in ("go", "javascript", "typescript", "tsx") and not text.endswith(("+", "-", "*", "=", "&&", "||", "(", ".")))
    return cuts[1:]


def windows(sizes: list[int], first: int, last: int, cuts: list[int], budget: int, overlap: int, torn: set[int]) -> list[tuple[int, int]]:
    """(first, last) line ranges under a token budget that begin at the cuts; neighbours share ``overlap`` of them.

    Without cuts lines are taken that begin in no string or comment, and if there are none, all lines.
    """
    if not cuts:
        cuts = [k for k in range(first + 1, last + 1) if k not in torn] or list(range(first + 1, last + 1))
    bounds = [first, *cuts, last + 1]
    sums = list(itertools.accumulate(sizes[first : last + 1], initial=0))
    out, i = [], 0
    while i < len(bounds) - 1:
        j = i + 1
        while j < len(bounds) - 1 and sums[bounds[j + 1] - first] - sums[bounds[i] - first] <= budget:
            j += 1
        out.append((bounds[i], bounds[j] - 1))
        if j == len(bounds) - 1:
            break
        i = max(i + 1, j - overlap)
    return out


def _fit(path: str, source: Source, first: int, last: int, name: str, s: Settings, signed: bool) -> list[tuple]:
    """One chunk, or windows of statements if header and body don't fit."""
    lines, language = source.lines, source.language
    header = _header(language, path, name, _signature(lines, first, last) if signed else "", s.max_tokens // 4 if s.cap_header else None)
    body = "\n".join(lines[first : last + 1]).strip("\n")
    left = s.max_tokens - tokens(header)
    if source.tokens(first, last) <= left or left < 32:
        return [(first, last, name, body, header + body)] if _worth(body, 1) else []
    cuts = statement_cuts(source.content, language, first, last, source) if signed else []
    spans = windows(source.sizes, first, last, cuts, left, s.overlap, set() if cuts else source.torn)
    out = []
    for k, (a, b) in enumerate(spans, 1):
        text = "\n".join(lines[a : b + 1]).strip("\n")
        if _worth(text, 1):
            out.append((a, b, f"{name}~{k}" if name and len(spans) > 1 else name, text, header + text))
    return out


_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_GO_WORDS = frozenset("if for switch select return func go defer range map chan make new len cap append copy delete panic print println recover close min max clear string int error".split())
_GO_KEYWORDS = frozenset("if for switch select return func go defer range map chan".split())


def go_calls(content: str) -> list[tuple[str, str]]:
    """(caller, callee) pairs of a Go file by names: each call within a function, its closures included.

    Built-in functions are no callees, unless the file itself declares a function of that name.
    """
    source = Source(content, "go")
    quiet = source.quiet
    out: set[tuple[str, str]] = set()
    own = set(re.findall(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "\n".join(quiet), re.M))
    for u in brace_units(source):
        text = "\n".join(quiet[u.first : u.last + 1])
        m = re.search(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", text, re.M)
        if m:
            body = text[text.index("{", m.end()) + 1 :] if "{" in text[m.end() :] else ""
            out.update((m[1], c) for c in _CALL.findall(body) if c not in _GO_KEYWORDS and (c not in _GO_WORDS or c in own))
    return sorted(out)
