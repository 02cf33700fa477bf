"""Definitions in source files: Python by its own parser, brace languages by a small lexer."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONTAINER

LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go",
}

_WORD = r"[\w$]+"
#: What may stand between a name and its parameters or body is skipped by brackets, see ``_end``.
_SCRIPT = [
    (rf"\bfunction\s*\*?\s*(?P<n>{_WORD})", "function"), (rf"\bclass\s+(?P<n>{_WORD})", "class"), (rf"\binterface\s+(?P<n>{_WORD})", "class"), (rf"\benum\s+(?P<n>{_WORD})", "class"),
    (rf"\b(?:const|let|var)\s+(?P<n>{_WORD})(?=\s*(?::[^;]*?)?=\s*(?:async\b\s*)?(?:function\b|[\w$(<]))", "arrow"),
    (rf"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*(?P<n>[\w$#]+)(?=\s*(?::[^;=]*?)?=\s*(?:async\b\s*)?(?:function\b|[(<]|{_WORD}\s*=>))", "arrow"),
    (rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|function|return|with|do|else|try|new|await|typeof|super)\b)(?P<n>[\w$#]+)(?=\s*(?:<[^()]*>)?\()", "method"),
]
_ALIAS = (rf"^\s*(?:export\s+)?type\s+(?P<n>{_WORD})(?=\s*(?:<[^=]*>)?\s*=)", "class")
RULES = {
    "rust": [(r"\bfn\s+(?P<n>\w+)", "function"), (r"\b(?:struct|enum|trait|union)\s+(?P<n>\w+)", "class"), (r"\bmod\s+(?P<n>\w+)", "module"), (r"\bimpl\b(?P<n>)", "block")],
    "javascript": _SCRIPT, "typescript": [*_SCRIPT, _ALIAS], "tsx": _SCRIPT,
    "go": [(r"^func\s*\([^()]*\)\s*(?P<n>\w+)", "method"), (r"^func\s+(?P<n>\w+)", "function"), (r"^type\s+(?P<n>\w+)", "class")],
}
_LEX = {
    "rust": r'//[^\n]*|/\*.*?\*/|r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|' + r"b?'(?:\\.[^']*|[^'\\])'",
    "go": r'//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.[^']*|[^'\\\n])'",
}
_LEX["javascript"] = _LEX["typescript"] = _LEX["tsx"] = r'//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"


def language_column(uri: Column) -> Column:
    """The language by the last suffix of a uri, null if it has no rules."""
    suffix = F.lower(F.regexp_extract(uri, r"\.([^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, suffix)


def _python(raw: bytes) -> list[tuple]:
    try:
        tree = ast.parse(raw)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(raw)
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset, node.lineno, node.end_lineno, node.name, kind))
    return out


_PY_LEX = re.compile(rb"(?:[rRbBuUfF]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|#[^\n]*", re.S)
_PY_HEAD = re.compile(rb"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def _indented(raw: bytes) -> list[tuple]:
    """Definitions of a Python file that its parser refuses, by indentation: a definition ends with the last line that is
    indented further than it, brackets aside."""
    # strings are one line, whatever they hold
    bare = _PY_LEX.sub(lambda m: (b" " if m.group()[:1] == b"#" else b"x") * len(m.group()), raw)
    depth, inner, at, rows = 0, [], 0, bare.split(b"\n")
    for row in rows:  # (start, end without white space, indentation; None if blank or within brackets)
        text = row.rstrip()
        inner.append((at, at + len(text), None if depth > 0 or not text else len(row) - len(row.lstrip())))
        depth = max(0, depth + sum(text.count(c) for c in (b"(", b"[", b"{")) - sum(text.count(c) for c in (b")", b"]", b"}")))
        if depth and re.match(rb"\s*(?:async\s+)?(?:def|class)\b", text) and inner[-1][2] is None:
            depth = 0  # a bracket that was never closed
            inner[-1] = (at, at + len(text), len(row) - len(row.lstrip()))
        at += len(row) + 1
    out = []
    for m in _PY_HEAD.finditer(bare):
        first = bare.count(b"\n", 0, m.start())
        own, last = len(m.group(1)), first
        for i in range(first + 1, len(inner)):
            if inner[i][2] is not None and inner[i][2] <= own:
                break
            if inner[i][1] > inner[i][0]:
                last = i
        begin, end = m.start() + own, inner[last][1]
        out.append((begin, end, raw.count(b"\n", 0, begin) + 1, raw.count(b"\n", 0, end) + 1, m.group(3).decode("utf-8", "replace"), "class" if m.group(2) == b"class" else "function"))
    return out


def _brackets(bare: str) -> dict[int, int]:
    """Where the bracket at each place is closed; a closing bracket of another kind closes all that are open within its own."""
    close, open_ = {}, []
    pair = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", bare):
        c = m.group()
        if c not in pair:
            open_.append((c, m.start()))
        elif any(o == pair[c] for o, _ in open_):
            while open_:
                o, at = open_.pop()
                close[at] = m.end()
                if o == pair[c]:
                    break
    return close


_TYPE_BEFORE = re.compile(r"(?:\b(?:interface|struct)|[:|&,<=(]|=>)\s*$")


def _end(bare: str, at: int, language: str, kind: str, close: dict[int, int]) -> int | None:
    """Where the definition ends whose name ends at ``at``: with its body, or with the semicolon or line that ends it; None
    if it is none after all. Parameters, types and generic arguments are skipped by their brackets."""
    n, i, whole = len(bare), at, len(bare.rstrip())
    script = language in ("javascript", "typescript", "tsx")
    arrow = False
    seen = False  # of a method, its parameters
    while i < n:
        c = bare[i]
        if c in "([":
            if c == "(" and script and kind == "arrow" and arrow:
                arrow = None  # the value is an expression in brackets
            i = close.get(i, whole)
            seen = True
            continue
        if c == "<" and (m := re.match(r"<(?:[^<>(){};=]|=>|\([^()]*\)|\{[^{}]*\}|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>", bare[i:])):
            i += m.end()
            continue
        if script and kind == "arrow" and bare.startswith("=>", i) and bare[at:i].strip().startswith(("=", ":")) and _is_value(bare[at:i]):
            arrow, i = True, i + 2
            j = i + len(bare[i:]) - len(bare[i:].lstrip())
            if bare[j : j + 1] == "{":
                return close.get(j, whole)
            continue
        if c == "{":
            before = bare[at:i]
            literal = _TYPE_BEFORE.search(before) is not None
            if kind == "arrow":
                if re.search(r"\bfunction\b[^=]*$", before) and seen:
                    return close.get(i, whole)
                i = close.get(i, whole)
                continue
            if script and kind == "class" and before.strip() == "=":
                literal = True
            if language == "go" and kind == "class":
                i = close.get(i, whole)
                continue
            if literal and kind != "class" and language != "rust" or literal and script:
                i = close.get(i, whole)
                continue
            return close.get(i, whole)
        if c == ";":
            return (None if kind == "method" and script else i + 1) if kind != "arrow" or arrow or arrow is None else None
        if c == "\n":
            if language == "go":
                return i
            rest = bare[i:].lstrip()
            if script and (kind == "arrow" and (arrow or arrow is None) or kind == "method" and seen) and not rest.startswith((".", "?", ":", "+", "-", "*", "/", "&", "|", "=", "{", ")")) and bare[at:i].rstrip()[-2:] != "=>":
                return None if kind == "method" else i
            if script and kind == "arrow" and not arrow and re.match(r"(?:export|const|let|var|function|class|import|return|if|for)\b", rest):
                return None
        if c in "})]" or (kind == "method" and script and seen and c in ".,=+?!&|"):
            return None if kind == "method" or kind == "arrow" and not arrow else i
        i += 1
    return whole if kind != "method" and (kind != "arrow" or arrow) else None


def _is_value(text: str) -> bool:
    """Whether an arrow after this text is that of the value, not of a type before the equals sign."""
    flat, before = text, None
    while flat != before:
        before, flat = flat, re.sub(r"\([^()]*\)", "\0", flat)
    return re.search(r"(?<![=<>!])=(?!=|>)\s*(?:async\b\s*)?(?:<[^=]*>\s*)?(?:\0|[\w$]+)\s*(?::[^=]*)?$", flat) is not None


def _braces(text: str, language: str) -> list[tuple]:
    """Definitions as (start, end, first line, last line, name, kind) in characters."""
    bare = re.sub(_LEX[language], lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    close = _brackets(bare)
    out = []
    for rule, kind in RULES[language]:
        for m in re.finditer(rule, bare, re.M):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            end = _end(bare, m.end(), language, kind, close)
            if end is not None:
                out.append((start, end, m.group("n") or None, "function" if kind == "arrow" else kind))
    if language in ("javascript", "typescript", "tsx"):
        out += _callbacks(bare, close, {end for _, end, *_ in out})
    feeds = [m.start() for m in re.finditer("\n", bare)]
    return [(start, end, bisect_left(feeds, start) + 1, bisect_left(feeds, max(start, end - 1)) + 1, *rest) for start, end, *rest in out]


def _callbacks(bare: str, close: dict[int, int], named: set[int]) -> list[tuple]:
    """Arrow functions with a body in braces that no rule names, from their parameters on."""
    opened, out = {end: start for start, end in close.items()}, []
    for m in re.finditer(r"=>\s*(?=\{)", bare):
        end = close.get(m.end())
        if end is None or end in named:
            continue
        start = at = m.start()
        while at and bare[at - 1].isspace():
            at -= 1
        if bare[at - 1 : at] == ")" and at in opened:
            start = opened[at]
        else:
            start = at
            while start and (bare[start - 1].isalnum() or bare[start - 1] in "_$"):
                start -= 1
            if start == at:
                continue
        if lead := re.search(r"\basync\s*$", bare[max(0, start - 12) : start]):
            start -= len(lead.group())
        out.append((start, end, None, "function"))
    return out


def definitions(raw: bytes, language: str, parser: Parser | None = None) -> list[dict]:
    """The definitions of a file in byte offsets, by start, the widest first."""
    if parser is not None:
        found = parser(raw)
    elif language == "python":
        found = _python(raw)
    else:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return []
        found = [(len(text[:s].encode()), len(text[:e].encode()), a, b, n, k) for s, e, a, b, n, k in _braces(text, language)] if not text.isascii() else _braces(text, language)
    return [dict(zip(("start", "end", "first", "last", "symbol", "kind"), x)) for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[4] or ""))]


#: Finds the definitions of a file: (start, end, first line, last line, name, kind), in bytes and lines from 1.
Parser = Callable[[bytes], list[tuple]]
#: Changes when definitions are found otherwise than before, so that a cache of older ones isn't used.
GRAMMAR = 2
CACHED = f"language string, content_hash string, containers {CONTAINER}"


def with_containers(files: DataFrame, parsers: dict[str, Parser] | None = None, cache: str | None = None) -> DataFrame:
    """``files(uri, content)`` with the columns language, content_hash and containers.

    Equal contents of a language are parsed once in the whole corpus. Files of other languages have no containers.
    ``parsers`` adds languages by the suffix of their files, or takes the place of known ones. ``cache`` is a folder in which definitions
    stay from call to call, by language, hash and grammar: what is there isn't parsed again, and what is new is added.
    """
    extra = {k.lower(): v for k, v in (parsers or {}).items()}
    suffix = F.lower(F.regexp_extract("uri", r"\.([^./]*)$", 1))
    language = F.when(suffix.isin(list(extra)), suffix).otherwise(language_column(F.col("uri"))) if extra else language_column(F.col("uri"))
    rows = files.select("uri", F.col("content").cast("binary").alias("content"), language.alias("language"))
    rows = rows.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    distinct = rows.where("language IS NOT NULL").groupBy("language", "content_hash").agg(F.any_value("content").alias("content"))
    known = None
    if cache is not None:
        at = f"{cache.rstrip('/')}/grammar-{GRAMMAR}"
        path = files.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        if path.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).exists(path):
            known = files.sparkSession.read.schema(CACHED).parquet(at)
            distinct = distinct.join(known.select("language", "content_hash"), ["language", "content_hash"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("symbol", pa.string()), ("kind", pa.string())]))
        for batch in batches:
            found = [definitions(c, lang, extra.get(lang)) for lang, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, kind)], names=["language", "content_hash", "containers"])

    parsed = distinct.mapInArrow(run, CACHED)
    if cache is not None:
        parsed.write.mode("append").parquet(at)  # twice the same, if two calls meet: either serves
        known = files.sparkSession.read.schema(CACHED).parquet(at)
        parsed = known.groupBy("language", "content_hash").agg(F.any_value("containers").alias("containers"))
    return rows.join(parsed, ["language", "content_hash"], "left").select("uri", "content", "language", "content_hash", "containers")
