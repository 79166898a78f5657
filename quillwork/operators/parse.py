"""Functions of source files: name, line range and cyclomatic complexity; shapes and types.

Python is parsed by the standard library; files that don't parse give one row with parse_error. Brace and end
languages go through the island grammar of grammar.py.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar

SCHEMA = "path string, name string, line int, end_line int, complexity int, lang string, parse_error boolean"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler, ast.Lambda)
_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'|`[^`]*`', re.S)


def python_functions(source: str) -> list[tuple[str, int, int, int]]:
    """(name, line, end line, complexity); a decorated function or class also gives an anonymous row from its first
    decorator on, and what decorators branch into counts there alone."""
    found = []
    for node in ast.walk(ast.parse(source)):
        decorators = getattr(node, "decorator_list", [])
        above = sum(isinstance(x, _BRANCHES) for d in decorators for x in ast.walk(d))
        if decorators or isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inside = 1 + sum(isinstance(x, _BRANCHES) for x in ast.walk(node))
            if not isinstance(node, ast.ClassDef):
                found.append((node.name, node.lineno, node.end_lineno, inside - above))
            if decorators:
                found.append(("<anonymous>", decorators[0].lineno, node.end_lineno, inside))
    return sorted(found, key=lambda r: (r[1], r[0]))


def functions(files: DataFrame) -> DataFrame:
    """One row a function of files (path, content, lang)."""
    known = files.filter(F.col("lang").isin("python", "tsx", *grammar.LANGUAGES)).select("path", "content", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("complexity", pa.int32()), ("lang", pa.string()), ("parse_error", pa.bool_())])
        for batch in batches:
            out = []
            for path, content, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = python_functions(content or "") if lang == "python" else grammar.functions(content or "", "typescript" if lang == "tsx" else lang)
                    out += [(path, *r, lang, False) for r in rows]
                except (SyntaxError, ValueError, RecursionError):
                    out.append((path, None, None, None, None, lang, True))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return known.mapInArrow(run, SCHEMA)


# Nodes of Python and the control-flow tokens that a function's shape is compared by.
_NODES = (
    (ast.If, "IF"), (ast.While, "WHILE"), ((ast.For, ast.AsyncFor), "FOR"), (ast.Match, "MATCH"), (ast.match_case, "ARM"), ((ast.Assign, ast.AnnAssign, ast.AugAssign), "LET"),
    (ast.Return, "RET"), (ast.Call, "CALL"), (ast.Lambda, "LAMBDA"), ((ast.Try, ast.ExceptHandler), "TRY"),
)
_DEEP = 20


def python_shape(source: str) -> list[tuple[str, int, list[str]]]:
    """(name, line, tokens) of each function, its nodes from the outside in, down to a bounded depth."""

    def walk(node: ast.AST, depth: int) -> Iterator[str]:
        if depth <= _DEEP:
            yield from (token for kind, token in _NODES if isinstance(node, kind))
            for child in ast.iter_child_nodes(node):
                yield from walk(child, depth + 1)

    return [(n.name, n.lineno, list(walk(n, 0))) for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def _closing(plain: str, at: int) -> int:
    """Where the bracket that is open at a place closes."""
    depth = 1
    while depth and at < len(plain):
        depth += {"{": 1, "}": -1}.get(plain[at], 0)
        at += 1
    return at


def _parsed(files: DataFrame, schema: str, rows) -> DataFrame:
    """rows(path, content, lang) gives tuples of the schema for a file; files that don't parse give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += rows(*file)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return files.mapInArrow(run, schema)


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, name, line, tokens array<string>): the control flow of each function of files (path, content, lang); not of Ruby."""

    def rows(path, content, lang):
        found = python_shape(content or "") if lang == "python" else grammar.shapes(content or "", "typescript" if lang == "tsx" else lang)
        return [(path, *f) for f in found]

    known = files.filter(F.col("lang").isin("python", "tsx", *(n for n in grammar.LANGUAGES if n != "ruby"))).select("path", "content", "lang")
    return _parsed(known, "path string, name string, line int, tokens array<string>", rows)


_STRUCT = re.compile(r"\bstruct\s+(\w+)[^;{(]*\{")
_FIELD = re.compile(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:")
_METHOD = re.compile(r"\bfn\s+(\w+)\s*[(<]")


def rust_structs(source: str) -> list[tuple[str, str, str | None]]:
    """(type, method, field or None) of types with two methods or more: each field that a method names."""
    plain = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    out = []
    for s in _STRUCT.finditer(plain):
        fields = _FIELD.findall(plain[s.end() : _closing(plain, s.end()) - 1])
        methods: list[tuple[str, str]] = []
        for block in re.finditer(rf"\bimpl\b[^{{;]*\b{re.escape(s[1])}\b[^{{;]*\{{", plain):
            body = plain[block.end() : _closing(plain, block.end()) - 1]
            heads = list(_METHOD.finditer(body))
            methods += [(m[1], body[m.end() : nxt.start() if nxt else len(body)]) for m, nxt in zip(heads, [*heads[1:], None], strict=True)]
        if len(methods) > 1:
            for name, body in methods:
                used = [f for f in dict.fromkeys(fields) if re.search(rf"\bself\.{re.escape(f)}", body)]
                out += [(s[1], name, f) for f in used or [None]]
    return out


def struct_methods(files: DataFrame) -> DataFrame:
    """(path, type, method, field) of Rust files (path, content): what cohesion is computed from."""
    known = files.filter(F.col("path").endswith(".rs")).select("path", "content")
    return _parsed(known, "path string, type string, method string, field string", lambda path, content: [(path, *r) for r in rust_structs(content or "")])
