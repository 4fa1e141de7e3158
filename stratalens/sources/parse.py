"""Source texts to symbols: declarations, imports, exports, calls, type relations, for five languages.

Python is read with its own syntax tree. The brace languages are scanned: comments and strings are blanked, so that
positions stay, then declarations are matched and nested by their brace extents. What a scanner can't see (macros,
type-level calls, overloads) is missing, not guessed. Malformed text gives what can be read, at least the file's node.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from stratalens.common import ship

SCHEMA = (
    "path string, language string, nodes array<struct<id:string,kind:string,name:string,line:int,col:int>>, imports array<struct<source:string,symbols:array<string>,kind:string>>, "
    "exports array<struct<name:string,kind:string,exported:boolean,public:boolean>>, calls array<struct<caller:string,callee:string,line:int,col:int>>, relations array<struct<source:string,target:string,kind:string>>"
)


@dataclass
class Analysis:
    path: str
    nodes: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    relations: list = field(default_factory=list)

    def node(self, name: str, kind: str, line: int, col: int) -> None:
        ident = f"{self.path}::{name}"
        if all(n[0] != ident for n in self.nodes):
            self.nodes.append((ident, kind, name.rsplit(".", 1)[-1], line, col))


def parse(path: str, content: str, language: str) -> Analysis:
    out = Analysis(path)
    out.nodes.append((f"{path}::file", "File", re.split(r"[/\\]", path)[-1], 1, 1))
    (_python if language == "python" else _braces)(out, content or "", language)
    return out


def _python(out: Analysis, text: str, _: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def callee(f: ast.expr, cls: str | None) -> str | None:
        if isinstance(f, ast.Name):
            return f.id
        if isinstance(f, ast.Attribute):
            return f"{cls}.{f.attr}" if cls and isinstance(f.value, ast.Name) and f.value.id == "self" else f.attr
        return None

    def visit(node: ast.AST, cls: str | None, caller: str | None, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            here, inside = caller, cls
            if isinstance(child, ast.ClassDef):
                out.node(child.name, "Class", child.lineno, child.col_offset + 1)
                for base in child.bases:
                    name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
                    if name:
                        out.relations.append((child.name, name, "extends"))
                inside, here = child.name, None
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                here = f"{cls}.{child.name}" if cls else child.name
                out.node(here, "Method" if cls else "Function", child.lineno, child.col_offset + 1)
            elif isinstance(child, ast.Import):
                out.imports += [(a.name, [], "Namespace") for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.imports.append(("." * child.level + (child.module or ""), [a.name for a in child.names], "Named"))
            elif isinstance(child, ast.Call) and caller:
                name = callee(child.func, cls)
                if name:
                    out.calls.append((caller, name, child.lineno, child.col_offset + 1))
            if top and isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign)):
                names = [child.name] if hasattr(child, "name") else [t.id for t in child.targets if isinstance(t, ast.Name)]
                kind = "Class" if isinstance(child, ast.ClassDef) else "Variable" if isinstance(child, ast.Assign) else "Function"
                out.exports += [(n, kind, True, not n.startswith("_")) for n in names]
            visit(child, inside, here, False)

    visit(tree, None, None, True)


def blank(text: str, quotes: str, hash_comments: bool = False) -> str:
    """The text with comments and the insides of strings as blanks, line ends kept."""
    pattern = r"//[^\n]*|/\*.*?(?:\*/|\Z)" + "".join(rf"|{q}(?:[^{q}\\{'' if q == '`' else chr(92) + 'n'}]|\\.)*{q}" for q in quotes)
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def _close(text: str, at: int) -> int:
    """Position behind the brace that closes the one at `at`."""
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return at + m.end()
    return len(text)


_NAME = r"[A-Za-z_$][\w$]*"
#: (kind, pattern with group 'name'); a block is searched from the pattern's end.
DECLARATIONS = {
    "typescript": [
        ("Class", rf"\bclass\s+(?P<name>{_NAME})(?P<heritage>[^{{;]*)"), ("Interface", rf"\binterface\s+(?P<name>{_NAME})(?P<heritage>[^{{;]*)"), ("Enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("Type", rf"\btype\s+(?P<name>{_NAME})\s*(?:<[^=]*>)?\s*="), ("Function", rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\("),
        ("Function", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_NAME})\s*(?::[^=\n]+)?=>)"),
        ("Method", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME})\s*(?:<[^(\n]*>)?\([^;{{}}]*\)\s*(?::[^{{;=]+)?\{{"),
    ],
    "go": [
        ("Method", rf"(?m)^func\s+\(\s*(?:{_NAME}\s+)?\*?(?P<owner>{_NAME})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_NAME})\s*\("), ("Function", rf"(?m)^func\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\("),
        ("Class", rf"(?m)^\s*(?:type\s+)?(?P<name>{_NAME})(?:\[[^\]]*\])?\s+struct\b"), ("Interface", rf"(?m)^\s*(?:type\s+)?(?P<name>{_NAME})(?:\[[^\]]*\])?\s+interface\b"),
        ("Type", rf"(?m)^type\s+(?P<name>{_NAME})\s+(?!struct\b|interface\b)=?\s*[\w*\[(]"),
    ],
    "rust": [
        ("Class", rf"\bstruct\s+(?P<name>{_NAME})"), ("Enum", rf"\benum\s+(?P<name>{_NAME})"), ("Interface", rf"\btrait\s+(?P<name>{_NAME})"), ("Type", rf"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{_NAME})"),
        ("Function", rf"\bfn\s+(?P<name>{_NAME})"),
    ],
    "java": [
        ("Class", rf"\b(?:class|record)\s+(?P<name>{_NAME})(?P<heritage>[^{{;]*)"), ("Interface", rf"@?\binterface\s+(?P<name>{_NAME})(?P<heritage>[^{{;]*)"), ("Enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("Method", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s+)?(?:[\w$.\[\]]+(?:<[^(){{}};]*>)?(?:\[\])*\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|else\b){_NAME})\s*\([^;{{}}()]*\)\s*(?:throws[^{{;]+)?(?=[{{;])"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "match", "fn", "func", "super", "await", "typeof", "else", "loop", "in", "of", "constructor", "synchronized", "throw", "range", "import", "require"}


def _braces(out: Analysis, text: str, language: str) -> None:
    text = text.replace("\r\n", "\n")
    code = blank(text, {"go": '"`', "rust": '"', "java": '"'}.get(language, "\"'`"))
    line_of = _Lines(text)
    owners: list[tuple[int, int, str]] = []  # extents of impl blocks and types with methods
    if language == "rust":
        for m in re.finditer(rf"\bimpl\b(?:\s*<[^{{]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<type>{_NAME})[^{{;]*", code):
            brace = code.find("{", m.end())
            if brace >= 0:
                owners.append((brace, _close(code, brace), m["type"]))
                if m["trait"]:
                    out.relations.append((m["type"], m["trait"].rsplit("::", 1)[-1], "implements"))
    found: list[tuple[int, int, str, str, re.Match]] = []
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, code):
            brace = code.find("{", m.end() - 1)
            stop = code.find(";", m.end() - 1)
            body = brace >= 0 and (stop < 0 or brace < stop) and kind != "Type"
            found.append((m.start(), _close(code, brace) if body else m.end(), kind, m["name"], m))
    types = [(a, b, name) for a, b, kind, name, _ in found if kind in ("Class", "Interface", "Enum") and language in ("typescript", "javascript", "java")] + owners
    spans: list[tuple[int, int, str]] = []  # functions, to find callers
    for a, b, kind, name, m in sorted(found, key=lambda f: f[0]):
        start = m.start("name")
        own = m.groupdict().get("owner") or next((n for x, y, n in sorted(types, key=lambda t: t[0], reverse=True) if x < a and b <= y), None)
        if kind == "Method" and not own:
            continue
        if kind == "Function" and own and language == "rust":
            kind = "Method"
        full = f"{own}.{name}" if kind == "Method" else name
        line, col = line_of(start)
        out.node(full, kind, line, col)
        if kind in ("Function", "Method"):
            spans.append((a, b, full))
        heritage = m.groupdict().get("heritage") or ""
        for word, rel in (("extends", "extends"), ("implements", "implements")):
            h = re.search(rf"\b{word}\s+([^{{]*?)(?=\bextends\b|\bimplements\b|$)", heritage, re.S)
            names = [re.match(r"[\w$.]+", x.strip()) for x in re.sub(r"<[^<>]*>", "", h[1]).split(",")] if h else []
            if language == "java":
                out.relations += [(name, n.group().rsplit(".", 1)[-1], rel) for n in names if n]
            elif names and names[0] and not any(r[0] == name for r in out.relations):
                out.relations.append((name, names[0].group(), "extends"))
        _export(out, language, code, a, kind, name, depth_zero=not any(x < a < y for x, y, *_ in found if (x, y) != (a, b)))
    for m in re.finditer(rf"(?P<new>\bnew\s+)?(?P<path>{_NAME}(?:\s*(?:\.|::)\s*{_NAME})*)\s*(?:::<[^()]*>)?\(", code):
        parts = re.split(r"\s*(?:\.|::)\s*", m["path"])
        name = parts[-1]
        caller = next((n for x, y, n in sorted(spans, key=lambda s: s[0], reverse=True) if x < m.start() < y), None)
        if not caller or name in _NOT_CALLS or any(f[4].start("name") == m.start("path") for f in found):
            continue
        cls = caller.split(".")[0] if "." in caller else None
        if m["new"] and language != "java":
            continue
        if cls and language == "rust" and parts[0] in ("self", "Self") and len(parts) == 2 or cls and language == "java" and not m["new"] and (len(parts) == 1 and code[: m.start()].rstrip()[-1:] != "." or parts[0] == "this"):
            name = f"{cls}.{name}"
        line, col = line_of(m.start("path") if len(parts) == 1 else m.start())
        out.calls.append((caller, name, line, col))
    _imports(out, language, text, code)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> tuple[int, int]:
        import bisect

        n = bisect.bisect_right(self.starts, at)
        return n, at - self.starts[n - 1] + 1


def _export(out: Analysis, language: str, code: str, at: int, kind: str, name: str, depth_zero: bool) -> None:
    if not depth_zero or kind == "Method" and language != "go":
        return
    before = code[code.rfind("\n", 0, at) + 1 : at]
    lead = before + code[at : at + 40]
    if language in ("typescript", "javascript"):
        shown = bool(re.search(r"\bexport\b", before))
    elif language == "go":
        shown = name[:1].isupper()
    else:
        shown = bool(re.match(r"\s*(?:@\w+\s+)*pub(?:lic)?\b", lead))
    out.exports.append((name, kind, shown, shown))


def _imports(out: Analysis, language: str, text: str, code: str) -> None:
    if language in ("typescript", "javascript"):
        for m in re.finditer(r"(?m)^import\s+(?:(?P<what>[^'\"]+?)\s+from\s+)?['\"](?P<src>[^'\"]+)['\"]", text):
            what = (m["what"] or "").strip()
            kind = "Type" if what.startswith("type ") else "Namespace" if "*" in what else "Named" if "{" in what else "Default"
            inner = re.search(r"\{([^}]*)\}", what)
            names = [x.strip().split(" as ")[0].strip() for x in inner[1].split(",") if x.strip()] if inner else []
            first = re.match(rf"(?:type\s+)?({_NAME})\s*(?:,|$)", what)
            out.imports.append((m["src"], ([first[1]] if first else []) + names, kind))
        for m in re.finditer(r"(?m)^export\s*\{([^}]*)\}", text):
            out.exports += [(x.strip().split(" as ")[-1].strip(), "Variable", True, True) for x in m[1].split(",") if x.strip()]
    elif language == "go":
        blocks = re.findall(r"(?ms)^import\s*\((.*?)\)", text) + re.findall(r"(?m)^import\s+(?!\()(.+)$", text)
        out.imports += [(s, [s.rsplit("/", 1)[-1]], "Namespace") for b in blocks for s in re.findall(r'"([^"]+)"', b)]
    elif language == "rust":
        out.imports += [(m[1], [x for x in re.findall(_NAME, m[2])[-1:]], "Named") for m in re.finditer(rf"(?m)^\s*(?:pub\s+)?use\s+({_NAME})([^;]*);", code)]
    elif language == "java":
        out.imports += [(m[1], [m[1].rsplit(".", 1)[-1]], "Named") for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", code)]


def analyse(files: DataFrame) -> DataFrame:
    """One row per file (path, language, content) with everything read from it; one task reads many files, none twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parse(p, c, lang) for p, lang, c in zip(batch["path"], batch["language"], batch["content"])]
            yield pd.DataFrame({
                "path": batch["path"], "language": batch["language"], "nodes": [a.nodes for a in got], "imports": [a.imports for a in got], "exports": [a.exports for a in got],
                "calls": [a.calls for a in got], "relations": [a.relations for a in got],
            })

    ship(files.sparkSession)
    return files.where("path IS NOT NULL AND language IS NOT NULL").select("path", "language", "content").mapInPandas(run, SCHEMA)
