"""Syntax nodes of source files, without grammars: one small scanner per family of languages.

``split_structure`` gives (text, first line, last line) of every node of a kind
that its language is cut at, outer nodes before inner ones, in order of where
they start; blank nodes are left out.  None means that the language has no
scanner, or that the text can't be read by it: the caller then cuts by size.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable

from tessera.functions.languages import NODE_KINDS

Span = tuple[int, int]


def split_structure(text: str, language: str) -> list[tuple[str, int, int]] | None:
    scanner = SCANNERS.get(language) if language in NODE_KINDS else None
    if scanner is None:
        return None
    try:
        spans = scanner(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    if spans is None:
        return None
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if text[a:b].strip():
            out.append((text[a:b], _line(starts, a), _line(starts, b)))
    return out


def _line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


# -- Python ------------------------------------------------------------------


def _python(text: str) -> list[Span]:
    lines = text.splitlines(keepends=True)
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line))

    def place(row: int, column: int) -> int:
        line = lines[row - 1] if row <= len(lines) else ""
        return begin[row - 1] + len(line.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "replace"))

    try:
        tree = ast.parse(text)
    except MemoryError as e:  # the parser's own stack is full: too deep to parse, whatever memory there is
        raise RecursionError(str(e)) from e
    spans = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            end = place(node.end_lineno, node.end_col_offset)
            spans.append((place(node.lineno, node.col_offset), end))
            if node.decorator_list:
                first = min(node.decorator_list, key=lambda d: (d.lineno, d.col_offset))
                at = place(first.lineno, first.col_offset)
                spans.append((text.rindex("@", 0, at + 1) if "@" in text[:at] else at, end))
    return spans


# -- JSON, YAML, TOML --------------------------------------------------------


def _json(text: str) -> list[Span] | None:
    spans, open_at, quoted, at = [], [], False, 0
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_at.append((c, at))
        elif c in "}]":
            if not open_at or open_at[-1][0] + c not in ("{}", "[]"):
                return None
            spans.append((open_at.pop()[1], at + 1))
        at += 1
    return None if open_at or quoted else spans


def _yaml(text: str) -> list[Span] | None:
    try:
        import yaml
    except ImportError:
        return None
    try:
        roots = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as problem:
        raise ValueError(str(problem)) from problem
    spans: list[Span] = []
    todo, met = [r for r in roots if r is not None], set()
    while todo:
        node = todo.pop()
        if id(node) in met or not isinstance(node, yaml.CollectionNode):
            continue
        met.add(id(node))
        end = node.end_mark.index
        spans.append((node.start_mark.index, len(text[:end].rstrip()) if not node.flow_style else end))
        for child in node.value:
            todo.extend(child if isinstance(child, tuple) else (child,))
    return spans


def _toml(text: str) -> list[Span]:
    heads = [m.start() for m in re.finditer(r"^[ \t]*\[\[?[^\[\]\n]+\]\]?[ \t]*(#.*)?$", text, re.M)]
    return [(a, len(text[:b].rstrip())) for a, b in zip(heads, [*heads[1:], len(text)], strict=True)]


# -- markup ------------------------------------------------------------------


def _markdown(text: str) -> list[Span]:
    spans, heads, at, fence = [], [], 0, None
    lines = text.split("\n")
    indented, before = None, ""
    for line in lines:
        end = at + len(line)
        bar = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if bar and bar[1].startswith(fence[0]) and not line.strip(" `~"):
                spans.append((fence[1], end))
                fence = None
        elif bar:
            fence = (bar[1], at)
        elif m := re.match(r" {0,3}(#{1,6})([ \t]|$)", line):
            heads.append((len(m[1]), at, end))
        elif before.strip() and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)) and not before.startswith("    "):
            heads.append((1 if m[1][0] == "=" else 2, at - len(before) - 1, end))
        if not fence and (line.startswith("    ") or line.startswith("\t")) and line.strip() and (indented or not before.strip()):
            indented = (indented[0] if indented else at, end)
        elif indented and line.strip():
            spans.append(indented)
            indented = None
        before, at = line, end + 1
    if fence:
        spans.append((fence[1], len(text)))
    if indented:
        spans.append(indented)
    for k, (level, a, b) in enumerate(heads):
        stop = next((x[1] for x in heads[k + 1 :] if x[0] <= level), len(text))
        spans += [(a, stop), (a, b)]
    return spans


#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)


def _markup(text: str, html: bool) -> list[Span]:
    spans, stack, at = [], [], 0
    while m := _TAG.search(text, at):
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower() if html else m["name"]
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    spans += [(a, m.start()) for _, a in stack[k + 1 :]]
                    spans.append((stack[k][1], m.end()))
                    del stack[k:]
                    break
        elif m["rest"].endswith("/") or (html and name in VOID):
            spans.append(m.span())
        elif html and name in ("script", "style"):
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            spans.append((m.start(), at))
        else:
            stack.append((name, m.start()))
            if not html:
                spans.append(m.span())
    return spans + [(a, len(text)) for _, a in stack]


# -- languages with braces ---------------------------------------------------

_LITERAL = {
    "c": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "hash": r"\#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "css": r"/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rust": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
}
_LITERAL["js"] = _LITERAL["c"] + r"|`(?:\\.|[^`\\])*`"
_LITERAL["php"] = _LITERAL["c"] + r"|\#[^\n\[][^\n]*"


def _masked(text: str, family: str) -> str:
    """The text with comments and strings blanked, places unchanged."""
    return re.sub(_LITERAL[family], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _close(masked: str, at: int) -> int:
    """End of the block whose brace stands at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _braces(text: str, family: str, heads: Iterable[str]) -> list[Span]:
    """Nodes that start with one of ``heads`` and end with their block, or with a semicolon before any."""
    masked, spans = _masked(text, family), []
    for head in heads:
        for m in re.finditer(head, masked, re.M):
            start = m.start("n") if "n" in m.groupdict() else m.start()
            stop = re.compile(r"[{;]").search(masked, m.end())
            if stop is None:
                continue
            spans.append((start, _close(masked, stop.start()) if stop[0] == "{" else stop.end()))
    return spans


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|open|data|inline|suspend|partial|readonly|export|default|implicit|lazy|case|fileprivate|mutating|class|unsafe|extern|new|synchronized|native|strictfp|fileprivate|convenience|required|operator|companion|inner|enum|annotation|tailrec|infix|external)\s+)*"
_START = r"^[ \t]*(?P<n>" + _MOD
#: How nodes of each kind start, by language; which kinds are cut is ``NODE_KINDS``' choice.
HEADS = {
    "java": {
        "class_declaration": _START + r"class\s+\w+)", "interface_declaration": _START + r"interface\s+\w+)",
        "method_declaration": _START + r"[\w<>\[\],.? ]+\s+\w+\s*\([^;{}]*\)(?:\s*throws[\w,. ]+)?(?=\s*[{;]))", "constructor_declaration": _START + r"[A-Z]\w*\s*\([^;{}]*\)(?=\s*\{))",
    },
    "csharp": {
        "class_declaration": _START + r"class\s+\w+)", "interface_declaration": _START + r"interface\s+\w+)", "struct_declaration": _START + r"struct\s+\w+)",
        "enum_declaration": _START + r"enum\s+\w+)", "method_declaration": _START + r"[\w<>\[\],.? ]+\s+\w+\s*(?:<[^>]*>)?\([^;{}]*\)(?=\s*\{))",
    },
    "go": {"function_declaration": r"^(?P<n>func\s+\w[^{;\n]*)", "method_declaration": r"^(?P<n>func\s*\([^{;\n]*)", "type_declaration": r"^(?P<n>type\s+\w+[^{;\n]*)(?=\{)"},
    "rust": {kind: r"^[ \t]*(?P<n>(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+)*" + word + r"\b)" for kind, word in
             (("function_item", "fn"), ("impl_item", "impl"), ("struct_item", "struct"), ("enum_item", "enum"), ("trait_item", "trait"), ("mod_item", "mod"))},
    "swift": {
        "function_declaration": _START + r"func\s+\w+)", "class_declaration": _START + r"(?:class|extension)\s+\w+)", "protocol_declaration": _START + r"protocol\s+\w+)",
        "struct_declaration": _START + r"struct\s+\w+)", "enum_declaration": _START + r"enum\s+\w+)",
    },
    "kotlin": {kind: _START + word + r"\b[^{;\n]*)(?=\{)" for kind, word in
               (("function_declaration", "fun"), ("class_declaration", "class"), ("object_declaration", "object"), ("interface_declaration", "interface"))},
    "scala": {"method_declaration": _START + r"def\s+\w+[^{;\n]*)(?=\{)", "class_declaration": _START + r"(?:class|object)\s+\w+[^{;\n]*)(?=\{)", "interface_declaration": _START + r"trait\s+\w+[^{;\n]*)(?=\{)"},
    "php": {"class_declaration": _START + r"(?:class|trait)\s+&?\w+)", "interface_declaration": _START + r"interface\s+&?\w+)", "function_definition": _START + r"function\s+&?\w+)"},
    "javascript": {
        "export_statement": r"^[ \t]*(?P<n>export\b)", "function_declaration": r"(?P<n>(?:async\s+)?function\s*\*?\s*\w+\s*\()", "class_declaration": r"(?P<n>\bclass\s+\w+)",
        "arrow_function": r"(?P<n>(?:async\s+)?\([^()]*\)\s*(?::\s*[\w<>\[\]| ]+)?=>\s*(?=\{))",
        "method_definition": r"^[ \t]+(?P<n>(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)[\w$]+\s*\([^;{}]*\)\s*(?::[^{;=]+)?(?=\{))",
        "interface_declaration": r"(?P<n>\binterface\s+\w+)", "type_alias_declaration": r"^[ \t]*(?P<n>type\s+\w+[^;{=]*=)",
    },
    "c": {
        "function_definition": r"^(?P<n>(?!typedef|using|return|else|if|for|while|switch|do)[A-Za-z_][\w\s*&:<>,~]*?\b[\w:~]+\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*(?=\{))",
        "class_specifier": r"^[ \t]*(?P<n>class\s+\w*[^;{}()]*)(?=\{)", "namespace_definition": r"^[ \t]*(?P<n>namespace\s+\w*[^;{}()]*)(?=\{)",
        "declaration": r"^(?P<n>(?!return|using|typedef)[A-Za-z_][\w\s*&:<>,]*\s[*&]*\w+(?:\[[^\]]*\])*(?:\s*=[^;{]*)?)(?=;)",
    },
    "objc": {"method_definition": r"^(?P<n>[-+]\s*\([^)]*\)[^;{]*)(?=\{)", "function_definition": r"^(?P<n>[A-Za-z_][\w\s*]*\b\w+\s*\([^;{}]*\)\s*)(?=\{)"},
    "css": {
        "media_statement": r"(?P<n>@media\b)", "keyframes_statement": r"(?P<n>@keyframes\b)", "import_statement": r"(?P<n>@import\b)", "rule_set": r"(?:^|(?<=[{};]))\s*(?P<n>[^@{};\s][^{};@]*)(?=\{)",
        "mixin_statement": r"(?P<n>@mixin\b)", "function_statement": r"(?P<n>@function\b)", "include_statement": r"(?P<n>@include\b)",
    },
}
for _name, _like in {"typescript": "javascript", "cpp": "c", "scss": "css"}.items():
    HEADS[_name] = HEADS[_like]


def heads(language: str) -> list[str]:
    """How the nodes start that a language is cut at."""
    return [HEADS[language][kind] for kind in NODE_KINDS[language] if kind in HEADS[language]]


def _objc(text: str) -> list[Span]:
    masked = _masked(text, "c")
    own = [m.span() for m in re.finditer(r"^@(?:interface|implementation|protocol)\b.*?^@end", masked, re.M | re.S)]
    return own + _braces(text, "c", HEADS["objc"].values())


def _go(text: str) -> list[Span]:
    masked = _masked(text, "js")
    grouped = [m.span() for m in re.finditer(r"^(?:var|const|type)\s*\([^)]*\)|^(?:var|const)\s+\w[^\n({]*|^type\s+\w+\s+[^\n{]+$", masked, re.M)]
    return grouped + _braces(text, "js", heads("go"))


# -- languages with end ------------------------------------------------------


def _ends(text: str, nodes: str, openers: str) -> list[Span]:
    """Nodes closed by ``end``; ``openers`` are all words that need one."""
    masked, stack, spans = _masked(text, "hash"), [], []
    for m in re.finditer(rf"(?P<node>{nodes})|(?P<open>{openers})|(?P<end>\bend\b)", masked, re.M):
        if m["end"]:
            if stack:
                start, is_node = stack.pop()
                if is_node:
                    spans.append((start, m.end()))
        else:
            stack.append((m.start() + len(m[0]) - len(m[0].lstrip()), m["node"] is not None))
    return spans


def _ruby(text: str) -> list[Span]:
    return _ends(text, r"^[ \t]*(?:def|class|module)\b", r"^[ \t]*(?:if|unless|case|while|until|for|begin)\b|\bdo\b|=[ \t]*(?:if|case|begin)\b")


def _elixir(text: str) -> list[Span]:
    spans = _ends(text, r"^[ \t]*\w+\b[^\n]*?\bdo\b(?!:)", r"\bfn\b")
    masked = _masked(text, "hash")
    return spans + [(m.start(), m.end()) for m in re.finditer(r"\bfn\b[^\n]*?->[^\n]*?\bend\b", masked)]


SCANNERS = {
    "python": _python,
    "json": _json,
    "yaml": _yaml,
    "toml": _toml,
    "markdown": _markdown,
    "html": lambda t: _markup(t, True),
    "xml": lambda t: _markup(t, False),
    "objc": _objc,
    "go": _go,
    "ruby": _ruby,
    "elixir": _elixir,
}
for _name, _family in {"java": "c", "csharp": "c", "rust": "rust", "swift": "c", "kotlin": "c", "scala": "c", "php": "php", "javascript": "js", "typescript": "js", "c": "c", "cpp": "c", "css": "css", "scss": "css"}.items():
    SCANNERS[_name] = lambda t, n=_name, f=_family: _braces(t, f, heads(n))
