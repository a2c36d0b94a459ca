"""Languages, their file extensions and names, and the syntax nodes chunks are cut at."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language.
EXTENSIONS = {
    "rust": (".rs",),
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".cxx"),
    "go": (".go",),
    "csharp": (".cs",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "ruby": (".rb", ".rake", ".gemspec"),
    "elixir": (".ex", ".exs"),
    "objc": (".m", ".mm"),
    "php": (".php",),
    "scala": (".scala", ".sc", ".sbt"),
    "markdown": (".md", ".markdown", ".rst"),
    "json": (".json",),
    "yaml": (".yaml", ".yml"),
    "xml": (".xml", ".xib", ".storyboard", ".plist", ".csproj", ".sln", ".props", ".targets"),
    "html": (".html", ".htm"),
    "css": (".css", ".less"),
    "scss": (".scss", ".sass"),
    "toml": (".toml", ".xcconfig"),
}
#: Extensions that are scanned though no language has them.
PLAIN_EXTENSIONS = (".txt", ".sh", ".bash", ".zsh", ".fish", ".gradle", ".properties", ".config", ".cmake", ".make", ".ini", ".ipynb")
DEFAULT_EXTENSIONS = tuple(chain(*EXTENSIONS.values(), PLAIN_EXTENSIONS))
#: Other names of languages.
ALIASES = {
    "js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "ex": "elixir", "objective-c": "objc", "objectivec": "objc",
    "md": "markdown", "yml": "yaml", "sass": "scss",
}
UNKNOWN = "unknown"
LANGUAGE_OF = {ext: name for name, exts in EXTENSIONS.items() for ext in exts}
#: Syntax nodes that become chunks, by language.
NODE_KINDS = {
    "javascript": ("function_declaration", "arrow_function", "class_declaration", "method_definition", "export_statement"),
    "typescript": (
        "function_declaration", "arrow_function", "class_declaration", "method_definition", "export_statement", "interface_declaration", "type_alias_declaration",
    ),
    "python": ("function_definition", "class_definition", "decorated_definition", "async_function_definition"),
    "java": ("method_declaration", "class_declaration", "interface_declaration", "constructor_declaration"),
    "c": ("function_definition", "class_specifier", "namespace_definition", "declaration"),
    "cpp": ("function_definition", "class_specifier", "namespace_definition", "declaration"),
    "go": ("function_declaration", "method_declaration", "type_declaration", "var_declaration", "const_declaration"),
    "rust": ("function_item", "impl_item", "struct_item", "enum_item", "trait_item", "mod_item"),
    "csharp": ("method_declaration", "class_declaration", "interface_declaration", "struct_declaration", "enum_declaration"),
    "scala": ("method_declaration", "class_declaration", "interface_declaration", "constructor_declaration"),
    "swift": ("function_declaration", "class_declaration", "protocol_declaration", "struct_declaration", "enum_declaration"),
    "kotlin": ("function_declaration", "class_declaration", "object_declaration", "interface_declaration"),
    "ruby": ("method", "class", "module", "singleton_method"),
    "elixir": ("call", "anonymous_function", "do_block", "stab_clause"),
    "objc": ("function_definition", "class_interface", "class_implementation", "protocol_declaration"),
    "php": ("function_definition", "class_declaration", "method_declaration", "interface_declaration"),
    "markdown": ("section", "atx_heading", "setext_heading", "fenced_code_block", "indented_code_block"),
    "html": ("element", "script_element", "style_element"),
    "xml": ("element", "STag"),
    "css": ("rule_set", "media_statement", "keyframes_statement", "import_statement"),
    "scss": ("rule_set", "media_statement", "keyframes_statement", "import_statement", "mixin_statement", "function_statement", "include_statement"),
    "json": ("object", "array"),
    "yaml": ("block_mapping", "block_sequence", "flow_mapping", "flow_sequence"),
    "toml": ("table", "table_array_element"),
}


def with_dots(extensions) -> list[str]:
    """Extensions with the leading dot that users may leave out."""
    return [e if e.startswith(".") else f".{e}" for e in extensions]


def valid_extension(ext: Column) -> Column:
    """Whether a filter's extension starts with a dot, has more than it, and no space."""
    return ext.startswith(".") & (F.length(ext) > 1) & ~ext.contains(" ")


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def language_of(extension: Column) -> Column:
    """Language name of a dotted extension, case-sensitive; ``unknown`` for others."""
    return F.coalesce(_mapped(extension, LANGUAGE_OF), F.lit(UNKNOWN))


def canonical_language(name: Column) -> Column:
    """Canonical language of a name or alias in any case; ``unknown`` for others."""
    return F.coalesce(_mapped(F.lower(name), {n: n for n in EXTENSIONS} | ALIASES), F.lit(UNKNOWN))
