"""Paths, languages and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the code-indexing table (lower case).
LANGUAGE_BY_EXTENSION = {
    "dart": "dart", "rs": "rust", "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "go": "go", "swift": "swift", "cs": "csharp", "php": "php", "scala": "scala", "rb": "ruby", "hs": "haskell",
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "c": "c",
    "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp",
    "json": "json", "yml": "yaml", "yaml": "yaml", "xml": "xml", "sql": "sql", "md": "markdown", "markdown": "markdown", "sh": "shell", "bash": "shell", "zsh": "shell", "cmake": "cmake",
}
#: The graph table has five languages, the review table eight (case matters there).
GRAPH_LANGUAGES = {"dart": "dart", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
REVIEW_LANGUAGES = {"dart": "dart", "kt": "kotlin", "kts": "kotlin", "java": "java", "ts": "typescript", "tsx": "tsx", "js": "javascript", "swift": "swift", "rs": "rust"}
RULE_FOLDERS = {"dart": "dart", "kt": "kotlin", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "swift": "swift", "rs": "rust", "py": "python", "go": "go"}

#: Folders that scans skip, and endings of generated files.
PRUNED_DIRS = (".git", "node_modules", "build", "target", ".dart_tool", ".idea", ".vscode")
GENERATED_SUFFIXES = (".g.dart", ".freezed.dart", ".gr.dart")
GENERATED_DIRS = ("/gen/", "/generated/")
MAX_FILE_BYTES = 2 * 1024 * 1024


def unix_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def extension(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def guess_language(path: Column) -> Column:
    low = F.lower(path)
    by_ext = F.when(F.contains(low, F.lit(".")), _lookup(LANGUAGE_BY_EXTENSION, extension(low)))
    return F.coalesce(F.when(low.endswith("cmakelists.txt"), F.lit("cmake")), by_ext, F.lit("other"))


def detect_language(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), _lookup(GRAPH_LANGUAGES, F.lower(extension(path))))


def review_language(path: Column) -> Column:
    return _lookup(REVIEW_LANGUAGES, extension(path))


def rule_folder(path: Column) -> Column:
    return _lookup(RULE_FOLDERS, F.lower(extension(path)))


def glob_to_regex(glob: str) -> str:
    """A regular expression for a glob on unix-separated paths: ``**`` spans folders, ``*`` and ``?`` stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_to_regex(x)[1:-1] for x in glob[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches; globs that make no valid expression are skipped."""
    found = F.lit(False)
    for g in globs:
        try:
            re.compile(pattern := glob_to_regex(g))
        except re.error:
            continue
        found = found | unix_path(path).rlike(pattern)
    return found


def looks_generated(path: Column, folders: bool = True) -> Column:
    out = F.lit(False)
    for s in GENERATED_SUFFIXES:
        out = out | path.endswith(s)
    for d in GENERATED_DIRS if folders else ():
        out = out | F.contains(path, F.lit(d))
    return out


def normal_segments(c: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back, lexically."""
    parts = F.filter(F.split(unix_path(c), "/"), lambda x: (x != "") & (x != "."))
    back = lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), back), "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def resolve_relative(base_file: Column, uri: Column) -> Column:
    """``./x``, ``../x`` and ``*.dart`` from a file's folder; null for other URIs."""
    relative = uri.startswith("./") | uri.startswith("../") | (uri.endswith(".dart") & ~F.contains(uri, F.lit(":")))
    folder = F.regexp_replace(base_file, r"[^/]*$", "")
    return F.when(relative, normal_segments(F.concat(folder, uri)))


def package_path(uri: Column, package: Column, lib_root: Column) -> Column:
    """``package:name/x`` to the package's lib folder, where the names agree."""
    return F.when(F.regexp_extract(uri, "^package:([^/]+)/", 1) == package, F.concat(lib_root, F.lit("/"), F.regexp_extract(uri, "^package:[^/]+/(.*)$", 1)))


def repo_relative(path: Column, root: Column) -> Column:
    """Relative to the repository's parent, with / separators."""
    parent = F.regexp_replace(F.regexp_replace(unix_path(root), "/+$", ""), r"[^/]*$", "")
    p = unix_path(path)
    return F.when(p.startswith(parent), F.substr(p, F.char_length(parent) + 1)).otherwise(p)


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"([^/:]+)$", 1), r"\.git$", "")


def safe_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(unix_path(path), "/"), -1), r"[^A-Za-z0-9._-]", "_")


def slashes_to_underscores(c: Column) -> Column:
    return F.translate(c, "/", "_")


def origin(uri: Column) -> Column:
    """sdk, package, local (a file URI) or unknown."""
    return F.when(uri.startswith("dart:"), "sdk").when(uri.startswith("package:"), "package").when(F.lower(uri).startswith("file:"), "local").otherwise("unknown")


def target_path(uri: Column, root: Column) -> Column:
    """A file URI inside the repository relative to it, one inside an SDK below ``flutter_sdk/``, any other as it is."""
    path = F.when(F.lower(uri).startswith("file://"), F.url_decode(F.regexp_replace(uri, r"(?i)^file://[^/]*", "")))
    sdk = F.regexp_extract(path, r"^(?:.*?/)flutter/((?:bin|packages)(?:/.*)?)$", 1)
    inside = path.startswith(F.concat(F.regexp_replace(unix_path(root), "/+$", ""), F.lit("/")))
    return F.when(inside, repo_relative(path, root)).when(sdk != "", F.concat(F.lit("flutter_sdk/"), sdk)).otherwise(uri)


def import_target(uri: Column) -> Column:
    """A graph target of an import: sdk:, package: or file:."""
    return F.when(uri.startswith("dart:"), F.concat(F.lit("sdk:"), F.substr(uri, F.lit(6)))).when(uri.startswith("package:"), uri).otherwise(F.concat(F.lit("file:"), uri))
