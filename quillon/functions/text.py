"""String, array and JSON functions: Column to Column, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def _regex(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokenize_spaced(text: Column) -> Column:
    """Lower-case words, with dots, underscores and camel-case humps as bounds."""
    parted = F.regexp_replace(F.translate(text, "._", "  "), "([a-z])([A-Z])", "$1 $2")
    return _regex(F.lower(parted), WORD)


def tokenize_raw(text: Column) -> Column:
    """The whole text in lower case as one token; none for the empty text."""
    return F.when(text != "", F.array(F.lower(text))).otherwise(F.array().cast("array<string>"))


def tokenize_words(text: Column) -> Column:
    """Lower-case words; underscores and camel case don't part them."""
    return _regex(F.lower(text), WORD)


def is_autogenerated(name: Column) -> Column:
    return name.endswith(".mk")


def package_name(module: Column) -> Column:
    """First part of a dotted name."""
    return F.split_part(module, F.lit("."), F.lit(1))


def has_prefix(name: Column, prefix: Column) -> Column:
    """The name is the prefix, or goes on with a dot after it."""
    return (name == prefix) | F.startswith(name, F.concat(prefix, F.lit(".")))


def has_any_prefix(name: Column, prefixes: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)).cast("array<string>"), lambda p: has_prefix(name, p))


def bold_header(text: Column) -> Column:
    """What a text that starts with **bold** has there; null without or with nothing in it."""
    return F.nullif(F.regexp_extract(text, r"(?d)^\*\*(.+?)\*\*", 1), F.lit(""))


def rerank_document(name: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(name, F.lit(": "), text)).otherwise(name)


def is_projection_name(name: Column) -> Column:
    """The last part of a dotted name is ``to`` and a capital letter."""
    return F.element_at(F.split(name, r"\."), -1).rlike(r"^to\p{Lu}")


def linked_names(html: Column, pattern: str = r'href="[^"]*#([^"]+)"') -> Column:
    """Distinct link targets of an HTML text, in order of their first use."""
    return F.array_distinct(_regex(html, pattern, 1))


def link_parts(url: Column, extension: str = "lean") -> Column:
    """(package, path, first line, last line) of a link to lines of a file in a repository; null if it is none."""
    pattern = rf"github\.com/([^/]+)/([^/]+)/blob/[^/]+/(.+\.{extension})#L(\d+)-L(\d+)"
    part = lambda k: F.regexp_extract(url, pattern, k)
    fields = F.struct(part(2).alias("package"), part(3).alias("path"), part(4).cast("long").alias("line_start"), part(5).cast("long").alias("line_end"))
    return F.when(url.rlike(pattern), fields)


# Where core modules live, by the first part of their name.
CORE_FOLDERS = {"Init": "src/lean", "Lean": "src/lean", "Std": "src/lean", "Lake": "src/lake"}
CORE_REPOSITORY = "https://github.com/leanprover/lean4"


def source_link(module: Column, url: Column, start: Column, end: Column, version: str | None = None) -> Column:
    """Link to a module's lines: from its own url, else for core modules from the core repository, else null."""
    lines = F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    root = package_name(module)
    path = F.replace(module, F.lit("."), F.lit("/"))
    out = F.when(F.coalesce(url, F.lit("")) != "", F.concat(url, lines))
    for name, folder in CORE_FOLDERS.items():
        out = out.when(root == name, F.concat(F.lit(f"{CORE_REPOSITORY}/blob/{version or 'master'}/{folder}/"), path, F.lit(".lean"), lines))
    return out


# Folders of the toolchain's repository that lie elsewhere on disk, and where from its source folder.
TOOLCHAIN = "lean4"
TOOLCHAIN_FOLDERS = {"src/lean/": "", "src/lake/": "../lake/", "src/": ""}


def path_in_package(package: Column, folder: Column, path: Column, toolchain: str = TOOLCHAIN) -> Column:
    """Where a repository's file lies below a package's folder; the toolchain's own folders are rebased, the first that fits."""
    above = F.regexp_replace(folder, "/?[^/]*$", "")
    out = F.when(package != toolchain, F.concat_ws("/", folder, path))
    for prefix, place in TOOLCHAIN_FOLDERS.items():
        rest = F.substring(path, len(prefix) + 1, 1 << 30)
        base = F.concat_ws("/", F.when(above != "", above), F.lit(place[3:].rstrip("/"))) if place.startswith("../") else folder
        out = out.when(path.startswith(prefix), F.concat_ws("/", base, rest))
    return out.otherwise(F.concat_ws("/", folder, path))


def package_variants(package: Column) -> Column:
    """Folder names under which a package may be found, best first."""
    low = F.lower(package)
    return F.array_distinct(F.array(low, F.regexp_replace(low, r"\d+$", ""), F.replace(low, F.lit("-"), F.lit(""))))


def shortened(text: Column, limit: int = 256) -> Column:
    """Texts over the limit lose their end to three dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def dependency_lines(pairs: Column) -> Column:
    """Prompt lines of an array of (name, text) structs; empty for none."""
    lines = F.transform(pairs, lambda p: F.concat(F.lit("- "), p["name"], F.lit(": "), shortened(p["text"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("Dependencies:\n"), F.array_join(lines, "\n"))).otherwise("")


def fill_template(template: str, **fields: Column) -> Column:
    """A template with its {fields} filled in one pass, so that filled-in text is never filled again; {{ and }} are braces."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def prompt(template: str, name: Column, source_text: Column, docstring: Column, dependencies: Column) -> Column:
    doc = F.when(F.coalesce(docstring, F.lit("")) == "", "No docstring available").otherwise(docstring)
    return fill_template(template, name=name, source_text=source_text, docstring=doc, dependencies=dependencies)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def repository_parts(url: Column) -> Column:
    """(owner, repo) of a repository's address; null if it is none."""
    pattern = r"github\.com[/:]([^/]+)/([^/]+?)(?:\.git)?/?$"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo")))


def raw_file_url(url: Column, branch: Column, path: Column) -> Column:
    parts = repository_parts(url)
    return F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), parts["owner"], parts["repo"], branch, path)


def version_of(text: Column) -> Column:
    """The first version number such as v4.2.0 or v4.2.0-rc1; null without one."""
    return F.nullif(F.regexp_extract(text, r"v\d+\.\d+\.\d+(?:-rc\d+)?", 0), F.lit(""))


def version_key(tag: Column) -> Column:
    """All integers of a tag, for ordering: a candidate (rc) of a release sorts after the release."""
    return F.transform(_regex(tag, r"\d+"), lambda x: x.cast("long"))


def is_version_tag(tag: Column) -> Column:
    return tag.rlike(r"^v?\d+\.\d+\.\d+")


def at_least_version(version: Column, least: tuple[int, int, int] = (4, 29, 0), candidate: int = 2) -> Column:
    """The version is the given one or later; of its candidates, those from the given one on."""
    pattern = r"^v(\d+)\.(\d+)\.(\d+)(?:-rc(\d+))?$"
    number = lambda k: F.regexp_extract(version, pattern, k).try_cast("int")
    own, bound = F.struct(number(1).alias("a"), number(2).alias("b"), number(3).alias("c")), F.struct(*(F.lit(x).alias(n) for x, n in zip(least, "abc")))
    rc = number(4)
    return F.coalesce(version.rlike(pattern) & ((own > bound) | ((own == bound) & (rc.isNull() | (rc >= candidate)))), F.lit(False))


def parsed_dependencies(text: Column) -> Column:
    """Names of a JSON list in a string; whatever isn't a list gives none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def strict_dependencies(text: Column) -> Column:
    """As parsed_dependencies, but malformed JSON fails the job."""
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.from_json(text, "array<string>", {"mode": "FAILFAST"}))


def dependencies_json(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.to_json(names))


def without_self(names: Column, own: Column) -> Column:
    """The names but the own one; null if none is left."""
    left = F.filter(names, lambda d: d != own)
    return F.when(F.size(left) > 0, left)


def compact_json(*columns: str) -> Column:
    """A struct as JSON without its null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def rerank_pair(instruction: str, query: Column, document: Column) -> Column:
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), document)
