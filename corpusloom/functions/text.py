"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of documents by the name of a folder above them.
DOC_TYPES = {
    "datasheets": "datasheet",
    "manuals": "manual",
    "schematics": "schematic",
    "reference": "reference",
    "specs": "spec",
    "guides": "guide",
}


def words(text: Column) -> Column:
    """The runs of characters other than white space (as Unicode has it)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word or a third of one a character, whichever is more; at least 1."""
    return F.greatest(F.lit(1), F.greatest(F.size(words(text)) * F.lit(1.3), F.length(text) / F.lit(3)).cast("int"))


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def slug(path: Column) -> Column:
    """The stem in lower case, other characters than letters, digits and hyphens made hyphens, single and not at ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(stem(path), "[^A-Za-z0-9]+", "-"), "^-|-$", ""))


def doc_type(path: Column) -> Column:
    """The kind that the nearest folder above stands for; ``unknown`` if none does."""
    kinds = F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])
    known = F.filter(F.reverse(F.split(parent(path), "/")), lambda d: F.map_contains_key(kinds, d))
    return F.coalesce(kinds[F.get(known, 0)], F.lit("unknown"))


def file_type(path: Column) -> Column:
    return F.when(suffix(path) == ".md", "markdown").otherwise("pdf")


def sidecar_path(path: Column, root: str) -> Column:
    """The metadata file that mirrors a source file under root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".embed-meta.yaml"))


def is_table(text: Column) -> Column:
    """Whether two lines or more are markdown table rows."""
    lines = F.split(F.trim(text), "\n")
    return F.size(F.filter(lines, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "").rlike(r"^\|[^\n]*\|$"))) >= 2


#: Fixed pattern of a markdown table: a header row, a rule and rows.
TABLE = r"(\|[^\n]*\|\n\|[-:\s|]+\|\n(?:\|[^\n]*\|\n?)+)"


def tables(text: Column) -> Column:
    """All markdown tables of a text, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


#: Fixed pattern of a figure's caption.
CAPTION = r"(?i)(?U)\b(fig\.?|figure|plot|chart|diagram|graph)\s*\d+\b"


def has_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole string; ``*`` and ``?`` go over slashes too."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/" else c
        i += 1
    return f"(?s)^{out}$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Folder patterns (ending in a slash) match at the start or as an inner folder, others by name or whole path."""
    tests = []
    for p in patterns:
        if p.endswith("/"):
            tests.append(path.startswith(p) | F.concat(F.lit("/"), path).contains(f"/{p.rstrip('/')}/"))
        else:
            tests.append(basename(path).rlike(glob_regex(p)) | path.rlike(glob_regex(p)))
    return any_of(tests)


def excluded_inside(path: Column, patterns: list[str]) -> Column:
    """The audit's form: the pattern, or the pattern anywhere below a slash with anything after it."""
    return any_of([path.rlike(glob_regex(p)) | path.rlike(glob_regex(f"*/{p}*")) for p in patterns])


def label(file_path: Column, slug_: Column, page: Column | None = None) -> Column:
    """Where a hit is from: its file, else its slug, else nothing; visual hits name the page."""
    name = F.coalesce(F.when(file_path != "", file_path), slug_, F.lit(""))
    return name if page is None else F.format_string("%s (page %d)", name, page)


def version_numbers(version: Column) -> Column:
    """The leading number of each dotted part; [0] if a part has none."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    return F.when(F.exists(parts, lambda p: p == "") | version.isNull(), F.array(F.lit(0))).otherwise(F.transform(parts, lambda p: p.cast("int")))


def query_of(prompt: Column, compressed: Column | None = None, most: int = 500) -> Column:
    """A short prompt as it is; of a long one what a model made of it, else its end."""
    rest = F.right(prompt, F.lit(most))
    return F.when(F.length(prompt) <= most, prompt).otherwise(rest if compressed is None else F.coalesce(compressed, rest))


def mentions(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds any of the keywords, whatever the case."""
    low = F.lower(text)
    return any_of([F.contains(low, F.lit(k.lower())) for k in keywords])
