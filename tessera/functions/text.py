"""Column helpers for paths, words and hashes; all native expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "c": "c", "cpp": "cpp",
    "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "lua": "lua", "sh": "shell", "bash": "shell", "zsh": "shell",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "less": "less",
    "md": "markdown", "sql": "sql",
}
# Words that a memory search ignores.
MEMORY_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "not", "but", "with", "from", "by", "that",
    "this", "it", "as", "be", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might", "i", "we", "you",
    "they", "my", "our", "your", "its", "when", "how", "what", "which", "who", "whom", "where", "why", "if", "then", "so", "no", "yes", "up", "out",
    "about", "into", "after", "before", "between", "under", "over", "also", "just", "more", "some", "any", "each", "every", "all", "both", "few",
    "most", "bug", "error", "issue", "problem", "broken", "fix", "fails", "failing", "wrong",
]
# Words that a section ranking ignores.
SECTION_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most",
    "other", "some", "such", "no", "only", "own", "same", "than", "too", "very", "just", "how", "what", "where", "when", "why", "which", "who",
    "whom", "this", "that", "these", "those", "about", "work", "use", "using", "get", "set", "make", "like",
]


def lit_array(xs: list | tuple, kind: str = "string") -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast(f"array<{kind}>")


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def directory(path: Column) -> Column:
    p = F.split(slashes(path), "/")
    return F.array_join(F.slice(p, 1, F.size(p) - 1), "/")


def extension(path: Column) -> Column:
    """What follows the last full stop, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    return F.coalesce(F.element_at(lit_map(LANGUAGES), extension(path)), F.lit("unknown"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(content, F.lit("")), 256))


def contains_any(c: Column, words: list[str] | tuple) -> Column:
    return F.exists(lit_array(words), lambda w: F.contains(c, w)) if words else F.lit(False)


# Three tokenizers, as three searches need them.


def search_tokens(query: str | None) -> list[str]:
    """White-space tokens, lower-cased, punctuation kept."""
    return (query or "").lower().split()


def symptom_words(text: Column) -> Column:
    """Runs of ASCII word characters of over two characters, lower-cased, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda w: F.length(w) > 2)


def memory_tokens(text: Column) -> Column:
    """Words of a-z, 0-9, - and _ of over two characters that are no stop words; repeats kept."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-_]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(lit_array(MEMORY_STOP_WORDS), w))


def file_references(text: Column) -> Column:
    """Distinct base names of the source files that a text names."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)([\w\-./\\]+\.(?:js|jsx|ts|tsx|json|html|css|py|vue|svelte))\b"), 1)
    return F.array_distinct(F.transform(found, lambda p: F.element_at(F.split(slashes(p), "/"), -1)))


def fnv_signature(events: list[str] | None) -> str | None:
    """Two 32-bit FNV-1a streams over the UTF-16 units of the events joined by an arrow, as 16 hex digits."""
    if events is None:
        return None
    a, b = 0x811C9DC5, 0xC4C35C9B  # fixed values: the two offsets
    s = "→".join(events).encode("utf-16-le", "surrogatepass")
    for i in range(0, len(s), 2):
        c = s[i] | s[i + 1] << 8
        a, b = ((a ^ c) * 0x01000193) & 0xFFFFFFFF, ((b ^ c) * 0x01000193) & 0xFFFFFFFF
    return f"{a:08x}{b:08x}"


def signature_hash(events: Column) -> Column:
    """fnv_signature of an array column, by Arrow batches: native hashes give other digits."""
    @F.arrow_udf("string")
    def of(x: pa.Array) -> pa.Array:
        return pa.array([fnv_signature(e) for e in x.to_pylist()], pa.string())

    return of(events)
