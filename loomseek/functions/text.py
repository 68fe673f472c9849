"""Text functions as columns. Null texts give null, or empty arrays where said."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with diacritics, by the rule that their canonical decomposition begins with an ASCII letter.
_MARKED = [chr(c) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, b)]
_MARKED = [c for c in _MARKED if (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii() and d[0].isalpha()]
MARKED, PLAIN = "".join(_MARKED), "".join(unicodedata.normalize("NFD", c)[0].lower() for c in _MARKED)

#: What is noise in text to embed: addresses, state changes of a log, and stamps.
NOISE = (
    r"(?i)https?://[^ \t\n]+",
    r"(?i)State \"[A-Za-z]+\"( +from +\"[A-Za-z]*\")? *(\[[^\]]*\])?",
    r"\[[0-9]{4}-[0-9]{2}-[0-9]{2}[^\]]*\]",
)
_SPACE = " \t\n\r"


def fold(text: Column) -> Column:
    """Lower case, Latin letters without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Maximal runs of letters or numbers of the folded text; of null none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def tokenize(text: str) -> list[str]:
    """The same for a query on the driver."""
    table = str.maketrans(MARKED, PLAIN)
    out, word = [], ""
    for c in "".join(c for c in text.lower() if unicodedata.category(c) != "Mn").translate(table):
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def trim(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(_SPACE))


def strip_noise(text: Column) -> Column:
    """Without addresses, log lines and stamps; of null empty."""
    text = F.coalesce(text, F.lit(""))
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, "")
    return trim(text)


def word_count(text: Column) -> Column:
    """Runs of at least three letters."""
    return F.size(F.filter(F.split(text, r"[^\p{IsAlphabetic}]+"), lambda w: F.length(w) >= 3))


def digest(text: Column) -> Column:
    """Content digest of a passage."""
    return F.sha2(trim(text).cast("binary"), 256)


def paragraphs(text: Column) -> Column:
    """Trimmed texts between blank lines; of null none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n"), trim), lambda p: p != "")


def windows(text: Column, most: int = 1500, overlap: int = 300, dedup: bool = False) -> Column:
    """Paragraphs joined until they reach ``most`` characters.

    A window that was cut carries its last paragraph into the next one, if
    overlap > 0, even if nothing follows; ``dedup`` drops such a last window.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"), F.lit(False).alias("carried"))

    def step(acc: Column, p: Column) -> Column:
        held = F.concat(acc["held"], F.array(p))
        size = (acc["size"] + F.length(p) + 1).cast("int")
        full = size >= most
        rest = F.array(p) if overlap > 0 else F.array().cast("array<string>")
        left = (F.length(p) + 1) if overlap > 0 else F.lit(0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(held, "\n\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, rest).otherwise(held).alias("held"),
            F.when(full, left).otherwise(size).cast("int").alias("size"),
            full.alias("carried"),
        )

    def end(acc: Column) -> Column:
        last = F.size(acc["held"]) > 0
        if dedup:
            last = last & ~acc["carried"]
        return F.when(last, F.concat(acc["done"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["done"])

    return F.aggregate(paragraphs(text), start, step, end)


def aliases(value: Column) -> Column:
    """Names in an alias value: separated by white space or quotes, a double-quoted run (with backslash escapes) is one. Of null, and of a value with an open quote, none."""
    quoted, value = r'"(?:[^"\\]|\\.)*"', F.coalesce(value, F.lit(""))
    parts = F.regexp_extract_all(value, F.lit(quoted + r'|[^\s"]+'), F.lit(0))
    bare = F.transform(parts, lambda a: F.when(F.startswith(a, F.lit('"')), F.regexp_replace(F.regexp_replace(a, '(?s)^"(.*)"$', "$1"), r"\\(.)", "$1")).otherwise(a))
    return F.when(F.contains(F.regexp_replace(value, quoted, ""), F.lit('"')), F.array().cast("array<string>")).otherwise(bare)


def parse_keyword(value: Column) -> tuple[Column, Column]:
    """Key and value of a property keyword line."""
    return F.regexp_extract(value, r"^([^ \t]+)[ \t]+(.*)$", 1), F.regexp_extract(value, r"^([^ \t]+)[ \t]+(.*)$", 2)


def prop(properties: Column, name: str) -> Column:
    """Value of a property, case of the name ignored; null if absent."""
    hits = F.filter(F.map_entries(properties), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def has_prop(properties: Column, name: str) -> Column:
    """Whether the property is there, even with a null value."""
    return F.coalesce(F.exists(F.map_keys(properties), lambda k: F.lower(k) == name.lower()), F.lit(False))


def trigrams(text: str, most: int = 32) -> list[str]:
    """Distinct padded trigrams in order; of more than ``most`` an even sample."""
    s = f"  {text.lower()}  "
    grams = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
    n = len(grams)
    return grams if n <= most else [grams[i * (n - 1) // (most - 1)] for i in range(most)]


def similarity(title: Column, query: str) -> Column:
    """100 at equality, less by edit distance; case ignored."""
    q, t = F.lit(query.lower()), F.lower(F.coalesce(title, F.lit("")))
    scale = F.greatest(F.lit(1), F.length(q), F.length(t))
    return (F.lit(100.0) * (scale - F.levenshtein(q, t)) / scale).cast("double")


def link() -> Column:
    """Link to a result row."""
    return F.when(F.col("org_id").isNotNull(), F.format_string("[[id:%s][%s]]", "org_id", "title")).otherwise(F.format_string("[[file:%s::%d][%s]]", "path", "position", "title"))


def context_line() -> Column:
    """Where a target row stands: a file's title, a heading's outline path."""
    path = F.when(F.size("outline_path") > 0, F.array_join("outline_path", " > ")).otherwise(F.col("title"))
    return F.when(F.col("kind") == "file", F.col("title")).otherwise(path)


def below(path: Column, root: str) -> Column:
    """Whether a path lies in a folder."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))


def join_path(parts: Column) -> Column:
    """Outline path as one string, and back."""
    return F.array_join(parts, "\x1f")


def split_path(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, "\x1f"))


def parse_properties(text: Column) -> Column:
    """Map from its JSON; bad JSON gives null."""
    return F.from_json(text, "map<string,string>")
