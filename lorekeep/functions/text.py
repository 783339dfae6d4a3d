"""Text functions as Spark columns: slugs, previews, tokens, title words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for term weights.
TERM_STOP_WORDS = """
the and for are but not you all can had her was one our out has have been from with they this that what when
which their will each make how its may into than then them same some were who did get let say she too use also
just about would there after other could these where being does more very most only such should over because
any here
""".split()

# Words that carry no meaning in titles.
TITLE_STOP_WORDS = """
the and for with from that this are was were been have has had not but all can her his how its may new now old
see way who did get let say she too use our out
""".split()


def _accents() -> tuple[str, str]:
    """Lower-case letters with a diacritic and their bare letters, from the canonical decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and chr(code) == chr(code).lower():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BARE = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics; ASCII text, the usual case, needs no more than the lower case."""
    bare = F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _BARE), r"\p{Mn}", "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(bare)


def search_form(c: Column) -> Column:
    """The text as full-text search sees it: folded words with one blank around each; null is a lone blank."""
    words = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def n_words(form: Column) -> Column:
    """Words in a search_form."""
    return F.when(F.trim(form) == "", 0).otherwise(F.regexp_count(form, F.lit(" ")) - 1)


def terms(c: Column) -> Column:
    """Terms for weights: runs of letters and decimal digits of at least two bytes that are no stop words."""
    runs = F.split(F.lower(c), r"[^\p{L}\p{Nd}]+")
    return F.filter(runs, lambda t: (F.octet_length(t) >= 2) & ~t.isin(TERM_STOP_WORDS))


def title_words(c: Column) -> Column:
    """The set of words of a title of at least three bytes that are no title stop words; punctuation stays."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(TITLE_STOP_WORDS)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the size of the smaller set; 0 if one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def slug_name(c: Column) -> Column:
    """File name of a title: lower case, '-' for everything but ASCII letters and digits, at most 100 characters."""
    dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-")
    stem = F.substring(F.btrim(dashed, F.lit("-")), 1, 100)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("untitled")), F.lit(".md"))


def cut_to(c: Column, most: int, keep: int) -> Column:
    """The text, or its first `keep` characters and '...' where it is longer than `most`."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def preview(c: Column) -> Column:
    """Preview of a search hit: trimmed first 200 characters, cut to 100."""
    return cut_to(F.trim(F.substring(c, 1, 200)), 100, 100)


def context_preview(c: Column) -> Column:
    """Preview in a context listing: up to 120 characters on one line."""
    return F.replace(cut_to(c, 120, 117), F.lit("\n"), F.lit(" "))


def note_preview(c: Column) -> Column:
    return cut_to(c, 60, 57)


def session_preview(summary: Column, decisions: Column) -> Column:
    """The summary up to 100 characters, or else the first decision."""
    first = F.concat(F.lit("Decisions: "), F.get(decisions, F.lit(0)))
    return cut_to(F.coalesce(F.nullif(summary, F.lit("")), first), 100, 97)


def id8(c: Column) -> Column:
    return F.substring(c, 1, 8)


def for_embedding(title: Column, content: Column, tags: Column) -> Column:
    return F.concat_ws(" ", title, content, F.array_join(tags, " "))


def embedding_input(c: Column, most: int = 7500, back: int = 200) -> Column:
    """At most `most` characters, cut at the last blank if one is among the final `back`."""
    head = F.substring(c, 1, most)
    at_blank = F.regexp_extract(head, rf"(?s)^(.{{{most - back},{most - 1}}}) [^ ]*$", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(at_blank, F.lit("")), head))


def human_bytes(n: Column) -> Column:
    """1024-based size with one decimal; plain bytes below 1 KB."""
    size = F.format_string("%d B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        size = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power)))).otherwise(size)
    return size


def language_of(path: Column) -> Column:
    """Programming language by file extension; empty if unknown."""
    # Extensions by language.
    extensions = {"go": ["go"], "python": ["py"], "typescript": ["ts", "tsx", "js", "jsx", "mjs"], "rust": ["rs"]}
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("")
    for language, endings in extensions.items():
        out = F.when(ending.isin(endings), language).otherwise(out)
    return out


def backend_pair(c: Column) -> Column:
    """(backend, model) of 'backend:model'; a bare name stands for both, an empty one for tfidf."""
    name = F.coalesce(F.nullif(c, F.lit("")), F.lit("tfidf"))
    return F.struct(
        F.split_part(name, F.lit(":"), F.lit(1)).alias("backend"),
        F.when(F.contains(name, F.lit(":")), F.regexp_extract(name, r"(?s)^[^:]*:(.*)$", 1)).otherwise(name).alias("model"),
    )


def observation(c: Column) -> Column:
    """The lines of a tool's output of 20 to 2000 bytes that tell of errors, warnings or passed tests; else ''."""
    # Fixed value: the words that make a line worth keeping.
    telling = r"(?i)error|fail|warning|passed|permission denied"
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(telling))
    return F.when(F.octet_length(c).between(20, 2000), F.array_join(lines, "\n")).otherwise(F.lit(""))


def split_fields(c: Column, *names: str) -> Column:
    """A struct of the parts of 'a:b:c', as many as there are names; the last keeps further colons, missing parts are
    null."""
    parts = F.split(c, ":", len(names))
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def is_secret(key: Column) -> Column:
    """Configuration keys whose values must not be shown."""
    low = F.lower(key)
    return low.rlike("api_key|secret|password|token") & ~low.endswith("api_key_env")


def masked(value: Column) -> Column:
    return F.when(F.length(value) > 8, F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4)))).otherwise(
        F.lit("***")
    )


def recency_boosted(score: Column, created: Column, as_of: Column) -> Column:
    """Score times 1.2 below an age of 7 days, falling to 1 at 30 days."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(created)) / F.lit(86_400)
    boost = F.when(age < 7, 0.2).when(age < 30, 0.2 * (1 - (age - 7) / 23)).otherwise(0.0)
    return score * (1 + F.coalesce(boost, F.lit(0.0)))
