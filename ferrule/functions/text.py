"""Text functions as Column expressions: no Python runs on the rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 120
WINDOW_SIZE, WINDOW_OVERLAP = 3, 1


#: Unicode's white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind, in one pass over it."""
    return F.trim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it, also inside lambdas."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def chunks(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (idx, start, end, text): windows of ``size`` characters, stripped, blank ones dropped, numbered after that."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it, not negative")
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), strip(F.substring(text, s + 1, F.lit(size))).alias("text")))
    kept = F.filter(cut, lambda x: x["text"] != "")
    return F.transform(kept, lambda x, i: F.struct(i.alias("idx"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def sentences(c: Column) -> Column:
    """Split after . ! ? followed by white space and at line ends; stripped; blank ones dropped."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), r"\n{2,}", "\n")
    return F.filter(F.transform(F.split(one, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def sentence_windows(items: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> Column:
    """Overlapping runs of an array's items, joined by spaces; the last may be short, and none starts once the end is reached."""
    step = size - overlap

    def windows(x: Column) -> Column:
        n = F.size(x)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(x, i * step + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return once(items, windows)


def window_places(items: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> Column:
    """The same windows as arrays of the items' numbers, from 0 on."""
    step = size - overlap

    def places(n: Column) -> Column:
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        listed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.filter(F.sequence(i * step, i * step + size - 1), lambda j: j < n))
        return F.when(n > 0, listed).otherwise(F.array().cast("array<array<int>>"))

    return once(F.size(items), places)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\S+)"), 1))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\S+)"), 1)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, one at least; 0 for nothing."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4).cast("int")))


def json_token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def first_words(c: Column, n: int) -> Column:
    """The text itself if it has at most n words, else its first n, joined by single spaces."""
    return F.when(word_count(c) <= n, c).otherwise(F.array_join(F.slice(words(c), 1, n), " "))


def token_windows(c: Column, size: int) -> Column:
    """Windows of ``size`` words, half overlapping, with one at the very end whatever the step."""
    step, w = max(1, size // 2), words(c)
    n = F.size(w)
    regular = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step))
    starts = F.array_distinct(F.concat(regular, F.array(F.greatest(n - size, F.lit(0)))))
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def nfkc(c: Column) -> Column:
    """Unicode's compatible composed form. Spark has no function for it; texts of ASCII characters alone are their own and don't go to Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(F.pandas_udf(run, "string")(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def norm_key(c: Column) -> Column:
    """Compatible forms made one, lower case, white space collapsed, everything but letters, digits, underscores and spaces dropped."""
    collapsed = F.regexp_replace(F.lower(strip(nfkc(c))), r"(?U)\s+", " ")
    return F.regexp_replace(collapsed, r"(?U)[^\w\s]+", "")


def norm_phrase(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def safe_title(c: Column, default: str = "Untitled") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "-"), "-{2,}", "-"), r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def valid_project_name(c: Column) -> Column:
    return ~blank(c) & ~F.contains(c, F.lit("/")) & ~F.contains(c, F.lit("\\")) & ~F.contains(c, F.lit(".."))


def escape_attr(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def format_score(c: Column) -> Column:
    """Eight decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.8f", c.cast("double")), "0+$", ""), r"\.$", "")


#: The rest of a line up to its last character that isn't a space or a tab; read once forward, its trailing spaces once back.
TO_LAST = r".*[^ \t\n\r\u0085\u2028\u2029]"


def mask_headings(c: Column, levels: int = 3) -> Column:
    """Line-start headings followed by a space become [H1], [H2] ...; a text keeps its meaning without structuring a prompt."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    for k in range(levels, 0, -1):
        out = F.regexp_replace(out, rf"(?m)^([ \t]*+)#{{{k}}} ++((?:{TO_LAST})?)[ \t]*+$", f"$1[H{k}] $2")
    return strip(out)


def mask_structure(c: Column) -> Column:
    """Line-start headings of any level, fences and rules become [H1] to [H6], [CODE_FENCE], [RULE]."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, rf"(?m)^([ \t]*+)```[ \t]*+(?=\S)({TO_LAST})[ \t]*+$", "$1[CODE_FENCE] $2")
    out = F.regexp_replace(out, r"(?m)^([ \t]*+)```[ \t]*+$", "$1[CODE_FENCE]")
    out = F.regexp_replace(out, r"(?m)^([ \t]*+)-{3,}+[ \t]*+$", "$1[RULE]")
    for k in range(6, 0, -1):
        out = F.regexp_replace(out, rf"(?m)^([ \t]*+)#{{{k}}}[ \t]*+(?=\S)({TO_LAST})[ \t]*+$", f"$1[H{k}] $2")
        out = F.regexp_replace(out, rf"(?m)^([ \t]*+)#{{{k}}}[ \t]*+$", f"$1[H{k}]")
    return strip(out)


def mask_headings_tight(c: Column) -> Column:
    """Only markers in the first column count, with or without a space after them."""
    out = F.coalesce(c, F.lit(""))
    for k in (3, 2, 1):
        out = F.regexp_replace(out, rf"(?m)^#{{{k}}}[ \t]*", f"[H{k}] ")
    out = F.regexp_replace(out, r"(?m)^```", "[CODE_FENCE]")
    return strip(F.regexp_replace(out, r"(?m)^---[ \t]*$", "[RULE]"))


def json_object(c: Column) -> Column:
    """The text if it is a JSON object, else its outermost braces if they are one, else an empty object."""
    text = F.coalesce(c, F.lit(""))
    first, after = F.instr(text, F.lit("{")), F.instr(F.reverse(text), F.lit("}"))  # counted from either end
    inner = F.when((first > 0) & (after > 0) & (first + after <= F.length(text)), F.substring(text, first, F.length(text) - after - first + 2)).otherwise("")
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(text), strip(text)).when(is_object(inner), inner).otherwise(F.lit("{}"))


def distinct_ci(items: Column) -> Column:
    """Stripped items, blank ones dropped, each kept once whatever its case, in order of first appearance."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")

    def firsts(x: Column) -> Column:
        """Items sorted by lower case and place; the first of each run, back in order."""
        placed = F.array_sort(F.transform(x, lambda y, i: F.struct(F.lower(y).alias("lower"), i.alias("i"))))
        heads = once(placed, lambda p: F.filter(p, lambda y, k: (k == 0) | (F.get(p, k - 1)["lower"] != y["lower"])))
        return F.transform(F.array_sort(F.transform(heads, lambda y: y["i"])), lambda i: F.get(x, i))

    return once(clean, firsts)


def split_keywords(c: Column) -> Column:
    return distinct_ci(F.split(F.coalesce(c, F.lit("")), r"[,\n]"))


def normalise_one(value: Column, allowed: list[str], default: str | None = None) -> Column:
    """The value if allowed, else the default if allowed, else the first allowed one."""
    fallback = default if default in allowed else (allowed[0] if allowed else None)
    return F.when(strip(value).isin(*allowed), strip(value)).otherwise(F.lit(fallback)) if allowed else F.lit(None).cast("string")


def normalise_many(values: Column, allowed: list[str], most: int, defaults: list[str] | None = None) -> Column:
    """Allowed values, each once, at most ``most``; if none is left, the defaults, else the first allowed ones."""
    options = F.array(*map(F.lit, allowed)).cast("array<string>")
    kept = F.slice(F.array_intersect(F.transform(values, strip), options), 1, most)
    fallback = [d for d in defaults or [] if d in allowed][:most] or allowed[:most]
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(*map(F.lit, fallback)).cast("array<string>"))


def chunk_id(source: Column, sha: Column, idx: Column) -> Column:
    return F.concat_ws("::", source, sha, idx.cast("string"))


def text_sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def clean_mode(c: Column) -> Column:
    mode = F.upper(strip(c))
    return F.when(mode.isin("QA", "Q", "A"), mode).otherwise("QA")


def utc_stamp(ts: Column) -> Column:
    """ISO form in whole seconds; the session's time zone should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def history_name(ts: Column, title: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd-HH-mm"), F.lit("-"), safe_title(title, "Memory"))


def canonical_sha(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names; null lists are empty ones, other nulls are written as null."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def auto_keywords(c: Column, n: int = 5) -> Column:
    """The n words of three letters or more that a text has most often, ties in alphabetical order."""
    listed = F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\p{L}{3,}+)"), 1))

    def counted(x: Column) -> Column:
        """Places where a run of equal words begins, and how far it is to the next."""
        heads = F.filter(F.transform(x, lambda w, i: F.when((i == 0) | (F.get(x, i - 1) != w), i)), lambda i: i.isNotNull())
        return once(heads, lambda h: F.transform(h, lambda i, k: F.struct((i - F.coalesce(F.get(h, k + 1), F.size(x))).alias("n"), F.get(x, i).alias("word"))))

    return F.slice(F.transform(F.array_sort(once(listed, counted)), lambda x: x["word"]), 1, n)
