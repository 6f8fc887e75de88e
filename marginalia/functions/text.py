"""String and date expressions. All are native column expressions; white space means what Unicode calls so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1C-\x1F]"
SOFT_HYPHEN = "­"
# Ligatures and what they count as when texts are compared.
LIGATURES, LIGATURE_LETTERS = "ﬁﬂﬀﬃﬄﬆﬅ", "fffffss"
# Ligatures and what they stand for when texts are read.
LIGATURE_SPELLINGS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ﬅ": "st"}
RECORD_END = "=========="


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: it becomes a lambda's variable, so big expressions aren't repeated.

    It costs generated code, but where a value is used by many fields that spares more than it costs (measured on positions).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"(?U){BLANK}+", " "))


def strip(c: Column | str) -> Column:
    """White space off both ends."""
    return F.regexp_replace(_col(c), rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def fold_ligatures(c: Column | str) -> Column:
    """Each ligature as the one letter that it counts as."""
    return F.translate(_col(c), LIGATURES, LIGATURE_LETTERS)


def spell_ligatures(c: Column | str) -> Column:
    """Each ligature as the letters that it stands for."""
    out = _col(c)
    for k, v in LIGATURE_SPELLINGS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def normalize_for_search(c: Column | str) -> Column:
    """Ligatures folded, line-break hyphens and then soft hyphens dropped, white space collapsed."""
    out = F.replace(fold_ligatures(c), F.lit("-\n"), F.lit(""))
    return collapse(F.replace(out, F.lit(SOFT_HYPHEN), F.lit("")))


def normalize_page(c: Column | str) -> Column:
    """As :func:`normalize_for_search`, but a hyphen with a soft hyphen before a line break stays a hyphen."""
    out = F.replace(fold_ligatures(c), F.lit(f"-{SOFT_HYPHEN}\n"), F.lit("-"))
    out = F.replace(out, F.lit(SOFT_HYPHEN), F.lit(""))
    return collapse(F.replace(out, F.lit("-\n"), F.lit("")))


def repair_spacing(c: Column | str) -> Column:
    """White space collapsed; a space after a full stop that runs into a digit or a capital."""
    out = F.regexp_replace(collapse(c), r"(?U)(\w)\.(\d)", "$1. $2")
    return F.regexp_replace(out, r"\.([A-Z])", ". $1")


def expanded(c: Column | str) -> Column:
    """The form that texts are compared in when results are checked: white space collapsed, ligatures spelled out, a space after a full stop that runs into a digit."""
    return F.regexp_replace(spell_ligatures(collapse(c)), r"(?U)(\w)\.(\d)", "$1. $2")


def with_ligatures(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))


def with_soft_hyphens(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("-"), F.lit(SOFT_HYPHEN))


def search_variants(c: Column | str) -> list[Column]:
    """The spellings tried one after the other by the prefix search."""
    c = _col(c)
    return [c, with_ligatures(c), with_soft_hyphens(c), with_ligatures(with_soft_hyphens(c))]


def words(c: Column | str) -> Column:
    """Non-empty words of a collapsed text; none for a blank one."""
    return F.array_remove(F.split(collapse(c), " "), "")


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of word characters and apostrophes, and single punctuation marks."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)([\w']+|[^\w\s])"), 1)


def token_norm(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def content_norm(c: Column | str) -> Column:
    """Lower case, hyphens dropped, whatever is neither letter nor digit as one space."""
    out = F.replace(F.lower(_col(c)), F.lit("-"), F.lit(""))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


# Fixed value: the form of a log's title line, as devices write it.
TITLE = r"(?U)\A(.+?)\s*\(([^)]+)\)\z"


def title_author(c: Column | str) -> Column:
    """struct<title, author> of a title line "Title (Author)"; without brackets at the end all is the title."""
    c = _col(c)
    bracketed = F.regexp_like(c, F.lit(TITLE))
    return F.struct(
        F.when(bracketed, strip(F.regexp_extract(c, TITLE, 1))).otherwise(strip(c)).alias("title"),
        F.when(bracketed, strip(F.regexp_extract(c, TITLE, 2))).otherwise("").alias("author"),
    )


# Fixed value: the form of a log's second line, as devices write it.
META = r"- Your (\w+) on (Location|Page) (\d+(?:-\d+)?)(?: \| Added on (.+))?"


def meta_line(c: Column | str) -> Column:
    """struct<type, location, page, added> of a clipping's second line; type "unknown" where it has another form."""
    c = _col(c)
    known = F.regexp_like(c, F.lit(META))
    part = lambda i: F.regexp_extract(c, META, i)
    return F.struct(
        F.when(known, F.lower(part(1))).otherwise("unknown").alias("type"),
        F.when(known & (part(2) == "Location"), part(3)).otherwise("").alias("location"),
        F.when(known & (part(2) == "Page"), part(3)).otherwise("").alias("page"),
        F.when(known & (part(4) != ""), part(4)).alias("added"),
    )


# Forms of date after the weekday is taken off, in the order they are tried.
DATE_FORMS = ("MMMM d, yyyy h:mm:ss a", "MMMM d, yyyy 'at' h:mm:ss a", "M/d/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss")


def added_date(c: Column | str) -> Column:
    """ISO form of the date a clipping was added on; a text of no known form is kept as it is."""
    c = strip(c)
    bare = F.regexp_replace(c, r"\A(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, ", "")
    parsed = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMS])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), c)


def added_on(c: Column | str) -> Column:
    """What follows "Added on " to the end of the line, else empty."""
    return F.regexp_extract(_col(c), r"Added on (.+)\z", 1)


def first_int(c: Column | str) -> Column:
    """First run of digits as a number; 0 where there is none."""
    return F.coalesce(F.regexp_extract(_col(c), r"\d+", 0).try_cast("int"), F.lit(0))


def range_start(c: Column | str) -> Column:
    """First number of "a" or "a-b"."""
    return F.split_part(_col(c), F.lit("-"), F.lit(1)).try_cast("int")


def book_key(c: Column | str) -> Column:
    return F.substring_index(_col(c), ".pdf", 1)


def book_from_path(c: Column | str) -> Column:
    """File name of a path up to the device's key mark, or its stem."""
    name = F.element_at(F.split(_col(c), "/"), -1)
    return F.when(F.contains(name, F.lit("-cdeKey_")), F.substring_index(name, "-cdeKey_", 1)).otherwise(F.regexp_replace(name, r"\.[^.]*\z", ""))


def content_key(c: Column | str) -> Column:
    """What two contents are compared by when exact duplicates are dropped."""
    return F.substring(strip(F.coalesce(_col(c), F.lit(""))), 1, 50)


def from_epoch_ms(c: Column | str) -> Column:
    """UTC time of epoch milliseconds; -1 stands for none."""
    return F.when(_col(c) != -1, F.timestamp_millis(_col(c)))


def bookmark_title(c: Column | str) -> Column:
    """Outline title of a bookmark from its ISO time."""
    t = F.try_to_timestamp(F.regexp_replace(_col(c), r"Z\z", "+00:00"))
    return F.coalesce(F.concat(F.lit("Kindle Bookmark ("), F.date_format(t, "yyyy-MM-dd HH:mm"), F.lit(")")), F.lit("Kindle Bookmark"))


def snippet(text: Column | str, at: Column, length: Column, around: int = 40) -> Column:
    """Part of a text around a 1-based match position."""
    start = F.greatest(F.lit(1), at - around)
    return F.substring(_col(text), start, at + length + around - start)


def learning_context(page: Column | str, page_norm: Column | str, search_norm: Column | str, before: int = 250, size: int = 500) -> Column:
    """``size`` characters of a page from ``before`` before the first 50 characters of the text sought, from the start if they are not there."""
    at = F.call_function("instr", _col(page_norm), F.substring(_col(search_norm), 1, 50))
    return F.substring(_col(page), F.when(at > 0, F.greatest(F.lit(1), at - before)).otherwise(1), F.lit(size))


def clean_filename(c: Column | str) -> Column:
    """Characters that file systems refuse as underscores, no spaces or dots at the ends, 200 characters at most."""
    out = F.translate(_col(c), '<>:"/\\|?*', "_" * 9)
    return F.substring(F.regexp_replace(out, r"\A[ .]+|[ .]+\z", ""), 1, 200)


def word_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of positions with equal words, of the longer text's length; 0 for two blank texts."""
    x, y = words(a), words(b)
    most = F.greatest(F.size(x), F.size(y))
    # Where one text is shorter its missing words are null and equal nothing.
    equal = F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda e: e)
    return F.when(most == 0, F.lit(0.0)).otherwise(F.size(equal) / most)


def first_words(w: Column, counts: tuple[int, ...] = (10, 7, 5)) -> list[Column]:
    """Candidates of the prefix search from an array of words: the first n where there are more, else null."""
    return [F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")) for n in counts]


def last_words(w: Column, ratios: tuple[float, ...] = (0.8, 0.6, 0.4)) -> list[Column]:
    """Candidates of the reverse search from an array of words: the last share of them; from where fewer than three are left all are null."""
    out, alive = [], F.lit(True)
    for r in ratios:
        k = (F.size(w) * F.lit(r)).cast("int")
        alive = alive & (k >= 3)
        out.append(F.when(alive, F.array_join(F.slice(w, -F.greatest(k, F.lit(1)), F.greatest(k, F.lit(1))), " ")))
    return out
