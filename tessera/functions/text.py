"""Text columns: cleaning, titles, tokens, sentences, counters and view scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
YEAR = r"(?iU)\b(?:1[5-9]\d{2}|20\d{2}|2100)(?:s)?\b"
NUMBER = r"(?iU)\b\d+(?:[.,]\d+)*(?:%|st|nd|rd|th)?\b"
ENTITY = r"(?U)\b(?:[A-Z][\w'’.-]*)(?:\s+(?:[A-Z][\w'’.-]*|of|the|and|de|van|von)){1,5}\b"
TIME_TERMS = (
    "after april august before born century date december died during early era february founded january july june "
    "late later march may month november october retired retirement september since until when while year years"
).split()
RELATION_TERMS = (
    "actor adapted alias appointed author award based became child created daughter directed director employed father "
    "founded founder husband joined known married member mother named partner played president produced producer related "
    "role son spouse starred studied succeeded teacher wife winner worked writer wrote"
).split()
EVENT_TERMS = (
    "africa america asia battle campaign china city conference country election europe event expedition festival france "
    "government incident meeting movement province revolution school tour treaty university war world"
).split()
IDENTITY_TERMS = (
    "album artist band book company film group institution organization person series team university work"
).split()
VIEWS = ("topic", "identity", "episode", "relation")
LEAST_SENTENCE, MOST_SENTENCE, MOST_INFORMATION = 18, 720, 45


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalization; Spark has no built-in for it."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) and not v.isascii() else v)


#: Characters whose capital is several characters in full, one in simple case mapping: what SQL engines with simple mapping make of them.
SIMPLE_UPPER = {c: "\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def simple_upper(value: Column) -> Column:
    """Upper case, character by character: the length stays."""
    known = F.create_map(*(F.lit(x) for pair in SIMPLE_UPPER.items() for x in pair))
    each = F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(known, c), F.upper(c)))
    return F.when(F.length(F.upper(value)) == F.length(value), F.upper(value)).otherwise(F.array_join(each, ""))


def simple_lower(value: Column) -> Column:
    """Lower case, character by character: the last sigma of a word is no exception, the length stays."""
    return F.lower(F.translate(value, "Σİ", "σi"))


def clean_lines(value: Column) -> Column:
    """Line ends unified, blanks in each line collapsed and stripped, the whole stripped; no normalization."""
    value = F.regexp_replace(F.replace(value, F.lit("\0"), F.lit(" ")), r"\r\n?|[\x0B\x0C\x1C-\x1E\x85  ]", "\n")
    value = F.regexp_replace(F.regexp_replace(value, r"[ \t]+", " "), r"(?m)^ | $", "")
    return F.regexp_replace(value, r"\A\s+|\s+\z", "")


def clean_text(value: Column) -> Column:
    """Compatibility normalization, then clean_lines."""
    return clean_lines(nfkc(value))


def clean_field(value: Column, limit: int = 400) -> Column:
    """All white space collapsed, at most limit characters; a null is an empty text."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\x00]+", " ")), 1, limit)


def title(text: Column, document_id: Column) -> Column:
    """A "title:" line of the first 4096 characters, else the first usable of the first 20 lines, else the id."""
    named = clean_field(F.regexp_extract(F.substring(text, 1, 4096), r"(?im)^title:\s*(.+?)\s*$", 1), 512)
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: clean_field(F.regexp_replace(x, r"^[#\- ]+", ""), 512))
    usable = F.filter(lines, lambda x: (x != "") & ~x.startswith("---"))
    return F.coalesce(F.when(named != "", named), F.get(usable, F.lit(0)), F.concat(F.lit("Document "), document_id.cast("string")))


def domain(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("unknown-domain")))


def all_tokens(value: Column) -> Column:
    """Lower-cased tokens in the order of the text, with repeats."""
    return F.transform(F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0)), F.lower)


def tokens(value: Column) -> Column:
    """Distinct lower-cased tokens, in the order of their first places."""
    return F.array_distinct(all_tokens(value))


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and their full-width forms before white space, and at newlines; each with white space collapsed, at most 720 characters."""
    cut = F.split(F.regexp_replace(text, r"([.!?。！？])\s+", "$1\n"), r"\n+")
    return F.transform(cut, lambda s: clean_field(s, MOST_SENTENCE))


def usable_sentences(text: Column) -> Column:
    """Sentences of at least 18 characters, the first of those that differ in case only; the whole text if there is none."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  value is computed once
    long = F.filter(sentences(text), lambda s: F.length(s) >= LEAST_SENTENCE)
    # equal ones are neighbours in the order of their small letters and places
    keyed = F.array_sort(F.transform(long, lambda s, i: F.struct(F.lower(s).alias("k"), i.alias("i"), s.alias("s"))))
    first = once(keyed, lambda a: F.filter(a, lambda x, j: (j == 0) | (x["k"] != F.get(a, j - 1)["k"])))
    kept = F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    return once(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.filter(F.array(clean_field(text, MOST_SENTENCE)), lambda s: s != "")))


def count_terms(found: Column, terms: list[str]) -> Column:
    """How many of the distinct tokens are in a fixed list."""
    return F.size(F.array_intersect(found, F.array(*map(F.lit, terms))))


def view_scores(sentence: Column) -> dict[str, Column]:
    """What a sentence is worth to each view."""
    found = tokens(sentence)
    count = lambda pattern: F.regexp_count(sentence, F.lit(pattern))
    entities, years, numbers = count(ENTITY), count(YEAR), count(NUMBER)
    information = F.least(F.size(found), F.lit(MOST_INFORMATION))
    events = count_terms(found, EVENT_TERMS)
    return {
        "topic": 0.25 * information + entities + events,
        "identity": 4.0 * entities + 1.5 * count_terms(found, IDENTITY_TERMS) + 0.1 * information,
        "episode": 4.0 * years + 2.0 * count_terms(found, TIME_TERMS) + 1.5 * events + 0.35 * numbers,
        "relation": 3.0 * count_terms(found, RELATION_TERMS) + 1.25 * entities + 0.75 * numbers,
    }


def visible(value: Column) -> Column:
    """Line numbers and handle prefixes dropped, lower case, plain quotes and dashes, white space collapsed."""
    value = F.regexp_replace(value, r"(?m)^[^\S\n]*\d{1,8}[^\S\n]*[\t|:][^\S\n]*", "")
    value = F.regexp_replace(value, r"(?m)^[^\S\n]*=+[^\S\n]*D[^:\n]+:[^\S\n]*", "")
    return F.trim(F.regexp_replace(F.translate(F.lower(value), "“”‘’–—", "\"\"''--"), r"\s+", " "))


def handles(value: Column) -> Column:
    """Distinct document handles D<token> of a text, without trailing full stops."""
    found = F.regexp_extract_all(value, F.lit(r"(?<!\w)D([^\s\t|:;,\]\[()]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", "")))


def final_text(value: Column) -> Column:
    """The first <FINAL> element's text, else all of it, trimmed."""
    inner = F.regexp_extract(value, r"(?is)<FINAL>(.*?)</FINAL>", 1)
    return F.trim(F.when(F.regexp_like(value, F.lit(r"(?is)<FINAL>.*?</FINAL>")), inner).otherwise(value))


def query_features(query: Column) -> dict[str, Column]:
    """Eight numbers of a question's form, each scaled to about one."""
    count = lambda pattern: F.regexp_count(query, F.lit(pattern))
    return {
        "length": F.log1p(F.length(query)) / 8.0,
        "words": F.log1p(count(r"[\p{L}\p{N}_'-]+")) / 5.0,
        "capitals": F.least(count(r"\b[A-Z][A-Za-z'-]+\b"), F.lit(8)) / 8.0,
        "years": F.least(count(r"\b(?:1[5-9]\d{2}|20\d{2}|2100)\b"), F.lit(4)) / 4.0,
        "numbers": F.least(count(r"(?<!\w)[+-]?(?:\d+[.,]?\d*|\.\d+)(?!\w)"), F.lit(6)) / 6.0,
        "quotes": F.least(count("[\"“”‘’'][^\"“”‘’']+[\"“”‘’']"), F.lit(4)) / 4.0,
        "relations": F.least(count(r"(?i)\b(?:born|died|married|founded|member|parent|child|spouse|before|after|during|between|located|owned|directed|written|created|served)\b"), F.lit(6)) / 6.0,
        "questions": F.least(count(r"(?i)\b(?:who|when|where|which|what|whose|how)\b"), F.lit(4)) / 4.0,
    }
