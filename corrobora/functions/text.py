"""Column functions over text: normalisation, tokens, sentences, labels and CSV fields."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white-space class, stop words and word classes that results depend on.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_SPACE = "[^" + SPACE[1:]
STOPWORDS = "the a an and or of to in for is are be by on with that this from as at it its their are".split()
INTENT = "must|shall|will|should|policy|polic|require|required|expected|responsible|intend"
OPERATIONAL = (
    "maintain|maintained|review|reviewed|perform|performed|log|logged|record|records|monitor|monitored|"
    "conduct|conducted|execut|test|tested|track|tracked|inventory|inventories|list|scan|scans|approved|completed|"
    "quarterly|annually|monthly|weekly"
)
CURLY, STRAIGHT = "\u2018\u2019\u201b\u201c\u201d\u2013\u2014", "'''\"\"--"
EXTENSIONS = [".txt", ".md", ".markdown", ".docx", ".pdf"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Trims the full white-space class, which SQL's trim does not."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def norm_for_chunks(c: Column | str) -> Column:
    """Runs of space, tab, form feed and vertical tab to one space; three or more line feeds to two."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"[ \t\f\x0B]+", " "), r"\n{3,}", "\n\n")


def norm_of_composed(c: Column | str) -> Column:
    """The form in which quotes are compared, of text that is composed already: straight quotes and hyphens,
    single spaces, trimmed, lower case."""
    text = F.translate(F.coalesce(_col(c), F.lit("")), CURLY, STRAIGHT)
    return F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))


def with_norm(df: DataFrame, source: str, out: str) -> DataFrame:
    """``df`` with column ``out``: ``source`` in canonical composition, for which there is no built-in, and then
    in the form in which quotes are compared. Compatibility characters stay apart (a superscript is no digit)."""
    held = df.withColumn(out, F.coalesce(F.col(source), F.lit("")))
    at = held.columns.index(out)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return held.mapInArrow(compose, held.schema).withColumn(out, norm_of_composed(out))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9._-]+", "_")


def tokens(c: Column | str, least: int = 3) -> Column:
    """Lower-case runs of ASCII letters and digits with at least ``least`` characters, repeats kept."""
    return F.filter(F.split(F.lower(_col(c)), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def keywords(c: Column | str) -> Column:
    """Distinct tokens of four characters or more that are no stop words, by first occurrence."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.array_distinct(F.filter(tokens(c, 4), lambda t: ~F.array_contains(stop, t)))


def sentences(c: Column | str) -> Column:
    """Pieces that end in . ! or ? before white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(c), rf"(?<=[.!?]){SPACE}+"), trim_space), lambda s: F.length(s) > 0)


def contained(words: Column, lower_text: Column) -> Column:
    """The words that occur in the text, as substrings."""
    return F.filter(words, lambda w: F.contains(lower_text, w))


def has_word(c: Column | str, words: str) -> Column:
    """Any of the alternatives between ASCII word boundaries, in either case."""
    return _col(c).rlike(rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])")


def is_intent(c: Column | str) -> Column:
    return has_word(c, INTENT)


def is_operational(c: Column | str) -> Column:
    return has_word(c, OPERATIONAL)


def substantive(norm: Column | str) -> Column:
    """Has a normalised quote 20 characters and three runs of three letters?"""
    c = _col(norm)
    return (F.length(c) >= 20) & (F.regexp_count(c, F.lit("[a-z]{3,}")) >= 3)


def truncated(c: Column | str, most: int = 300) -> Column:
    """Cuts a longer quote, trims its end and appends an ellipsis."""
    text = _col(c)
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), f"{SPACE}+$", ""), F.lit("\u2026"))).otherwise(text)


def location(file: Column | str, page: Column | str) -> Column:
    """``file``, or ``file, p.N`` for a page other than null and 0."""
    p = _col(page)
    return F.concat(_col(file), F.when(p.isNotNull() & (p != 0), F.concat(F.lit(", p."), p.cast("string"))).otherwise(F.lit("")))


def csv_field(c: Column | str) -> Column:
    """One CSV field: null is empty, a leading formula character gets an apostrophe, then quoting if needed."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: Column | str) -> Column:
    return F.concat_ws(",", *(csv_field(c) for c in columns))


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"([^/]*)$", 1)


def extension(c: Column | str) -> Column:
    """The lower-case extension with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(basename(c), r"[^/](\.[^./]*)$", 1))
