"""Text functions as columns (native, so they stay inside generated code).

Regular expressions keep to what Java and RE2 read alike; white space is
``[\\s\\p{Z}]`` because Java's ``\\s`` alone misses the no-break space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed values.
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "plc", "lp", "holdings", "group", "the")
KNOWN_TICKERS = ("AAPL", "MSFT", "NVDA", "GOOG", "GOOGL", "AMZN", "META", "TSLA", "A0")
# End of fixed values.

SPACES = r"[\s\p{Z}]+"
CITATION = r"\[([GP][0-9]+)\]"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: ColumnLike) -> Column:
    """White space runs become one blank; ends are trimmed (B2)."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def html_to_text(c: ColumnLike) -> Column:
    """Visible text: script, style and table elements go with their contents (B1)."""
    out = col(c)
    for tag in ("script", "style", "table"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return squeeze(F.regexp_replace(out, r"<[^>]*>", " "))


def filing_date(name: ColumnLike) -> Column:
    """The first eight digits of a file name as a date, null if they are none (A5)."""
    digits = F.regexp_extract(col(name), r"([0-9]{8})", 1)
    return F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd")


def chunk_id(doc_id: ColumnLike, pos: ColumnLike) -> Column:
    """sha1 of 'doc:pos': the same place has the same id whatever its text."""
    return F.sha1(F.concat_ws(":", col(doc_id).cast("string"), col(pos).cast("string")))


def fingerprint(text: ColumnLike) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 16)


def canonical(name: ColumnLike) -> Column:
    """Key under which spellings of one name meet; may be empty."""
    out = F.regexp_replace(F.lower(col(name)), r"[.,'\"]", "")
    out = F.regexp_replace(out, rf"\b({'|'.join(LEGAL_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def is_junk(name: ColumnLike, label: ColumnLike, tickers: Sequence[str] = KNOWN_TICKERS) -> Column:
    """Too short, short with a digit, or a ticker posing as a company."""
    n = F.trim(F.coalesce(col(name), F.lit("")))
    ticker = (col(label) == "COMPANY") & F.upper(n).isin(*tickers)
    return (F.length(n) < 2) | (n.rlike("[0-9]") & (F.length(n) <= 4)) | F.coalesce(ticker, F.lit(False))


def slug(name: ColumnLike) -> Column:
    """Id for display: lower case, other characters as '-', 'node' if none is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(col(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("node"))


def windows(text: ColumnLike, size: int = 512, overlap: int = 64) -> Column:
    """Array of (pos, text): runs of ``size`` words, ``overlap`` of them shared with the next."""
    words = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    stride = size - overlap

    def runs(ws: Column) -> Column:
        # The last run is the first that reaches the end.
        last = F.greatest(F.lit(0), F.ceil((F.size(ws) - size) / F.lit(stride))).cast("int")
        of = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(ws, i * stride + 1, F.lit(size)), " ").alias("text")))
        return F.when(F.size(ws) > 0, of).otherwise(F.array().cast("array<struct<pos: int, text: string>>"))

    # As a lambda's argument the words are split once, not for each run.
    return F.coalesce(F.transform(F.array(words), runs)[0], F.array().cast("array<struct<pos: int, text: string>>"))


def section_parts(text: ColumnLike) -> Column:
    """Array of (item, pos, body) between 'Item 1A.' headers; empty with fewer than two."""
    header = r"(?i)\bitem\s+([0-9]{1,2}[a-c]?)\s*[.:]"
    items = F.regexp_extract_all(col(text), F.lit(header), F.lit(1))
    bodies = F.split(col(text), header)
    # Header and body together make a section's text, as they stand.
    heads = F.regexp_extract_all(col(text), F.lit(header), F.lit(0))
    zipped = F.arrays_zip(items.alias("item"), heads.alias("head"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("body"))
    parts = F.transform(zipped, lambda x, i: F.struct(F.upper(x["item"]).alias("item"), (i + 1).alias("pos"), F.concat(x["head"], x["body"]).alias("body")))
    return F.when(F.size(items) >= 2, parts).otherwise(F.array().cast("array<struct<item: string, pos: int, body: string>>"))


def signature(text: ColumnLike) -> Column:
    """The part of a chunk by which its section is found: characters 200 to 280, or the first 80 of a short one."""
    t = squeeze(text)
    return F.when(F.length(t) > 320, F.substring(t, 201, 80)).otherwise(F.substring(t, 1, 80))


def citations(text: ColumnLike) -> Column:
    """All [G1] and [P1] labels in order; combined ones don't count."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(CITATION), F.lit(1))


def cited_tags(text: ColumnLike) -> Column:
    """Distinct labels in the order of first use."""
    return F.array_distinct(citations(text))


def claims(text: ColumnLike) -> Column:
    """Sentences and lines without bullets."""
    parts = F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])\s+|\n+")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^[•*\- \t]+|[•*\- \t]+$", ""))
    return F.filter(bare, lambda p: p != "")


def uncited(text: ColumnLike) -> Column:
    """Claims of five words or more, not ending with ':', that cite nothing; 70 characters of each."""
    bad = F.filter(
        claims(text), lambda p: (F.size(F.filter(F.split(p, SPACES), lambda w: w != "")) >= 5) & ~p.endswith(":") & ~p.rlike(CITATION)
    )
    return F.transform(bad, lambda p: F.substring(p, 1, 70))


def strip_tags(text: ColumnLike, tags: ColumnLike) -> Column:
    """Remove the given labels with the white space before them."""
    gone = F.array_join(F.transform(col(tags), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    return F.when(F.size(col(tags)) == 0, col(text)).otherwise(F.regexp_replace(col(text), F.concat(F.lit(r"\s*\[(?:"), gone, F.lit(r")\]")), F.lit("")))


def passage_cite(doc_id: ColumnLike, section: ColumnLike, date: ColumnLike, chunk: ColumnLike) -> Column:
    """'doc · section · date (chunk 8 characters)' (B20)."""
    none = F.lit("None")
    parts = [F.coalesce(col(c).cast("string"), none) for c in (doc_id, section, date)]
    return F.concat(F.concat_ws(" · ", *parts), F.lit(" (chunk "), F.substring(col(chunk), 1, 8), F.lit(")"))


def passage_text(text: ColumnLike) -> Column:
    return F.substring(squeeze(text), 1, 400)


def path_key(path_used: ColumnLike) -> Column:
    """First word of the path used, in capitals; NONE if there is none."""
    return F.upper(F.split_part(F.coalesce(F.nullif(col(path_used), F.lit("")), F.lit("NONE")), F.lit(" "), F.lit(1)))


def inline_tokens(text: ColumnLike) -> Column:
    """Array of (kind, text): bold runs, citations and the text between, in order."""
    marks = {"\x02": "bold", "\x03": "cite"}
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), "[\x01-\x03]", "")
    outer = F.split(F.regexp_replace(t, r"\*\*(.+?)\*\*", "\x01\x02$1\x01"), "\x01")
    # Citations count outside bold runs only.
    inner = F.transform(outer, lambda s: F.when(s.startswith("\x02"), F.array(s)).otherwise(F.split(F.regexp_replace(s, CITATION, "\x01\x03$1\x01"), "\x01")))
    parts = F.filter(F.flatten(inner), lambda s: s != "")

    def token(s: Column) -> Column:
        kind = F.when(s.startswith("\x02"), marks["\x02"]).when(s.startswith("\x03"), marks["\x03"]).otherwise("text")
        return F.struct(kind.alias("kind"), F.regexp_replace(s, "^[\x02\x03]", "").alias("text"))

    return F.transform(parts, token)


def answer_blocks(text: ColumnLike) -> Column:
    """Array of (kind, items): paragraphs, and lists where all lines have bullets or numbers."""
    bullet = r"^\s*(?:[-*•]|[0-9]+[.)])\s+"
    chunks = F.split(F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", "")), r"\n\s*\n")
    lines = F.transform(chunks, lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""))

    def block(ls: Column) -> Column:
        listed = F.forall(ls, lambda x: x.rlike(bullet))
        items = F.when(listed, F.transform(ls, lambda x: F.regexp_replace(x, bullet, ""))).otherwise(F.array(F.array_join(ls, " ")))
        return F.struct(F.when(listed, "ul").otherwise("p").alias("kind"), items.alias("items"))

    return F.transform(F.filter(lines, lambda ls: F.size(ls) > 0), block)
