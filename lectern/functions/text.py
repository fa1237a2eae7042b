"""Text cleaning as column expressions.

Java patterns are ASCII by default, so ``(?U)`` is set where white space must be
Unicode white space, ``(?iu)`` where case is ignored for accented letters, and
``(?d)`` where a dot must stop at a newline only.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same characters inside a pattern class, under the flag (?U).
S = r"\s\x1c-\x1f"
WHITE_RUN = rf"(?U)[{S}]+"
# The runs of white space that are more than one plain space.
UNEVEN_RUN = rf"(?U)[{S}](?:(?<! )|[{S}]+)[{S}]*"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column expression is a tree: naming one twice in Python computes it twice.
    Binding it to the variable of a one-element transform avoids that, inside
    lambdas too, where Spark finds no common subexpressions.
    """
    return F.transform(F.array(value), body).getItem(0)


def _accent_table() -> tuple[str, str]:
    """Letters whose decomposition is one base letter plus marks, and the bases."""
    sources, bases = [], []
    for code in range(0x80, 0x3000):
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != letter:
            sources.append(letter)
            bases.append(base[0])
    return "".join(sources), "".join(bases)


ACCENTED, PLAIN = _accent_table()


# So many bytes at the end are looked at before a whole text is trimmed there.
END_BYTES = 32


def bytes_of(c: Column, start: Column | int, count: Column | int) -> Column:
    """Part of a text by bytes: unlike characters, they need no counting."""
    return F.substring(c.cast("binary"), start, count).cast("string")


def strip_end(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` at the end."""
    # Spark notes the place of every character before it trims at the end, so a short end is
    # trimmed instead. It may begin inside a character, so something must be left after that.
    def without(x: Column, end: Column, kept: Column) -> Column:
        shorter = bytes_of(x, F.lit(1), F.octet_length(x) - F.octet_length(end) + F.octet_length(kept))
        return F.when(kept == end, x).when(F.octet_length(kept) < 4, F.rtrim(x, F.lit(chars))).otherwise(shorter)

    return let(c, lambda x: let(bytes_of(x, -END_BYTES, END_BYTES), lambda end: let(
        F.rtrim(end, F.lit(chars)), lambda kept: without(x, end, kept)
    )))


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    # Most texts have none there; looking at a character or byte is cheaper than trimming.
    white = F.lit(WHITE)

    def at_start(x: Column) -> Column:
        return F.when(F.contains(white, F.left(x, F.lit(1))), F.ltrim(x, white)).otherwise(x)

    def at_end(x: Column) -> Column:
        last = F.substring(x.cast("binary"), -1, 1)
        return F.when((last <= F.lit(b" ")) | (last >= F.lit(b"\x80")), strip_end(x, WHITE)).otherwise(x)

    return let(let(c, at_start), at_end)


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` at both ends."""
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Turn each run of white space into one space."""
    return F.regexp_replace(c, UNEVEN_RUN, " ")


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def nullify(c: Column) -> Column:
    """Empty string to null."""
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing (or an empty text) matched."""
    return nullify(F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def fold_accents(c: Column) -> Column:
    """Drop combining marks from composed and decomposed letters."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def match_key(c: Column) -> Column:
    """Lower case, no accents, plain d, single spaces: for keyword comparison."""
    return strip(collapse(F.translate(fold_accents(F.lower(c)), "đ", "d")))


def slug_id(c: Column) -> Column:
    """Identifier of upper-case ASCII letters, digits and underscores."""
    ascii_text = F.translate(fold_accents(c), "Đđ", "Dd")
    return F.upper(F.btrim(F.regexp_replace(ascii_text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def safe_int(c: Column, default: int = 0) -> Column:
    whole = lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))
    return F.coalesce(let(strip(c.cast("string")), whole), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    text = strip(F.replace(c.cast("string"), F.lit(","), F.lit(".")))
    return F.coalesce(text.try_cast("double"), F.lit(default))


def remove_emphasis(c: Column) -> Column:
    """Drop Markdown bold and italic marks that open and close within a line."""
    c = F.regexp_replace(c, r"(?d)\*\*\*(.+?)\*\*\*", "$1")
    c = F.regexp_replace(c, r"(?d)(\*\*|__)(.+?)\1", "$2")
    return F.regexp_replace(c, r"(?d)(\*|_)(.+?)\1", "$2")


# A numbered heading line, Roman or decimal.
HEADING_LINE = (
    rf"(?Ud)^[{S}]*[*_]*(?:Phần|Chương|Mục)?[{S}]*([IVX]+|[0-9]+(?:\.[0-9]+)*)[.:)]*[*_]*[{S}]+(.*)"
)
HEADING_MAX_CHARS = 100
SENTENCE_MIN_CHARS = 30
SENTENCE_ENDS = (".", ";", ":")


def _heading_title(line: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(line, HEADING_LINE, 2), r"^[*_]+|[*_]+$", ""))


def _reads_like_title(title: Column) -> Column:
    sentence = (F.length(title) > SENTENCE_MIN_CHARS) & F.right(title, F.lit(1)).isin(*SENTENCE_ENDS)
    return (title != "") & (F.length(title) <= HEADING_MAX_CHARS) & ~sentence


def is_heading(line: Column) -> Column:
    """Does a stripped line carry a section number and read like a title?"""
    return line.rlike(HEADING_LINE) & let(_heading_title(line), _reads_like_title)


def _markdown_heading(line: Column, title: Column) -> Column:
    def with_number(number: Column) -> Column:
        depth = F.when(
            number.rlike("^[IVX]+$") | line.contains("Phần"), F.lit(2)
        ).otherwise(F.least(F.size(F.split(number, "[.]")) + 1, F.lit(6)))
        return F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), number, F.lit(" "), title)

    return let(F.regexp_extract(line, HEADING_LINE, 1), with_number)


def upgrade_line(line: Column) -> Column:
    """A numbered title line as a Markdown heading, any other line stripped."""
    # Only lines opening with a mark, a number or one of the words can match;
    # the cheap test spares all other lines the full pattern.
    maybe = r"^[*_PCMIVX0-9]"

    def upgraded(x: Column) -> Column:
        return F.when(
            x.rlike(maybe) & x.rlike(HEADING_LINE),
            let(_heading_title(x), lambda t: F.when(_reads_like_title(t), _markdown_heading(x, t)).otherwise(x)),
        ).otherwise(x)

    return let(strip(line), upgraded)


def upgrade_headings(text: Column) -> Column:
    """Rewrite numbered title lines as Markdown headings, strip every line."""
    return F.array_join(F.transform(F.split(text, "\n"), upgrade_line), "\n")


def plain_line(line: Column) -> Column:
    """Emphasis removed; marks pair within a line, so lines without any are left alone."""
    marked = F.contains(line, F.lit("*")) | F.contains(line, F.lit("_"))
    return F.when(marked, remove_emphasis(line)).otherwise(line)


def refine(text: Column) -> Column:
    """``upgrade_headings`` then ``remove_emphasis``, in one pass over the lines."""
    return F.array_join(
        F.transform(F.split(text, "\n"), lambda line: let(upgrade_line(line), plain_line)), "\n"
    )


def has_markdown_table(text: Column) -> Column:
    return text.rlike(rf"(?Umd)^[{S}]*\|.+\|[{S}]*$")


def drop_heading_marks(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U)^#+[{S}]+", ""))


def fix_lookalikes(c: Column) -> Column:
    """Letters that scanners confuse with the Roman numerals of chapter lines."""
    # Fixed values, in this order: the two-letter form goes first.
    c = F.replace(c, F.lit("IШ"), F.lit("III"))
    return strip(F.translate(c, "ІⅤХ", "IVX"))


def join_pages(pages: Column) -> Column:
    """Strip the page texts, drop blank ones, put a blank line between the rest."""
    return F.array_join(F.filter(F.transform(pages, strip), lambda p: p != ""), "\n\n")


PREVIEW_CHARS = 12000


def preview(text: Column, flatten: bool = True, chars: int = PREVIEW_CHARS) -> Column:
    """Leading characters for display; ``flatten`` also removes the newlines."""
    head = F.substring(text, 1, chars)
    return strip(one_line(head)) if flatten else head


def first_nonblank(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first candidate that is not blank, and the name it came from."""
    picks = [(name, strip(F.coalesce(c, F.lit(""))) != "", c) for name, c in candidates]
    text = F.coalesce(*[F.when(filled, c) for _, filled, c in picks])
    name = F.coalesce(*[F.when(filled, F.lit(n)) for n, filled, _ in picks])
    return text, name


def format_bytes(n: Column, decimals: int = 2) -> Column:
    """1536 to ``1.5 KB``."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")])
    size = n.cast("double")
    # Counting powers with comparisons avoids log(1024**k) rounding just below k.
    power = sum(F.when(size >= float(1024 ** k), 1).otherwise(0) for k in (1, 2, 3, 4))
    scaled = F.round(size / F.pow(F.lit(1024.0), power), max(decimals, 0)).cast("string")
    scaled = F.regexp_replace(scaled, r"\.0$", "")
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(
        F.concat(scaled, F.lit(" "), F.element_at(units, power + 1))
    )


def stored_file_name(name: Column, at: Column) -> Column:
    """Stem, UTC time, eight hex digits and the lower-cased suffix.

    The hex digits come from the name and the time, so a rerun agrees with itself.
    """
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    stem = F.left(base, F.length(base) - F.length(suffix))
    digest = F.left(F.sha2(F.concat_ws("|", name, at.cast("string")), 256), F.lit(8))
    return F.concat(stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), digest, F.lower(suffix))


def fenced_block(c: Column, language: str) -> Column:
    """Content of the first fenced block of a language, null if there is none."""
    return nullify(strip(F.regexp_extract(c, rf"(?s)```{language}(.*?)```", 1)))


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace, null if there is none."""
    return first_match(c, r"(?s)(\{.*\})")
