"""Lines, terms, slugs, link targets and dates as column expressions. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode's White_Space property, as a Java character class body. Fixed values.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a browser trims: the same without U+0085, and with the byte order mark. Fixed values.
SCRIPT_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Punctuation that a heading's slug drops. Fixed values.
SLUG_DROPS = "!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~"
#: Letters and digits, as a Java character class body.
WORD = r"a-z0-9\p{L}\p{N}"
MARKDOWN = r"(?i)\.(md|markdown|mdown)$"


def raw_lines(text: Column) -> Column:
    """Lines with the ending each has (CR LF, CR or LF); an empty text is one empty line."""
    found = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def line_windows(text: Column, size: int) -> Column:
    """Runs of ``size`` lines, the last one perhaps shorter, by one match each; no array of lines is made. An empty text has none."""
    line = r"[^\r\n]*+(?>\r\n|\r|\n)"
    return F.regexp_extract_all(text, F.lit(rf"(?:{line}){{{size}}}|(?:{line}){{0,{size - 1}}}+[^\r\n]++|(?:{line}){{1,{size}}}"), F.lit(0))


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\r\n]*+(?>\r\n|\r|\n)|[^\r\n]++"))


def without_ending(line: Column) -> Column:
    return F.regexp_replace(line, r"(\r\n|\r|\n)\z", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def script_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SCRIPT_SPACE}]+|[{SCRIPT_SPACE}]+\z", "")


def _foldings() -> tuple[str, str]:
    """Lower-case letters with diacritics in the Latin, Greek and Cyrillic blocks, and what is left without these: by rule, from Unicode itself."""
    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_WITH, _WITHOUT = _foldings()


def folded(text: Column) -> Column:
    """Lower case without diacritics, for letters that Unicode composes of one letter and marks."""
    return F.regexp_replace(F.translate(F.lower(text), _WITH, _WITHOUT), r"\p{Mn}", "")


def fold(term: str) -> str:
    """The same for one string on the driver."""
    return "".join(c for c in term.lower().translate(str.maketrans(_WITH, _WITHOUT)) if unicodedata.category(c) != "Mn")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order. Runs are taken first, with marks between their letters, and only those that aren't ASCII are folded."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}][{WORD}\p{{Mn}}]*"), F.lit(0))
    return F.transform(runs, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(F.translate(t, _WITH, _WITHOUT), r"\p{Mn}", "")))


def query_terms(query: str) -> list[str]:
    """Distinct compatibility-normalized lower-case terms in the order of the query. Documents aren't so normalized."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", query.lower()))))


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(heading), SLUG_DROPS, ""), rf"[{SPACE}]", "-")


def has_scheme(target: Column) -> Column:
    return target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def is_markdown(path: Column) -> Column:
    return path.rlike(MARKDOWN)


def percent_decoded(text: Column) -> Column:
    """Null for a malformed escape or a result that isn't UTF-8; a plus stays a plus."""
    ok = ~text.rlike(r"%(?![0-9A-Fa-f]{2})")
    value = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = F.instr(value, "\ufffd") > 0  # unless the text had one itself
    return F.when(ok & ~(broken & (F.instr(text, "\ufffd") == 0) & ~F.upper(text).contains("%EF%BF%BD")), value)


def normalized(path: Column) -> Column:
    """A relative path without . and ..; null if it leaves the root."""
    step = lambda acc, part: (
        F.when(acc.isNull() | part.isin("", "."), acc)
        .when(part == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)))
        .otherwise(F.array_append(acc, part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    """All of a path up to and with its last slash."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def local_link(source: Column, target: Column) -> Column:
    """The project path of a Markdown document that a link in ``source`` names; null if it names something else."""
    path = percent_decoded(F.regexp_extract(target, r"^[^?#]*", 0))
    at = F.when(path.startswith("/"), F.lit(None)).otherwise(normalized(F.concat(folder(source), path)))
    return F.when(~has_scheme(target) & (path != "") & is_markdown(at) & (at != ""), at)


def real_date(text: Column) -> Column:
    """YYYY-MM-DD of the Gregorian calendar, year 1 or later."""
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~text.startswith("0000") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def kebab_tags(tags: Column) -> Column:
    """Some tags, all distinct, each lower-case alphanumeric parts between hyphens."""
    good = F.forall(tags, lambda t: (t == F.lower(t)) & t.rlike(r"^[\p{IsAlphabetic}\p{N}]+(-[\p{IsAlphabetic}\p{N}]+)*\z"))
    return F.coalesce((F.size(tags) > 0) & good & (F.size(F.array_distinct(tags)) == F.size(tags)), F.lit(False))


def code_units(text: Column) -> Column:
    """A sort key by UTF-16 code units."""
    return F.hex(F.encode(text, "UTF-16BE"))


def release(text: Column) -> Column:
    """MAJOR.MINOR.PATCH as comparable numbers of 64 bits; null for anything else."""
    parts = [F.regexp_extract(text, r"^\+?([0-9]+)\.\+?([0-9]+)\.\+?([0-9]+)\z", k) for k in (1, 2, 3)]
    numbers = [F.expr("18446744073709551615BD") >= p.try_cast("decimal(38,0)") for p in parts]
    return F.when(numbers[0] & numbers[1] & numbers[2], F.struct(*[p.try_cast("decimal(20,0)").alias(n) for p, n in zip(parts, ("major", "minor", "patch"), strict=True)]))


def civil_date(days: Column) -> Column:
    """The calendar date so many days after 1970-01-01, as YYYY-MM-DD; a year past 9999 has more digits and no plus, one below 0 a minus and no zeros before it."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    padded = lambda part, size: F.lpad(part.cast("string"), size, "0")
    year = F.when(F.year(date).between(0, 999), padded(F.year(date), 4)).otherwise(F.year(date).cast("string"))
    return F.concat(year, F.lit("-"), padded(F.month(date), 2), F.lit("-"), padded(F.dayofmonth(date), 2))
