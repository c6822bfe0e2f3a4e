"""Text columns: trimming, entity names, currency codes, the numeric test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyproof.config import BLANK_CURRENCY, BLANK_LABEL

# Every character that counts as blank space around a cell.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = "[0-9]+(?:_[0-9]+)*"
_FINITE = rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
NUMBER_PATTERN = rf"^[+-]?{_FINITE}$"
NUMBER_OR_SPECIAL_PATTERN = rf"^[+-]?(?:{_FINITE}|(?i:inf|infinity|nan))$"


def cell(c: Column | str) -> Column:
    """A cell as text, never null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def strip(c: Column) -> Column:
    """Blanks of every kind gone from both ends; the long list is searched only where plain trim leaves another sign than `!` to `~` at an end."""
    plain = F.trim(c)
    last = F.substring(plain, -1, 1)
    done = (plain == "") | ((plain >= "!") & (plain < "\x7f") & (last >= "!") & (last < "\x7f"))
    return F.when(done, plain).otherwise(F.btrim(c, F.lit(BLANKS)))


def is_blank(c: Column) -> Column:
    """Takes c once, so that a filter pushed to where a text is made does not make it several times."""
    return F.ltrim(c, F.lit(BLANKS)) == ""


def entity_key(c: Column) -> Column:
    """The form under which spellings of one entity are the same."""
    return F.lower(strip(c))


def _title(c: Column) -> Column:
    letters = F.split(F.lower(c), "")
    # a letter is capital unless a cased letter stands right before it
    return F.array_join(
        F.transform(
            letters,
            lambda ch, i: F.when(
                (i > 0) & (F.upper(F.get(letters, i - 1)) != F.get(letters, i - 1)), ch
            ).otherwise(F.upper(ch)),
        ),
        "",
    )


def entity_label(c: Column) -> Column:
    """Display name: title case for all-upper and all-lower spellings, else as written."""
    v = strip(c)
    one_case = (v == F.upper(v)) | (v == F.lower(v))
    return F.when(v == "", F.lit(BLANK_LABEL)).when(one_case, _title(v)).otherwise(v)


def raw_currency(c: Column) -> Column:
    code = F.upper(strip(c))
    return F.when(code.isin("", "NAN"), F.lit(BLANK_CURRENCY)).otherwise(code)


def effective_currency(code: Column, answers: dict[str, str]) -> Column:
    """The currency a row is converted from; '' stands for blank and not answered."""
    moved = {k: v for k, v in answers.items() if k != v}
    out = F.when(code == BLANK_CURRENCY, F.lit(moved.get(BLANK_CURRENCY, "")))
    for found, means in moved.items():
        out = out.when(code == found, F.lit(means))
    return out.otherwise(code)


def is_number(c: Column, special: bool = True) -> Column:
    """True for text that reads as a number once thousands commas are gone; `special` admits inf and nan."""
    pattern = NUMBER_OR_SPECIAL_PATTERN if special else NUMBER_PATTERN
    return F.replace(strip(c), F.lit(","), F.lit("")).rlike(pattern)
