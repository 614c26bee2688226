"""Coding one event out of a headline and a text: date, keywords, head count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casework.functions.arrays import filled, let

# Full-width digits are read as ASCII digits.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"

# Headline dates. The raw text may run month and day together;
# a date needs a separator between them.
DATE_RAW = r"(?U)201\d[.\s年]+\d{1,2}[.\s月]*\d{1,2}"
DATE_PARTS = r"(?U)(201\d)[.\s年]+(\d{1,2})[.\s月]+(\d{1,2})"

# Characters that name people, and phrases that are no head count.
PEOPLE = "民名户人业主司机开发商投资者朋友众父母老学生家工师"
POLICE = r"[0-9]{1,10}人民警察"
NOT_PEOPLE = (
    "[^\\n]{0,2}岁|[^\\n]{0,4}人口|[^\\n]{0,4}元|[^\\n]{0,4}人民币|[^\\n]{0,4}金"
    "|[^\\n]{0,4}工程|[^\\n]{0,4}块|[^\\n]{0,4}钱|[^\\n]{0,4}工资"
)
ROUND_COUNT = r"[1-9][0-9]?0{0,6}"
MAX_PEOPLE = 999_999

# Chinese numerals.
NUMERALS, NUMERAL_DIGITS = "一二两三四五六七八九", "1223456789"
UNITS = {"十": 10, "百": 100, "千": 1000}
ABOUT = {"上百": 100, "上千": 1_000, "上万": 10_000}


def ascii_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, DIGITS)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return filled(F.regexp_extract(text, pattern, group))


def headline_date(headline: Column) -> Column:
    """Date in a headline as DATE; NULL when absent or not a calendar date."""
    return let(
        ascii_digits(headline),
        lambda h: F.try_to_date(
            F.concat_ws(".", *[F.regexp_extract(h, DATE_PARTS, g) for g in (1, 2, 3)]), "yyyy.M.d"
        ),
    )


def headline_date_raw(headline: Column) -> Column:
    """The matched date text as written."""
    return _found(ascii_digits(headline), DATE_RAW)


def bracket_keyword(headline: Column, opening: str, closing: str) -> Column:
    """Text from the last opening bracket to the last closing one; NULL if empty."""
    return _found(headline, rf"^[^\n]*{opening}([^\n]*){closing}", 1)


def keyword1(headline: Column) -> Column:
    return bracket_keyword(headline, "［", "］")


def keyword2(headline: Column) -> Column:
    return bracket_keyword(headline, "（", "）")


def _one_line(text: Column) -> Column:
    return ascii_digits(F.replace(text, F.lit("\n"), F.lit("")))


def _bounded(count: Column) -> Column:
    return let(count, lambda n: F.when(n <= MAX_PEOPLE, n))


def people_arabic(text: Column, compat: bool = False) -> Column:
    """Head count written in Arabic digits.

    By default the whole digit run before the people word counts.  ``compat``
    takes a round number cut out of a longer run, wants five more characters
    after the word and may read digits out of those.
    """

    def compat_value(t: Column) -> Column:
        hit = F.regexp_extract(t, rf"{ROUND_COUNT}[{PEOPLE}][^\n]{{5}}", 0)
        rest = F.regexp_replace(F.regexp_replace(hit, POLICE, ""), NOT_PEOPLE, "")
        return F.regexp_extract(rest, r"[0-9]{2,8}", 0)

    def strict_value(t: Column) -> Column:
        pattern = rf"(?:^|[^0-9])(([1-9][0-9]{{1,7}})[{PEOPLE}][^\n]{{0,5}})"
        hit, digits = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
        rest = F.regexp_replace(F.regexp_replace(hit, POLICE, ""), NOT_PEOPLE, "")
        return F.when(F.regexp_extract(rest, r"^[0-9]+", 0) == digits, digits)

    value = let(_one_line(text), compat_value if compat else strict_value)
    return _bounded(value.try_cast("int"))


def numeral_value(numeral: Column) -> Column:
    """Value of a Chinese numeral below 100,000,000 (three hundred fifty -> 350)."""

    def value_of(s: Column, leading: bool) -> Column:
        total = F.lit(0)
        for unit, size in UNITS.items():
            total = total + size * F.reduce(
                F.regexp_extract_all(s, F.lit(f"([{NUMERALS}]){unit}"), F.lit(1)),
                F.lit(0),
                lambda acc, d: acc + F.translate(d, NUMERALS, NUMERAL_DIGITS).cast("int"),
            )
        # A last digit without a unit counts after a ten or a zero, or when it stands alone.
        before = "^|[十零]" if leading else "[十零]"
        ones = F.regexp_extract(s, f"(?:{before})([{NUMERALS}])$", 1)
        return total + F.coalesce(F.translate(ones, NUMERALS, NUMERAL_DIGITS).try_cast("int"), F.lit(0))

    def whole(run: Column) -> Column:
        return F.when(
            F.contains(run, F.lit("万")),
            value_of(F.substring_index(run, "万", 1), True) * 10_000
            + value_of(F.substring_index(run, "万", -1), False),
        ).otherwise(value_of(run, True))

    return let(let(numeral, whole), lambda v: F.when(v != 0, v))


def people_numeral(text: Column) -> Column:
    """Head count written in Chinese numerals; "over a hundred" counts as 100."""

    def value(t: Column) -> Column:
        hit = F.regexp_extract(t, rf"[{NUMERALS}上][十百千万][^\n]{{0,4}}[{PEOPLE}]", 0)
        return let(
            F.regexp_replace(hit, NOT_PEOPLE, ""),
            lambda rest: F.coalesce(
                # A later entry wins when several occur.
                *[
                    F.when(F.contains(rest, F.lit(word)), F.lit(size))
                    for word, size in reversed(list(ABOUT.items()))
                ],
                numeral_value(F.regexp_extract(rest, f"^[{NUMERALS}十百千万零]+", 0)),
            ),
        )

    return _bounded(let(_one_line(text), value))


def people(text: Column, compat: bool = False) -> Column:
    """Larger of the two head counts; NULL when neither is found."""
    return F.greatest(people_arabic(text, compat), people_numeral(text))
