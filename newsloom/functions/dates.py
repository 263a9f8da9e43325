"""Reading of publish dates.

A small grammar: the time of day and its zone are taken out first, wherever they stand. What is
left is words and numbers. Words are looked up: months in seven languages, whole or shortened,
weekdays and words that say nothing; any other word makes the text unreadable. With a month's
name the two numbers are day and year, otherwise three numbers are read by their shape. Each text
takes one path, so no row runs through a chain of failing parsers.

Written UTC offsets and zone names are dropped without converting, and results carry no zone. In
numeric dates the month comes first, unless the first number can only be a day, or ``day_first``
says that it is one (``operators.date_order`` lets the dates of a host decide).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.arrays import let

# ---- fixed values: names of months and weekdays, from the first on, and spellings ------
MONTHS = """
january february march april may june july august september october november december
januar februar marz april mai juni juli august september oktober november dezember
janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro
januari februari maart april mei juni juli augustus september oktober november december
"""
WEEKDAYS = """
monday tuesday wednesday thursday friday saturday sunday
montag dienstag mittwoch donnerstag freitag samstag sonntag
lundi mardi mercredi jeudi vendredi samedi dimanche
lunes martes miercoles jueves viernes sabado domingo
lunedi martedi mercoledi giovedi venerdi sabato domenica
segunda terca quarta quinta sexta sabado domingo
maandag dinsdag woensdag donderdag vrijdag zaterdag zondag
mo di mi do fr sa so
ma di wo do vr za zo
"""
SAY_NOTHING = (
    "at of on the um uhr den der am vom le la el a as las alle ore il de del do di om te feira "
    "st nd rd th er"
)
ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
SHORTEST = 3
SECONDS_SHAPE = "^(?:19|20)[0-9]{12}$"
ISO = (
    r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[Tt ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?"
    r"(?: ?(?:[Zz]|[+-][0-9]{2}:?(?:[0-9]{2})?))?)?$"
)
COMPACT = r"^([0-9]{8})[Tt ]?([0-9]{2})([0-9]{2})([0-9]{2})?(?=$|[^0-9])"
FRACTION = r"([0-9]:[0-9]{2})[.,][0-9]+"
HOUR_ALONE = r"(?i)(?<![0-9:.])(1[0-2]|0?[1-9]) ?([ap])\.? ?m\b"
NO_MONTH = "(?!(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|ENE|ABR|MAI|MEI|AGO|OKT|DEZ|DIC)[A-Z]?\\b)"
ZONE = (
    r"([0-9]|[aApP]\.? ?[mM]\b\.?) *\(?(?:[zZ]|" + NO_MONTH + r"[A-Z]{3,5}|(?i:utc|gmt)"
    r"|(?i:utc|gmt)? ?[+-][0-9]{1,2}:?(?:[0-9]{2})?)\)?$"
)
TIME = (
    r"(?i)(?<![0-9])([0-9]{1,2})(?::| ?h ?)([0-9]{2})(?::([0-9]{2}))?(?![0-9])(?: ?([ap])\.? ?m\b\.?)?"
)
YEAR_FIRST = r"^([0-9]{4})([-/. ])([0-9]{1,2})\2([0-9]{1,2})\.?$"
YEAR_LAST = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})\.?$"
# Two-digit years from this one on are of the last century.
TURN = 69
# Years 1 to 9999, the only ones a timestamp can hold.
MOST_SECONDS = 253402300799
# --------------------------------------------------------------------------------------


def _shortened(names: list[str], shortest: int) -> dict[str, set[int]]:
    """All beginnings of names with the places the names have in their lists."""
    found: dict[str, set[int]] = {}
    for name, place in names:
        for end in range(min(shortest, len(name)), len(name) + 1):
            found.setdefault(name[:end], set()).add(place)
    return found


def _known_words() -> dict[str, int]:
    """Word -> month, or 0 for what does not tell the day. A beginning that fits two months is
    none."""
    lines = MONTHS.strip().splitlines()
    months = _shortened([(n, k + 1) for line in lines for k, n in enumerate(line.split())], SHORTEST)
    quiet = _shortened([(n, 0) for n in WEEKDAYS.split()], SHORTEST)
    words = dict.fromkeys([*quiet, *SAY_NOTHING.split()], 0)
    return words | {name: places.pop() for name, places in months.items() if len(places) == 1}


KNOWN = _known_words()


def is_epoch(date: Column) -> Column:
    """True where the whole text is an integer that is not a plain ``yyyyMMdd`` day."""
    number = date.try_cast("bigint").isNotNull() & ~date.contains(".")
    return F.coalesce(number & ~F.btrim(date).rlike("^[0-9]{8}$"), F.lit(False))


def is_in_millis(epoch: Column, as_of: Column) -> Column:
    """An epoch later than ``as_of`` (a TIMESTAMP) can only be in milliseconds."""
    return epoch > F.unix_seconds(as_of)


def normal_spelling(date: Column) -> Column:
    """One spelling for what means the same: no fraction, zone or doubled blank, compact times and
    hours alone with a colon."""
    text = F.regexp_replace(F.btrim(date), FRACTION, "$1")
    compact = F.regexp_replace(text, COMPACT, "$1 $2:$3:$4")
    text = F.when(text.rlike(COMPACT), F.regexp_replace(compact, r":($|[^0-9])", "$1")).otherwise(text)
    text = F.regexp_replace(text, r"([0-9])[Tt]([0-9])", "$1 $2")
    text = F.regexp_replace(text, HOUR_ALONE, "$1:00 $2m")
    text = F.when(text.rlike("[0-9](?::| ?[hH] ?)[0-9]{2}"), F.regexp_replace(text, ZONE, "$1")).otherwise(text)
    return F.btrim(F.regexp_replace(text, r"[,\s]+", " "))


def _moment(epoch: Column, as_of: Column) -> Column:
    """An epoch as TIMESTAMP; NULL outside the years 1 to 9999 (nothing overflows)."""
    millis = F.when(F.abs(epoch) <= MOST_SECONDS * 1000, epoch)
    seconds = F.when(F.abs(epoch) <= 62135596800, epoch).when(
        (epoch > 0) & (epoch <= MOST_SECONDS), epoch
    )
    return F.when(is_in_millis(epoch, as_of), F.timestamp_millis(millis)).otherwise(
        F.timestamp_seconds(seconds)
    )


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _full_year(digits: Column) -> Column:
    """A year of two digits lies between 1969 and 2068."""
    year = digits.try_cast("int")
    short = F.length(digits) <= 2
    return F.when(short, year + F.when(year >= TURN, 1900).otherwise(2000)).otherwise(year)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))


def _by_month_name(plain: Column) -> Column:
    """Day of a text with a month's name and two numbers."""
    known = F.from_json(F.lit(json.dumps(KNOWN)), "map<string,int>")
    numbers = F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))
    words = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))

    def looked_up(codes: Column) -> Column:
        # A shortened weekday may look like a month: the longest name counts, then the last.
        named = F.filter(codes, lambda code: code["month"] > 0)
        month = F.array_max(named)["month"]
        first, second = numbers[0], F.try_element_at(numbers, F.lit(2))
        year_first = F.length(first) == 4
        year = F.when(year_first, first.try_cast("int")).otherwise(_full_year(second))
        day = F.when(year_first, second).otherwise(first)
        fits = (F.size(numbers) == 2) & (F.length(day) <= 2) & F.length(F.when(year_first, first).otherwise(second)).isin(2, 4)
        unknown = F.exists(codes, lambda code: code["month"].isNull())
        return F.when(fits & ~unknown & month.isNotNull(), _date(year, month, day.try_cast("int")))

    codes = F.transform(
        words,
        lambda word, i: F.struct(
            F.length(word).alias("length"), i.alias("i"), F.try_element_at(known, word).alias("month")
        ),
    )
    return let(codes, looked_up)


def _by_numbers(plain: Column, day_first: Column | None) -> Column:
    """Day of a text without letters."""
    a, b = _number(plain, YEAR_LAST, 1), _number(plain, YEAR_LAST, 3)
    as_day = (a > 12) & (b <= 12)
    if day_first is not None:
        as_day = as_day | (F.coalesce(day_first, F.lit(False)) & (b <= 12))
    year = _full_year(F.regexp_extract(plain, YEAR_LAST, 4))
    digits = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    return (
        F.when(plain.rlike(YEAR_FIRST), _date(*(_number(plain, YEAR_FIRST, k) for k in (1, 3, 4))))
        .when(
            plain.rlike(YEAR_LAST),
            _date(year, F.when(as_day, b).otherwise(a), F.when(as_day, a).otherwise(b)),
        )
        .when(plain.rlike(digits), _date(*(_number(plain, digits, k) for k in (1, 2, 3))))
    )


def _day(text: Column, day_first: Column | None) -> Column:
    """Day of a text without a time of day."""

    def of(plain: Column) -> Column:
        def of_numbers(bare: Column) -> Column:
            return F.when(~bare.rlike(r"[^-0-9/. ]"), _by_numbers(bare, day_first))

        # Weekdays and the like may stand before numbers too.
        quiet = "|".join(sorted((w for w, m in KNOWN.items() if m == 0 and len(w) > 1), key=len, reverse=True))
        bare = F.btrim(F.regexp_replace(plain, rf"\b(?:{quiet})\b\.?", " "))
        return (
            F.when(plain.rlike(r"[^-a-z0-9/. ()ºª°']"), None)
            .when(~plain.rlike("[a-z]"), of_numbers(plain))
            .when(plain.rlike("[0-9][-/.][0-9]{1,2}[-/.][0-9]"), let(bare, of_numbers))
            .otherwise(_by_month_name(plain))
        )

    return let(F.translate(F.lower(text), *ACCENTS), of)


def _time(text: Column) -> Column:
    """Seconds of the day as written, 0 without a time; NULL if there is no such time."""
    hour, minute, second = (
        F.coalesce(F.regexp_extract(text, TIME, k).try_cast("int"), F.lit(0)) for k in (1, 2, 3)
    )
    half = F.lower(F.regexp_extract(text, TIME, 4))
    hour = F.when(half == "", hour).when(
        hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)
    )
    return F.when(
        (hour <= 23) & (minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second
    )


def _written(text: Column, day_first: Column | None) -> Column:
    rest = F.btrim(F.regexp_replace(F.regexp_replace(text, TIME, " "), " +", " "))
    day = _day(rest, day_first)
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _time(text).cast("decimal(18,6)"))


def _iso(text: Column) -> Column:
    parts = [F.coalesce(_number(text, ISO, k), F.lit(0)) for k in range(1, 7)]
    return F.try_make_timestamp_ntz(*parts[:5], parts[5].cast("decimal(8,6)"))


def parse_date(
    date: Column, as_of: Column | None = None, day_first: Column | None = None
) -> Column:
    """Publish date as TIMESTAMP_NTZ; NULL where it cannot be read.

    Integers are epochs in seconds, or in milliseconds if they lie after ``as_of``
    (default: now), shown in the session time zone; but eight digits are a day, and fourteen
    that begin with 19 or 20 a day and time. ``day_first`` tells which of two small numbers is
    the day.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    seconds = F.try_to_timestamp(F.btrim(date), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    moment = _moment(date.try_cast("bigint"), as_of).cast("timestamp_ntz")
    return (
        F.when(F.btrim(date).rlike(ISO), _iso(F.btrim(date)))
        .when(F.btrim(date).rlike(SECONDS_SHAPE), seconds)
        .when(is_epoch(date), moment)
        .otherwise(let(normal_spelling(date), lambda text: _written(text, day_first)))
    )


def order_votes(date: Column) -> tuple[Column, Column]:
    """Whether a date can only have the day first, or only the month first: at most one is true,
    and neither for dates that leave it open."""

    def numbers(k: int) -> Column:
        text = F.regexp_replace(normal_spelling(date), TIME, "")
        return F.coalesce(_number(F.btrim(text), YEAR_LAST, k), F.lit(0))

    a, b = numbers(1), numbers(3)
    return a.between(13, 31) & b.between(1, 12), a.between(1, 12) & b.between(13, 31)


def date_error(date: Column, parsed: Column) -> Column:
    """True where a date was given but could not be read."""
    return (F.coalesce(date, F.lit("")) != "") & parsed.isNull()


def pdf_creation_date(value: Column) -> Column:
    """``D:YYYYMMDDHHmmSS...`` as TIMESTAMP_NTZ; NULL where absent or unreadable.  All parts
    after the year may be left out, from the end."""
    digits = F.regexp_extract(value, r"^(?:D:)?([0-9]{4}(?:[0-9]{2}){0,5})", 1)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    return F.when(
        digits != "", F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    )
