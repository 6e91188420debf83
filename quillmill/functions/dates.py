"""Date functions: custom formats, date groups, gaps between groups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESOLUTIONS = ("weeks", "days", "months", "years")
ISO = "yyyy-MM-dd"
SQL_FORMAT = "yyyy-MM-dd HH:mm:ss"

# What a strptime field is in a Java date pattern.
STRPTIME = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "e": "d", "H": "H", "I": "h", "M": "m", "S": "s", "p": "a",
    "B": "MMMM", "b": "MMM", "h": "MMM", "A": "", "a": "", "j": "D", "F": "yyyy-M-d", "T": "H:m:s",
    "R": "H:m", "D": "M/d/yy", "z": "xx", "Z": "zzz", "n": " ", "t": " ", "%": "%",
}

# Month names and abbreviations that stand for English ones, by language.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "fi": "tammikuu helmikuu maaliskuu huhtikuu toukokuu kesäkuu heinäkuu elokuu syyskuu lokakuu marraskuu joulukuu",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "uk": "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня",
}
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo"
)
ORDINALS = {"en": "(st|nd|rd|th)", "fr": "(er|ère|e|ème)", "ru": "(-?го|-?е|-?я)", "uk": "(-?го|-?е|-?я)"}


def java_pattern(fmt: str) -> str:
    """A strptime format as a Java date pattern; other text is quoted."""
    out, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            field = fmt[i + 1]
            if field not in STRPTIME:
                raise ValueError(f"date field %{field} is not supported")
            out += STRPTIME[field]
            i += 2
            continue
        out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        i += 1
    return out


def localise(text: Column, lang: str | None) -> Column:
    """English month names in place of those of a language, and no ordinal endings."""
    lang = (lang or "en")[:2].lower()
    t = F.lower(text)
    names = MONTHS.get(lang, "").split()
    english = [m.capitalize() for m in MONTHS["en"].split()]
    if lang in ORDINALS:
        t = F.regexp_replace(t, rf"(?<=[0-9]){ORDINALS[lang]}(?![\p{{L}}])", "")
    # full names first, then the same names cut short
    pairs = [(n, e) for n, e in zip(names, english, strict=False)]
    t = reduce(lambda c, p: F.regexp_replace(c, rf"(?<!\p{{L}}){p[0]}(?!\p{{L}})", p[1]), pairs, t)
    short = [(n[:3], e[:3]) for n, e in zip(names, english, strict=False) if len(n) > 3]
    return reduce(lambda c, p: F.regexp_replace(c, rf"(?<!\p{{L}}){p[0]}\p{{Ll}}{{0,2}}\.?(?!\p{{L}})", p[1]), short, t)


def parse_datetime(text: Column, fmt: str = "%F %T", lang: str | None = None) -> Column:
    """The time in a text as ``yyyy-MM-dd HH:mm:ss``, null if it doesn't fit the format.

    ``UNIX``, ``UNIX+n`` and ``UNIX-n`` read seconds since 1970, whose offset n
    is taken off again; fractions are rounded.
    """
    unix = re.fullmatch(r"UNIX(?:([+-])([0-9]+))?", fmt)
    if unix:
        off = int(unix[2] or 0) * (-1 if unix[1] == "-" else 1)
        seconds = F.round(text.try_cast("double")).cast("long") - off
        return F.date_format(F.timestamp_seconds(seconds), SQL_FORMAT)
    t = F.trim(text)
    if re.search("%[aA]", fmt):
        # the day of the week follows from the date: its name is dropped, in full or cut short
        names = "|".join(f"{d}|{d[:3]}|{d[:2]}" for d in WEEKDAYS.split())
        t = F.trim(F.regexp_replace(t, rf"(?i)(?<!\p{{L}})({names})\.?(?!\p{{L}})", ""))
        fmt = re.sub("%[aA]", "", fmt).strip()
    if re.search("%[bBhp]", fmt) or lang:
        t = localise(t, lang)
        if "%p" in fmt:
            t = F.regexp_replace(t, r"(?i)(?<![\p{L}])([ap])\.?m\.?(?![\p{L}])", "$1m")
            t = F.regexp_replace(F.regexp_replace(t, "(?<![\\p{L}])am(?![\\p{L}])", "AM"), "(?<![\\p{L}])pm(?![\\p{L}])", "PM")
    at = F.try_to_timestamp(t, F.lit(java_pattern(fmt)))
    if "%y" in fmt or "%D" in fmt:
        # a two-digit year is of this century if it would be before 1969
        at = F.when(F.year(at) >= 2069, F.add_months(at, -1200).cast("timestamp")).otherwise(at)
    return F.date_format(at, SQL_FORMAT)


def reduce_date(date: Column, resolution: str) -> Column:
    """The date group of an ISO date: ``2020-#07`` for weeks, else its first 10, 7 or 4 characters.

    A text that isn't 10 characters long is an error.
    """
    d = F.when((F.length(date) != 10), F.raise_error(F.concat(F.lit("not an ISO date: "), date))).otherwise(date)
    if resolution == "weeks":
        day = F.to_date(d)
        return F.concat(
            F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-#"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")
        )
    return {"days": d, "months": F.substring(d, 1, 7), "years": F.substring(d, 1, 4)}[resolution]


def valid_iso(date: Column) -> Column:
    return date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(date, ISO).isNotNull()


def in_range(date: Column, first: str = "", last: str = "") -> Column:
    """Whether an ISO date lies in an inclusive range; an empty bound is open, a short date never fits."""
    ok = F.length(date) >= 10
    d = F.substring(date, 1, 10)
    if first:
        ok = ok & (d >= first[:10])
    if last:
        ok = ok & (d <= last[:10])
    return F.coalesce(ok, F.lit(False))


def _first_day(group: Column, resolution: str) -> Column:
    """The first day of a date group, null for the group of undated things."""
    g = F.when(group != "", group)
    if resolution == "weeks":
        # ISO week 1 holds January 4th
        jan4 = F.to_date(F.concat(F.substring(g, 1, 4), F.lit("-01-04")))
        return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (F.substring(g, 7, 2).cast("int") - 1) * 7)
    return F.to_date(F.concat(g, F.lit({"days": "", "months": "-01", "years": "-01-01"}[resolution])))


STEPS = {"weeks": "interval 7 days", "days": "interval 1 day", "months": "interval 1 month", "years": "interval 1 year"}


def all_groups(groups: DataFrame, resolution: str, column: str = "date") -> DataFrame:
    """Every date group from the first to the last of a table of groups.

    Only the two ends are aggregated; the rest is a generated sequence.
    """
    day = _first_day(F.col(column), resolution)
    ends = groups.select(day.alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence("a", "b", F.expr(STEPS[resolution]))).alias("d"))
    return days.select(reduce_date(F.date_format("d", ISO), resolution).alias(column))


def fill_gaps(result: DataFrame, resolution: str, column: str = "date") -> DataFrame:
    """Adds the missing groups between two neighbouring ones, with zeros in every number column.

    Each row generates the groups up to the next one, so what made the result
    runs once. One row per date group meets in the window, no more than a
    calendar has.
    """
    numbers = [f.name for f in result.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    step = F.expr(STEPS[resolution])
    placed = result.withColumn("_d", _first_day(F.col(column), resolution))
    last = F.lead("_d").over(W.orderBy(F.col("_d").asc_nulls_first()))
    until = F.greatest(F.col("_d"), (F.coalesce(last, F.col("_d")) - step).cast("date"))
    spread = placed.withColumn("_u", until).select(
        "*", F.posexplode(F.when(F.col("_d").isNull(), F.array(F.lit(None).cast("date"))).otherwise(F.sequence("_d", "_u", step))).alias("_i", "_g")
    )
    name = F.when(F.col("_i") == 0, F.col(column)).otherwise(reduce_date(F.date_format("_g", ISO), resolution))
    own = lambda c: F.when(F.col("_i") == 0, F.col(c))
    return spread.select(
        *[name.alias(c) if c == column else F.coalesce(own(c), F.lit(0).cast(dict(result.dtypes)[c])).alias(c) if c in numbers else own(c).alias(c) for c in result.columns]
    )


def pretty_duration(milliseconds: Column) -> Column:
    """A duration in words: days, hours, minutes, seconds, milliseconds; parts of zero are left out."""
    units = ((86_400_000, "d"), (3_600_000, "h"), (60_000, "min"), (1000, "s"), (1, "ms"))
    rest, parts = milliseconds.cast("long"), []
    for size, name in units:
        n = F.floor(rest / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))))
        rest = rest % size
    out = F.concat_ws(" ", *parts)
    return F.when(out == "", F.lit("<1ms")).otherwise(out)
