"""Dates in words: what a phrase, a query or a deadline means at an anchor, and durations in words.

Everything is a native column: the phrase is matched by patterns, its parts are looked up in maps, and the date is
calendar arithmetic on the anchor. Unknown phrases give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.rules import TEMPORAL_WORDS, any_word
from tessella.functions.text import let

# --- fixed values ------------------------------------------------------------------------------------

#: Months by their first three letters, and Russian ones by their stems.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
RU_MONTHS = ("январ", "феврал", "март", "апрел", "ма", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр")
RU_MONTH_ENDINGS = "(?:ь|е|я|а|й)?"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
RU_WEEKDAYS = ("понедельник", "вторник", "сред", "четверг", "пятниц", "суббот", "воскресень")
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
RU_NUMBERS = {"один": 1, "одну": 1, "одна": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10}
OFFSETS = {"today": 0, "yesterday": -1, "tomorrow": 1, "day before yesterday": -2, "day after tomorrow": 2, "сегодня": 0, "вчера": -1, "завтра": 1, "позавчера": -2, "послезавтра": 2}
RU_UNITS = {"day": "день|дня|дней", "week": "неделя|неделю|недели|недель|неделе", "month": "месяц|месяца|месяцев|месяце", "year": "год|года|лет|году|годе"}
DIRECTIONS = {"last": -1, "previous": -1, "next": 1, "coming": 1, "this": 0}
RU_DIRECTIONS = (("прошл", -1), ("следующ", 1), ("эт", 0))
SEASONS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "autumn": (9, 11), "winter": (12, 2)}
RU_FORMS = {"year": ("год", "года", "лет"), "month": ("месяц", "месяца", "месяцев"), "week": ("неделя", "недели", "недель"), "day": ("день", "дня", "дней"), "hour": ("час", "часа", "часов"), "minute": ("минута", "минуты", "минут"), "second": ("секунда", "секунды", "секунд")}
YEAR_DAYS, MONTH_DAYS = 365, 30.4375

_MONTH = "|".join((*MONTHS, *SHORT_MONTHS))

# --- parts -------------------------------------------------------------------------------------------


def _looked_up(word: Column, names: dict) -> Column:
    out = F.lit(None).cast("int")
    for k, v in names.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def _starts(word: Column, stems) -> Column:
    """Index of the stem that a word begins with; the longest one decides."""
    out = F.lit(None).cast("int")
    for n, stem in sorted(stems, key=lambda s: len(s[1])):
        out = F.when(F.startswith(word, F.lit(stem)), n).otherwise(out)
    return out


def month_number(word: Column) -> Column:
    """1 to 12 of an English month, whole or short, or of a Russian one in any case."""
    at = F.call_function("locate", F.substring(word, 1, 3), F.lit("".join(m[:3] for m in MONTHS)))
    by_name = F.when(word.rlike(f"^(?:{_MONTH})$"), F.floor((at - 1) / 3) + 1)
    return F.coalesce(by_name, _starts(word, list(enumerate(RU_MONTHS, 1)))).cast("int")


def weekday_number(word: Column) -> Column:
    """0 (Monday) to 6."""
    english = [(n, d[:3]) for n, d in enumerate(WEEKDAYS)]
    return F.coalesce(F.when(word.rlike(f"^(?:{'|'.join(d + '|' + d[:3] for d in WEEKDAYS)})$"), _starts(word, english)), _starts(word, list(enumerate(RU_WEEKDAYS))))


def _number(word: Column) -> Column:
    return F.coalesce(F.when(word.rlike(r"^\d{1,9}$"), word.cast("int")), _looked_up(word, NUMBERS | RU_NUMBERS))


def unit_of(word: Column) -> Column:
    out = F.when(word.rlike("^(?:day|week|month|year)s?$"), F.regexp_replace(word, "s$", ""))
    for unit, forms in RU_UNITS.items():
        out = out.when(word.rlike(f"^(?:{forms})$"), unit)
    return out


def _days(t: Column, n: Column) -> Column:
    return F.date_add(t.cast("date"), n.cast("int")).cast("timestamp")


def _months(t: Column, n: Column) -> Column:
    return F.add_months(t.cast("date"), n.cast("int")).cast("timestamp")


def _month_start(year: Column, month: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), F.lit("1")), F.lit("y-M-d"))


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


# --- phrases -----------------------------------------------------------------------------------------


def phrase_date(phrase: Column, anchor: Column) -> Column:
    """(at, kind, confidence) of a relative or absolute phrase, English or Russian; the first form that fits decides:
    ISO, day offset, ago, relative period, relative weekday, month."""
    ago = r"^(\d+|\p{L}+)\s+(\p{L}+)\s+(?:ago|назад)$"
    pair = r"^(?:на\s+|в\s+)?(\p{L}+)\s+(\p{L}+)$"
    month_form = rf"^(?:in\s+|в\s+)?({_MONTH}|(?:{'|'.join(RU_MONTHS)}){RU_MONTH_ENDINGS})(?:\s+(\d{{4}}))?$"

    def parts(p: Column) -> Column:
        """What the forms find in a phrase; each is looked up once."""
        word, noun = _group(p, pair, 1), _group(p, pair, 2)
        russian = F.lit(None).cast("int")
        for stem, d in RU_DIRECTIONS:
            russian = F.when(word.rlike(f"^{stem}(?:ой|ая|ого|ий|ый|ом|ем|ей|его|ую|ее|ое|от|у|о|а)$"), d).otherwise(russian)
        return F.struct(
            p.alias("p"),
            _looked_up(p, OFFSETS).alias("offset"),
            _number(_group(p, ago, 1)).alias("n"),
            unit_of(_group(p, ago, 2)).alias("unit"),
            F.coalesce(_looked_up(word, DIRECTIONS), russian).alias("turn"),
            F.when(noun.rlike("^(?:week|month|year)$|^[а-я]"), unit_of(noun)).alias("period"),
            weekday_number(noun).alias("weekday"),
            month_number(_group(p, month_form, 1)).alias("month"),
            _group(p, month_form, 2).cast("int").alias("year"),
            F.date_trunc("day", anchor).alias("day0"),
        )

    def meaning(x: Column) -> Column:
        p, n, turn, day0 = x["p"], x["n"], x["turn"], x["day0"]
        has_time = p.rlike("[t ]")
        full = F.when(has_time, F.rpad(F.regexp_replace(p, "t", " "), 19, ":00")).otherwise(F.concat(p, F.lit(" 00:00:00")))
        iso_at = F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?$"), F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")))
        back = F.when(x["unit"] == "day", _days(day0, -n)).when(x["unit"] == "week", _days(day0, n * -7)).otherwise(_months(day0, n * F.when(x["unit"] == "month", -1).otherwise(-12)))
        ago_at = F.when(p.rlike(ago) & n.isNotNull() & x["unit"].isNotNull(), back)
        months = F.date_trunc("month", anchor)
        period_at = F.when(x["period"] == "week", _days(day0, turn * 7 - F.weekday(day0))).when(x["period"] == "month", _months(months, turn)).when(x["period"] == "year", _months(F.date_trunc("year", anchor), turn * 12))
        ahead, behind = F.pmod(x["weekday"] - F.weekday(day0), F.lit(7)), F.pmod(F.weekday(day0) - x["weekday"], F.lit(7))
        seven = lambda k: F.when(k == 0, 7).otherwise(k)
        weekday_at = F.when(turn == 0, _days(day0, x["weekday"] - F.weekday(day0))).when(turn == 1, _days(day0, seven(ahead))).when(turn == -1, _days(day0, -seven(behind)))
        gap = lambda y: F.abs(F.floor((F.unix_timestamp(_month_start(y, x["month"])) + 14 * 86400 - F.unix_timestamp(anchor)) / 86400))
        near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.struct(gap(F.year(anchor) + d).alias("gap"), d.alias("d"), (F.year(anchor) + d).alias("y")))
        month_at = F.when(x["month"].isNotNull(), _month_start(F.coalesce(x["year"], F.array_min(near)["y"]), x["month"]))
        found = lambda at, kind, c: F.struct(at.alias("at"), kind.alias("kind"), c.alias("confidence"))
        every = F.array(
            found(iso_at, F.when(has_time, "exact").otherwise("day"), F.lit(1.0)),
            found(_days(day0, x["offset"]), F.lit("day"), F.lit(1.0)),
            found(ago_at, x["unit"], F.lit(0.95)),
            found(period_at, x["period"], F.lit(0.9)),
            found(weekday_at, F.lit("day"), F.lit(0.95)),
            found(month_at, F.lit("month"), F.when(x["year"].isNotNull(), 1.0).otherwise(0.7)),
        )
        return F.get(F.filter(every, lambda r: r["at"].isNotNull()), F.lit(0))

    return let(F.btrim(F.lower(phrase), F.lit(" \t\n")), lambda p: let(parts(p), meaning))


def query_dates(query: Column) -> Column:
    """[(kind, from, to)] of the dates in a query, closed ranges; kinds in the order dmy, mdy, my, iso, season, year."""
    q = F.lower(query)
    m = rf"({_MONTH})"

    def found(pattern: str, kind: str, one) -> Column:
        hits = F.regexp_extract_all(q, F.lit(pattern), F.lit(0))
        ranges = F.transform(hits, lambda h: one(lambda n: F.regexp_extract(h, pattern, n)))
        return F.transform(F.filter(ranges, lambda r: r["from"].isNotNull()), lambda r: F.struct(F.lit(kind).alias("kind"), r["from"].alias("from"), r["to"].alias("to")))

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("from"), b.alias("to"))

    def day(y: Column, mo: Column, d: Column) -> Column:
        at = F.try_to_timestamp(F.concat_ws("-", y.cast("string"), mo.cast("string"), d.cast("string")), F.lit("y-M-d"))
        return span(at, at + F.expr("INTERVAL 1 DAY"))

    def month(g) -> Column:
        at = _month_start(g(2), month_number(g(1)))
        return span(at, _months(at, F.lit(1)) - F.expr("INTERVAL 1 SECOND"))

    def season(g) -> Column:
        lo, hi = (_looked_up(g(1), {k: v[i] for k, v in SEASONS.items()}) for i in (0, 1))
        end = g(2).cast("int") + F.when(lo > hi, 1).otherwise(0)
        return span(_month_start(g(2), lo), _days(_month_start(end, hi), F.lit(27)))

    def year(g) -> Column:
        return span(_month_start(g(1), F.lit(1)), _days(_month_start(g(1), F.lit(12)), F.lit(30)))

    return F.concat(
        found(rf"\b(\d{{1,2}})\s+{m}(?:\s*,)?\s+(\d{{4}})\b", "dmy", lambda g: day(g(3), month_number(g(2)), g(1))),
        found(rf"\b{m}\s+(\d{{1,2}})(?:\s*,)?\s+(\d{{4}})\b", "mdy", lambda g: day(g(3), month_number(g(1)), g(2))),
        found(rf"\b{m}\s+(\d{{4}})\b", "my", month),
        found(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", "iso", lambda g: day(g(1), g(2), g(3))),
        found(rf"\b({'|'.join(SEASONS)})\s+(\d{{4}})\b", "season", season),
        found(r"\b(?:in|during)\s+(\d{4})\b", "year", year),
    )


def entry_time(content: Column) -> Column:
    """When an entry was said, from a head such as ``[3:05 pm on 7 June, 2023]``; null without one."""
    form = rf"(?i)^\s*\[(\d{{1,2}}):(\d{{2}}) ([ap])m on (\d{{1,2}}) ({_MONTH}), (\d{{4}})\]"
    g = lambda n: F.regexp_extract(F.lower(content), form, n)
    day = F.try_to_timestamp(F.concat_ws("-", g(6), month_number(g(5)).cast("string"), g(4)), F.lit("y-M-d"))
    hour = g(1).try_cast("int") % 12 + F.when(g(3) == "p", 12).otherwise(0)
    return F.when(content.rlike(form), F.timestamp_seconds(F.unix_timestamp(day) + hour * 3600 + g(2).try_cast("int") * 60))


def tag_range(tag: Column) -> Column:
    """(from, to) of a tag that is a month (2023-04), a year (2023) or a quarter (Q2-2023)."""
    year, month = F.regexp_extract(tag, r"^(\d{4})(?:-(\d{2}))?$", 1), F.regexp_extract(tag, r"^\d{4}-(\d{2})$", 1)
    quarter, of = F.regexp_extract(tag, r"(?i)^q([1-4])-(\d{4})$", 1), F.regexp_extract(tag, r"(?i)^q[1-4]-(\d{4})$", 1)
    span = lambda a, n: F.when(a.isNotNull(), F.struct(a.alias("from"), (_months(a, F.lit(n)) - F.expr("INTERVAL 1 SECOND")).alias("to")))
    first = _month_start(of, (quarter.try_cast("int") - 1) * 3 + 1)
    return F.coalesce(F.when(month != "", span(_month_start(year, month), 1)), F.when(year != "", span(_month_start(year, F.lit(1)), 12)), F.when(quarter != "", span(first, 3)))


def record_range(content: Column, tags: Column) -> Column:
    """(from, to, source) that a record is about: the hour of its head, else the widest range of the dates in its text, else of its
    tags; null if nothing says."""
    head = entry_time(content)
    wide = lambda a: F.struct(F.array_min(F.transform(a, lambda r: r["from"])).alias("from"), F.array_max(F.transform(a, lambda r: r["to"])).alias("to"))
    dates, own = query_dates(content), F.filter(F.transform(tags, tag_range), lambda r: r.isNotNull())
    out = lambda a, b, s: F.struct(a.alias("from"), b.alias("to"), F.lit(s).alias("source"))
    return F.coalesce(
        F.when(head.isNotNull(), out(head, head + F.expr("INTERVAL 1 HOUR"), "entry_prefix")),
        let(dates, lambda d: F.when(F.size(d) > 0, out(wide(d)["from"], wide(d)["to"], "content_regex"))),
        let(own, lambda d: F.when(F.size(d) > 0, out(wide(d)["from"], wide(d)["to"], "tag"))),
    )


def temporal_intent(query: Column) -> Column:
    """Whether a query speaks of time: one of the words anywhere in it, or a date."""
    return any_word(F.lower(query), TEMPORAL_WORDS) | (F.size(query_dates(query)) > 0)


def deadline(text: Column, now: Column) -> Column:
    """When something is due: the end of the day meant, or an hour from now; English or Russian; null if nothing is said."""
    t = F.btrim(F.lower(text), F.lit(" \t\n"))
    end = lambda at: F.date_trunc("day", at) + F.expr("INTERVAL 86399 SECOND")
    later = lambda n: end(_days(now, n))
    iso = F.try_to_timestamp(_group(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    n = lambda form: _group(t, rf"^(?:через|in)\s+(\d{{1,6}})\s+(?:{form})", 1).cast("int")
    days, weeks, hours = n("дн[ейяь]|день|days?"), n("недел[ьию]|weeks?"), n("час[аов]*|hours?")

    def in_year(m: Column, d: Column) -> Column:
        at = lambda y: F.try_to_timestamp(F.concat_ws("-", y.cast("string"), m.cast("string"), d), F.lit("y-M-d")) + F.expr("INTERVAL 86399 SECOND")
        this, after = at(F.year(now)), at(F.year(now) + 1)
        return F.when(m.isNotNull(), F.when(this < now, after).otherwise(this))

    ru = in_year(_starts(_group(t, r"^\d{1,2}\s+([а-яё]+)", 1), list(enumerate(RU_MONTHS, 1))), _group(t, r"^(\d{1,2})\s+[а-яё]+", 1))
    en = in_year(month_number(F.substring(_group(t, r"^([a-z]+)\s+\d{1,2}", 1), 1, 3)), _group(t, r"^[a-z]+\s+(\d{1,2})", 1))
    word = F.regexp_replace(t, r"^(?:к|by|до|ко)\s+", "")
    wd = _starts(word, [*enumerate(RU_WEEKDAYS), *enumerate(WEEKDAYS)])
    ahead = F.pmod(wd - F.weekday(now), F.lit(7))
    return F.coalesce(
        F.when(iso.isNotNull(), end(iso)),
        F.when(t.isin("завтра", "tomorrow"), later(F.lit(1))),
        F.when(t.isin("послезавтра", "day after tomorrow"), later(F.lit(2))),
        F.when(days.isNotNull(), later(days)),
        F.when(t.rlike(r"^(?:через\s+неделю|in\s+a?\s*week)"), later(F.lit(7))),
        F.when(weeks.isNotNull(), later(weeks * 7)),
        F.when(hours.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600)),
        F.when(t.rlike(r"^(?:через\s+месяц|in\s+a?\s*month)"), later(F.lit(30))),
        ru,
        en,
        F.when(wd.isNotNull(), later(F.when(ahead == 0, 7).otherwise(ahead))),
    )


#: Where a task's text may begin with its deadline.
DEADLINE_HEADS = (r"через\s+\S+\s+\S+", r"in\s+\d+\s+\S+", "завтра|послезавтра|tomorrow", r"через\s+неделю", r"in\s+a?\s*week", r"к\s+\S+|ко\s+\S+|by\s+\S+|до\s+\S+", r"\d{1,2}\s+[а-яёa-z]+", r"\d{4}-\d{2}-\d{2}", r"[A-Za-z]+\s+\d{1,2}")


def deadline_and_title(text: Column, now: Column) -> Column:
    """(due, title) of a task's text: the first head that is a deadline is cut off."""
    t = F.btrim(text, F.lit(" \t\n"))
    forms = [rf"(?iu)^({head})\s+(.+)" for head in DEADLINE_HEADS]
    heads = F.array(*(F.struct(F.regexp_extract(t, f, 1).alias("head"), F.btrim(F.regexp_extract(t, f, 2)).alias("title")) for f in forms))
    due = F.transform(F.filter(heads, lambda h: h["head"] != ""), lambda h: F.struct(deadline(h["head"], now).alias("due"), h["title"].alias("title")))
    first = F.get(F.filter(due, lambda d: d["due"].isNotNull()), F.lit(0))
    return F.coalesce(first, F.struct(F.lit(None).cast("timestamp").alias("due"), t.alias("title")))


# --- durations ---------------------------------------------------------------------------------------


def _plural(n: Column, one: str, few: str, many: str) -> Column:
    tens, last = n % 100, n % 10
    return F.when(tens.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def humanised(seconds: Column, lang: str = "en") -> Column:
    """The one or two coarsest units of a duration, in words: years and months, months and days, weeks and days, days
    and hours, hours and minutes, minutes, seconds."""
    s = F.abs(seconds)
    days = F.floor(s / 86400)
    rest = s - days * 86400
    hours = F.floor(rest / 3600)

    def said(n: Column, unit: str) -> Column:
        word = F.when(n == 1, unit).otherwise(unit + "s") if lang == "en" else _plural(n, *RU_FORMS[unit])
        return F.concat(n.cast("string"), F.lit(" "), word)

    def two(n: Column, unit: str, m: Column, smaller: str) -> Column:
        return F.concat_ws(" ", said(n, unit), F.when(m > 0, said(m, smaller)))

    years, months = F.floor(days / YEAR_DAYS), F.floor(days / MONTH_DAYS)
    more_months = F.floor((days - years * YEAR_DAYS) / MONTH_DAYS)
    more_days = days - F.floor(months * MONTH_DAYS)
    minutes = F.floor((rest - hours * 3600) / 60)
    return (
        F.when(days >= YEAR_DAYS, two(years, "year", more_months, "month"))
        # Thirty days are not a whole mean month yet: none of it is said, as "0 months".
        .when(days >= 30, two(months, "month", more_days, "day"))
        .when(days >= 7, two(F.floor(days / 7), "week", days % 7, "day"))
        .when(days >= 1, two(days, "day", hours, "hour"))
        .when(hours >= 1, two(hours, "hour", minutes, "minute"))
        .when(rest >= 60, said(F.floor(rest / 60), "minute"))
        .otherwise(said(rest, "second"))
    )
