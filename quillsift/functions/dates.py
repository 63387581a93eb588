"""Dates in words. Everything is relative to a reference time that the caller gives; the clock is read only where none is given."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass
from functools import lru_cache

_DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class ParsedDate:
    """An instant, or a range from start to end."""

    start: dt.datetime
    end: dt.datetime | None = None
    text: str = ""
    begin: int = 0
    finish: int = 0

    @property
    def is_range(self) -> bool:
        return self.end is not None


def as_instant(value: dt.date | dt.datetime) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)


# Suggested phrases by locale, as (text, label).
DATE_SUGGESTIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "en": (
        ("today", "Today"),
        ("yesterday", "Yesterday"),
        ("tomorrow", "Tomorrow"),
        ("last week", "Last 7 days"),
        ("last month", "Last 30 days"),
        ("this week", "This week"),
        ("this month", "This month"),
        ("this year", "This year"),
    ),
    "de": (
        ("heute", "Heute"),
        ("gestern", "Gestern"),
        ("morgen", "Morgen"),
        ("letzte Woche", "Letzte 7 Tage"),
        ("letzten Monat", "Letzte 30 Tage"),
        ("diese Woche", "Diese Woche"),
        ("diesen Monat", "Diesen Monat"),
        ("dieses Jahr", "Dieses Jahr"),
    ),
    "fr": (
        ("aujourd'hui", "Aujourd'hui"),
        ("hier", "Hier"),
        ("demain", "Demain"),
        ("la semaine dernière", "7 derniers jours"),
        ("le mois dernier", "30 derniers jours"),
        ("cette semaine", "Cette semaine"),
        ("ce mois", "Ce mois"),
        ("cette année", "Cette année"),
    ),
    "es": (
        ("hoy", "Hoy"),
        ("ayer", "Ayer"),
        ("mañana", "Mañana"),
        ("la semana pasada", "Últimos 7 días"),
        ("el mes pasado", "Últimos 30 días"),
        ("esta semana", "Esta semana"),
        ("este mes", "Este mes"),
        ("este año", "Este año"),
    ),
    "nl": (
        ("vandaag", "Vandaag"),
        ("gisteren", "Gisteren"),
        ("morgen", "Morgen"),
        ("vorige week", "Afgelopen 7 dagen"),
        ("vorige maand", "Afgelopen 30 dagen"),
        ("deze week", "Deze week"),
        ("deze maand", "Deze maand"),
        ("dit jaar", "Dit jaar"),
    ),
    "ja": (
        ("今日", "今日"),
        ("昨日", "昨日"),
        ("明日", "明日"),
        ("先週", "先週"),
        ("先月", "先月"),
        ("今週", "今週"),
        ("今月", "今月"),
        ("今年", "今年"),
    ),
    "pt": (
        ("hoje", "Hoje"),
        ("ontem", "Ontem"),
        ("amanhã", "Amanhã"),
        ("semana passada", "Últimos 7 dias"),
        ("mês passado", "Últimos 30 dias"),
        ("esta semana", "Esta semana"),
        ("este mês", "Este mês"),
        ("este ano", "Este ano"),
    ),
}
_MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])}
_DAYS = {name.lower(): i for i in range(7) for name in (calendar.day_name[i], calendar.day_abbr[i])}
_UNITS = "second|minute|hour|day|week|month|quarter|year"
# Month names by locale, January first; units as (word, unit); a number of units back and ahead.
MONTH_NAMES = {
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
}
UNIT_WORDS = {
    "de": "tag|day tage|day tagen|day woche|week wochen|week monat|month monate|month monaten|month quartal|quarter "
    "quartalen|quarter jahr|year jahre|year jahren|year stunde|hour stunden|hour minute|minute minuten|minute",
    "fr": "jour|day jours|day semaine|week semaines|week mois|month trimestre|quarter trimestres|quarter an|year "
    "ans|year année|year années|year heure|hour heures|hour minute|minute minutes|minute",
    "es": "día|day días|day semana|week semanas|week mes|month meses|month trimestre|quarter "
    "trimestres|quarter año|year años|year hora|hour horas|hour minuto|minute minutos|minute",
    "nl": "dag|day dagen|day week|week weken|week maand|month maanden|month kwartaal|quarter "
    "kwartalen|quarter jaar|year jaren|year uur|hour uren|hour minuut|minute minuten|minute",
    "pt": "dia|day dias|day semana|week semanas|week mês|month meses|month trimestre|quarter "
    "trimestres|quarter ano|year anos|year hora|hour horas|hour minuto|minute minutos|minute",
    "ja": "日|day 週間|week か月|month ヶ月|month "
    "四半期|quarter 年|year 時間|hour 分|minute",
}
BACK_AND_AHEAD = {
    "de": ("vor {}", "in {}"),
    "fr": ("il y a {}", "dans {}"),
    "es": ("hace {}", "(?:en|dentro de) {}"),
    "nl": ("{} geleden", "over {}"),
    "pt": ("há {}", "(?:em|daqui a) {}"),
    "ja": ("{}前", "{}後"),
}
_COUNTS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_MONTH, _WEEKDAY = "|".join(sorted(_MONTHS, key=len, reverse=True)), "|".join(sorted(_DAYS, key=len, reverse=True))


def _shift(when: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in ("month", "quarter", "year"):
        months = when.year * 12 + when.month - 1 + n * {"month": 1, "quarter": 3, "year": 12}[unit]
        year, month = divmod(months, 12)
        return when.replace(year=year, month=month + 1, day=min(when.day, calendar.monthrange(year, month + 1)[1]))
    return when + n * dt.timedelta(**{unit + "s": 1})


def _start(when: dt.datetime) -> dt.datetime:
    return when.replace(hour=0, minute=0, second=0, microsecond=0)


def _end(when: dt.datetime) -> dt.datetime:
    return when.replace(hour=23, minute=59, second=59, microsecond=999000)


def _period(which: str, unit: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime | None]:
    """Last and this week, month and year are ranges that end today; next ones, and quarters, are single dates."""
    if unit == "quarter":
        first = now.replace(month=(now.month - 1) // 3 * 3 + 1, day=1)
        return {"last": _shift(now, -1, unit), "this": _start(first), "next": _shift(now, 1, unit)}[which], None
    if which == "last":
        back = {"week": now - 7 * _DAY, "month": now - 30 * _DAY, "year": _shift(now, -1, "year")}[unit]
        return _start(back), _end(now)
    if which == "this":
        first = {"week": now - ((now.weekday() + 1) % 7) * _DAY, "month": now.replace(day=1), "year": now.replace(month=1, day=1)}[unit]
        return _start(first), _end(now)
    return _shift(now, 1, unit), None


def _year(text: str) -> int:
    return int(text) if len(text) > 2 else 2000 + int(text) if int(text) < 50 else 1900 + int(text)


def _clock(m: re.Match, when: dt.datetime) -> dt.datetime:
    hour = int(m["h"]) % (12 if m["half"] else 24) + (12 if (m["half"] or "").lower() == "pm" else 0)
    return when.replace(hour=hour, minute=int(m["min"] or 0), second=0, microsecond=0)


def _count(text: str) -> int:
    return _COUNTS.get(text.lower()) or int(text)


def _numeric(m: re.Match, now: dt.datetime):
    found = m.groupdict()
    clock = (int(found.get(k) or 0) for k in ("h", "min", "s"))
    return dt.datetime(_year(m["y"]), int(m["m"]), int(m["d"]), *clock), None


def _named(m: re.Match, now: dt.datetime):
    return dt.datetime(int(m["y"] or now.year), _MONTHS[m["m"].lower()], int(m.groupdict().get("d") or 1)), None


def _moved(sign: int):
    return lambda m, now: (_shift(now, sign * _count(m["n"]), m["u"].lower()), None)


_NEAR_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1}
_AMOUNT = rf"(?P<n>\d+|{'|'.join(_COUNTS)}) (?P<u>{_UNITS})s?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<min>\d{2})(?::(?P<s>\d{2})(?:\.\d+)?)?Z?"
# (pattern, (match, now) -> (start, end)); at one place, the longest match counts.
_ENGLISH = (
    (rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:[T ]{_CLOCK})?", _numeric),
    (r"(?P<m>\d{1,2})[/-](?P<d>\d{1,2})[/-](?P<y>\d{2,4})", _numeric),
    (rf"(?P<m>{_MONTH})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?:,? (?P<y>\d{{4}}))?", _named),
    (rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)? (?:of )?(?P<m>{_MONTH})\.?(?:,? (?P<y>\d{{4}}))?", _named),
    (rf"(?P<m>{_MONTH}) (?P<y>\d{{4}})", _named),
    (r"now", lambda m, now: (now, None)),
    (rf"(?P<w>{'|'.join(_NEAR_DAYS)})", lambda m, now: (now + _NEAR_DAYS[m["w"].lower()] * _DAY, None)),
    (r"(?P<w>last|this|next) (?P<u>week|month|quarter|year)", lambda m, now: _period(m["w"].lower(), m["u"].lower(), now)),
    (f"{_AMOUNT} ago", _moved(-1)),
    (f"in {_AMOUNT}", _moved(1)),
    (rf"(?:within (?:the )?)?(?:last|past) (?P<n>\d+) (?P<u>{_UNITS})s?", _moved(-1)),
    (rf"(?:(?P<w>last|this|next) )?(?P<day>{_WEEKDAY})", lambda m, now: (_weekday(now, _DAYS[m["day"].lower()], (m["w"] or "").lower()), None)),
    (r"(?:at )?(?P<h>\d{1,2})(?::(?P<min>\d{2}))? ?(?P<half>am|pm)", lambda m, now: (_clock(m, now), None)),
)


def _compiled(rules, before: str = r"(?<!\w)", after: str = r"(?!\w)") -> tuple:
    return tuple((re.compile(f"{before}(?:{p}){after}", re.I), make) for p, make in rules)


def _local_rules(locale: str) -> tuple:
    """Day-first dates, month names, and numbers of units back and ahead."""
    units = dict(w.split("|") for w in UNIT_WORDS.get(locale, "").split())
    if not units:
        return ()
    months = {name: i for i, name in enumerate(MONTH_NAMES.get(locale, "").split(), 1)}
    amount = r"(?P<n>\d+)" + ("" if locale == "ja" else " ") + f"(?P<u>{'|'.join(sorted(units, key=len, reverse=True))})"
    day_first = lambda m, now: (dt.datetime(_year(m["y"]), int(m["m"]), int(m["d"])), None)
    moved = lambda sign: lambda m, now: (_shift(now, sign * int(m["n"]), units[m["u"].lower()]), None)
    back, ahead = (form.format(amount) for form in BACK_AND_AHEAD[locale])
    rules = [(back, moved(-1)), (ahead, moved(1))]
    if months:
        names = "|".join(sorted(months, key=len, reverse=True))
        named = lambda m, now: (dt.datetime(int(m["y"] or now.year), months[m["m"].lower()], int(m["d"] or 1)), None)
        rules += [
            (r"(?P<d>\d{1,2})[./-](?P<m>\d{1,2})[./-](?P<y>\d{4}|\d{2})", day_first),
            (rf"(?P<d>\d{{1,2}})(?:\.|er|º)? (?:de )?(?P<m>{names})(?:,? (?:de )?(?P<y>\d{{4}}))?", named),
            (rf"(?P<d>)(?P<m>{names}) (?:de )?(?P<y>\d{{4}})", named),
        ]
    else:
        rules.append((r"(?P<y>\d{4})年(?P<m>\d{1,2})月(?P<d>\d{1,2})日", day_first))
    return _compiled(rules, "", "") if locale == "ja" else _compiled(rules)


@lru_cache(maxsize=None)
def _rules(locale: str) -> tuple:
    """A locale's rules, which come before the English ones at one place and length."""
    return *_local_rules(locale), *_compiled(_ENGLISH)


def _weekday(now: dt.datetime, day: int, which: str) -> dt.datetime:
    ahead = (day - now.weekday()) % 7
    if which == "last":
        ahead -= 7
    elif which == "next":
        ahead += 7 * (ahead == 0 or which == "next")
    elif ahead > 3:  # the nearest
        ahead -= 7
    return _start(now + ahead * _DAY) + dt.timedelta(hours=12)


def _english(text: str, locale: str) -> tuple[str, bool]:
    """The phrase in English, if it is one of the locale's."""
    for known, (en, _) in zip(DATE_SUGGESTIONS.get(locale, ()), DATE_SUGGESTIONS["en"], strict=False):
        if text.strip().lower() == known[0].lower():
            return en, True
    return text, False


def detect_dates(text: str, now: dt.datetime | None = None, locale: str = "en") -> list[ParsedDate]:
    """All date expressions in the text, in the locale or in English, without overlaps, in order."""
    now = now or dt.datetime.now()
    found: list[ParsedDate] = []
    at = 0
    while at < len(text):
        best: tuple[int, int, re.Match, object] | None = None
        for pattern, make in _rules(locale):
            if (m := pattern.search(text, at)) and (best is None or (m.start(), -m.end()) < best[:2]):
                best = (m.start(), -m.end(), m, make)
        if best is None:
            break
        m = best[2]
        try:
            start, end = best[3](m, now)
            found.append(ParsedDate(start, end, m[0], m.start(), m.end()))
        except ValueError:
            pass  # such as month 13
        at = m.end()
    return found


@lru_cache(maxsize=100)
def _parse(text: str, now: dt.datetime, locale: str) -> ParsedDate | None:
    found = detect_dates(_english(text, locale)[0], now, locale)
    if not found:
        return None
    first = found[0]
    if len(found) > 1 and not first.is_range and not found[1].is_range and re.fullmatch(r"[\s,]*(?:(?:to|till|until|and|-|–)?[\s,]*)", text[first.finish : found[1].begin], re.I):
        start, end = sorted((first, found[1]), key=lambda d: d.start)
        return ParsedDate(start.start, end.start, text[first.begin : found[1].finish], first.begin, found[1].finish)
    return first


def parse_date(text: str, now: dt.datetime | None = None, locale: str = "en") -> ParsedDate | None:
    """The first date expression, two neighbouring single dates as a range; None if there is none."""
    return _parse(text, now or dt.datetime.now().replace(microsecond=0), locale.lower().split("-")[0]) if text and text.strip() else None


def format_date(when: dt.datetime, with_time: bool = False) -> str:
    day = f"{calendar.month_abbr[when.month]} {when.day}, {when.year}"
    return f"{day}, {when.hour % 12 or 12}:{when.minute:02d} {'PM' if when.hour >= 12 else 'AM'}" if with_time else day


# Words that a date expression has.
_HINTS = ("today", "yesterday", "tomorrow", "ago", "last", "this", "next", "week", "month", "year", "day", "hour", "minute", *(m for m in _MONTHS), *(d for d in _DAYS))


def might_be_date(text: str) -> bool:
    low = (text or "").lower()
    return bool(low.strip()) and (any(h in low for h in _HINTS) or bool(re.search(r"\d{4}-\d{2}-\d{2}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", low)))


def date_suggestions(locale: str | None = None) -> tuple[tuple[str, str], ...]:
    return DATE_SUGGESTIONS.get((locale or "en").lower().split("-")[0], DATE_SUGGESTIONS["en"])
