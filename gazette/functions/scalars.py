
from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_MINUTES = 9999
# The white space of the feeds' trim and \s, as a set of a regular expression and as characters.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The characters whose upper case is several, but for a single one of their own or its title case; others of them stay.
ONE_UPPER = ("".join(_SEVERAL := [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]), "".join({"ß": "ẞ"}.get(c, c.title() if len(c.title()) == 1 else c) for c in _SEVERAL))
# The last year, and the last day from 1970-01-01, of the dates that feeds can state.
LAST_YEAR, LAST_DAY = 275_760, 100_000_000
# Clock texts in the strict and in the lenient form.
STRICT_CLOCK, LENIENT_CLOCK = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$", rf"(?i)(\d{{1,2}}):?(\d{{2}})?{SPACE}*(am|pm)?"
# Kinds of URLs, the first rule that holds.
URL_KINDS = ((r"\.pdf$", "pdf"), (r"\.(docx?|odt)$", "word"), (r"\.(xlsx?|csv|ods)$", "sheet"), (r"\.(jpg|jpeg|png|gif|webp)$", "image"), (r"youtu", "video"), (r"docs\.google\.com", "doc"))


def field(df: DataFrame, name: str) -> Column:
    """A column that a feed may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def default(c: Column, otherwise: Column | str = "") -> Column:  # X1
    return F.coalesce(F.nullif(c, F.lit("")), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def header(name: str) -> str:  # X10
    return re.sub(f"[{SPACES}]+", "_", name.strip(SPACES).lower())


def headers(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Normalised names; one that is taken gets the first free number after it."""
    out = list(taken)
    for name in map(header, names):
        free = (name if not k else f"{name}_{k}" for k in itertools.count())
        out.append(next(x for x in free if x not in out))
    return out[len(taken) :]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def whole(c: Column) -> Column:
    """try_cast to int; texts without a digit don't come to it, as a cast that fails costs an exception."""
    return F.when(c.rlike("[0-9]"), c.try_cast("int"))


def parse_date(text: Column) -> Column:
    """Year-month-day; months and days beyond their range roll over, years below 100 are 19xx.

    Years beyond LAST_YEAR, months or days that reach no earlier than that, and dates after LAST_DAY are null.
    """

    def of(p: Column) -> Column:
        y, m, d = (F.get(p, F.lit(i)) for i in range(3))
        usable = y.between(1, LAST_YEAR) & m.between(1, 12 * LAST_YEAR) & d.between(1, 2 * LAST_DAY)
        first = F.make_date(F.when(usable, F.when(y < 100, y + 1900).otherwise(y)), F.lit(1), F.lit(1))
        return let(F.date_add(F.add_months(first, m - 1), d - 1), lambda x: F.when(x <= F.date_from_unix_date(F.lit(LAST_DAY)), x))

    return let(F.transform(F.slice(F.split(text, "-"), 1, 3), whole), of)


def _minutes(text: Column, pattern: str) -> Column:
    def of(g: Column) -> Column:
        half, minute = F.lower(F.get(g, F.lit(2))), F.coalesce(whole(F.get(g, F.lit(1))), F.lit(0))
        return let(whole(F.get(g, F.lit(0))), lambda h: F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h) * 60 + minute)

    return let(text, lambda t: let(F.array(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)]), of))


def parse_clock(text: Column) -> Column:
    """Minutes of the day by the strict form; 0 for anything else."""
    kept = F.trim(F.regexp_replace(text, r"(?i)[^0-9:apm ]", ""))
    return F.coalesce(_minutes(kept, STRICT_CLOCK), F.lit(0))


def lenient_clock(text: Column) -> Column:
    """Minutes of the day by the first thing that looks like a time; MISSING_MINUTES without one."""
    return F.coalesce(_minutes(text, LENIENT_CLOCK), F.lit(MISSING_MINUTES))


def parse_datetime(date: Column, clock: Column) -> Column:  # X4
    return F.timestamp_add("MINUTE", parse_clock(clock), parse_date(date).cast("timestamp_ntz"))


def with_datetimes(df: DataFrame, **of: tuple[Column, Column | None]) -> DataFrame:
    """df with a timestamp for each name: parse_datetime() of a date and a clock, or midnight of parse_date() without a clock.

    The same results as those functions in steps, each of which names what the one before has worked out once. A step
    is a generator of one row: Spark compiles it, and moves neither filters nor projections through it, which would
    write its expressions out wherever they are named.
    """
    steps: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for k, (name, (date, clock)) in enumerate(of.items()):
        part, minute, first, day = (f"_{x}{k}" for x in ("part", "minute", "first", "day"))
        y, m, d = (f"_{x}{k}" for x in "ymd")
        steps[0][part] = F.split(date, "-", 4)
        steps[1] |= {c: whole(F.get(part, F.lit(i))) for i, c in enumerate((y, m, d))}
        usable = F.col(y).between(1, LAST_YEAR) & F.col(m).between(1, 12 * LAST_YEAR) & F.col(d).between(1, 2 * LAST_DAY)
        steps[2][first] = F.make_date(F.when(usable, F.when(F.col(y) < 100, F.col(y) + 1900).otherwise(F.col(y))), F.lit(1), F.lit(1))
        steps[3][day] = F.date_add(F.add_months(first, F.col(m) - 1), F.col(d) - 1)
        midnight = F.when(F.col(day) <= F.date_from_unix_date(F.lit(LAST_DAY)), F.col(day)).cast("timestamp_ntz")
        steps[4][name] = midnight
        if clock is not None:
            # A text of the strict form becomes its three parts; others have no comma, as none is kept.
            kept = F.trim(F.regexp_replace(clock, r"(?i)[^0-9:apm ]", ""))
            half, hour = F.lower(F.get(f"_clock{k}", F.lit(2))), F.col(f"_hour{k}")
            steps[0][f"_clock{k}"] = F.split(F.regexp_replace(kept, STRICT_CLOCK, "$1,$2,$3"), ",")
            steps[1][f"_hour{k}"] = F.when(F.size(f"_clock{k}") == 3, whole(F.get(f"_clock{k}", F.lit(0))))
            within = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
            steps[2][minute] = F.coalesce(within * 60 + F.coalesce(whole(F.get(f"_clock{k}", F.lit(1))), F.lit(0)), F.lit(0))
            steps[4][name] = F.timestamp_add("MINUTE", F.col(minute), midnight)
    kept = [F.col(f"`{c}`") for c in df.columns]
    for k, step in enumerate(steps):
        made = F.struct(*[v.alias(c) for c, v in step.items()])
        earlier = [] if k == len(steps) - 1 else [F.col(c) for old in steps[:k] for c in old]
        df = df.select("*", F.inline(F.array(made))).select(*kept, *earlier, *step)
    return df


def flag(c: Column) -> Column:  # X6
    return F.coalesce(F.lower(c).isin("y", "yes", "true", "1"), F.lit(False))


def slug_id(start_date: Column, title: Column) -> Column:  # X7
    return F.concat(F.coalesce(start_date, F.lit("")), F.lit("-"), F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), rf"{SPACE}+", "-"))


def tags(c: Column) -> Column:  # X8
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,]"), trim), lambda x: x != "")


def int_prefix(c: Column) -> Column:  # X9
    return whole(F.regexp_extract(c, rf"^{SPACE}*([+-]?\d+)", 1))


def search_text(*fields: Column) -> Column:  # X11
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields]))


def after(c: Column, before: str) -> Column:
    """before and c, or nothing without c."""
    return F.when(present(c), F.concat(F.lit(before), c)).otherwise("")


def truncate(c: Column, n: int = 160) -> Column:  # X13
    return F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), F.lit(n - 1)), F.lit("…"))).otherwise(c)


def letter_upper(c: Column) -> Column:
    """One character in upper case as one character: ß is ẞ rather than SS."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, *ONE_UPPER)).otherwise(F.upper(c))


def initials(name: Column) -> Column:  # X14
    first = F.transform(F.slice(F.split(trim(name), f"{SPACE}+"), 1, 2), lambda w: letter_upper(F.substr(w, F.lit(1), F.lit(1))))
    return default(F.array_join(first, ""), "??")


def file_stem(c: Column) -> Column:  # X16
    return F.lower(F.substr(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), F.lit(1), F.lit(60)))


def percent_encode(c: Column) -> Column:  # X17
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def map_link(address: Column, base: str) -> Column:  # X18
    return F.when(present(address), F.concat(F.lit(base), percent_encode(address))).otherwise("")


def contact_link(c: Column) -> Column:  # X19
    return F.when(F.contains(c, F.lit("@")), F.concat(F.lit("mailto:"), c)).otherwise(c)


def url_kind(url: Column) -> Column:  # X20
    u = F.lower(F.coalesce(url, F.lit("")))
    (pattern, kind), *rest = URL_KINDS
    out = F.when(u.rlike(pattern), kind)
    for pattern, kind in rest:
        out = out.when(u.rlike(pattern), kind)
    return out.otherwise("link")


def external(url: Column) -> Column:  # X21
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def announcement_link(url: Column) -> Column:  # X22
    return F.when(~present(url), "").when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("#"), url))


def long_date(ts: Column) -> Column:  # X25
    return F.date_format(ts, "EEEE, MMMM d, y")


def short_date(ts: Column) -> Column:  # X26
    return F.date_format(ts, "MMM d, y")


def time_range(start: Column, end: Column) -> Column:  # X27
    clock = lambda t: F.date_format(t, "h:mm a")
    return F.when(end.isNull() | (end == start), clock(start)).otherwise(F.concat(clock(start), F.lit(" – "), clock(end)))


def date_tile(ts: Column) -> dict[str, Column]:  # X28
    return {"tile_month": F.upper(F.date_format(ts, "MMM")), "tile_day": F.day(ts), "tile_year": F.year(ts)}


def calendar_stamp(ts: Column, zone: str) -> Column:  # X29
    return F.date_format(F.convert_timezone(F.lit(zone), F.lit("UTC"), ts), "yyyyMMdd'T'HHmmss'Z'")


def calendar_text(c: Column) -> Column:  # X30
    return F.translate(c, "\n,;", "   ")
