"""Date phrases as a small grammar over words, in SQL that both engines read.

A text is cut into words and what stands between them. Where a word can begin a phrase, a window of three words and the two
gaps between them is taken; the words are looked up in ``date_words``, a table of a few dozen rows, and kinds and gaps say which
form the window has. A form names a calendar day, or a number of days from the reference date. Windows stay in the task that
read their text; only the days that were found are shuffled, to make them distinct.

Defined results: without a reference date that begins as YYYY-MM-DD and exists, a text has no dates; a null or empty text has
none; a day that no calendar has, or past the year 9999, is left out, but an ISO date stands for itself, checked or not. White
space is that of ASCII and Unicode's separators; digits are those of ASCII.
"""

from __future__ import annotations

from ..sql import relation
from . import macros as m

#: Weekdays from Monday on, and numbers that are written as words.
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
#: Days of a unit.
UNITS = {"day": 1, "days": 1, "week": 7, "weeks": 7}


def vocabulary() -> list[tuple[str, str, int]]:
    """(word, kind, number); a month has its name and the first three letters of it."""
    months = {short: i for i, name in enumerate(m.MONTHS, 1) for short in (name.lower(), name[:3].lower())}
    kinds = {"month": months, "weekday": {w: i for i, w in enumerate(WEEKDAYS)}, "count": NUMBERS, "unit": UNITS}
    return [(word, kind, number) for kind, words in kinds.items() for word, number in words.items()]


relation("date_words", f"SELECT * FROM (VALUES {', '.join(repr(row) for row in vocabulary())}) AS t(word, kind, number)")

_SPACE = f"[{m.WS}\\\\p{{Z}}]"
_BEGINS = "|".join(["[0-9]{1,2}(st|nd|rd|th)?", "[0-9]{4}", "next", "this", "tomorrow", "in", "on", *(w for w, kind, _ in vocabulary() if kind == "month")])
#: Days from which on a shift leads past the last year from any date, so longer ones needn't be added.
_FAR = 4_000_000


def _like(x: str, pattern: str) -> str:
    return f"regexp_like({x}, '^{pattern}$')"


def _day(x: str) -> str:
    return _like(x, "[0-9]{1,2}(st|nd|rd|th)?")


def _one(x: str) -> str:
    """A row with x where x isn't null. A generator's input is computed once, however often its output is named."""
    return f"explode(filter(array({x}), v -> v IS NOT NULL))"


def _year_after(gap: str) -> str:
    """The year that a day and a month have: grown onto the second word, or the third word across a short gap, or the reference's."""
    return f"CASE WHEN grown <> '' THEN grown WHEN {_like('t', gap + ',?' + _SPACE + '*')} AND {_like('c', '[0-9]{4}')} THEN c ELSE substr(CAST(ref AS STRING), 1, 4) END"


def date_phrases(source: str, keys: list[str], text: str = "text", ref: str = "ref") -> str:
    """(keys, day): the distinct ISO dates that phrases of source's texts mean, seen from the reference date."""
    own = ", ".join(keys)
    window = ", ".join(f"lower(coalesce(try_element_at(u, i + {k}), ''))" for k in range(5))
    units = f"SELECT {own}, TRY_CAST(substr(CAST({ref} AS STRING), 1, 10) AS DATE) AS ref, regexp_extract_all({text}, '[{m.SIGN}]+|[^{m.SIGN}]+', 0) AS u FROM {source} WHERE regexp_like(CAST({ref} AS STRING), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
    begins = f"filter(sequence(1, greatest(1, size(u))), i -> regexp_like(lower(coalesce(try_element_at(u, i), '')), '^({_BEGINS})$'))"
    windows = f"SELECT {own}, ref, explode(transform({begins}, i -> array({window}))) AS p FROM ({units}) q WHERE ref IS NOT NULL"
    named = f"SELECT {own}, ref, {', '.join(f'try_element_at(p, {k}) AS {n}' for k, n in enumerate('asbtc', 1))} FROM ({windows}) q"
    grown = f"SELECT *, regexp_extract(b, '^(?:[a-z]+|[0-9]{{1,2}}(?:st|nd|rd|th)?)([0-9]{{4}})$', 1) AS grown FROM ({named}) q"
    heads = f"SELECT *, CASE WHEN grown = '' THEN b ELSE substr(b, 1, length(b) - 4) END AS head FROM ({grown}) q"
    looked = f"""
SELECT q.*, x.kind AS a_kind, x.number AS a_number, y.kind AS b_kind, y.number AS b_number, z.kind AS c_kind, z.number AS c_number, {_like('s', _SPACE + '+')} AS apart
FROM ({heads}) q LEFT JOIN date_words x ON x.word = q.a LEFT JOIN date_words y ON y.word = q.head LEFT JOIN date_words z ON z.word = q.c"""
    formed = f"""
SELECT *, {_one(f"""CASE WHEN {_like('a', '[0-9]{4}')} THEN CASE WHEN s = '-' AND t = '-' AND {_like('b', '[0-9]{2}')} AND {_like('c', '[0-9]{2}')} THEN 'iso' END
  WHEN {_day('a')} AND s = '/' THEN CASE WHEN t = '/' AND {_like('a', '[0-9]+')} AND {_like('b', '[0-9]{1,2}')} AND {_like('c', '[0-9]{4}')} THEN 'slashes' END
  WHEN {_day('a')} THEN CASE WHEN apart AND b_kind = 'month' THEN 'day month' END
  WHEN a_kind = 'month' THEN CASE WHEN apart AND {_day('head')} THEN 'month day' END
  WHEN a = 'tomorrow' THEN a
  WHEN a IN ('next', 'this') THEN CASE WHEN apart AND grown = '' AND b_kind = 'weekday' THEN a END
  WHEN a = 'in' THEN CASE WHEN apart AND {_like('t', _SPACE + '+')} AND c_kind = 'unit' AND (grown = '' AND b_kind = 'count' OR {_like('b', '[0-9]+')}) THEN a END
  WHEN a = 'on' THEN CASE WHEN s = ' ' AND b = 'the' AND t = ' ' AND {_like('c', '[0-9]{1,2}(st|nd|rd|th)')} THEN a END END""")} AS form FROM ({looked}) q"""
    number = lambda x: f"lpad(regexp_extract({x}, '^[0-9]{{1,2}}', 0), 2, '0')"
    month = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    bare = "regexp_replace(b, '^0+', '')"
    placed = f"""
SELECT {own}, ref, form,
  CASE form WHEN 'iso' THEN a || '-' || b || '-' || c WHEN 'slashes' THEN c || '-' || {number('b')} || '-' || {number('a')}
    WHEN 'day month' THEN ({_year_after('[.]?')}) || '-' || {month('b_number')} || '-' || {number('a')} WHEN 'month day' THEN ({_year_after('')}) || '-' || {month('a_number')} || '-' || {number('head')}
    WHEN 'on' THEN substr(CAST(ref AS STRING), 1, 8) || {number('c')} END AS written,
  CASE form WHEN 'on' THEN substr(CAST(last_day(ref) + 1 AS STRING), 1, 8) || {number('c')} END AS later,
  CASE form WHEN 'tomorrow' THEN 1 WHEN 'next' THEN 1 + (b_number - weekday(ref) + 6) % 7 WHEN 'this' THEN (b_number - weekday(ref) + 7) % 7
    WHEN 'in' THEN nullif(CASE WHEN {_like('b', '[0-9]+')} THEN CASE WHEN length({bare}) > 7 THEN {_FAR} WHEN {bare} = '' THEN 0 ELSE CAST({bare} AS BIGINT) END ELSE b_number END, 0) * c_number END AS shift
FROM ({formed}) q"""
    day = f"""
CASE WHEN form = 'iso' THEN written WHEN form = 'on' THEN CASE WHEN TRY_CAST(written AS DATE) > ref THEN written WHEN TRY_CAST(later AS DATE) IS NOT NULL THEN later END
  WHEN written IS NOT NULL THEN CASE WHEN substr(written, 1, 4) <> '0000' AND TRY_CAST(written AS DATE) IS NOT NULL THEN written END
  WHEN shift < {_FAR} THEN CASE WHEN ref + CAST(shift AS INTEGER) <= DATE '9999-12-31' THEN CAST(ref + CAST(shift AS INTEGER) AS STRING) END END"""
    return f"SELECT DISTINCT {own}, day FROM (SELECT {own}, {_one(day)} AS day FROM ({placed}) q) q"


relation("date_notes", """
SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS ref, CASE o_orderkey % 5 WHEN 0 THEN 'see you next tuesday' WHEN 1 THEN 'in two weeks, or tomorrow' WHEN 2 THEN 'on the ' || (1 + o_orderkey % 28) || 'th' WHEN 3 THEN 'by 14 Oct. 2024 or this friday'
  ELSE 'until ' || (1 + o_orderkey % 12) || '/11/2023, March ' || (1 + o_orderkey % 31) || 'th' END AS text FROM orders
""")
relation("date_note_days", date_phrases("date_notes", ["id"]))
#: Dates that the source texts of extracted fields mean, seen from their reference dates.
relation("dates_derived", date_phrases("enquiry_items", ["split", "item_id"], ref="reference_date"))

QUERIES = {
    "resolve_dates": "SELECT n.id, coalesce(d.days, '') AS dates FROM date_notes n LEFT JOIN (SELECT id, array_join(array_sort(collect_list(day)), ',') AS days FROM date_note_days GROUP BY id) d ON d.id = n.id",
    "date_rederivable": """
SELECT f.seq, d.day IS NOT NULL AS derivable FROM enquiry_fields f JOIN enquiry_items i ON i.item_id = f.item_id AND i.split = f.split
LEFT JOIN dates_derived d ON d.item_id = i.item_id AND d.split = i.split AND d.day = f.said_value WHERE f.type = 'date' AND f.said IS NOT NULL""",
}
