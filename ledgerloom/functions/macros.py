"""SQL expressions that several relations use, as text; Spark and DuckDB read them alike."""

from __future__ import annotations

from ..sql import either

#: White space that a pattern trims: blank, tab, line feed, carriage return, form feed, vertical tab.
WS = " \t\n\r\f\v"
#: Fixed value: what a label is stripped of on both sides.
LABEL_MARKS = " \t\n\r`'\".,;:!?"
_MARKS = "[ \t\n\r`''\".,;:!?]"
_FENCE = f"(?s)```[a-zA-Z0-9_+-]*[{WS}]*(.*?)```"


def _stripped(x: str) -> str:
    """The same as ``_trimmed`` in Spark, without a pattern."""
    return f"btrim({x}, '{WS}')"


def _trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def trimmed(x: str) -> str:
    return either(_stripped(x), _trimmed(x))


def one_spaced(x: str) -> str:
    """White space collapsed to single blanks, none at the ends."""
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ' /*g*/))"


def without_reasoning(x: str) -> str:
    """Closed reasoning blocks go, then one that never ends."""
    return f"regexp_replace(regexp_replace({x}, '(?is)<think>.*?</think>', '' /*g*/), '(?is)<think>.*$', '')"


def unwrapped(x: str) -> str:
    """x, free of reasoning already, or the body of its first code fence; trimmed."""
    return trimmed(f"CASE WHEN regexp_like({x}, '{_FENCE}') THEN regexp_extract({x}, '{_FENCE}', 1) ELSE {x} END")


def label_line(x: str) -> str:
    """The first line that holds more than marks, without those at its ends; null if there is none."""
    line = f"regexp_extract({x}, '[^\n\r]*[^ \t\n\r`''\".,;:!?][^\n\r]*', 0)"
    bare = f"regexp_replace(regexp_replace({line}, '^{_MARKS}+', ''), '{_MARKS}+$', '')"
    return f"nullif({bare}, '')"


def folded_label(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '^{_MARKS}+', ''), '{_MARKS}+$', '')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '' /*g*/)"


def words(x: str) -> str:
    """Number of words."""
    return f"CASE WHEN {one_spaced(x)} = '' THEN 0 ELSE length({one_spaced(x)}) - length(replace({one_spaced(x)}, ' ', '')) + 1 END"


#: A letter, digit or underscore of any script, in a class of a pattern.
SIGN = "\\\\p{L}\\\\p{N}_"
_UNITS = f"[{SIGN}]+|[^{SIGN}]+"


def _marked(x: str) -> str:
    """x with a mark before and after each run of word signs and each run between them; marks of its own are rewritten."""
    safe = f"replace(replace({x}, char(2), char(2) || '!'), char(1), char(2) || '?')"
    return f"(char(1) || array_join(regexp_extract_all({safe}, '{_UNITS}', 0), char(1)) || char(1))"


def marked_text(x: str) -> str:
    """A text for ``has_words``: what stands before its first word and after its last has no word on its other side."""
    return _marked(f"regexp_replace(regexp_replace({x}, '^[^{SIGN}]+', ''), '[^{SIGN}]+$', '')")


def has_words(marked: str, words: str) -> str:
    """Whether a text, marked, has words, a literal or column, with a word's boundary at both ends.

    No pattern is made of words: runs of the one must be runs of the other, in order.
    """
    return f"({words} <> '' AND contains({marked}, {_marked(words)}))"


def whole_word(text: str, word: str) -> str:
    """Whether text has word, a literal or column, between boundaries of words."""
    return has_words(marked_text(text), word)


def words_of(x: str) -> str:
    return f"regexp_extract_all({x}, '[{SIGN}]+', 0)"


def first_word(x: str) -> str:
    return f"regexp_extract({x}, '[{SIGN}]+', 0)"


def _bits(short: str, long: str) -> str:
    """Length of the longest common subsequence; bit i of a number stands for sign i of short, which has 62 at most."""
    full = f"(shiftleft(1L, length({short})) - 1L)"
    hit = f"aggregate(sequence(1, length({short})), 0L, (h, i) -> h | CASE WHEN substr({short}, i, 1) = substr({long}, j, 1) THEN shiftleft(1L, i - 1) ELSE 0L END)"
    return f"length({short}) - bit_count(aggregate(transform(sequence(1, length({long})), j -> {hit}), {full}, (r, m) -> ((r + (r & m)) | (r & ~m)) & {full}))"


def _rows(short: str, long: str) -> str:
    """The same by rows of the table of prefixes, for strings of any length."""
    cell = f"CASE WHEN substr({short}, i, 1) = substr({long}, j, 1) THEN element_at(r, i) + 1 ELSE greatest(element_at(r, i + 1), element_at(t, i)) END"
    return f"element_at(aggregate(sequence(1, length({long})), array_repeat(0, length({short}) + 1), (r, j) -> aggregate(sequence(1, length({short})), array(0), (t, i) -> array_append(t, {cell}))), -1)"


def _wide(short: str, long: str) -> str:
    full = f"((1::HUGEINT << length({short})) - 1)"
    hit = f"list_sum(list_transform(generate_series(1, length({short})), lambda i: CASE WHEN substr({short}, i::BIGINT, 1) = substr({long}, j::BIGINT, 1) THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT"
    return f"length({short}) - bit_count(list_reduce(list_transform(generate_series(1, length({long})), lambda j: {hit}), lambda r, m: ((r + (r & m)) | (r & ~m)) & {full}, {full}))"


def common_length(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns."""
    ours = (
        f"CASE WHEN {a} = {b} THEN length({a}) WHEN {a} = '' OR {b} = '' THEN 0 WHEN least(length({a}), length({b})) > 62 THEN {_rows(a, b)}"
        f" WHEN length({a}) <= length({b}) THEN {_bits(a, b)} ELSE {_bits(b, a)} END"
    )
    return either(ours, f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN length({a}) <= length({b}) THEN {_wide(a, b)} ELSE {_wide(b, a)} END")


def indel_ratio(a: str, b: str) -> str:
    """1 for equal strings, 0 for nothing in common."""
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1e0 ELSE 2e0 * ({common_length(a, b)}) / (length({a}) + length({b})) END"


def iso_date(x: str) -> str:
    """x as an ISO date if its first ten characters are one, else in lower case."""
    v = trimmed(x)
    return f"CASE WHEN regexp_like(substr({v}, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN coalesce(CAST(TRY_CAST(substr({v}, 1, 10) AS DATE) AS STRING), lower({v})) ELSE lower({v}) END"


#: Names that stand for a country in a field.
COUNTRY_NAMES = {"UNITED KINGDOM": "GB", "UK": "GB", "GREAT BRITAIN": "GB", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "USA": "US", "CANADA": "CA"}


def _looked_up(x: str, values: dict[str, str]) -> str:
    """The value of a word, null for others. Spark computes x once; a CASE computes it for each WHEN up to the one that fits."""
    return f"try_element_at(map({', '.join(f'{chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)}' for k, v in values.items())}), {x})"


def country_code(x: str) -> str:
    ours, v = f"upper({_stripped(x)})", f"upper({_trimmed(x)})"
    return either(f"coalesce({_looked_up(ours, COUNTRY_NAMES)}, {ours})", f"CASE {v} {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {chr(39)}{c}{chr(39)}' for n, c in COUNTRY_NAMES.items())} ELSE {v} END")


def allowed_value(x: str, allowed: str) -> str:
    """The first of the allowed values, separated by bars, that x is but for case; else x."""
    ours, v = _stripped(x), _trimmed(x)
    place = f"CAST(nullif(array_position(transform(split({allowed}, '[|]'), a -> lower(a)), lower({ours})), 0) AS INTEGER)"
    return either(f"coalesce(try_element_at(split({allowed}, '[|]'), {place}), {ours})", f"coalesce(list_extract(list_filter(string_split_regex({allowed}, '[|]'), lambda a: lower(a) = lower({v})), 1), {v})")


def amount_cents(x: str) -> str:
    """Cents, rounded half-even, as text; null where no number is left."""
    return f"CAST(CAST(bround(TRY_CAST(regexp_replace({x}, '[^0-9.-]', '' /*g*/) AS DOUBLE) * 100, 0) AS BIGINT) AS STRING)"


def whole_number(x: str) -> str:
    v = trimmed(f"replace({x}, ',', '')")
    return f"CASE WHEN regexp_like({v}, '^[+-]?[0-9]{{1,18}}$') THEN CAST(CAST({v} AS BIGINT) AS STRING) END"


def normal_field(kind: str, x: str, allowed: str) -> str:
    """x as it is compared, by the logical type that the column kind names."""
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {kind} = 'string' THEN lower({one_spaced(x)}) WHEN {kind} = 'email' THEN lower({trimmed(x)}) WHEN {kind} = 'phone' THEN nullif({digits(x)}, '')"
        f" WHEN {kind} = 'country' THEN {country_code(x)} WHEN {kind} = 'date' THEN {iso_date(x)} WHEN {kind} IN ('enum', 'currency') THEN {allowed_value(x, allowed)}"
        f" WHEN {kind} = 'int' THEN {whole_number(x)} WHEN {kind} = 'amount' THEN {amount_cents(x)} ELSE {x} END"
    )


def occurrences(text: str, query: str) -> str:
    """Places (1-based, in text with white space collapsed) where query, which isn't empty, begins; overlaps count. None: null or empty."""
    following = f"locate({query}, {text}, element_at(r, -1) + 1)"
    most = f"length({text}) - length(replace({text}, substr({query}, 1, 1), ''))"  # each begins with the query's first sign
    ours = f"CASE WHEN {query} <> '' AND contains({text}, {query}) THEN aggregate(sequence(1, {most}), array(locate({query}, {text})), (r, i) -> CASE WHEN {following} > 0 THEN array_append(r, {following}) ELSE r END) END"
    return either(ours, f"filter(sequence(1, greatest(1, length({text}) - length({query}) + 1)), i -> substr({text}, CAST(i AS INTEGER), length({query})) = {query})")


def kept_places(text: str) -> str:
    """Places (1-based) that stay where white space is collapsed and none is left before the first word."""
    ours = f"translate({text}, '{WS[1:]}', '{' ' * len(WS[1:])}')"
    flags = f"zip_with(split({ours}, ''), split(' ' || {ours}, ''), (c, p) -> c IS NOT NULL AND (c <> ' ' OR p <> ' '))"
    theirs = f"filter(sequence(1, length({text})), i -> NOT regexp_like(substr({text}, CAST(i AS INTEGER), 1), '[{WS}]') OR i > 1 AND NOT regexp_like(substr({text}, CAST(i - 1 AS INTEGER), 1), '[{WS}]'))"
    return either(f"filter(transform({flags}, (k, i) -> CASE WHEN k THEN i + 1 END), i -> i IS NOT NULL)", theirs)


#: Months, and how they are abbreviated.
MONTHS = "January February March April May June July August September October November December".split()


def month_number(x: str) -> str:
    """Two digits of a month's name or its abbreviation, in any case; null for other words."""
    theirs = f"CASE lower({x}) " + " ".join(f"WHEN '{m.lower()}' THEN '{i:02d}' WHEN '{m[:3].lower()}' THEN '{i:02d}'" if len(m) > 3 else f"WHEN '{m.lower()}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1)) + " WHEN 'sept' THEN '09' END"
    return either(_looked_up(f"lower({x})", {w: f"{i:02d}" for i, m in enumerate(MONTHS, 1) for w in (m.lower(), m[:3].lower())} | {"sept": "09"}), theirs)


def amount_value(x: str) -> str:
    """A written amount as a number, with k for thousands; null where it is none."""
    v = f"regexp_replace({x}, '[^0-9.kK]', '' /*g*/)"
    return f"CASE WHEN regexp_like({v}, '[kK]$') THEN TRY_CAST(substr({v}, 1, length({v}) - 1) AS DOUBLE) * 1000 ELSE TRY_CAST({v} AS DOUBLE) END"


def amounts_in(text: str) -> str:
    """The written amounts of text."""
    return f"regexp_extract_all({text}, '[$€£]?[{WS}]?[0-9][0-9,]*(?:[.][0-9]+)?[{WS}]?[kK]?', 0)"


def _two(x: str) -> str:
    return f"substr('0' || {x}, -2)"


#: A sign that is no letter, digit or underscore of ASCII. Java tests a negated class range by range, several times as long as the name of it.
OTHER, OTHER_NAMED = "[^0-9A-Za-z_]", "\\\\W"


def all_of(text: str, pattern: str, group: int = 0) -> str:
    """What a pattern finds in text."""
    theirs = f"regexp_extract_all({text}, '{pattern}', {group})"
    return either(theirs.replace(OTHER, OTHER_NAMED), theirs)


def day_then_month(text: str) -> str:
    """MM-DD of each day that is followed by a word; the month is -- where the word is none."""
    found = all_of(text, f"(?:^|[^0-9A-Za-z_])[0-9]{{1,2}}(?:st|nd|rd|th)?[{WS}]+[A-Za-z]+")
    return f"transform({found}, x -> coalesce({month_number(f'regexp_extract(x, {chr(39)}([A-Za-z]+)${chr(39)}, 1)')}, '--') || '-' || {_two(f'regexp_extract(x, {chr(39)}([0-9]+){chr(39)}, 1)')})"


def month_then_day(text: str) -> str:
    found = all_of(text, f"(?:^|[^0-9A-Za-z_])[A-Za-z]+[{WS}]+[0-9]{{1,2}}(?:st|nd|rd|th)?(?:$|[^0-9A-Za-z_])")
    return f"transform({found}, x -> coalesce({month_number(f'regexp_extract(x, {chr(39)}([A-Za-z]+){chr(39)}, 1)')}, '--') || '-' || {_two(f'regexp_extract(x, {chr(39)}([0-9]+){chr(39)}, 1)')})"


def slash_days(text: str) -> str:
    """MM-DD of days written as day/month."""
    found = all_of(text, f"(?:^|[^0-9A-Za-z_])[0-9]{{1,2}}/[0-9]{{1,2}}(?:$|[^0-9A-Za-z_])")
    return f"transform({found}, x -> {_two(f'regexp_extract(x, {chr(39)}/([0-9]+){chr(39)}, 1)')} || '-' || {_two(f'regexp_extract(x, {chr(39)}([0-9]+)/{chr(39)}, 1)')})"


def iso_days(text: str) -> str:
    found = all_of(text, f"(?:^|[^0-9A-Za-z_])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}")
    return f"transform({found}, x -> substr(x, -5))"


def month_day(x: str) -> str:
    """MM-DD of the first day and month that x writes, either first; null if it names no month."""
    first = lambda a: f"CASE WHEN substr(try_element_at({a}, 1), 1, 2) = '--' THEN NULL ELSE try_element_at({a}, 1) END"
    guarded = lambda a: f"CASE WHEN size({a}) > 0 THEN {first(a)} END"
    return f"coalesce({guarded(day_then_month(x))}, {guarded(month_then_day(x))})"


#: Within which amounts are equal: half a cent.
CENT = "0.005e0"


def token_passes(kind: str, token: str, text: str) -> str:
    """Whether text states a key token, by its kind: an amount within half a cent, a day in one of four forms, else as it stands."""
    near = f"size(filter({amounts_in(text)}, x -> abs({amount_value('x')} - {amount_value(token)}) < {CENT})) > 0"
    days = " OR ".join(f"array_contains({f(text)}, {month_day(token)})" for f in (day_then_month, month_then_day, slash_days, iso_days))
    plain = f"contains(lower({text}), lower({token}))"
    return f"CASE WHEN {kind} = 'amount' THEN coalesce({near}, FALSE) WHEN {kind} = 'date' AND {month_day(token)} IS NOT NULL THEN coalesce({days}, FALSE) ELSE {plain} END"


def stated(text: str) -> str:
    """Columns amounts and days: what text states, for ``states``. Patterns that need a slash or a dash run where there is one."""
    days = " || ".join([day_then_month(text), month_then_day(text), *(f"CASE WHEN contains({text}, '{sign}') THEN {f(text)} ELSE array() END" for sign, f in (("/", slash_days), ("-", iso_days)))])
    return f"transform({amounts_in(text)}, x -> {amount_value('x')}) AS amounts, {days} AS days"


def meant(kind: str, token: str) -> str:
    """Columns amount and day: what a token means, null where its kind has none."""
    return f"CASE WHEN {kind} = 'amount' THEN {amount_value(token)} END AS amount, CASE WHEN {kind} = 'date' THEN {month_day(token)} END AS day"


def states(t: str, p: str, text: str) -> str:
    """``token_passes`` by columns of ``stated`` in p and ``meant`` in t, so that patterns run once a text and once a token."""
    near, plain = f"size(filter({p}.amounts, x -> abs(x - {t}.amount) < {CENT})) > 0", f"contains(lower({p}.{text}), lower({t}.token))"
    return f"CASE WHEN {t}.token_kind = 'amount' THEN coalesce({near}, FALSE) WHEN {t}.day IS NOT NULL THEN coalesce(array_contains({p}.days, {t}.day), FALSE) ELSE {plain} END"
