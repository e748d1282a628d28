"""Scalar text, number and date functions as SQL over whole columns."""

from __future__ import annotations

from ..sources import tasks  # noqa: F401
from ..sql import computed, relation
from . import macros as m

#: Names and codes of countries that are evidence for a code, and the code.
COUNTRIES = {
    "GB": ["GB", "UK", "UNITED KINGDOM", "GREAT BRITAIN"], "US": ["US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"], "CA": ["CA", "CANADA"], "IE": ["IE", "IRELAND"], "FR": ["FR", "FRANCE"], "DE": ["DE", "GERMANY"],
    "ES": ["ES", "SPAIN"], "IT": ["IT", "ITALY"], "NL": ["NL", "NETHERLANDS", "THE NETHERLANDS"], "BE": ["BE", "BELGIUM"], "PT": ["PT", "PORTUGAL"], "AT": ["AT", "AUSTRIA"], "CH": ["CH", "SWITZERLAND"], "SE": ["SE", "SWEDEN"], "NO": ["NO", "NORWAY"],
    "DK": ["DK", "DENMARK"], "FI": ["FI", "FINLAND"], "PL": ["PL", "POLAND"], "AU": ["AU", "AUSTRALIA"], "NZ": ["NZ", "NEW ZEALAND"], "SG": ["SG", "SINGAPORE"], "JP": ["JP", "JAPAN"], "IN": ["IN", "INDIA"],
}
#: Calling codes and national notations that are evidence for a country.
CALLING = {
    "GB": "([+]|(^|[^0-9A-Za-z_])00)[ ]*44($|[^0-9A-Za-z_])|(^|[^0-9A-Za-z_])[(]?07[0-9]{3}[)]?[ -]?[0-9]{3}[ -]?[0-9]{3}($|[^0-9A-Za-z_])",
    "US": "([+]|(^|[^0-9A-Za-z_])00)[ ]*1($|[^0-9A-Za-z_])|(^|[^0-9A-Za-z_])[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}($|[^0-9A-Za-z_])",
}
_MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: Dates as texts write them, without what stands around them.
_DAY = "[0-9]{1,2}(?:st|nd|rd|th)?"
_YEAR = f",?[{m.WS}]*[0-9]{{0,4}}"
WRITTEN_DATE = "(?i)" + "|".join(
    f"\\\\b{form}\\\\b" for form in ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", f"{_DAY}[{m.WS}]+(?:{_MONTH})[.]?{_YEAR}", f"(?:{_MONTH})[{m.WS}]+{_DAY}{_YEAR}")
)
#: Notations of personal data, labels of numbers that are no person's, and words that speak of a birth.
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = "[+]44[ -]?7700[ -]?9[0-9]{2}[ -]?[0-9]{3}|07700[ -]?9[0-9]{2}[ -]?[0-9]{3}|[(]?[0-9]{3}[)]?[ .-]?555[ .-]?01[0-9]{2}|[+][0-9]{1,3}[ -]?[(]?[0-9]{2,4}[)]?(?:[ -]?[0-9]{2,4}){2,4}"
OFFICE = "(?i)switchboard|office line|main line|general enquir(?:y|ies)"
BIRTH = "born|dob|date of birth"
BIRTH_DATE = f"(?i)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}[ ]+(?:{_MONTH})[.]?[ ]+[0-9]{{4}}"


def country_values() -> str:
    return ", ".join(f"('{name}', '{code}')" for code, names in COUNTRIES.items() for name in names)


def digits_in(value: str, text: str, numbers: str | None = None) -> str:
    """Whether the digits of value, or the last seven of them, stand in those of text, which numbers has if given."""
    v, t = m.digits(value), numbers or m.digits(text)
    return f"(length({v}) > 0 AND (contains({t}, {v}) OR (length({v}) >= 7 AND contains({t}, substr({v}, -7)))))"


def signed_64(x: str) -> str:
    """An unsigned number of 64 bits, as DECIMAL, read as a signed one."""
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


def without_zero_cents(value: str) -> str:
    return f"CASE WHEN regexp_like({m.trimmed(value)}, '^-?[0-9]+[.]0+$') THEN regexp_replace({m.trimmed(value)}, '[.]0+$', '') ELSE {m.trimmed(value)} END"


def thousands_in(text: str) -> str:
    found = m.all_of(text, "([0-9]+(?:[.][0-9]+)?)[ ]*[kK](?:$|[^0-9A-Za-z_])", 1)
    return f"transform({found}, x -> CAST(x AS DOUBLE) * 1000)"


def amount_in(value: str, text: str, numbers: str | None = None, thousands: str | None = None) -> str:
    """Whether an amount stands in text, digit by digit or as thousands with a k; numbers and thousands of the text, if given, are columns."""
    bare, thousands = without_zero_cents(value), thousands or thousands_in(text)
    return f"({digits_in(bare, text, numbers)} OR coalesce(array_contains({thousands}, TRY_CAST({bare} AS DOUBLE)), FALSE))"


#: How far before a number its label may stand.
LABEL_REACH = 40


def found_pii(source: str, keys: str) -> str:
    """(keys, type, text) of the personal data that patterns find in source's texts, in one scan.

    Numbers are cut out of the text between marks, so that what stands before each can be searched for an office's label.
    """
    apart = f"split(regexp_replace(replace(text, char(1), ' '), '({PHONE})', char(1) || '$0' || char(1) /*g*/), char(1))"
    before = f"right(array_join(slice(parts, 1, CAST(2 * i - 1 AS INTEGER)), ''), {LABEL_REACH})"
    phones = f"transform(filter(sequence(1, greatest(1, CAST(floor(size(parts) / 2) AS INTEGER))), i -> size(parts) > 2 * i AND NOT regexp_like({before}, '{OFFICE}')), i -> 'PHONE:' || try_element_at(parts, CAST(2 * i AS INTEGER)))"
    numbered = f"transform(regexp_extract_all(text, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}', 0), x -> lpad({_numeric('substr(x, 5) || substr(x, 1, 4)')}, 72, '0') || x)"
    ibans = f"transform(filter({numbered}, x -> {_mod97('x')} = 1), x -> 'IBAN:' || substr(x, 73))"
    births = f"flatten(transform(filter(split(text, '[.\n]'), x -> regexp_like(x, '(?i){BIRTH}')), x -> regexp_extract_all(x, '{BIRTH_DATE}', 0)))"
    emails = f"transform(regexp_extract_all(text, '{EMAIL}', 0), x -> 'EMAIL:' || x)"
    whole = f"{emails} || {phones} || {ibans} || transform({births}, x -> 'DATE_OF_BIRTH:' || x)"
    return f"""
SELECT {keys}, regexp_extract(hit, '^[A-Z_]+', 0) AS type, substr(hit, length(regexp_extract(hit, '^[A-Z_]+', 0)) + 2) AS text
FROM (SELECT {keys}, explode({whole}) AS hit FROM (SELECT {keys}, text, {apart} AS parts FROM {source}) p) h
"""


def _numeric(x: str) -> str:
    """x with letters as two digits, A as 10."""
    for i in range(26):
        x = f"replace({x}, '{chr(65 + i)}', '{10 + i}')"
    return x


def _mod97(n: str, width: int = 72) -> str:
    """The number that n's first width digits write, modulo 97: nine digits at a time, each with its power of ten."""
    parts = width // 9
    return "((" + " + ".join(f"CAST(substr({n}, {1 + 9 * i}, 9) AS BIGINT) % 97 * {pow(10, 9 * (parts - 1 - i), 97)}" for i in range(parts)) + ") % 97)"


MOD97 = _mod97("lpad(n, 72, '0')")

relation("iban_samples", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'GB82WEST12345698765432' WHEN 1 THEN 'DE89370400440532013000' WHEN 2 THEN 'DE8937040044053201' || (3000 + o_orderkey % 50) ELSE 'FR' || (10 + o_orderkey % 90) || '30006000011234567890189' END AS iban FROM orders
""")
relation("dates_ref", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 31 + 1 AS INTEGER) AS nth FROM orders")
relation("amounts", "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, CASE o_orderkey % 4 WHEN 0 THEN 'budget of ' || CAST(floor(o_totalprice) AS BIGINT) || ' USD' WHEN 1 THEN 'about ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'k' WHEN 2 THEN 'no number here' ELSE 'call 555-0100 re ' || CAST(floor(o_totalprice) AS BIGINT) || '.00' END AS text FROM orders")


relation("country_texts", "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'ship to GB now' WHEN 1 THEN 'office in great Britain' WHEN 2 THEN 'ring +44 20 7946' WHEN 3 THEN 'somewhere in france' WHEN 4 THEN 'reach us or use it' WHEN 5 THEN 'call 204-555-0167' WHEN 6 THEN 'the NETHERLANDS, USA' ELSE '07700 900123' END AS text FROM customer")
relation("countries", f"SELECT * FROM (VALUES {country_values()}) AS t(name, code)")


def country_evidence(source: str, keys: list[str]) -> str:
    """(keys, code) of the countries that source's texts show, by names, written in capitals if short, or by calling codes.

    Words of the texts are joined with the names' first words; only where they meet is a whole name looked for.
    """
    own = ", ".join(keys)
    both = " AND ".join(f"i.{k} = w.{k}" for k in keys)
    said = m.has_words(f"CASE WHEN length(w.name) <= 3 THEN {m.marked_text('i.text')} ELSE {m.marked_text('upper(i.text)')} END", "w.name")
    calling = " UNION ALL ".join(f"SELECT {own}, '{code}' AS code FROM {source} WHERE regexp_like(text, '{CALLING[of]}')" for code, of in (("GB", "GB"), ("US", "US"), ("CA", "US")))
    return f"""
SELECT DISTINCT {own}, code FROM (SELECT {", ".join(f"i.{k}" for k in keys)}, w.code FROM {source} i
  JOIN (SELECT {", ".join(f"t.{k}" for k in keys)}, c.name, c.code FROM (SELECT DISTINCT {own}, explode({m.words_of('upper(text)')}) AS word FROM {source}) t JOIN (SELECT name, code, {m.first_word('name')} AS word FROM countries) c ON c.word = t.word) w ON {both}
  WHERE {said} UNION ALL {calling}) x
"""


def country_hits(source: str, keys: list[str]) -> str:
    """``country_evidence`` with the patterns of a text run once and its words looked up where it is read: only hits are shuffled."""
    own, there = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    said = m.has_words("CASE WHEN length(c.name) <= 3 THEN t.marked ELSE t.upper_marked END", "c.name")
    # a generator's input is computed once; a plain column would be computed anew for each word
    once = f"named_struct('marked', {m.marked_text('text')}, 'upper_marked', {m.marked_text('upper(text)')}, 'words', array_distinct({m.words_of('upper(text)')}))"
    calls = ", ".join(f"CASE WHEN regexp_like(text, '{CALLING[of].replace(m.OTHER, m.OTHER_NAMED)}') THEN {codes} END" for of, codes in (("GB", "array('GB')"), ("US", "array('US', 'CA')")))
    return f"""
SELECT DISTINCT {own}, code FROM (SELECT {", ".join(f"t.{k}" for k in keys)}, c.code
  FROM (SELECT {own}, p.marked, p.upper_marked, explode(p.words) AS word FROM (SELECT {own}, explode(array({once})) AS p FROM {source} WHERE {there}) s) t
  JOIN (SELECT name, code, {m.first_word('name')} AS word FROM countries) c ON c.word = t.word WHERE {said}
  UNION ALL SELECT {own}, explode(flatten(filter(array({calls}), x -> x IS NOT NULL))) AS code FROM {source}) x
"""


def country_relation(name: str, source: str, keys: list[str]) -> None:
    computed(name, country_evidence(source, keys), lambda run: run(country_hits(source, keys)))


country_relation("country_text_hits", "country_texts", ["c_custkey"])
relation("field_samples", f"SELECT item_id, field, type, allowed, said, gold FROM enquiry_said WHERE ok")
relation("summaries_said", "SELECT conv_id, coalesce(summary, '') AS summary, coalesce(asked, '') AS asked FROM talks")
relation("texts", "SELECT doc_id, coalesce(text, '') AS text FROM documents")

QUERIES = {
    "normalize_field": f"SELECT item_id, field, said, {m.normal_field('type', 'said', 'allowed')} AS value FROM field_samples",
    "normalize_enum": f"SELECT item_id, said, {m.allowed_value('said', 'allowed')} AS value FROM field_samples WHERE type IN ('enum', 'currency') AND said IS NOT NULL",
    "normalize_country": f"SELECT item_id, said, {m.country_code('said')} AS value FROM field_samples WHERE type = 'country' AND said IS NOT NULL",
    "normalize_date": f"SELECT id, {m.iso_date('v')} AS value FROM (SELECT id, CASE id % 5 WHEN 0 THEN CAST(d AS STRING) || 'T10:00:00Z' WHEN 1 THEN '2024-02-30' WHEN 2 THEN ' Next Tuesday' WHEN 3 THEN '2026-1-2' ELSE CAST(d AS STRING) END AS v FROM dates_ref) x",
    "normalize_ws": f"SELECT doc_id, {m.one_spaced('text')} AS text FROM texts",
    "digits_in_source": f"SELECT id, {digits_in('CAST(v AS STRING)', 'text')} AS found FROM amounts",
    "strip_zero_cents": f"SELECT id, {without_zero_cents('said')} AS value FROM (SELECT id, v || CASE id % 4 WHEN 0 THEN '.00' WHEN 1 THEN '.50' WHEN 2 THEN '.0' ELSE '' END AS said FROM amounts) x",
    "amount_in_source": f"SELECT id, {amount_in('said', 'text')} AS found FROM (SELECT id, text, CASE id % 3 WHEN 0 THEN v || '.0' WHEN 1 THEN CAST(v AS STRING) ELSE CAST(CAST(floor(v / 1000) AS BIGINT) * 1000 AS STRING) END AS said FROM amounts) x",
    "country_in_source": """
SELECT t.c_custkey, c.code, h.code IS NOT NULL AS found FROM country_texts t CROSS JOIN (SELECT DISTINCT code FROM countries) c LEFT JOIN country_text_hits h ON h.c_custkey = t.c_custkey AND h.code = c.code""",
    "resolve_next_weekday": "SELECT id, CAST(d + CAST(1 + (1 - weekday(d) + 6) % 7 AS INTEGER) AS STRING) AS next_tuesday FROM dates_ref",
    "resolve_this_weekday": "SELECT id, CAST(d + CAST((1 - weekday(d) + 7) % 7 AS INTEGER) AS STRING) AS this_tuesday FROM dates_ref",
    "resolve_day_of_month": """
SELECT id, CAST(coalesce(CASE WHEN here > d THEN here END, there) AS STRING) AS resolved FROM (SELECT id, d, TRY_CAST(substr(CAST(d AS STRING), 1, 8) || substr('0' || nth, -2) AS DATE) AS here,
  TRY_CAST((CASE WHEN month(d) = 12 THEN (year(d) + 1) || '-01-' ELSE year(d) || '-' || substr('0' || (month(d) + 1), -2) || '-' END) || substr('0' || nth, -2) AS DATE) AS there FROM dates_ref) x""",
    "month_index": f"SELECT word, {m.month_number('word')} AS month FROM (SELECT DISTINCT regexp_extract(day, '([A-Za-z]+)$', 1) AS word FROM briefs) w",
    "keytoken_owner": "SELECT seq, stands AS ok FROM token_checks WHERE token_kind = 'owner'",
    "keytoken_amount": "SELECT seq, token, passes AS ok FROM token_checks WHERE token_kind = 'amount'",
    "amount_parse": f"SELECT item_id, amount, {m.amount_value('amount')} AS value FROM briefs",
    "keytoken_date": "SELECT seq, token, passes AS ok FROM token_checks WHERE token_kind IN ('date', 'fact')",
    "month_day_parse": f"SELECT item_id, day, {m.month_day('day')} AS month_day FROM briefs",
    "keytoken_fact": "SELECT seq, ix, passes, stands FROM brief_facts",
    "iban_valid": f"SELECT id, iban, {MOD97} = 1 AS valid FROM (SELECT id, iban, {_numeric('substr(iban, 5) || substr(iban, 1, 4)')} AS n FROM iban_samples) x",
    "regex_pii": found_pii("texts", "doc_id"),
    "pii_dob": found_pii("letters", "item_id"),
    "power_watts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0e0 - value * 12 / 1e6 END AS watts FROM events",
    "signed_64_bit": f"SELECT event_id, {signed_64('x')} AS signed FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST('18446744073709551615' AS DECIMAL(20, 0)) - CAST(event_id % 5000 AS DECIMAL(20, 0)) ELSE CAST(event_id AS DECIMAL(20, 0)) END AS x FROM events) e",
    "parse_size": """
SELECT p_partkey, CAST(regexp_extract(s, '^[0-9]+', 0) AS BIGINT) * CASE regexp_extract(s, '[KMG]$', 0) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1 END AS bytes FROM (SELECT p_partkey, p_size || CASE p_partkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G' ELSE '' END AS s FROM part) x""",
    "trimmed_digits": f"SELECT id, {m.digits('phone')} AS digits, lower(trim(name)) AS name FROM company_records",
}
