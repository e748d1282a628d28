"""Similarity of two records of companies as SQL: weighted fields, each from 0 to 1."""

from __future__ import annotations

from . import macros as m

#: Weights of the fields of a company.
WEIGHTS = {"name": 0.30, "street": 0.15, "postcode": 0.15, "city": 0.10, "country": 0.10, "domain": 0.10, "vat_id": 0.05, "phone": 0.05}
_PLAIN = ["street", "postcode", "city", "country", "domain"]


def _said(x: str) -> str:
    return f"lower({m.trimmed(f"coalesce({x}, '')")})"


def scored(source: str, keys: list[str]) -> str:
    """keys and score of source's pairs (l_ and r_ columns of every field).

    Names compare by their words: what both hold against each side, and the sides with that first. VAT numbers compare
    exactly, phones by their digits, other fields by the length of their common subsequence.
    """
    own = ", ".join(keys)
    words = {s: f"array_sort(array_distinct(filter(split({_said(f'{s}_name')}, '[{m.WS}]+'), w -> w <> '')))" for s in "lr"}
    cleaned = ", ".join([f"{_said(f'{s}_{f}')} AS {s}_{f}" for f in [*_PLAIN, "vat_id"] for s in "lr"] + [f"{m.digits(f"coalesce({s}_phone, '')")} AS {s}_phone" for s in "lr"] + [f"{w} AS {s}_words" for s, w in words.items()])
    carried = ", ".join(f"{s}_{f}" for f in [*_PLAIN, "vat_id", "phone"] for s in "lr")
    own_words = {s: f"array_join(filter({s}_words, w -> NOT array_contains({o}_words, w)), ' ')" for s, o in ("lr", "rl")}
    in_both = "array_join(filter(l_words, w -> array_contains(r_words, w)), ' ')"
    name = (
        "CASE WHEN least(n_l, n_r) = 0 THEN 0e0 WHEN shared <> '' AND (only_l = '' OR only_r = '') THEN 1e0"
        f" ELSE greatest({m.indel_ratio('with_l', 'with_r')}, CASE WHEN shared = '' THEN 0e0 ELSE {m.indel_ratio('shared', 'with_l')} END, CASE WHEN shared = '' THEN 0e0 ELSE {m.indel_ratio('shared', 'with_r')} END) END"
    )
    fields = {f: m.indel_ratio(f"l_{f}", f"r_{f}") for f in _PLAIN} | {
        "name": name,
        "vat_id": "CASE WHEN l_vat_id <> '' AND l_vat_id = r_vat_id THEN 1e0 ELSE 0e0 END",
        "phone": f"CASE WHEN l_phone = '' AND r_phone = '' THEN 0e0 ELSE {m.indel_ratio('l_phone', 'r_phone')} END",
    }
    total = " + ".join(f"{w}e0 * ({fields[f]})" for f, w in WEIGHTS.items())
    return f"""
SELECT {own}, {total} AS score FROM (SELECT {own}, {carried}, n_l, n_r, shared, only_l, only_r, trim(shared || ' ' || only_l) AS with_l, trim(shared || ' ' || only_r) AS with_r
  FROM (SELECT {own}, {carried}, size(l_words) AS n_l, size(r_words) AS n_r, {in_both} AS shared, {own_words["l"]} AS only_l, {own_words["r"]} AS only_r FROM (SELECT {own}, {cleaned} FROM {source}) a) b) c
"""
