"""Steps that the chain's queries share run their patterns once a text, and give what their SQL says."""

import re

from ledgerloom import catalog, sql  # noqa: F401  the catalog registers the relations
from ledgerloom.functions import macros as m
from ledgerloom.functions import similarity
from ledgerloom.functions import text as t

SAID = ["", None, "Owner1 gives $2,500 by 3 April for all", "owner1 gives 2.5K by april 3rd", "on 3/04, or 2024-04-03", "2.504k 2.5041 k 1.2.3", "3 Aprilis, 31 sept, May 9th", "€ 2500 until 03/4 and x1", "by 3\tApril\n2024"]
TOKENS = [(0, "owner", "Owner1"), (1, "amount", "$2,500"), (1, "amount", "2.5k"), (1, "amount", "none"), (2, "date", "3 April"), (2, "date", "May 9"), (2, "date", "3 Aprilis"), (2, "date", "some day"), (3, "fact", "all"), (3, None, None), (3, "date", None), (1, "amount", None)]


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def theirs(text):
    return re.sub(r"/\*<\*/.*?/\*\|(.*?)>\*/", r"\1", text, flags=re.S)


def test_kept_token_checks_are_made_with_patterns_once_a_text(spark, monkeypatch):
    parsed = spark.createDataFrame([(i, "m", "local", "test", "A", 1, s, s is not None) for i, s in enumerate(SAID)], "seq long, model_id string, kind string, split string, pass string, item_id long, summary string, ok boolean")
    tokens = spark.createDataFrame([("test", 1, *x) for x in TOKENS], "split string, item_id long, ix int, token_kind string, token string")
    made, make = [], sql.COMPUTED["token_checks"]
    monkeypatch.setitem(sql.COMPUTED, "token_checks", lambda run: (made.append(1), make(run))[1])
    given = {"brief_parsed": parsed, "brief_tokens": tokens}
    got = told(sql.run(spark, "", "SELECT seq, ix, token, stands, passes FROM token_checks", given))
    want = f"SELECT p.seq, t.ix, t.token, contains(lower(p.summary), lower(t.token)) AS stands, {m.token_passes('t.token_kind', 't.token', 'p.summary')} AS passes FROM brief_parsed p JOIN brief_tokens t ON t.item_id = p.item_id AND t.split = p.split"
    assert made == [1] and got == told(sql.run(spark, "", want, given)) and {True, False} <= {r[-1] for r in got}


def test_countries_of_odd_texts(spark):
    texts = ["to GB", "GBX, ukulele", "great  Britain", "Great Britain. in india", "united states of america", None, "", "+44 20", "call 204-555-0167 in CA", "IN it NO", "\x01US\x02", "the NETHERLANDS-USA", "Straße in DE"]
    rows = [(i if i % 5 else None, "s", x) for i, x in enumerate(texts)] + [(1, "s", "uk or UK"), (1, "s", "FR")]
    given = {"odd": spark.createDataFrame(rows, "item_id long, split string, text string")}
    keys = ["split", "item_id"]
    got, want = (told(sql.run(spark, "", f(source, keys), given)) for f, source in ((t.country_hits, "odd"), (t.country_evidence, "odd")))
    assert got == want and len(got) > 8


def test_looked_up_words_equal_the_twins(spark):
    words = [None, "", " uk ", "USA", "Canada\n", "xx", "May", "sept", "SEPTEMBER", "juno", "low", " LOW", "a|b", "Σας"]
    df = {"words": spark.createDataFrame([(w, a) for w in words for a in (None, "", "low|medium", "Low|low|ΣΑΣ")], "w string, a string")}
    for text in (m.country_code("w"), m.month_number("w"), m.allowed_value("w", "a")):
        assert "/*<*/" in text
        other = theirs(text).replace("list_extract(list_filter(string_split_regex(", "try_element_at(filter(split(").replace("lambda a:", "a ->")
        assert told(sql.run(spark, "", f"SELECT w, a, {text} AS x FROM words", df)) == told(sql.run(spark, "", f"SELECT w, a, {other} AS x FROM words", df))


def test_similarities_of_pairs_are_kept():
    assert {"pair_similarity", "country_hits"} <= set(sql.KEPT)


def test_pairs_are_compared_on_all_cores(spark):
    pairs = [(i, "test", i % 2 == 0, *(f"{side}{i} {f}" for f in similarity.WEIGHTS for side in "ab")) for i in range(40)]
    columns = ", ".join(f"{side}_{f} string" for f in similarity.WEIGHTS for side in "lr")
    given = {"match_pairs": spark.createDataFrame(pairs, f"item_id long, split string, gold_match boolean, {columns}").coalesce(1)}
    files = {r[0] for r in sql.run(spark, "", "SELECT input_file_name() FROM pair_similarity", given).distinct().collect()}
    want = sql.run(spark, "", similarity.scored("match_pairs", ["item_id", "split", "gold_match"]), given)
    assert len(files) > 4 and told(sql.run(spark, "", "SELECT * FROM pair_similarity", given)) == told(want)


def test_trims_and_words_ends_without_slow_patterns(spark):
    words = [None, "", " \t\v", "a", "\f a\n b\r\n", " a ", "a  ", " \x85 é \x85", "a  "]
    df = {"words": spark.createDataFrame([(w,) for w in words], "w string")}
    assert "/*<*/btrim(" in m.trimmed("w") and told(sql.run(spark, "", f"SELECT w, {m.trimmed('w')} AS x FROM words", df)) == sorted(((w, w and w.strip(m.WS)) for w in words), key=repr)
    texts = {"texts": spark.createDataFrame([(s,) for s in [*SAID, "3/4 5/6 7/8", "é3/4é _3/4", "x-2024-01-02 2024-01-023", " April 3\u0085", "3rd  May4 3 Mayé", "2k 3.5K, 4kg 5k"]], "w string")}
    for text in (m.day_then_month("w"), m.month_then_day("w"), m.slash_days("w"), m.iso_days("w"), t.thousands_in("w")):
        ours = re.sub(r"/\*\|.*?>\*/", "", text, flags=re.S)
        assert m.OTHER not in ours and told(sql.run(spark, "", f"SELECT w, {text} AS x FROM texts", texts)) == told(sql.run(spark, "", f"SELECT w, {theirs(text)} AS x FROM texts", texts))
    assert m.OTHER not in t.country_hits("texts", ["w"])
