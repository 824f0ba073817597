"""Known values of the text expressions and speech helpers."""

import pytest
from pyspark.sql import functions as F

from quire.functions import speech
from quire.functions import text as T
from quire.functions.answers import first_json, parse_answer, string_list


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_plain_text_and_words(spark):
    got = values(spark, T.plain_text("t"), ["<p>a \x1c b</p>\n", "&lt;b&gt; &hellip;&nbsp;x", None, ""])
    assert got == ["a b", "<b> … x", None, ""]
    assert values(spark, T.word_count("t"), [" a b\x1dc ", "", None]) == [3, 0, 0]
    assert values(spark, T.has_letter("t"), ["12_", "²", "é", "", None]) == [False, True, True, False, False]


def test_speech_text_and_preparation(spark):
    markup = 'See<br n="1"/>it<sup n="2">1</sup> <a n="3">[*]</a><a n="4">here</a> https://www.example.com/a/b?c and x.co'
    assert values(spark, T.speech_text("t"), [markup]) == ["See it here example.com and x.co"]
    rows = [("4 Babanevelés", True), ("4.5. Babanevelés", True), ("4 Babanevelés", False), ("4.5. Babanevelés", False), ("3. fejezet", True), ("lásd (p. 350) és (350. o.) meg (pp. 76–77) ___", False)]
    assert values(spark, T.prepare("t", "h"), rows, "t string, h boolean") == ["Babanevelés", "Babanevelés", "4 Babanevelés", "Babanevelés", "3. fejezet", "lásd és meg "]


def test_marks_and_numbers(spark):
    assert values(spark, T.ends_sentence("t"), ["a.", 'a!”)', "a", "a.\n", "a. b"]) == [True, True, False, True, False]
    assert values(spark, T.needs_spelling("t"), ["a 1", "II. rész", "V. Károly", "M. úr", "CD"]) == [True, True, True, False, False]
    assert values(spark, T.piece_key("t"), ["abc"]) == ["a9993e364706816a"]
    assert values(spark, T.piece_seed("t", 2), ["abc"]) == [0xA9993E36 + 2]
    assert values(spark, T.frame_cap("n"), [1000, 10], "n int") == [3000, 400]


def test_names_and_escapes(spark):
    assert values(spark, T.slug("t", "book"), ["A  Bőrönd!", "--", "x"]) == ["a-b-r-nd", "book", "x"]
    assert values(spark, T.output_name("t"), ["a/b c.xhtml", "d.e/f", "é.x"]) == ["a_b_c", "d.e_f", "é"]
    assert values(spark, T.metadata_escape("t"), ["a=b;c#d\\e\nf"]) == ["a\\=b\\;c\\#d\\\\e\\\nf"]
    assert values(spark, T.quote_path("t"), ["it's"]) == ["'it'\\''s'"]
    assert values(spark, T.escape_bare_ampersands("t"), ["a & b &amp; &#1; &x;"]) == ["a &amp; b &amp; &#1; &amp;x;"]
    assert values(spark, F.array_sort(T.semantics("t", "u")), [("a doc-b", "doc-a c"), (None, None)], "t string, u string") == [["a", "b", "c", "doc-a", "doc-b"], []]
    assert [tuple(r) for r in spark.createDataFrame([("a:b:c",), ("a",)], "t string").select(*T.provider_spec("t")).collect()] == [("a", "b:c"), ("a", "")]
    assert values(spark, T.is_quota_error("t"), ["Rate limit reached", "oops", None]) == [True, False, False]
    assert values(spark, T.is_noise("t"), ["Warning: x", "Fetching 3 files", "done"]) == [True, True, False]


def test_numbers_in_words_and_similarity(spark):
    assert [speech.number_words(n) for n in (0, 25, 102, 200, 1970, 2018, 1_000_000)] == ["nulla", "huszonöt", "százkettő", "kétszáz", "ezerkilencszázhetven", "kétezer-tizennyolc", "egymillió"]
    assert values(spark, speech.normalize_spoken("t"), ["4.5. Óra!", None]) == ["négy öt óra", None]
    rows = [("x" * 23, "x" * 17), ("", "!"), ("a", None), ("25 éves", "huszonöt éves")]
    assert values(spark, speech.similarity("t", "u"), rows, "t string, u string") == [0.85, 1.0, None, 1.0]


def test_answers(spark):
    answer = 'Sure: <seg id="1">a &nbsp;&bogus; & <b n="1">c</b></seg>\n<seg id="2"/><seg id="3"></seg> bye'
    rows = [answer, "none", '<seg id="1">x</seg><seg id="1">y</seg>', "<seg>x</seg>", '<seg id="1"><b>x</seg>', None]
    got = values(spark, parse_answer("t"), rows)
    assert [(s.id, s.markup, s.signature) for s in got[0].segments] == [("1", 'a &#160;&amp;bogus; &amp; <b n="1">c</b>', ["1 b"]), ("2", "", []), ("3", "", [])]
    assert all(g.segments is None and g.error for g in got[1:])
    assert first_json('x {"a": [1]} {"b": 2}', "{") == {"a": [1]}
    assert string_list('["a", "b"] x', 2) == ["a", "b"]
    for bad in ("[4]", '["a"]', "none", "[1", '{"a": 1}'):
        with pytest.raises(ValueError):
            string_list(bad, 2)


def test_glossaries_as_yaml(spark):
    pytest.importorskip("yaml")
    from quire.functions.answers import yaml_text

    assert values(spark, yaml_text("t"), ['{"b": ["é"], "a": 1}', None]) == ["b:\n- é\na: 1\n", None]


def test_functions_in_sql(spark):
    from quire.functions import register_sql

    assert "quire_similarity" in register_sql(spark)
    row = spark.sql("""SELECT quire_similarity('a b', 'a b') AS s, quire_unescape_html('&eacute;') AS u, quire_split_long('x y') AS p, quire_normalize_spoken('2 Almák') AS n,
        quire_tag_signature('<b n="1"/>') AS t, quire_json_value('x [1, 2] y', '[') AS j, quire_parse_answer('<seg id="1">x</seg>').segments[0].markup AS a""").first()
    assert tuple(row) == (1.0, "é", ["x y"], "kettő almák", ["1 b"], "[1, 2]", "x")


def test_matching_blocks_as_by_trying_all():
    import difflib
    import random

    from quire.functions import matching

    rng = random.Random(5)
    for size in (0, 1, 5, 40, 300):
        for letters in ("a", "ab", "abcdefgh "):
            for _ in range(12):
                a = "".join(rng.choice(letters) for _ in range(rng.randrange(size + 1)))
                b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(size + 1))]
                for _ in range(rng.randrange(6)):
                    b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
                b = "".join(b)
                blocks = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
                best = blocks.find_longest_match()
                assert matching.longest_block(a, b) == (best.size, best.a if best.size else 0, best.b if best.size else 0)
                assert matching.matching_characters(a, b) == sum(x.size for x in blocks.get_matching_blocks())


def test_long_texts_are_compared_in_seconds():
    import random
    import time

    from quire.functions.speech import matching_ratio

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    a = [rng.choice(words) for _ in range(17000)]
    b = [w if rng.random() > 0.02 else rng.choice(words) for w in a]
    began = time.perf_counter()
    assert len(" ".join(a)) > 90_000 and matching_ratio(" ".join(a), " ".join(b)) > 0.95
    assert time.perf_counter() - began < 60
