import math
import re

import pytest
from ferrule.functions import text as fn
from ferrule.functions import vectors as vec
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def values(spark, rows, column, name="x", ddl="x string"):
    df = spark.createDataFrame([(r,) for r in rows], ddl)
    return [r[0] for r in df.select(column(F.col(name))).collect()]


def plain_chunks(text, size=1200, overlap=120):
    out = []
    for s in range(0, len(text), size - overlap):
        if piece := text[s : s + size].strip():
            out.append((len(out), s, min(s + size, len(text)), piece))
    return out


TEXTS = ["", "  \n", "a" * 1200, "a" * 1201, "b" * 1080 + " " * 1300 + "c" * 50, " edge ", None]


def test_chunks(spark):
    got = values(spark, TEXTS, fn.chunks)
    assert [[tuple(c) for c in x] for x in got] == [plain_chunks(t or "") for t in TEXTS]


def test_chunks_validates():
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            fn.chunks(None, *bad)


def test_sentences_and_windows(spark):
    got = values(spark, ["One. Two!  Three?\n\n\nFour", "", None, "No end"], fn.sentences)
    assert got == [["One.", "Two!", "Three?", "Four"], [], [], ["No end"]]
    windows = values(spark, ["a. b. c. d. e.", "a. b.", ""], lambda c: fn.sentence_windows(fn.sentences(c)))
    assert windows == [["a. b. c.", "c. d. e."], ["a. b."], []]


def test_token_windows_has_tail(spark):
    got = values(spark, ["a b c d e f g", "a b", ""], lambda c: fn.token_windows(c, 4))
    assert got == [["a b c d", "c d e f", "d e f g"], ["a b"], []]


def test_norm_key_keeps_letters(spark):
    assert values(spark, [" Außerhalb  der-Zeit! ", "few-shot"], fn.norm_key) == ["außerhalb derzeit", "fewshot"]


def test_masks(spark):
    text = "# One\n## Two\n  ### Three\n#### Four\n#tight\n```py\n---\nplain # no"
    assert values(spark, [text], fn.mask_headings) == ["[H1] One\n[H2] Two\n  [H3] Three\n#### Four\n#tight\n```py\n---\nplain # no"]
    assert values(spark, [text], fn.mask_structure) == ["[H1] One\n[H2] Two\n  [H3] Three\n[H4] Four\n[H1] tight\n[CODE_FENCE] py\n[RULE]\nplain # no"]
    assert values(spark, ["### a\n#b"], fn.mask_headings_tight) == ["[H3] a\n[H1] b"]


def test_small_text_functions(spark):
    assert values(spark, ['a<b>&"c"', None], fn.escape_attr) == ["a&lt;b&gt;&amp;&quot;c&quot;", ""]
    assert values(spark, [0.5, 1.0, 0.123456789], fn.format_score, ddl="x double") == ["0.5", "1", "0.12345679"]
    assert values(spark, ["Hello  World!", "", "..."], fn.safe_title) == ["Hello-World", "Untitled", "Untitled"]
    assert values(spark, ["a, B\nb,, A ,c"], fn.split_keywords) == [["a", "B", "c"]]
    assert values(spark, ['{"a":1}', 'x {"a":{"b":2}} y', "none", "{broken", None], fn.json_object) == ['{"a":1}', '{"a":{"b":2}}', "{}", "{}", "{}"]
    assert values(spark, ["q", " qa ", "zz", None], fn.clean_mode) == ["Q", "QA", "QA", "QA"]
    assert values(spark, ["ok", "a/b", "..", " "], fn.valid_project_name, ddl="x string") == [True, False, False, False]


def test_enums(spark):
    assert values(spark, ["b", "z", None], lambda c: fn.normalise_one(c, ["a", "b"], "b")) == ["b", "b", "b"]
    assert values(spark, ["z"], lambda c: fn.normalise_one(c, ["a", "b"], "q")) == ["a"]
    got = values(spark, [["b", "z", "b", "a"], ["z"], None], lambda c: fn.normalise_many(c, ["a", "b", "c"], 1, ["c"]), ddl="x array<string>")
    assert got == [["b"], ["c"], ["c"]]


def test_recency(spark):
    rows = [None, float("nan"), float("inf"), -3.0, 0.0, 10.0]
    assert values(spark, rows, vec.recency, ddl="x double") == [1.0, 1.0, 1.0, 1.0, 1.0, 0.5]
    assert values(spark, [10.0], lambda c: vec.recency(c, -1), ddl="x double") == [0.5]


def test_distance_score(spark):
    assert values(spark, [None, float("nan"), float("inf"), -1.0, 0.0, 3.0], vec.distance_score, ddl="x double") == [0.0, 0.0, 0.0, 1.0, 1.0, 0.25]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_power_mean(spark):
    got = values(spark, [[-1.0, -2.0], [0.5], [0.3, -0.9], []], vec.array_power_mean, ddl="x array<double>")
    assert got == pytest.approx([0.0, 0.5, (0.3**10 / 2) ** 0.1, 0.0])


def test_top_mean(spark):
    got = values(spark, [[1.0, 2.0], [float(i) for i in range(10)], [float(i) for i in range(30)], []], vec.top_mean, ddl="x array<double>")
    assert got == [1.5, 7.5, 26.5, 0.0]


def test_qa_budget_rounds_half_even(spark):
    df = spark.createDataFrame([(1, 3), (3, 1), (0, 5), (1, 10_000)], "q int, a int")
    q, a = vec.qa_budget(F.col("q"), F.col("a"), 10, 6)
    assert [tuple(r) for r in df.select(q, a).collect()] == [(2, 8), (6, 4), (0, 10), (6, 4)]


def test_weights():
    assert vec.norm_weights(3, 1) == (0.75, 0.25) and vec.norm_weights(-1, 0) == (1.0, 0.0)


def test_mode_weighted(spark):
    df = spark.createDataFrame([("QA", 1.0, 1.0, 1.0), ("A", 1.0, 9.0, 0.0), ("Q", 9.0, 1.0, None), ("?", 1.0, 0.0, 0.0)], "m string, a double, q double, x double")
    got = [r[0] for r in df.select(vec.mode_weighted(F.col("m"), F.col("a"), F.col("q"), F.col("x"))).collect()]
    assert got == pytest.approx([1.0, 0.85, 0.85, 0.55])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.!? \n", max_size=40), min_size=1, max_size=8))
def test_sentences_like_python(spark, texts):
    plain = [[p for s in re.split(r"(?<=[.!?])\s+|\n+", re.sub(r"\n{2,}", "\n", t)) if (p := s.strip())] for t in texts]
    assert values(spark, texts, fn.sentences) == plain


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=8))
def test_token_estimate(spark, sizes):
    assert values(spark, ["x" * n for n in sizes], fn.token_estimate) == [math.ceil(n / 4) for n in sizes]


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte of spaces, headings, words or items, each in a few seconds."""
    import time

    from ferrule.operators import reduce

    n = 1_000_000
    names = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26) + chr(97 + i // 17_576 % 26) for i in range(n // 6)]
    cases = [
        (fn.strip, "x" + " " * n + "y"),
        (fn.strip, " " * n + " y "),
        (fn.sentences, "a." + " " * n + "b"),
        (fn.mask_structure, "# a" + " " * n + "b"),
        (fn.mask_structure, "```" + " " * n + "b  \n" + " " * n),
        (fn.mask_headings, "# a" + " " * n + "b"),
        (fn.mask_headings, "# a \n" * (n // 5)),
        (fn.auto_keywords, " ".join(names)),
        (fn.split_keywords, ",".join(names)),
        (fn.json_object, "{" * n),
        (reduce.clean_chunk, "a: b\n" * (n // 5)),
    ]
    for f, text in cases:
        frame, began = spark.createDataFrame([(text,)], "c string"), time.time()
        frame.select(F.length(f(F.col("c")).cast("string"))).collect()
        assert time.time() - began < 15, f.__name__


def test_masks_of_odd_lines(spark):
    cases = ["# a  ", "#  ", "#", "#\t\tx \t", " \t## two  words \t ", "### x\u2028# y ", "#a", "####### seven", "```  py ", "``` ", "--- \t", "--", "# a\r\n\r# b", "# \x0b", "a # b"]
    structured = ["[H1] a", "[H1]", "[H1]", "[H1] x", "[H2] two  words", "[H3] x\u2028[H1] y", "[H1] a", "[H6] # seven", "[CODE_FENCE] py", "[CODE_FENCE]", "[RULE]", "--", "[H1] a\n\n[H1] b", "#", "a # b"]
    headed = ["[H1] a", "[H1]", "#", "#\t\tx", "[H2] two  words", "[H3] x\u2028[H1] y", "#a", "####### seven", "```  py", "```", "---", "--", "[H1] a\n\n[H1] b", "[H1]", "a # b"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", fn.mask_structure(F.col("c")), fn.mask_headings(F.col("c"))).orderBy("i").collect()
    assert [r[1] for r in rows] == structured
    assert [r[2] for r in rows] == headed
