"""The rules of answers give what they gave before their texts were shortened and their matches put together."""

import random

import pytest
from pyspark.sql import functions as F

from rewardmill.functions import answers as an


def counted_body(tail):
    """Body of the brace group that opens a text, by counting."""
    rest = tail.lstrip()
    depth = 0
    for n, c in enumerate(rest):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if depth <= 0:
            return rest[1:n] if n else None
    return None


def boxed(text):
    bodies = [(counted_body(t) or "").strip(" ") for t in text.split(r"\boxed")[1:]]
    return next((b for b in reversed(bodies) if b), None)


def test_boxes_over_random_braces(spark):
    """Closed, empty and cut-off groups in any order, at few levels and around the number that one pattern reads."""
    r = random.Random(4)
    texts = ["".join(r.choice([r"\boxed{", "{", "}", "}", "a", " ", r"\frac{", "\n{"]) for _ in range(r.randrange(1, 14))) for _ in range(600)]
    for levels in (an._LEVELS - 1, an._LEVELS, an._LEVELS + 1, an._LEVELS + 9):
        texts += [r"\boxed" + gap + "{" * levels + "x" + "}" * closed + " y" for closed in (levels - 1, levels) for gap in ("", " ", "\n")]
        texts += [r"\boxed{7} \boxed{" + "{a}" * levels + end for end in ("", "}", "{")]
    df = spark.createDataFrame([(t, boxed(t)) for t in texts], "t string, expected string")
    got = df.select("t", "expected", an.last_boxed(F.col("t")).alias("x")).collect()
    assert [tuple(g) for g in got if g.x != g.expected] == []


@pytest.mark.parametrize("pieces", [["answer", " Final Answer is ", "final ", " is", "$", "$1$", "\\$", "\\(2\\)", ". ", "\n\n", "é", "İ", "ANSWER", " so" * 9]])
def test_shortened_texts_keep_their_answer(spark, pieces):
    """What stands before the first mark counts by its last answer word alone: against the tokens of the whole text."""
    r = random.Random(5)
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 10))) for _ in range(1500)]

    def by_tokens(text):
        rank, seen, over, loose, final = 0, False, False, None, None
        for token in text:
            word, stop = token.lower() in ("answer", "final answer is"), token[0] in ".!?\n"
            counts = not word and not stop and len(token) > 2 and rank > 0 and not over
            if word:
                rank, seen, over = (2 if len(token) > 6 else 1), False, False
                continue
            seen, over = seen or counts, over or (stop and (seen or counts))
            loose = token if counts else loose
            final = token if counts and rank == 2 else final
        return final or loose

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tokens = F.regexp_extract_all("t", F.lit(an.ANSWER_TOKENS), F.lit(0))
    got = df.select("t", tokens.alias("tokens"), an.anchored_span(F.col("t")).alias("x"), an.last_span(F.col("t")).alias("last"), an.latex_gold(F.col("t")).alias("gold")).collect()
    body = lambda span: None if span is None else (span[2:-2] if span[0] == "\\" or span[:2] == "$$" else span[1:-1]).strip(" ") or None
    assert [tuple(g) for g in got if g.x != body(by_tokens(g.tokens))] == []
    assert [tuple(g) for g in got if g.gold != (g.x if g.x is not None else g.last)] == []


def test_every_rewrite_rule_is_announced(spark):
    """A text that any rule changes is one in which the pattern of all rules, and that of its own group, is found."""
    r = random.Random(6)
    pieces = ["{,}", "\\$", "\\left", "\\quad", "\\,", "~", "\\%", "%", "^{\\circ}", "°", " ", "\\dfrac{1}{2}", "\\frac12", "\\frac{1}2", "\\sqrt3", "\\text{m}", "\\mathrm{x}", "\\mbox{a}",
              "\\textbf{b}", "x=", "x\\in[", "\\pm", ".", "(A)", "1", "12", "\\pi", "\\sqrt{2}", ",000", "\\lambda", "}", "{"]
    texts = [*pieces, *("".join(r.choice(pieces) for _ in range(r.randrange(1, 4))) for _ in range(1500))]
    whole = F.col("t")
    for pattern, replacement in an._REWRITES:
        whole = F.regexp_replace(whole, pattern, replacement)
    whole = F.when(F.rlike(whole, F.lit(an._GROUPED_DIGITS)), F.replace(whole, F.lit(","), F.lit(""))).otherwise(whole)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.filter(F.regexp_extract("t", an._PLAIN, 1) == "").select("t", whole.alias("whole"), an.normalise(F.col("t")).alias("x")).collect()
    assert [tuple(g) for g in got if g.x != g.whole] == []


def test_numbers_by_one_match(spark):
    """Signs, missing parts, broken forms, and the character that separates the groups of a match."""
    rows = [("2\\pi", 6.283185), ("-\\sqrt{4}", -2.0), ("+3\\times\\sqrt{4}\\pi", 18.849556), ("\\pi\n", 3.141593), ("-", None), ("\\times", None), ("", None), ("2\\pi\x01", None),
            ("\x01\\frac{1}{2}", None), ("3\\frac{1}{2}", 3.5), ("-\\frac{\\sqrt{4}}{2}\\pi", -3.141593), ("\\frac{1}{2}\\cdot4", 2.0), ("\\frac{}{2}", 0.5),
            ("\\frac{1}{2}3", None), ("2\\times10^{-3}", 0.002), ("-2^3", -8.0), ("2^{\x01}", None)]
    got = spark.createDataFrame(rows, "t string, expected double").select("t", "expected", F.round(an.number_of(F.col("t")), 6).alias("x")).collect()
    assert [tuple(g) for g in got if g.x != g.expected] == []


def test_usual_texts_take_no_counting(spark):
    """Nested and cut-off groups do not reach the counting of braces, and a far answer word leaves a short text for the tokens."""
    df = spark.range(1).select(an._brace_body(F.lit("{a{b{c}}} {")).alias("x"))
    assert df.head().x == "a{b{c}}"
    deep = an._brace_body(F.col("t"))
    shown = spark.createDataFrame([("x",)], "t string").select(deep)._jdf.queryExecution().analyzed().toString()
    assert f"> {an._LEVELS}" in shown
