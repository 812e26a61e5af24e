import pytest
from pyspark.sql import functions as F

from rewardmill.functions import answers as an


def one(spark, text, fn):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(fn(F.col("t")).alias("x")).head()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"so \boxed{42}", "42"),
        (r"first \boxed{1}, then \boxed{2}", "2"),
        (r"\boxed{\frac{1}{\sqrt{2}}} done", r"\frac{1}{\sqrt{2}}"),
        (r"\boxed{7} and a cut-off \boxed{\frac{1}{", "7"),
        (r"\boxed {5}", "5"),
        (r"\boxed{}", None),
        ("nothing here", None),
    ],
)
def test_last_boxed(spark, text, expected):
    assert one(spark, text, an.last_boxed) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The final answer is $5$. I hope it is correct", "5"),
        ("answer: \\(x+1\\)", "x+1"),
        ("value $3$ without a phrase", None),
        (r"Answer $4$ but \boxed{6}", "6"),
        ("the answer is \\[ 9 \\]", "9"),
    ],
)
def test_final_answer_must_be_anchored(spark, text, expected):
    assert one(spark, text, an.final_answer) == expected


@pytest.mark.parametrize(
    "text, any_form, latex_form",
    [
        ("$12$", "12", "12"),
        ("12", "12", None),
        ("it is 3 or -4.5", "-4.5", None),
        ("$$x=3$$", "x=3", "x=3"),
        ("", None, None),
        ("no number", None, None),
    ],
)
def test_gold(spark, text, any_form, latex_form):
    assert one(spark, text, lambda t: F.coalesce(an.latex_gold(t), an.plain_gold(t))) == any_form
    assert one(spark, text, an.latex_gold) == latex_form


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"x = 5", "5"),
        (r"1,234,567", "1234567"),
        (r"(1,234)", "(1,234)"),
        (r"\dfrac{1}{2}", r"\frac{1}{2}"),
        (r"\left( 1, 2 \right)", "(1,2)"),
        (r"5 \text{ cm}", "5"),
        (r"\text{east}", "east"),
        (r"50\%", "50"),
        (r"90^\circ", "90"),
        (r"3.", "3"),
        (r"\boxed{8}", "8"),
    ],
)
def test_normalise(spark, text, expected):
    assert one(spark, text, an.normalise) == expected


@pytest.mark.parametrize(
    "text, value",
    [
        ("3", 3.0),
        ("-.5", -0.5),
        (r"\frac{1}{4}", 0.25),
        (r"-\frac{1}{4}", -0.25),
        (r"\frac{-1}{4}", -0.25),
        ("3/8", 0.375),
        (r"2\sqrt{9}", 6.0),
        (r"\sqrt{4}", 2.0),
        (r"2\pi", 6.283185307179586),
        (r"1.5\times10^{3}", 1500.0),
        (r"\frac{1}{0}", None),
        ("x+1", None),
    ],
)
def test_number(spark, text, value):
    assert one(spark, text, an.number_of) == pytest.approx(value) if value is not None else one(
        spark, text, an.number_of
    ) is None


@pytest.mark.parametrize(
    "left, right, same",
    [
        (r"\frac{1}{2}", "0.5", True),
        ("1.0", "1", True),
        ("x+1", "1+x", False),
        ("east", "east", True),
        ("", "", False),
        (None, "1", None),
        ("(1,2)", "(1.0,2)", True),
        ("(1,2)", "(2,1)", False),
        (r"\{1,2\}", r"\{2,1.0\}", True),
        ("(1,2)", "[1,2]", False),
        ("1", "1.0000001", True),
    ],
)
def test_same_answer(spark, left, right, same):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert df.select(an.same_answer(F.col("l"), F.col("r")).alias("x")).head()["x"] is same


def test_long_body_and_many_boxes_do_not_overflow(spark):
    body = "{a}" * 20000
    text = "\\boxed{" + body + "} " * 1 + "\\boxed{" + "x" * 100000
    assert one(spark, text, an.last_boxed) == body


def test_choice_letter(spark):
    assert one(spark, "Answer: A, no, Answer: $C", an.choice_letter) == "C"
    assert one(spark, "Answer: E", an.choice_letter) is None


def nested(depth):
    return r"\sqrt{1+" * depth + "2" + "}" * depth


@pytest.mark.parametrize("depth", [0, 1, 3, 6, 20])
def test_boxed_at_any_depth(spark, depth):
    assert one(spark, r"so \boxed{" + nested(depth) + "} and on", an.last_boxed) == nested(depth)
    assert one(spark, r"\boxed{" + nested(depth) + r"} then cut off \boxed{\frac{" + nested(depth), an.last_boxed) == nested(depth)


@pytest.mark.parametrize("distance", [5, 60, 500])
def test_answer_word_far_from_its_span(spark, distance):
    assert one(spark, "The answer" + " so" * distance + " $42$", an.final_answer) == "42"


def test_unreadable_box_gives_no_gold(spark):
    text = r"with 1 and $2$ we get \boxed{\frac{3}{"
    assert one(spark, text, an.latex_gold) is None and one(spark, text, an.plain_gold) is None


@pytest.mark.parametrize(
    "left, right, expected",
    [
        (r"\frac12", "0.5", True),
        (r"\sqrt2", r"\sqrt{2}", True),
        ("2^{3}", "8", True),
        ("2^3", "8", True),
        ("10^{-3}", "0.001", True),
        (r"\frac{\sqrt{3}}{2}", r"\frac{1}{2}\sqrt{3}", True),
        (r"\frac{\pi}{2}", "1.570796", True),
        (r"1\frac{1}{2}", "1.5", True),
        (r"-1\frac{1}{2}", "-1.5", True),
        (r"\frac{-1}{2}", "-0.5", True),
        (r"\dfrac{2\sqrt{3}}{4}", r"\frac{\sqrt3}2", True),
        (r"2\pi\sqrt{2}", "8.9", False),
        (r"3\times10^{2}", "300", True),
        (r"\frac{1}{0}", "1", False),
        ("10000000000000000", "10000000000000001", False),
        ("10000000000000000", "+0010000000000000000.0", True),
        ("0.1234561", "0.1234562", True),
        ("12345678901234567890.5", "12345678901234567890.25", False),
        ("-0", "0", True),
    ],
)
def test_answer_forms(spark, left, right, expected):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    same = an.same_answer(an.normalise(F.col("l")), an.normalise(F.col("r")))
    assert df.select(same.alias("x")).head()["x"] is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"The answer, since \frac12 is small, is $42$", "42"),
        (r"The answer, substituting $x=3$, is $42$", "42"),
        (r"The answer costs \$5 so it is $42$", "42"),
        (r"The answer is $42$. Check: $6\cdot7=42$.", "42"),
        ("The answer is $42$.\n\nWith $x=1$ the answer holds.", "42"),
        (r"Answer \(1\), no: the final answer is: \[ 7 \] as the answer $8$ was wrong", "7"),
        (r"an $answer$ and $5$", None),
        (r"answer \$5 and \$6", None),
        (r"The answer follows. It is $\$5$", r"\$5"),
        ("the answer " + r"\alpha $b$, " * 300 + "so $9$", "9"),
    ],
)
def test_spans_behind_answer_words(spark, text, expected):
    assert one(spark, text, an.anchored_span) == expected


FORMS = [
    ("1{,}000", "1000"), (r"\$18.90", "18.9"), (r"\text{(A)}", "A"), (r"\pm 2", r"\{-2,2\}"), (r"x\in\{1,2\}", r"\{2,1\}"), ("1e3", "1000"),
    (r"1+\sqrt{2}", r"\sqrt{2}+1"), (r"3\pi/2", r"\frac{3\pi}{2}"), (r"\sqrt[3]{8}", "2"), (r"2\sqrt[3]{27}", "6"), (r"-\sqrt[3]{8}", "-2"),
    (r"\frac{12345678901234567890}{1}", "12345678901234567890"), (r"\frac{2}{4}", r"\frac{1}{2}"), (r"\frac{-1}{2}", r"\frac{1}{-2}"), ("6/4", r"\frac{3}{2}"),
    (r"\sqrt{2}-1", r"-1+\sqrt{2}"), (r"2\pi+\frac{1}{2}", r"\frac{1}{2}+2\pi"), ("1.5e-3", "0.0015"), (r"x \in (1,2]", "(1,2]"), (r"2{,}500{,}000", "2500000"),
]
DIFFERENT = [
    (r"\frac{12345678901234567891}{1}", "12345678901234567890"), (r"1+\sqrt{2}", r"1-\sqrt{2}"), (r"3\pi/2", r"2\pi/3"), (r"\sqrt[3]{8}", "3"),
    (r"\pm 2", r"\{2\}"), ("1e3", "1e4"), (r"\frac{1}{3}", r"\frac{33333333333333333}{99999999999999998}"), (r"\text{(A)}", "B"), ("x+y", "y+z"),
]


def test_golden_forms(spark):
    """Each value in two writings, over several numbers, joined by key; other values are not equal."""
    rows = [(l, r, True) for l, r in FORMS] + [(l, r, False) for l, r in DIFFERENT]
    for n in range(2, 18):
        for l, r in [
            (rf"\frac{{{n}}}{{{n + 1}}}", f"{n}/{n + 1}"), (rf"\frac{n % 9 + 1}{n % 7 + 2}", rf"\dfrac{{{n % 9 + 1}}}{{{n % 7 + 2}}}"), (f"{n}e2", f"{n}00"),
            (rf"{n}+\sqrt{{{n}}}", rf"\sqrt{{{n}}}+{n}"), (rf"{n}\pi/4", rf"\frac{{{n}\pi}}{{4}}"), (rf"\sqrt[3]{{{n**3}}}", str(n)), (f"{n}{{,}}000", f"{n}000"),
            (rf"\${n}.50", f"{n}.5"), (rf"x\in\{{{n},1\}}", rf"\{{1,{n}\}}"), (rf"\pm{n}", rf"\{{{n},-{n}\}}"),
        ]:
            rows += [(l, r, True), (l, r.replace(str(n), str(n + 3), 1) + ("1" if str(n) not in r else ""), None)]
    keyed = [(i, l, r, e) for i, (l, r, e) in enumerate(rows)]
    df = spark.createDataFrame(keyed, "i int, l string, r string, expected boolean")
    normal = df.select("i", "l", "r", "expected", an.normalise(F.col("l")).alias("nl"), an.normalise(F.col("r")).alias("nr"))
    got = normal.select("i", "l", "r", "nl", "nr", "expected", an.same_answer(F.col("nl"), F.col("nr")).alias("x")).collect()
    assert [tuple(g) for g in got if g.expected is not None and g.x is not g.expected] == []
    assert [tuple(g) for g in got if g.expected is None and g.x] == []
    assert len(rows) >= 200


SHORT_PAIRS = [
    ("7", r"\frac{14}{2}", True), ("-7", r"-\frac{14}{2}", True), ("7", r"-\frac{14}{2}", False), (r"\frac{1}{3}", r"\frac{2}{6}", True), ("0", r"-\frac{0}{5}", True),
    (r"\frac{1}{0}", r"\frac{1}{0}0", False), (r"\frac{1}{0}", r"\frac{2}{0}", False), (r"\frac{999999999}{1}", r"\frac{999999998}{1}", False), ("5", "5.0", True), ("5", "5.0000001", True),
    ("5", "5.000001", False), ("-0.5", "-.5", True), ("-0", "0.0", True), ("0.1234564", "0.1234560", True), ("007", "7", True), ("123456789012345678", "123456789012345678.0", True),
    ("123456789012345678", "123456789012345679.0", False), (r"\frac{1}{2}", "0.5", True), ("1234567890123", r"\frac{2469135780246}{2}", True),
]


def test_short_numbers_as_by_the_full_rules(spark):
    df = spark.createDataFrame([(i, l, r, e) for i, (l, r, e) in enumerate(SHORT_PAIRS)], "i int, l string, r string, expected boolean")
    full = F.coalesce(an._same_numbers(F.col("l"), F.col("r"), 6), F.lit(False))
    got = df.select("*", an.same_answer(F.col("l"), F.col("r")).alias("x"), an.same_answer(F.col("r"), F.col("l")).alias("y"), full.alias("full")).collect()
    assert [tuple(g) for g in got if not g.x == g.y == g.expected or g.full != g.expected] == []


ANCHORED = [
    ("İ. so the answer is $3$.", "3"), ("A final. Answer: \\(x\\) is $4$. Next $5$.", "4"), ("x. FINAL ANSWER IS $6$, the answer $7$", "6"), ("$2$ before the answer $8$", "8"),
    ("cost \\$5, answer $9$", "9"), ("answer 10", None), ("only $1$", None), (None, None), ("final answer is: \\[ 11 \\]", "11"), ("..... answer\n\n$12$", "12"),
]


def test_answer_word_found_by_place(spark):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(ANCHORED)], "i int, t string, expected string")
    got = df.select("*", an.anchored_span(F.col("t")).alias("x")).collect()
    assert [tuple(g) for g in got if g.x != g.expected] == []
