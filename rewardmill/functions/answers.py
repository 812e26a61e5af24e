"""Answer extraction, normalisation and comparison as column expressions.

What is covered: boxed answers, LaTeX environments, plain numbers; integers,
decimals, fractions, roots, multiples of pi, powers of ten, tuples and sets of
those; text answers by normalised equality. Symbolic identities (``x+1`` against
``1+x``) are not decided here: such pairs count as not equal unless the caller
passes a checker of their own (see ``operators.scoring``).

When several candidates are present the rightmost one is used, so the last
boxed answer of a long derivation is the one that counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardmill.functions.text import let


BOX_MARK = r"\boxed"
# A brace group after the marker whose body holds at most so many inner levels. No way is tried twice.
_LEVELS = 32


def _body(levels: int) -> str:
    return r"(?:[^{}]++|\{" + _body(levels - 1) + r"\})*+" if levels else r"[^{}]*+"


_GROUP_BODY = rf"^\s*\{{({_body(_LEVELS)})\}}"
_BRACE_PIECES = r"[{}]|[^{}]+"

# The first look at a character rules out most of them before the branches are tried.
LATEX_SPAN = (
    r"(?=[$\\])(?:(?<!\\)\$\$(?:[^$\\]|\\.)++\$\$|(?<!\\)\$(?:[^$\\]|\\.)++\$"
    r"|\\\[(?:[^\\]|\\[^\]])*+\\\]"
    r"|\\\((?:[^\\]|\\[^)])*+\\\))"
)
# An escaped dollar before the closing mark belongs to the body.
SPAN_MARKS = r"^(?:\$\$|\$|\\\[|\\\()|(?:(?<!\\)\$\$|\$|\\\]|\\\))$"
# A text's answer words, spans and ends of sentences in order. Inside a span, and behind a backslash, nothing else counts.
ANSWER_TOKENS = r"(?is)(?=[$\\fa.!?\n])(?:" + LATEX_SPAN + r"|\\.|final answer is|answer|[.!?](?=\s)|\n\s*\n)"
# A text whose only formula stands behind an answer word, and nothing else in it is marked.
ONE_SPAN = r"(?is)^[^$\\]*answer[^$\\]*\$([^$\\]*(?:\\.[^$\\]*)*)\$[^$\\]*\z"
# A text with one formula between dollars, whatever stands around it, and nothing marked outside of it.
ONLY_SPAN = r"^[^$\\]*\$((?:[^$\\]|\\.)++)\$[^$\\]*\z"
PLAIN_NUMBER = r"[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*/\s*\d+)?"

NUMBER = r"(?:\d+\.?\d*|\.\d+)"


def _last(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(-1))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _non_empty(text: Column) -> Column:
    return let(F.trim(text), lambda trimmed: F.nullif(trimmed, F.lit("")))


def _brace_body(tail: Column) -> Column:
    """Body of the brace group that opens a text, at any depth; NULL when it does not close.

    Groups of at most ``_LEVELS`` inner levels are found by one pattern. Only where there are braces
    enough for more are they counted over the pieces between them.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("state"), F.array().cast("array<string>").alias("body"))

    def step(a: Column, piece: Column) -> Column:
        # state: 0 before the group, 1 inside, 2 closed, 3 no group here
        depth = a["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        state = (
            F.when(a["state"] >= 2, a["state"])
            .when(a["state"] == 0, F.when(piece == "{", 1).when(F.rlike(piece, F.lit(r"^\s*\z")), 0).otherwise(3))
            .otherwise(F.when(depth == 0, 2).otherwise(1))
        )
        inside = (a["state"] == 1) & (depth > 0)
        body = F.when(inside, F.concat(a["body"], F.array(piece))).otherwise(a["body"])
        return F.struct(depth.alias("depth"), state.alias("state"), body.alias("body"))

    counted = F.aggregate(
        _all(tail, _BRACE_PIECES), start, step, lambda a: F.when(a["state"] == 2, F.array_join(a["body"], ""))
    )
    deep = F.octet_length(tail) - F.octet_length(F.replace(tail, F.lit("{"), F.lit(""))) > _LEVELS
    return let(F.regexp_extract(tail, _GROUP_BODY, 1), lambda body: F.when(body != "", body).when(deep, counted))


def last_boxed(text: Column) -> Column:
    r"""Content of the rightmost ``\boxed{...}`` that closes, at any depth of braces.

    The tail behind the last marker is found by plain search; only if its brace
    group is broken (a cut-off completion) are the earlier markers looked at.
    """
    quick = _non_empty(_brace_body(F.substring_index(text, r"\boxed", -1)))
    tails = F.split(text, r"\\boxed")
    bodies = F.transform(F.slice(tails, F.lit(2), F.size(tails) - 2), lambda tail: _non_empty(_brace_body(tail)))
    earlier = _last(F.filter(bodies, lambda body: body.isNotNull()))
    return F.when(F.contains(text, F.lit(r"\boxed")), F.coalesce(quick, earlier))


def _span_body(span: Column) -> Column:
    return _non_empty(F.regexp_replace(span, SPAN_MARKS, ""))


def last_span(text: Column) -> Column:
    """Body of the rightmost LaTeX environment."""
    return _span_body(_last(_all(text, LATEX_SPAN)))


def anchored_span(text: Column) -> Column:
    """Body of the LaTeX environment that an answer phrase announces.

    The last answer word with an environment behind it counts, and of these the last one in the sentence
    that has the first: formulas on the way to the value do not end the search, remarks after it
    do not replace the value. "Final answer is" goes before other answer words. Texts with one
    formula are settled by one pattern, others by their tokens; of what stands before the first mark only the last
    answer word is kept, as nothing else there can change the result.
    """
    words = F.array(F.lit("answer"), F.lit("final answer is"))
    none = F.lit(None).cast("string")
    # rank: 0 before any answer word, 1 behind one, 2 behind a final one; open: whether a span would count.
    start = F.struct(F.lit(0).alias("rank"), F.lit(False).alias("seen"), F.lit(False).alias("over"), none.alias("loose"), none.alias("final"))

    def step(a: Column, token: Column) -> Column:
        word = F.array_contains(words, F.lower(token))
        # Spans have three characters or more, escaped ones two; blank lines begin with their line feed.
        stops = F.substring(token, 1, 1).isin(".", "!", "?", "\n")
        counts = ~word & ~stops & (F.length(token) > 2) & (a["rank"] > 0) & ~a["over"]
        return F.struct(
            F.when(word, F.when(F.length(token) > 6, 2).otherwise(1)).otherwise(a["rank"]).alias("rank"),
            F.when(word, F.lit(False)).otherwise(a["seen"] | counts).alias("seen"),
            F.when(word, F.lit(False)).otherwise(a["over"] | (stops & a["seen"])).alias("over"),
            F.when(counts, token).otherwise(a["loose"]).alias("loose"),
            F.when(counts & (a["rank"] == 2), token).otherwise(a["final"]).alias("final"),
        )

    def spanned(part: Column) -> Column:
        return F.contains(part, F.lit("$")) | F.contains(part, F.lit(r"\(")) | F.contains(part, F.lit(r"\["))

    def last_word(lower: Column) -> Column:
        final = F.lit("final answer is")
        is_final = F.contains(lower, final) & ~F.contains(F.substring_index(lower, "final answer is", -1), F.lit("answer"))
        return F.when(~F.contains(lower, F.lit("answer")), F.lit("")).when(is_final, final).otherwise(F.lit("answer"))

    def search(part: Column) -> Column:
        one = _non_empty(F.regexp_extract(part, ONE_SPAN, 1))
        found = F.aggregate(_all(part, ANSWER_TOKENS), start, step, lambda a: F.coalesce(a["final"], a["loose"]))
        return F.coalesce(one, let(found, _span_body))

    # Long texts are cut by their bytes: patterns and places in characters take several times as long.
    def shortened(before: Column) -> Column:
        rest = F.substr(text.cast("binary"), F.octet_length(before) + F.lit(1)).cast("string")
        return F.concat(let(F.lower(before), last_word), rest)

    def unmarked(before: Column) -> Column:
        return F.when(F.contains(before, F.lit("\\")), F.substring_index(before, "\\", 1)).otherwise(before)

    def worded(part: Column) -> Column:
        return F.when(F.rlike(part, F.lit("(?i)answer")), search(part))

    before = let(F.substring_index(text, "$", 1), unmarked)
    return F.when(spanned(text), let(let(before, shortened), worded))


def last_number(text: Column) -> Column:
    return _non_empty(_last(_all(text, PLAIN_NUMBER)))


def latex_gold(solution: Column) -> Column:
    """Gold answer when only LaTeX forms are allowed. A boxed answer that cannot be read leaves none.

    Where a text's only formula is found by one pattern, an answer word before it changes nothing.
    """
    only = F.regexp_extract(solution, ONLY_SPAN, 1)
    unboxed = F.coalesce(anchored_span(solution), last_span(solution))
    return (
        F.when(F.contains(solution, F.lit(BOX_MARK)), last_boxed(solution))
        .when(~F.contains(solution, F.lit("$")) & ~F.contains(solution, F.lit("\\")), F.lit(None).cast("string"))
        .when(only != "", F.nullif(F.trim(only), F.lit("")))
        .otherwise(unboxed)
    )


def plain_gold(solution: Column) -> Column:
    """Gold answer outside LaTeX: the last number of a solution without a boxed answer."""
    return F.when(~F.contains(solution, F.lit(BOX_MARK)), last_number(solution))


def final_answer(completion: Column) -> Column:
    """A completion's answer: boxed first, else a LaTeX span behind an answer phrase."""
    return F.coalesce(last_boxed(completion), anchored_span(completion))


def expression_prediction(completion: Column) -> Column:
    """A benchmark prediction: boxed, then any LaTeX, then the last plain number."""
    return F.coalesce(
        last_boxed(completion), anchored_span(completion), last_span(completion), last_number(completion)
    )


def expression_gold(answer: Column) -> Column:
    """A benchmark gold given as an expression: LaTeX marks are optional around it."""
    return F.coalesce(last_boxed(answer), last_span(answer), last_number(answer))


# Layout without meaning: spacing and sizing commands, dollar signs, percent, degrees, blanks.
_NOISE = (
    r"\\[$]|\\(?:left|right|displaystyle|quad|qquad)\b|\\[,;:!]|[$~]|\\?%|\^\{?\\circ\}?|\x{b0}|\s+"
)
# Ordered rewrite rules of ``normalise``: (pattern, replacement).
_REWRITES = (
    (r"\{,\}", ","),
    (_NOISE, ""),
    (r"\\[dtc]frac(?![a-z])", r"\\frac"),
    (r"\\(frac|sqrt)([0-9])", r"\\$1{$2}"),
    (r"(\\frac\{(?:[^{}]|\{[^{}]*\})*\})([0-9])", "$1{$2}"),
    (r"^\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}$", "$1"),
    (r"\\(?:text|mathrm|textbf|mbox)\{[^{}]*\}", ""),
    (r"^.*=", ""),
    (r"^.*\\in(?=\\\{|[(\[])", ""),
    (r"^\\pm(.+)$", r"\\{$1,-$1\\}"),
    (r"\.+$", ""),
    (r"^\(([A-Za-z])\)$", "$1"),
)
# Rules by place, and what a text holds in which one of them finds something; where none of these is found, the text stays as it is.
_RULES = (
    (slice(0, 2), r"\{,\}|[$~%\x{b0}\s]|\\(?:[lrdq,;:!$]|circ)"),
    (slice(2, 5), r"\\(?:[dtc]frac|(?:frac|sqrt)[0-9])|\}[0-9]"),
    (slice(5, 12), r"=|\\(?:text|mathrm|mbox|in|pm)|\.$|^\("),
)
_ANY_RULE = r"[$~%\x{b0}\s=]|\\(?:[lrdq,;:!$]|circ|text|mathrm|mbox|in|pm|[tc]frac|(?:frac|sqrt)[0-9])|\}[0-9]|\{,\}|\.$|^\("
# What the rewrite rules leave as it is, or with a letter's name before it.
_PLAIN = r"^(?:[A-Za-z]\s*=\s*)?([-+]?(?:\d+(?:\.\d+)?|\\frac\{\d+\}\{\d+\}))\z"
_GROUPED_DIGITS = r"^[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"


def normalise(answer: Column) -> Column:
    """Canonical text of an answer: wrappers, spacing, units and ``name =`` removed.

    The answer is named more than once: pass a column, not the expression that extracts it.
    """
    def rewritten(text: Column) -> Column:
        new = text
        for places, sign in _RULES:
            new = let(new, lambda t: F.when(F.rlike(t, F.lit(sign)), replaced(t, places)).otherwise(t))
        return let(F.when(F.rlike(text, F.lit(_ANY_RULE)), new).otherwise(text), ungrouped)

    def replaced(text: Column, places: slice) -> Column:
        for pattern, replacement in _REWRITES[places]:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    def ungrouped(text: Column) -> Column:
        grouped = F.contains(text, F.lit(",")) & F.rlike(text, F.lit(_GROUPED_DIGITS))
        return F.when(grouped, F.replace(text, F.lit(","), F.lit(""))).otherwise(text)

    def unboxed(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(BOX_MARK)), F.coalesce(last_boxed(text), text)).otherwise(text)

    def usual(plain: Column) -> Column:
        return F.when(plain != "", plain).otherwise(let(let(answer, unboxed), rewritten))

    return let(F.regexp_extract(answer, _PLAIN, 1), usual)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


# Stands between the groups of a match. Texts that hold it are no numbers.
_BETWEEN = "\x01"


def _groups(text: Column, pattern: str, count: int, read: Callable[[list[Column]], Column]) -> Column:
    """``read`` of all groups of a pattern for a whole text, found by one match; NULL where it does not match."""
    marked = F.regexp_replace(text, pattern + r"\R?", _BETWEEN.join(f"${n + 1}" for n in range(count)))

    def parted(found: Column) -> Column:
        fits = F.contains(found, F.lit(_BETWEEN)) & ~F.contains(text, F.lit(_BETWEEN))
        return F.when(fits, let(F.split(found, _BETWEEN), lambda parts: read([parts[n] for n in range(count)])))

    return let(marked, parted)


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def _signed(sign: Column, value: Column) -> Column:
    return F.when(sign == "-", -value).otherwise(value)


_DECIMAL = rf"^([-+]?)({NUMBER})$"
_RATIO = rf"^([-+]?)({NUMBER})/({NUMBER})$"
_TIMES = r"(?:\\times|\\cdot|\*)?"
# A product: coefficient, root, multiple of pi; each may be missing, not all.
_PRODUCT = rf"^(?=.)([-+]?)({NUMBER})?{_TIMES}(?:\\sqrt\{{({NUMBER})\}})?{_TIMES}(\\pi)?$"
# A power, with or without a factor before it.
_POWER = rf"^([-+]?)(?:({NUMBER})(?:\\times|\\cdot|\*))?({NUMBER})\^(?:\{{([-+]?{NUMBER})\}}|(\d))$"
# What may stand before and behind a fraction, and its two parts. A digit right behind it makes no product.
_QUOTIENT = r"^([-+]?)([^\\{}]*(?:\\sqrt\{[^{}]*\}|\\pi|\\times|\\cdot)*)\\frac\{((?:[^{}]|\{[^{}]*\})*)\}\{((?:[^{}]|\{[^{}]*\})*)\}(?![0-9.])(.*)$"
_WHOLE = r"^\d+$"


def _product(text: Column) -> Column:
    """Value of a coefficient times a root times pi; NULL for anything else."""

    def value(parts: list[Column]) -> Column:
        coefficient = F.coalesce(_double(parts[1]), F.lit(1.0))
        root = F.coalesce(F.sqrt(_double(parts[2])), F.lit(1.0))
        pi = F.when(parts[3] != "", F.lit(math.pi)).otherwise(F.lit(1.0))
        something = (parts[1] != "") | (parts[2] != "") | (parts[3] != "")
        return F.when(something, _signed(parts[0], coefficient * root * pi))

    return F.when(F.rlike(text, F.lit(_WHOLE)), text.try_cast("double")).otherwise(_groups(text, _PRODUCT, 4, value))


def _quotient(text: Column) -> Column:
    """Value of a fraction of products with products around it; a whole number before it makes a mixed number. NULL for anything else."""

    def value(p: Column) -> Column:
        before, above, below, behind = (p[n]["value"] for n in range(4))
        mixed = F.forall(F.slice(p, 1, 3), lambda x: F.rlike(x["text"], F.lit(_WHOLE)))
        quotient = above / F.nullif(below, F.lit(0.0))
        return F.when(mixed, before + quotient).otherwise(before * quotient) * behind

    def read(part: Column) -> Column:
        return F.struct(part.alias("text"), F.when(part == "", F.lit(1.0)).otherwise(_product(part)).alias("value"))

    def signed(parts: list[Column]) -> Column:
        before = F.when(parts[1] == "", parts[1]).otherwise(F.regexp_replace(parts[1], r"(?:\\times|\\cdot|\*)$", ""))
        behind = F.when(parts[4] == "", parts[4]).otherwise(F.regexp_replace(parts[4], r"^(?:\\times|\\cdot|\*)", ""))
        return _signed(parts[0], let(F.transform(F.array(before, parts[2], parts[3], behind), read), value))

    return _groups(text, _QUOTIENT, 5, signed)


_ROOT = rf"^([-+]?)({NUMBER})?{_TIMES}\\sqrt\[(\d+)\]\{{({NUMBER})\}}$"
_SCIENTIFIC = rf"^[-+]?{NUMBER}[eE][-+]?\d+$"
_OVER = rf"^(.+)/({NUMBER})$"
# Between the terms of a sum: before a sign that follows a digit, a letter or a closing brace.
_TERMS = r"(?<=[0-9a-z}])(?=[-+])"


def number_of(answer: Column) -> Column:
    """Numeric value of a normalised answer, NULL when it is not a supported number.

    Decimals, ratios, powers, products of a number, a root and pi, fractions of such products, mixed numbers, and sums of these.
    """
    return let(answer, _number_in)


def _number_in(text: Column) -> Column:
    """The sum of two or more terms that are all numbers, without a sign inside braces; else the whole text as one term.

    Terms and whole are read by one function over one array: the rules of a term are large, and stand in the plan once.
    """
    terms = F.split(text, _TERMS)
    balanced = F.forall(terms, lambda t: F.length(F.replace(t, F.lit("{"), F.lit(""))) == F.length(F.replace(t, F.lit("}"), F.lit(""))))
    whole = F.array(text)
    read = F.transform(F.when(F.rlike(text, F.lit(_TERMS)) & balanced, F.concat(terms, whole)).otherwise(whole), _term)

    def value(numbers: Column) -> Column:
        total = F.aggregate(F.slice(numbers, F.lit(1), F.size(numbers) - 1), F.lit(0.0), lambda a, x: a + x)
        return F.coalesce(F.when(F.size(numbers) > 1, total), F.element_at(numbers, -1))

    return let(read, value)


def _term(text: Column) -> Column:
    ratio = _double(F.substring_index(text, "/", 1)) / F.nullif(
        _double(F.substring_index(text, "/", -1)), F.lit(0.0)
    )
    def power(parts: list[Column]) -> Column:
        exponent = F.coalesce(_double(parts[3]), _double(parts[4]))
        return _signed(parts[0], F.coalesce(_double(parts[1]), F.lit(1.0)) * F.pow(_double(parts[2]), exponent))

    nth_root = F.when(
        F.rlike(text, F.lit(_ROOT)),
        _signed(
            _part(text, _ROOT, 1),
            F.coalesce(_double(_part(text, _ROOT, 2)), F.lit(1.0)) * F.pow(_double(_part(text, _ROOT, 4)), F.lit(1.0) / F.nullif(_double(_part(text, _ROOT, 3)), F.lit(0.0))),
        ),
    )
    return (
        F.when(F.rlike(text, F.lit(_DECIMAL)), text.try_cast("double"))
        .when(F.contains(text, F.lit(r"\frac")), _quotient(text))
        .when(F.contains(text, F.lit("/")) & F.rlike(text, F.lit(_RATIO)), ratio)
        .when(F.contains(text, F.lit("/")), _product(_part(text, _OVER, 1)) / F.nullif(_double(_part(text, _OVER, 2)), F.lit(0.0)))
        .when(F.rlike(text, F.lit(_SCIENTIFIC)), text.try_cast("double"))
        .when(F.contains(text, F.lit(r"\sqrt[")), nth_root)
        .when(F.contains(text, F.lit("^")), _groups(text, _POWER, 5, power))
        .when(F.contains(text, F.lit(r"\sqrt")) | F.contains(text, F.lit(r"\pi")), _product(text))
    )


_INTEGER = r"^[-+]?\d+(?:\.0*)?$"


def _digits(text: Column) -> Column:
    """An integer's digits without sign of plus, leading zeros and empty decimals."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\.0*$", ""), r"^([-+]?)0+(?=\d)", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), "^-0$", "0")


# A whole number, or a quotient of two, in each of its writings.
_RATIONAL = r"^([-+]?)(?:(\d+)(?:\.0*)?|\\frac\{([-+]?)(\d+)\}\{([-+]?)(\d+)\}|(\d+)/(\d+))$"


def _ratio_of(text: Column) -> tuple[Column, Column]:
    """Numerator with its sign and denominator of a rational, as exact decimals."""
    def group(n: int) -> Column:
        return _part(text, _RATIONAL, n)

    exact = lambda digits: F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    minus = F.when(group(1) == "-", -1).otherwise(1) * F.when(group(3) == "-", -1).otherwise(1) * F.when(group(5) == "-", -1).otherwise(1)
    above = exact(F.concat(group(2), group(4), group(7)))
    below = F.coalesce(exact(F.concat(group(6), group(8))), F.lit(1).cast("decimal(38,0)"))
    return F.try_multiply(above, minus.cast("decimal(2,0)")), F.nullif(below, F.lit(0).cast("decimal(38,0)"))


def _same_rationals(left: Column, right: Column) -> Column:
    """Cross products, exact; NULL where they need more than 38 digits."""
    (a, b), (c, d) = _ratio_of(left), _ratio_of(right)
    return F.try_multiply(a, d) == F.try_multiply(c, b)


# A character that integers, quotients of integers and decimals do not have.
_OTHER = r"[^-+0-9.\\{}/frac]"


def _same_numbers(left: Column, right: Column, places: int) -> Column:
    """Integers by their digits, quotients of integers by cross products, decimals exactly to ``places``, all else as doubles rounded to ``places``."""
    def both(pattern: str) -> Column:
        return F.rlike(left, F.lit(pattern)) & F.rlike(right, F.lit(pattern))

    exact = F.round(left.try_cast("decimal(38,10)"), places) == F.round(right.try_cast("decimal(38,10)"), places)
    numbers = F.transform(F.array(left, right), lambda text: F.round(_number_in(text), places))
    rounded = let(numbers, lambda n: n[0] == n[1])
    other = F.rlike(left, F.lit(_OTHER)) | F.rlike(right, F.lit(_OTHER))
    return (
        F.when(~other & both(_INTEGER), _digits(left) == _digits(right))
        .when(~other & both(_RATIONAL), F.coalesce(_same_rationals(left, right), F.lit(False)))
        .otherwise(F.coalesce(F.when(~other & both(_DECIMAL), exact), rounded))
    )


_LIST = r"^(\(|\[|\\\{)(.*)(\)|\]|\\\})$"


def _same_lists(left: Column, right: Column, places: int) -> Column:
    def read(text: Column) -> Column:
        items = F.transform(
            F.split(_part(text, _LIST, 2), ","),
            lambda item: F.coalesce(F.round(number_of(item), places).cast("string"), item),
        )
        return F.struct(F.concat(_part(text, _LIST, 1), _part(text, _LIST, 3)).alias("marks"), items.alias("items"))

    def compared(sides: Column) -> Column:
        l, r = sides[0], sides[1]
        any_order = F.array_sort(F.array_distinct(l["items"])) == F.array_sort(F.array_distinct(r["items"]))
        same = F.when(l["marks"] == F.lit(r"\{\}"), any_order).otherwise(l["items"] == r["items"])
        return (l["marks"] == r["marks"]) & same

    return let(F.transform(F.array(left, right), read), compared)


_SHORT_INTEGER = r"^-?[1-9]\d{0,17}$"
_SHORT_DECIMAL = r"^-?\d{1,18}(?:\.\d{1,10})?$"
# Cross products of these fit a bigint.
_SHORT_QUOTIENT = r"^-?(?:\d{1,9}|\\frac\{\d{1,9}\}\{\d{1,9}\})$"


def _same_short_quotients(left: Column, right: Column) -> Column:
    """Cross products of two texts of the form ``_SHORT_QUOTIENT``; NULL where a denominator is 0."""
    def ratio(text: Column) -> Column:
        def read(parts: Column) -> Column:
            above = parts[0].cast("bigint") * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
            below = F.coalesce(F.get(parts, F.lit(1)).cast("bigint"), F.lit(1).cast("bigint"))
            return F.struct(above.alias("above"), F.nullif(below, F.lit(0).cast("bigint")).alias("below"))

        return let(_all(text, r"\d+"), read)

    return let(F.transform(F.array(left, right), ratio), lambda r: r[0]["above"] * r[1]["below"] == r[1]["above"] * r[0]["below"])


def same_answer(left: Column, right: Column, places: int = 6) -> Column:
    """Whether two *normalised* answers agree; NULL when either is NULL.

    Equal text, equal numbers after rounding, or equal lists: tuples and
    intervals by position, sets without regard to order. Both sides are named many times: pass columns.
    """
    def by_form(pair: Column) -> Column:
        l, r = pair["l"], pair["r"]
        listed = F.contains(l, F.lit(",")) & F.rlike(l, F.lit(_LIST)) & F.rlike(r, F.lit(_LIST))
        return F.when(listed, _same_lists(l, r, places)).otherwise(F.coalesce(_same_numbers(l, r, places), F.lit(False)))

    # The usual answers, short numbers and quotients, are settled here, with the same result; the rest of the rules stays
    # out of the generated code, which would become too long to be compiled.
    def both(pattern: str) -> Column:
        return F.rlike(left, F.lit(pattern)) & F.rlike(right, F.lit(pattern))

    exact = F.round(left.try_cast("decimal(38,10)"), places) == F.round(right.try_cast("decimal(38,10)"), places)
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None).cast("boolean"))
        .when((left == "") | (right == ""), F.lit(False))
        .when(left == right, F.lit(True))
        .when(both(_SHORT_INTEGER), F.lit(False))
        .when(both(_SHORT_DECIMAL), exact)
        .when(both(_SHORT_QUOTIENT), F.coalesce(_same_short_quotients(left, right), F.lit(False)))
        .otherwise(let(F.struct(left.alias("l"), right.alias("r")), by_form))
    )


CHOICE = r"Answer:\s*\$?([ABCD])\b"


def choice_letter(completion: Column) -> Column:
    """The rightmost ``Answer: X`` letter of a multiple-choice completion."""
    return _last(F.regexp_extract_all(completion, F.lit(CHOICE), F.lit(1)))
