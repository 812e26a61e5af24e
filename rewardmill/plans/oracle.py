"""The same derived tables and rules in plain SQL, as building blocks of the oracle queries."""

from __future__ import annotations

ROLLOUTS = r"""
v_rollouts AS (
  SELECT l_orderkey AS prompt_id, l_partkey AS part_key, l_suppkey AS supp_key, l_linenumber AS line_no,
         'r0' AS run_id, l_orderkey // 64 AS step, l_orderkey % 2 AS process_id, l_suppkey % 3 AS worker_id,
         100 + l_partkey % 3901 AS target_length, l_extendedprice / 10000.0 AS model_score,
         concat(CASE WHEN l_linenumber % 2 = 0 THEN '<think>' || chr(10) ELSE '' END,
                'Step 1: ', repeat(text || ' ', l_linenumber % 3 + 1),
                CASE WHEN l_returnflag = 'R'
                     THEN chr(10) || '- First, check' || chr(10) || '* Next, verify' ELSE '' END,
                CASE WHEN l_linestatus = 'F' THEN chr(10) || '</think>' || chr(10) ELSE '' END,
                CASE WHEN l_tax < 0.005 THEN '<answer>none</answer>'
                     WHEN l_tax > 0.065 THEN 'The final answer is: $' || form || '$.'
                     ELSE '<answer>$\boxed{' || form || '}$</answer>' END) AS completion,
         CASE WHEN l_orderkey % 50 = 0 THEN ''
              WHEN l_orderkey % 50 = 1 THEN CAST(l_orderkey % 50 + 1 AS VARCHAR)
              ELSE '$' || CAST(l_orderkey % 50 + 1 AS VARCHAR) || '$' END AS solution
  FROM (SELECT *, CASE l_partkey % 4
                    WHEN 0 THEN CAST(v AS VARCHAR)
                    WHEN 1 THEN '\frac{' || CAST(2 * v AS VARCHAR) || '}{2}'
                    WHEN 2 THEN CAST(v AS VARCHAR) || '.0'
                    ELSE 'x = ' || CAST(v AS VARCHAR) END AS form
        FROM (SELECT *, CASE WHEN l_discount < 0.05 THEN l_orderkey % 50 + 1
                             ELSE CAST(l_quantity AS BIGINT) END AS v
              FROM lineitem JOIN benchmark ON l_partkey % (SELECT count(*) FROM benchmark) = item_id))
)"""

_BODY = r"[^{}]*(?:\{[^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*\}[^{}]*)*"
_SPAN = r"\$\$[^$]+\$\$|\$[^$]+\$"
_NUM = r"(?:\d+\.?\d*|\.\d+)"


def boxed(text: str) -> str:
    return rf"nullif(trim(regexp_extract_all({text}, '\\boxed\s*\{{({_BODY})\}}', 1)[-1]), '')"


def span(text: str) -> str:
    return rf"nullif(trim(trim(regexp_extract_all({text}, '{_SPAN}')[-1], '$')), '')"


def anchored(text: str) -> str:
    final = rf"regexp_extract_all({text}, '(?i)final answer is:?\s*(?:{_SPAN})')[-1]"
    loose = rf"regexp_extract_all({text}, '(?i)answer[^$\\]*(?:{_SPAN})')[-1]"
    return f"coalesce({span(final)}, {span(loose)})"


def number_text(text: str) -> str:
    return rf"nullif(trim(regexp_extract_all({text}, '[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:\s*/\s*\d+)?')[-1]), '')"


def normalised(text: str) -> str:
    """Wrappers, spacing, units and ``name =`` removed."""
    rules = [
        (rf"\\boxed\s*\{{({_BODY})\}}", r"\1"),
        (r"\\(?:left|right|displaystyle|quad|qquad)\b|\\[,;:!]|[$~]", ""),
        (r"\\[dtc]frac\b", r"\\frac"),
        (r"^\s*\\(?:text|mathrm|textbf|mbox)\s*\{([^{}]*)\}\s*$", r"\1"),
        (r"\\(?:text|mathrm|textbf|mbox)\s*\{[^{}]*\}", ""),
        (r"\\?%|\^\{?\\circ\}?", ""),
        (r"^.*=", ""),
        (r"\s+", ""),
        (r"\.+$", ""),
    ]
    out = text
    for pattern, replacement in rules:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


def number(text: str) -> str:
    frac = rf"^([-+]?)\\frac\{{([-+]?{_NUM})\}}\{{([-+]?{_NUM})\}}$"
    ratio = rf"^([-+]?)({_NUM})/({_NUM})$"

    def quotient(p: str) -> str:
        part = f"CAST(regexp_extract({text}, '{p}', %d) AS DOUBLE)"
        sign = f"CASE WHEN regexp_extract({text}, '{p}', 1) = '-' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
        return f"({sign}) * {part % 2} / nullif({part % 3}, 0)"

    return (
        rf"CASE WHEN regexp_matches({text}, '^[-+]?{_NUM}$') THEN TRY_CAST({text} AS DOUBLE) "
        f"WHEN regexp_matches({text}, '{frac}') THEN {quotient(frac)} "
        f"WHEN regexp_matches({text}, '{ratio}') THEN {quotient(ratio)} END"
    )


def same(left: str, right: str, places: int) -> str:
    numbers = f"round({number(left)}, {places}) = round({number(right)}, {places})"
    return (
        f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN NULL WHEN {left} = '' OR {right} = '' THEN FALSE "
        f"WHEN {left} = {right} THEN TRUE ELSE coalesce({numbers}, FALSE) END"
    )


ANSWERS = f"""
v_answers AS (
  SELECT *, {normalised(f"coalesce({boxed('solution')}, {anchored('solution')}, {span('solution')}, {number_text('solution')})")} AS gold,
         {normalised(f"coalesce({boxed('solution')}, {anchored('solution')}, {span('solution')})")} AS gold_latex,
         {normalised(f"coalesce({boxed('completion')}, {anchored('completion')})")} AS answer,
         length(completion) AS len
  FROM v_rollouts
),
v_verified AS (
  SELECT *, CASE WHEN gold IS NULL THEN NULL WHEN answer IS NULL THEN FALSE ELSE {same('gold', 'answer', 6)} END AS correct,
         CASE WHEN gold_latex IS NULL THEN TRUE WHEN answer IS NULL THEN FALSE
              ELSE {same('gold_latex', 'answer', 6)} END AS graded,
         min(len) OVER (PARTITION BY run_id, step, process_id) AS lo,
         max(len) OVER (PARTITION BY run_id, step, process_id) AS hi
  FROM v_answers
)"""

_WORD = r"[^\s\x0b\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"



def count_of(text: str, needle: str, size: int) -> str:
    return f"(length({text}) - length(replace({text}, {needle}, ''))) // {size}"


_CLOSE = "chr(10) || '</think>' || chr(10)"
_OPEN = "'<think>' || chr(10)"
_COS = (
    "CASE WHEN gold_latex IS NULL THEN 1.0::DOUBLE "
    "WHEN graded THEN 0.5::DOUBLE + 0.25::DOUBLE * (1 + cos(len / {max_len}::DOUBLE * pi())) "
    "ELSE -0.5::DOUBLE + 0.25::DOUBLE * (1 + cos(len / {max_len}::DOUBLE * pi())) END"
)
_POSITION = "0.5::DOUBLE - (len - lo) / nullif(hi - lo, 0)::DOUBLE"
_DISTANCE = "0.0003::DOUBLE * abs(len - target_length)"

REWARD = {
    "accuracy": "CAST(CAST(correct AS INTEGER) AS DOUBLE)",
    "format": f"CASE WHEN {count_of('completion', _CLOSE, 10)} = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "tag_count": f"(CASE WHEN {count_of('completion', _OPEN, 8)} = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    f" + CASE WHEN {count_of('completion', _CLOSE, 10)} = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)",
    "reasoning_steps": "least(1.0::DOUBLE, len(regexp_extract_all(completion, "
    r"'(Step \p{Nd}+:|^\p{Nd}+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0::DOUBLE)",
    "length": f"CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN graded THEN {_POSITION} ELSE least(0.0::DOUBLE, {_POSITION}) END",
    "length_l1_exact": f"CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN graded THEN 1 - {_DISTANCE} ELSE -({_DISTANCE}) END",
    "length_l1_max": "CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN graded THEN greatest(0.0::DOUBLE, "
    "least(0.0003::DOUBLE * (target_length - len) + 0.5::DOUBLE, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END",
    "cosine": _COS.format(max_len="1000"),
    "cosine_long": _COS.format(max_len="3584"),
    "repetition_penalty": "CASE WHEN n_grams = 0 THEN 0.0::DOUBLE "
    "ELSE (1 - n_distinct / n_grams::DOUBLE) * -1.0::DOUBLE END",
}


def grams_of(source: str) -> str:
    """CTEs that add n_grams and n_distinct of the text column to ``source`` as v_grams."""
    return f"""
v_words AS (SELECT *, regexp_extract_all(lower(completion), '{_WORD}') AS words FROM {source}),
v_grams AS (
  SELECT * EXCLUDE (words, grams), len(grams) AS n_grams, len(list_distinct(grams)) AS n_distinct
  FROM (SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)),
                                 lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams
        FROM v_words)
)"""


TOKENS = """
v_tokens AS (
  SELECT a.vec_id, a.vec_id // 8 AS minibatch_id, a.vec_id // 64 AS step,
         list_transform(a.embedding, lambda x: -abs(x::DOUBLE)) AS cur_logps,
         list_transform(b.embedding, lambda x: -abs(x::DOUBLE)) AS ref_logps,
         list_transform(a.embedding, lambda x: CASE WHEN CAST(floor(abs(x::DOUBLE) * 1000) AS INTEGER) % 17 = 0 THEN 0
                                                    ELSE CAST(floor(abs(x::DOUBLE) * 1000) AS INTEGER) END) AS completion_ids,
         CAST(a.vec_id % 16 + 4 AS INTEGER) AS prompt_len, a.label::DOUBLE AS reward, 1.0::DOUBLE AS importance_weight
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
),
v_masked AS (
  SELECT *, len(completion_ids) AS size, coalesce(list_position(completion_ids, 0), 0) AS eos_at,
         CASE WHEN list_position(completion_ids, 0) > 0 THEN list_position(completion_ids, 0)
              ELSE len(completion_ids) END AS n_tokens
  FROM v_tokens
)"""

PREDICTIONS = r"""
v_eval AS (
  SELECT l_returnflag || '/' || l_linestatus AS model, l_returnflag AS base, l_linestatus AS checkpoint,
         p_type AS task, l_linenumber AS seed, l_orderkey AS doc, l_partkey AS part_key, l_suppkey AS supp_key,
         '$\frac{' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '}{2}$' AS gold,
         l_suppkey % 4 AS gold_index,
         CASE WHEN l_discount < 0.05 THEN 'answer $\boxed{' || CAST(l_quantity / 2 AS VARCHAR) || '}$'
              ELSE 'Answer: ' || substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) END AS prediction
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

_PREDICTED = f"coalesce({boxed('prediction')}, {anchored('prediction')}, {span('prediction')}, {number_text('prediction')})"


def matched(gold_form: str) -> str:
    """CTEs that add ``score`` to v_eval as v_matched. ``gold_form`` is the extracted gold."""
    return f"""
v_read AS (SELECT *, {normalised(gold_form)} AS g, {normalised(_PREDICTED)} AS p FROM v_eval),
v_matched AS (SELECT *, CAST(CAST(coalesce({same('g', 'p', 5)}, FALSE) AS INTEGER) AS DOUBLE) AS score FROM v_read)"""


EXPRESSION_GOLD = f"coalesce({boxed('gold')}, {span('gold')}, {number_text('gold')})"
LATEX_GOLD = f"coalesce({boxed('gold')}, {anchored('gold')}, {span('gold')})"

CONVERSATIONS = """
v_messages AS (
  SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id
)"""


def r(expression: str, name: str, places: int = 6) -> str:
    """A double as it is compared."""
    return f"round({expression}, {places}) + 0.0::DOUBLE AS {name}"


def with_ctes(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + select
