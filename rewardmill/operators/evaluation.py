"""Benchmark evaluation: questions, matching, run grid, keys and leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.functions import answers as an
from rewardmill.functions.text import let, seeded_int
from rewardmill.registry import (
    CHOICE_QUERY,
    DEFAULT_TOKEN_LIMIT,
    GRID_SEEDS,
    GRID_TASKS,
    MATH_QUERY,
    TOKEN_LIMITS,
    Task,
)

MATCH_PLACES = 5
LETTERS = ("A", "B", "C", "D")


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Put columns into a ``{Name}`` template; text inside the values is not looked at again."""
    pieces, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), value.cast("string")]
    return F.concat(*pieces, F.lit(rest))


def math_docs(df: DataFrame, task: Task, keep: Sequence[str] = ()) -> DataFrame:
    """Evaluation documents of a free-answer benchmark."""
    return df.select(
        *keep,
        F.lit(task.name).alias("task_name"),
        _fill(MATH_QUERY, {"Question": F.col(task.question)}).alias("query"),
        F.array(F.col(task.gold).cast("string")).alias("choices"),
        F.lit(0).alias("gold_index"),
        F.lit(None).cast("string").alias("instruction"),
    )


def choice_docs(
    df: DataFrame,
    task: Task,
    wrong: Sequence[str] = ("Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"),
    seed: int = 42,
    row_key: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Evaluation documents of a four-way benchmark; the right answer's place is seeded by the row."""
    if not row_key:
        raise ValueError("row_key columns are needed to place the right answer")
    placed = df.withColumn("gold_index", seeded_int(seed, 0, 3, *[F.col(k) for k in row_key]))
    options = F.array_insert(
        F.array(*[F.col(f"`{w}`").cast("string") for w in wrong]),
        F.col("gold_index") + 1,
        F.col(f"`{task.gold}`").cast("string"),
    )
    listed = placed.withColumn("__options", options)
    values = {"Question": F.col(f"`{task.question}`")}
    values |= {letter: F.element_at("__options", i + 1) for i, letter in enumerate(LETTERS)}
    query = _fill(CHOICE_QUERY, values)
    return listed.select(
        *keep,
        F.lit(task.name).alias("task_name"),
        query.alias("query"),
        F.array(*[F.lit(x) for x in LETTERS]).alias("choices"),
        "gold_index",
        query.alias("instruction"),
    )


def eval_docs(df: DataFrame, task: Task, **options) -> DataFrame:
    """Documents of a task by its kind."""
    return choice_docs(df, task, **options) if task.metric == "choice" else math_docs(df, task, **options)


# ---------------------------------------------------------------------------
# Matching.


@dataclass(frozen=True)
class Matcher:
    """How a benchmark reads its gold and a prediction, and when the two agree."""

    read_gold: Callable[[Column], Column]
    read_prediction: Callable[[Column], Column]
    same: Callable[[Column, Column], Column]


def _same_value(gold: Column, prediction: Column) -> Column:
    return an.same_answer(gold, prediction, MATCH_PLACES)


def _normalised(read: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: let(read(text), an.normalise)


METRICS = {
    "expression": Matcher(_normalised(an.expression_gold), _normalised(an.expression_prediction), _same_value),
    "latex": Matcher(_normalised(an.latex_gold), _normalised(an.expression_prediction), _same_value),
    "choice": Matcher(lambda letter: letter, an.choice_letter, lambda gold, prediction: gold == prediction),
}


def register_metric(name: str, matcher: Matcher) -> None:
    """Plug in a matcher under a task's metric name."""
    METRICS[name] = matcher


def match(df: DataFrame, metric: str, gold: str | Column = "gold", prediction: str = "prediction") -> DataFrame:
    """Add ``score``, 1 or 0, of each prediction against its gold."""
    matcher = METRICS[metric]
    read = df.select(
        "*",
        matcher.read_gold(F.col(gold) if isinstance(gold, str) else gold).alias("__gold"),
        matcher.read_prediction(F.col(prediction)).alias("__prediction"),
    )
    pair = F.struct(F.col("__gold").alias("gold"), F.col("__prediction").alias("prediction"))
    same = let(pair, lambda p: matcher.same(p["gold"], p["prediction"]))
    return read.withColumn("score", F.coalesce(same, F.lit(False)).cast("double")).drop("__gold", "__prediction")


def match_expression(df: DataFrame) -> DataFrame:
    """Against a gold given as an expression."""
    return match(df, "expression")


def match_latex(df: DataFrame) -> DataFrame:
    """Against a gold that must be LaTeX."""
    return match(df, "latex")


def match_choice(df: DataFrame, gold_index: str = "gold_index") -> DataFrame:
    """Against the letter of the right choice."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return match(df, "choice", F.get(letters, F.col(gold_index)))


def best_of_golds(
    df: DataFrame,
    doc_key: Sequence[str],
    golds: str = "golds",
    metric: str = "expression",
    prediction: str = "prediction",
) -> DataFrame:
    """Score per document as the best over all its golds and predictions.

    A prediction is read once and compared in place; only keys and scores are grouped.
    """
    matcher = METRICS[metric]
    read = df.select(
        *doc_key,
        F.transform(golds, matcher.read_gold).alias("__golds"),
        matcher.read_prediction(F.col(prediction)).alias("__prediction"),
    )
    hit = F.exists(
        "__golds", lambda gold: F.coalesce(matcher.same(gold, F.col("__prediction")), F.lit(False))
    )
    scored = read.select(*doc_key, hit.cast("double").alias("score"))
    return scored.groupBy(*doc_key).agg(F.max("score").alias("score"))


def task_accuracy(scored: DataFrame, keys: Sequence[str] = ("model", "task", "seed")) -> DataFrame:
    """Share of matched documents per run."""
    return scored.groupBy(*keys).agg(F.avg("score").alias("accuracy"), F.count(F.lit(1)).alias("n_docs"))


def leaderboard(runs: DataFrame, keys: Sequence[str] = ("model", "task")) -> DataFrame:
    """Mean and sample deviation over seeds, and the best seed's accuracy."""
    return runs.groupBy(*keys).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_samp("accuracy").alias("std_accuracy"),
        F.max("accuracy").alias("best_accuracy"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def best_checkpoint(board: DataFrame, keys: Sequence[str], checkpoint: str = "checkpoint") -> DataFrame:
    """The checkpoint with the highest mean accuracy; the smallest name wins a tie."""
    # Smallest (-accuracy, name): one partial aggregate, no join back.
    best = F.min(F.struct((-F.col("mean_accuracy")).alias("loss"), F.col(checkpoint).alias("name")))
    return board.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, F.col("__best.name").alias(checkpoint), (-F.col("__best.loss")).alias("mean_accuracy")
    )


# ---------------------------------------------------------------------------
# Runs.


def model_id(model: Column, post_train_type: Column, dataset: Column, checkpoint: Column) -> Column:
    """Id of a post-trained model in result folders."""
    return F.concat_ws("_", model, post_train_type, dataset, checkpoint)


def max_model_length(requested: Column, max_new_tokens: Column) -> Column:
    """Unset means the generation limit; -1 means no limit (NULL)."""
    return F.nullif(F.coalesce(requested, max_new_tokens), F.lit(-1))


def _as_text(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("None"))


def run_key(
    seed: Column,
    temperature: Column,
    top_p: Column,
    task: Column,
    max_new_tokens: Column,
    max_model_length: Column,
    use_chat_template: Column,
) -> Column:
    """Name of a result record within its model's folder."""
    base = F.concat_ws(
        "-", *[c.cast("string") for c in (seed, temperature, top_p, task, max_new_tokens)]
    )
    same = max_model_length.eqNullSafe(max_new_tokens)
    return F.concat(
        base,
        F.when(same, F.lit("")).otherwise(F.concat(F.lit("-"), _as_text(max_model_length))),
        F.when(use_chat_template, F.lit("")).otherwise(F.lit("-nochat")),
    )


def model_folder(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def token_limit(model: Column) -> Column:
    """Generation limit of a model: a few have a smaller one."""
    limit = F.lit(DEFAULT_TOKEN_LIMIT)
    for name, smaller in TOKEN_LIMITS.items():
        limit = F.when(model == name, F.lit(smaller)).otherwise(limit)
    return limit


def run_grid(
    models: DataFrame,
    seeds: Sequence[int] = GRID_SEEDS,
    tasks: Sequence[str] = GRID_TASKS,
    temperature: float = 0.6,
    top_p: float = 0.95,
) -> DataFrame:
    """One row per model, seed and task, with its limits and result key.

    Seeds and tasks are short configuration lists, exploded in place: no join.
    """
    grid = (
        models.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
        .withColumn("max_new_tokens", token_limit(F.col("model")))
        .withColumn("max_model_length", max_model_length(F.col("max_new_tokens"), F.col("max_new_tokens")))
        .withColumn("temperature", F.lit(temperature))
        .withColumn("top_p", F.lit(top_p))
    )
    key = run_key(
        *[F.col(c) for c in ("seed", "temperature", "top_p", "task", "max_new_tokens", "max_model_length")],
        F.lit(True),
    )
    return grid.withColumn("folder", model_folder(F.col("model"))).withColumn("run_key", key)


def pending_runs(
    plan: DataFrame, results: DataFrame, keys: Sequence[str] = ("model", "task", "seed"), overwrite: bool = False
) -> DataFrame:
    """Planned runs that have no result yet; all of them when overwriting."""
    return plan if overwrite else plan.join(results.select(*keys).distinct(), list(keys), "left_anti")


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
