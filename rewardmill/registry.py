"""Named datasets, benchmark tasks, reward presets and prompt texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from rewardmill.functions.rewards import Reward, reward_named

# ---------------------------------------------------------------------------
# Prompt texts.

BOXED_SYSTEM_PROMPT = """
A conversation between User and Assistant. The user asks a question, and the Assistant solves it.
The assistant first thinks about the reasoning process in the mind and then provides the user with the answer, and put your final answer within \\boxed{{}} .
The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, 
i.e., <think> reasoning process here </think> <answer> answer here </answer>.
Note that respond by English, NOT use other languages.
"""

DEFAULT_SYSTEM_PROMPT = """
You are a helpful AI Assistant that provides well-reasoned and detailed responses.
You first think about the reasoning process as an internal monologue and then provide the user with the answer.
Respond in the following format: <think>\n...\n</think>\n<answer>\n...\n</answer>
"""

MATH_QUERY = (
    "Solve the following math problem efficiently and clearly.  The last line of your response should be of the "
    "following format: 'Therefore, the final answer is: $\\boxed{ANSWER}$. I hope it is correct' (without quotes) "
    "where ANSWER is just the final number or expression that solves the problem. Think step by step before "
    "answering.\n\n{Question}"
)

CHOICE_QUERY = (
    "Answer the following multiple choice question. The last line of your response should be of the following "
    "format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering."
    "\n\n{Question}\n\nA) {A}\nB) {B}\nC) {C}\nD) {D}"
)

# ---------------------------------------------------------------------------
# Training datasets, name -> source id.

TRAINING_SOURCES = {
    "deepscaler": "agentica-org/DeepScaleR-Preview-Dataset",
    "2thought": "Intelligent-Internet/II-Thought-RL-v0-Math-50K",
    "l1_exact": "agentica-org/DeepScaleR-Preview-Dataset",
    "l1_max": "agentica-org/DeepScaleR-Preview-Dataset",
    "fastcurl": "Nickyang/FastCuRL",
    "still": "RUC-AIBOX/STILL-3-Preview-RL-Data",
    "open_rs3": "knoveleng/open-rs",
    "open_rs2": "knoveleng/open-rs",
    "open_rs1": "knoveleng/open-s1",
    "limr": "GAIR/LIMR",
    "open_r1": "open-r1/OpenR1-Math-220k",
    "thoughts": "bethgelab/CuratedThoughts",
    "limr_large_lr_ablation": "GAIR/LIMR",
    "limr_small_lr_ablation": "GAIR/LIMR",
    "limr_large_rank_ablation": "GAIR/LIMR",
    "limr_medium_rank_ablation": "GAIR/LIMR",
    "limr_small_rank_ablation": "GAIR/LIMR",
    "limr_tiny_rank_ablation": "GAIR/LIMR",
    "open_rs3_drgrpo_ablation": "knoveleng/open-rs",
    "open_rs3_format_ablation": "knoveleng/open-rs",
    "open_rs3_long_completion_ablation": "knoveleng/open-rs",
    "openthoughts3": "open-thoughts/OpenThoughts3-1.2M",
}

SFT_SOURCES = {
    "qwen_rationale_limo": "GAIR/LIMO",
    "r1_rationale_s1": "simplescaling/s1K-1.1",
    "claude_rationale_s1": "simplescaling/s1K-claude-3-7-sonnet",
    "deepscaler": "agentica-org/DeepScaleR-Preview-Dataset",
    "still": "RUC-AIBOX/STILL-3-Preview-RL-Data",
}

# SFT source id -> (trajectory column, attempt column).
SFT_COLUMNS = {
    "simplescaling/s1K-claude-3-7-sonnet": ("claude_thinking_trajectory", "claude_attempt"),
    "simplescaling/s1K-1.1": ("deepseek_thinking_trajectory", "deepseek_attempt"),
    "simplescaling/s1K": ("thinking_trajectories", "attempt"),
    "GAIR/LIMO": ("solution", "answer"),
    "RUC-AIBOX/STILL-3-Preview-RL-Data": ("answer", "answer"),
    "agentica-org/DeepScaleR-Preview-Dataset": ("solution", "answer"),
}

# Range of the length budget.
TARGET_LENGTH_RANGE = (100, 4000)


@dataclass(frozen=True)
class TrainingDataset:
    """How a named dataset is shaped and which prompt it gets."""

    name: str
    source: str

    @property
    def answer_over_derivation(self) -> bool:
        return "deepscaler" in self.name

    @property
    def messages_and_json(self) -> bool:
        return "2thought" in self.name

    @property
    def length_budget(self) -> bool:
        return "l1" in self.name

    @property
    def system_prompt(self) -> str:
        return BOXED_SYSTEM_PROMPT if "open-rs" in self.source else DEFAULT_SYSTEM_PROMPT


def training_dataset(name: str) -> TrainingDataset:
    if name not in TRAINING_SOURCES:
        raise KeyError(f"unknown training dataset {name!r}; known: {sorted(TRAINING_SOURCES)}")
    return TrainingDataset(name, TRAINING_SOURCES[name])


def sft_columns(source: str) -> tuple[str, str]:
    if source not in SFT_COLUMNS:
        raise ValueError(f"unknown dataset for SFT: {source}")
    return SFT_COLUMNS[source]


# ---------------------------------------------------------------------------
# Benchmark tasks.


@dataclass(frozen=True)
class Task:
    """A benchmark: where it is read, how it is asked and how it is matched."""

    name: str
    source: str
    subset: str
    split: str
    question: str
    gold: str
    metric: str
    generation_size: int = 32768
    version: int = 1


# The seven benchmark tasks.
TASKS = {
    t.name: t
    for t in (
        Task("aime24", "HuggingFaceH4/aime_2024", "default", "train", "problem", "answer", "expression"),
        Task("aime25", "yentinglin/aime_2025", "default", "train", "problem", "answer", "expression"),
        Task("math_500", "HuggingFaceH4/MATH-500", "default", "test", "problem", "solution", "latex"),
        Task("gpqa:diamond", "Idavidrein/gpqa", "gpqa_diamond", "train", "Question", "Correct Answer", "choice"),
        Task("minerva", "knoveleng/Minerva-Math", "default", "train", "problem", "solution", "latex"),
        Task("amc23", "knoveleng/AMC-23", "default", "train", "problem", "answer", "expression"),
        Task("olympiadbench", "knoveleng/OlympiadBench", "default", "train", "question", "answer", "latex"),
    )
}

# Tasks of the default run grid, its seeds, and the models with a smaller limit.
GRID_TASKS = ("aime24", "aime25", "amc23", "math_500", "minerva", "gpqa:diamond")
GRID_SEEDS = tuple(range(10))
DEFAULT_TOKEN_LIMIT = 32768
TOKEN_LIMITS = {"Qwen/Qwen2.5-Math-1.5B": 4096, "Qwen2.5-Math-1.5B": 4096}
BASELINE_MODELS = (
    "Qwen/Qwen2.5-1.5B",
    "Qwen/Qwen2.5-Math-1.5B",
    "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B",
    "RUC-AIBOX/STILL-3-1.5B-preview",
    "Intelligent-Internet/II-Thought-1.5B-Preview",
    "agentica-org/DeepScaleR-1.5B-Preview",
    "Nickyang/FastCuRL-1.5B-Preview",
    "l3lab/L1-Qwen-1.5B-Exact",
    "l3lab/L1-Qwen-1.5B-Max",
    "knoveleng/Open-RS1",
    "knoveleng/Open-RS2",
    "knoveleng/Open-RS3",
)

# ---------------------------------------------------------------------------
# Reward presets.


@dataclass(frozen=True)
class Preset:
    """Reward names with weights and the group size of a training setting."""

    name: str
    reward_names: tuple[str, ...]
    weights: tuple[float, ...]
    generations: int
    scale_rewards: bool = True
    params: dict[str, dict] = field(default_factory=dict)

    def rewards(self) -> list[Reward]:
        return [reward_named(n, **self.params.get(n, {})) for n in self.reward_names]


_FORMAT_ACCURACY = (("format", "accuracy"), (1.0, 2.0))
_FORMAT_COSINE = (("format", "cosine"), (1.0, 2.0))
_LENGTH_ACCURACY = (("length", "accuracy"), (1.0, 2.0))
_SEVEN = (
    ("accuracy", "format", "tag_count", "length", "reasoning_steps", "cosine", "repetition_penalty"),
    (1.0,) * 7,
)
_FORMAT_ONLY = (("format", "tag_count", "length", "reasoning_steps", "repetition_penalty"), (1.0,) * 5)

# Fixed value: cosine length of the settings that run with long completions.
_LONG = {"cosine": {"max_len": 3584}}

# Presets of the training settings.
PRESETS = {
    p.name: p
    for p in (
        Preset("deepscaler", *_FORMAT_ACCURACY, 4),
        Preset("2thought", *_FORMAT_ACCURACY, 4),
        Preset("fastcurl", *_FORMAT_ACCURACY, 4),
        Preset("limr", *_FORMAT_ACCURACY, 4),
        Preset("limr_large_lr_ablation", *_FORMAT_ACCURACY, 4),
        Preset("limr_small_lr_ablation", *_FORMAT_ACCURACY, 4),
        Preset("limr_large_rank_ablation", *_FORMAT_ACCURACY, 4),
        Preset("limr_medium_rank_ablation", *_FORMAT_ACCURACY, 4),
        Preset("limr_small_rank_ablation", *_FORMAT_ACCURACY, 4),
        Preset("limr_tiny_rank_ablation", *_FORMAT_ACCURACY, 4),
        Preset("open_rs1", *_FORMAT_ACCURACY, 4),
        Preset("open_rs2", *_FORMAT_ACCURACY, 6),
        Preset("open_rs3", *_FORMAT_COSINE, 6, params=_LONG),
        Preset("open_rs3_drgrpo_ablation", *_FORMAT_COSINE, 6, False, _LONG),
        Preset("open_rs3_long_completion_ablation", *_FORMAT_COSINE, 6, False, _LONG),
        Preset("open_rs3_format_ablation", *_FORMAT_ONLY, 6),
        Preset("still", *_LENGTH_ACCURACY, 4),
        Preset("open_r1", *_SEVEN, 8, params=_LONG),
        Preset("thoughts", *_SEVEN, 8, params=_LONG),
        Preset("l1_exact", ("length_l1_exact",), (1.0,), 4),
        Preset("l1_max", ("length_l1_max",), (1.0,), 4),
        Preset("offpolicy", ("accuracy",), (1.0,), 4),
    )
}
