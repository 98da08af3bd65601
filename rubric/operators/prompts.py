"""PROMPTS job: samples -> prompts, targets and chat messages.

Every rule is a Column expression; the whole job is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import _col
from ..sources.samples import first_n

# Chat rendering template.  The real template ships with a model's
# tokenizer; this one is the public ChatML role-marker layout used by
# common vision-language chat models.
CHATML = {
    "start": "<|im_start|>",
    "end": "<|im_end|>\n",
    "image": "<|vision_start|><|image_pad|><|vision_end|>",
    "generation": "<|im_start|>assistant\n",
}

PART = "struct<type:string,text:string>"
MESSAGE = f"struct<role:string,content:array<{PART}>>"


def instruction(instr: str = "instruction", question: str = "question") -> Column:
    """Instruction, else question, else ''."""
    return F.coalesce(F.col(instr), F.col(question), F.lit(""))


def image_path(image_dir, image_id: str = "imageId") -> Column:
    """``<dir>/<imageId>.jpg``; NULL id stays NULL (``concat``)."""
    d = image_dir if isinstance(image_dir, Column) else F.lit(image_dir)
    return F.concat(d, F.lit("/"), F.col(image_id), F.lit(fixed.IMAGE_SUFFIX))


def first_cot(cot: str = "cot") -> Column:
    """Text of the first CoT entry, '' if the list is missing or empty.
    ``get`` returns NULL out of range where ``cot[0]`` would fail under ANSI."""
    return F.coalesce(F.get(F.col(cot), 0).getField("text"), F.lit(""))


def answer_or_empty(answer: str = "answer") -> Column:
    """P4."""
    return F.coalesce(F.col(answer), F.lit(""))


def target_text(cot: Column, answer: Column, split: Column | None = None) -> Column:
    """P5: the assistant target (``fixed.TARGET_FORMAT``); only for train and val rows."""
    head, rest = fixed.TARGET_FORMAT.split("{cot}")
    middle, tail = rest.split("{answer}")
    t = F.concat(F.lit(head), cot, F.lit(middle), answer, F.lit(tail))
    if split is None:
        return t
    return F.when(split.isin("train", "val"), t)


def user_prompt(instr: Column) -> Column:
    """Question trigger + instruction."""
    return F.concat(F.lit(fixed.QUESTION_TRIGGER), instr)


def _text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"))


def _image_part() -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))


def _message(role: str, parts: list[Column]) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def messages(user: Column, target: Column | None = None, with_image: bool = True) -> Column:
    """System, user (image + text) and, when ``target`` is not NULL, the
    assistant turn.  A plain-string system content becomes one text part."""
    user_parts = ([_image_part()] if with_image else []) + [_text_part(user)]
    base = F.array(_message("system", [_text_part(F.lit(fixed.SYSTEM_PROMPT))]),
                   _message("user", user_parts))
    if target is None:
        return base
    return F.when(target.isNull(), base).otherwise(
        F.concat(base, F.array(_message("assistant", [_text_part(target)]))))


def render_chat(msgs: Column, add_generation_prompt=False, template: dict = CHATML) -> Column:
    """Messages -> one string, optionally ending with the generation
    marker (``add_generation_prompt`` may be a bool or a boolean Column)."""
    def part(p):
        return F.when(p.getField("type") == "image", F.lit(template["image"])) \
            .otherwise(F.coalesce(p.getField("text"), F.lit("")))

    def msg(m):
        return F.concat(F.lit(template["start"]), m.getField("role"), F.lit("\n"),
                        F.array_join(F.transform(m.getField("content"), part), ""),
                        F.lit(template["end"]))

    body = F.array_join(F.transform(_col(msgs), msg), "")
    gen = add_generation_prompt if isinstance(add_generation_prompt, Column) else F.lit(bool(add_generation_prompt))
    return F.when(gen, F.concat(body, F.lit(template["generation"]))).otherwise(body)


def flatten_messages(msgs: Column) -> Column:
    """Stable text form of a message list (role:type=text|..., one per line)."""
    def part(p):
        return F.concat(p.getField("type"), F.lit("="), F.coalesce(p.getField("text"), F.lit("")))

    def msg(m):
        return F.concat(m.getField("role"), F.lit(":"),
                        F.array_join(F.transform(m.getField("content"), part), "|"))
    return F.array_join(F.transform(_col(msgs), msg), "\n")


def build_prompts(samples: DataFrame, image_dir: Column | str = "image_dir",
                  split: str = "split") -> DataFrame:
    """The PROMPTS job: P1-P8 over a samples table with a split column.

    ``image_dir`` is a column name (per-split dirs from S6) or a literal dir.
    """
    d = F.col(image_dir) if isinstance(image_dir, str) and image_dir in samples.columns else \
        (image_dir if isinstance(image_dir, Column) else F.lit(image_dir))
    s1 = samples.select("*", instruction().alias("instruction_text"), first_cot().alias("first_cot"),
                        answer_or_empty().alias("answer_text"), image_path(d).alias("image_path"))
    s2 = s1.select("*", user_prompt(F.col("instruction_text")).alias("user_prompt"),
                   target_text(F.col("first_cot"), F.col("answer_text"), F.col(split)).alias("target_text"))
    s3 = s2.select("*", messages(F.col("user_prompt"), F.col("target_text")).alias("messages"),
                   messages(F.col("user_prompt")).alias("prompt_messages"))
    return s3.select("*", render_chat(F.col("messages"), F.col(split) == "test").alias("chat_text"),
                     render_chat(F.col("prompt_messages"), True).alias("prompt_text"))


def rollout_prompts(samples: DataFrame, image_dir: str, n: int | None = None,
                    order: str = "ord") -> DataFrame:
    """The RL rows (prompt, image path, ground-truth answer), of all
    samples or of the first ``n`` in file order (S2).  The prompt is rendered without
    the generation marker.  A row with no answer is kept with a ``reject``
    reason instead of failing the job."""
    src = first_n(samples, n, order) if n is not None else samples
    user = user_prompt(instruction())
    return src.select(
        "sample_id",
        render_chat(messages(user), False).alias("prompt"),
        image_path(F.lit(image_dir)).alias("image"),
        F.col("answer").alias("ground_truth_answer"),
        F.when(F.col("answer").isNull(), F.lit("missing answer")).alias("reject"),
    )
