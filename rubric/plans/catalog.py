"""Registered queries: one Spark plan and one DuckDB oracle per operator ID.

Every query reads the test tables (or data Spark derives from them) in full;
doubles are rounded to 6 digits and arrays joined into strings so results
hash the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.numeric import round_half_up
from ..operators import evaluation as E
from ..operators import scoring as S
from ..sources import tables as TB
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Six-digit rounding computed identically by Spark and the oracle."""
    return round_half_up(F.col(c) if isinstance(c, str) else c, 6)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_completions(TB.completions(spark, sf_dir), gold="answer")


KEY = ["sample_id", "gen_idx"]

# ------------------------------------------------------------------ T1-T8


@register("t1_extract_tolerant", O.with_base(scored=True)
          + "SELECT sample_id, gen_idx, pred_think, pred_answer FROM scored")
def t1(spark, sf_dir):
    return S.parse_completions(TB.completions(spark, sf_dir)).select(*KEY, "pred_think", "pred_answer")


@register("t2_extract_strict", O.with_base(scored=False)
          + f"SELECT sample_id, gen_idx, {O.strict_cot('completion')} AS strict_cot, "
            f"{O.strict_answer('completion')} AS strict_answer FROM completions")
def t2(spark, sf_dir):
    return S.strict_parse(TB.completions(spark, sf_dir)).select(*KEY, "strict_cot", "strict_answer")


@register("t3_clean_text", O.with_base(scored=True)
          + "SELECT sample_id, gen_idx, ans_clean AS answer_clean, think_clean, gold_clean FROM scored")
def t3(spark, sf_dir):
    p = S.parse_completions(TB.completions(spark, sf_dir))
    return p.select(*KEY, T.clean_text("pred_answer").alias("answer_clean"),
                    T.clean_text("pred_think").alias("think_clean"),
                    T.clean_text("answer").alias("gold_clean"))


@register("t4_synonym_group", O.with_base(scored=False)
          + f"SELECT sample_id, answer, {O.group_name(O.clean('answer'))} AS synonym_group FROM samples")
def t4(spark, sf_dir):
    s = TB.samples(spark, sf_dir)
    return s.select("sample_id", "answer", T.synonym_group_name(T.clean_text("answer")).alias("synonym_group"))


@register("t5_is_match", O.with_base(scored=True)
          + "SELECT sample_id, gen_idx, CAST(ans_ok AS INTEGER) AS answer_match, "
            "CAST(think_ok AS INTEGER) AS think_match FROM scored")
def t5(spark, sf_dir):
    p = S.parse_completions(TB.completions(spark, sf_dir))
    return p.select(*KEY, T.is_match(F.col("pred_answer"), F.col("answer")).cast("int").alias("answer_match"),
                    T.is_match(F.col("pred_think"), F.col("answer")).cast("int").alias("think_match"))


@register("t6_n_words", O.with_base(scored=True)
          + "SELECT sample_id, gen_idx, CAST(ans_words AS INTEGER) AS n_words, is_concise FROM scored")
def t6(spark, sf_dir):
    p = S.parse_completions(TB.completions(spark, sf_dir))
    return p.select(*KEY, T.n_words("pred_answer").alias("n_words"),
                    (T.n_words("pred_answer") <= 3).cast("int").alias("is_concise"))


_FOREIGN_SQL = ("array_to_string(list_sort(list_distinct(list_filter(list_transform("
                f"regexp_extract_all(completion, {O.q(T.TAG_NAME_RE)}, 1), lambda t: lower(t)), "
                "lambda t: t NOT IN ('think', 'answer')))), ',')")


@register("t7_tag_policy", O.with_base(scored=False)
          + "SELECT sample_id, gen_idx, CAST(contains(completion, '<tool_call>') AS INTEGER) AS has_tool_call, "
            f"{_FOREIGN_SQL} AS foreign_tags, "
            f"CAST(contains(completion, '<tool_call>') OR {_FOREIGN_SQL} <> '' AS INTEGER) AS tag_violation "
            "FROM completions")
def t7(spark, sf_dir):
    return S.tag_policy(TB.completions(spark, sf_dir)).select(*KEY, "has_tool_call", "foreign_tags",
                                                              "tag_violation")


@register("t8_correct_consist", O.with_base(scored=True)
          + "SELECT sample_id, gen_idx, is_correct, is_consist FROM scored")
def t8(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "is_correct", "is_consist")


# ------------------------------------------------------------------ R1-R3


@register("r1_format_reward", O.with_base(scored=True)
          + f"SELECT sample_id, gen_idx, {O.r6('format_reward')} AS format_reward FROM scored")
def r1(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, r6("format_reward").alias("format_reward"))


@register("r2_correctness_consistency", O.with_base(scored=True)
          + f"SELECT sample_id, gen_idx, {O.r6('main_reward')} AS main_reward FROM scored")
def r2(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, r6("main_reward").alias("main_reward"))


@register("r3_combined_reward", O.with_base(scored=True)
          + f"SELECT sample_id, gen_idx, {O.r6('reward')} AS reward FROM scored")
def r3(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, r6("reward").alias("reward"))


@register("score_completions", O.with_base(scored=True)
          + f"SELECT sample_id, gen_idx, pred_think, pred_answer, is_correct, is_consist, is_concise, "
            f"{O.r6('format_reward')} AS format_reward, {O.r6('main_reward')} AS main_reward, "
            f"{O.r6('reward')} AS reward FROM scored")
def score_all(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "pred_think", "pred_answer", "is_correct", "is_consist",
                                        "is_concise", r6("format_reward").alias("format_reward"),
                                        r6("main_reward").alias("main_reward"), r6("reward").alias("reward"))


# ------------------------------------------------------------------ A1-A2

_RATES_SQL = ("count(is_correct) AS n, CAST(coalesce(sum(is_correct), 0) AS BIGINT) AS n_correct, "
              "CAST(coalesce(sum(is_consist), 0) AS BIGINT) AS n_consist")


def _rates_outer(inner: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}n, n_correct, n_consist, "
            f"{O.r6('CASE WHEN n > 0 THEN n_correct / n ELSE 0.0 END')} AS accuracy, "
            f"{O.r6('coalesce(n_consist / nullif(n_correct, 0), 0.0)')} AS consistency FROM ({inner})")


def _round_rates(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("accuracy", "consistency")],
                     r6("accuracy").alias("accuracy"), r6("consistency").alias("consistency"))


@register("a1_a2_accuracy_consistency", O.with_base(scored=True)
          + _rates_outer(f"SELECT {_RATES_SQL} FROM scored"))
def a12(spark, sf_dir):
    return _round_rates(E.accuracy_consistency(scored(spark, sf_dir)))


# Every synonym, and golds that are NULL, blank, unstripped or upper case, dealt to completions in turn.
_BROAD_GOLDS = [w for words in fixed.SYNONYM_GROUPS.values() for w in words] + [None, "", " ", " yes ", "RED", "red car", "It's"]
_BROAD_SQL = ("broad AS (SELECT *, ([" + ", ".join("NULL" if g is None else O.q(g) for g in _BROAD_GOLDS)
              + f"])[1 + (sample_id * 6 + gen_idx) % {len(_BROAD_GOLDS)}] AS gold FROM completions)")


@register("score_broad_golds", O.with_base(_BROAD_SQL, O.scored_ctes("broad", gold="gold", prefix="b", out="bscored"), scored=False)
          + f"SELECT sample_id, gen_idx, is_correct, is_consist, {O.r6('main_reward')} AS main_reward FROM bscored")
def broad(spark, sf_dir):
    golds = F.array(*[F.lit(g) for g in _BROAD_GOLDS])
    c = TB.completions(spark, sf_dir).withColumn(
        "gold", F.get(golds, ((F.col("sample_id") * 6 + F.col("gen_idx")) % len(_BROAD_GOLDS)).cast("int")))
    return S.score_completions(c, gold="gold").select(*KEY, "is_correct", "is_consist", r6("main_reward").alias("main_reward"))


# ------------------------------------------------------------------ R5-R7

from ..operators import groups as G  # noqa: E402
from ..operators import joins as J  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from ..session import scratch_path  # noqa: E402


@register("r5_fan_out", O.with_base(scored=False) + "SELECT sample_id, gen_idx, answer FROM completions")
def r5(spark, sf_dir):
    return TB.fan_out(TB.samples(spark, sf_dir).select("sample_id", "answer")) \
        .select("sample_id", "gen_idx", "answer")


_ADV_SQL = ("g AS (SELECT sample_id, avg(CAST(reward AS DOUBLE)) AS m, stddev_samp(CAST(reward AS DOUBLE)) AS s "
            "FROM scored GROUP BY sample_id)")


@register("r6_group_advantage", O.with_base(_ADV_SQL)
          + f"SELECT sample_id, gen_idx, {O.r6('reward')} AS reward, "
            f"{O.r6('CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE (CAST(reward AS DOUBLE) - m) / (s + 1e-4) END')} "
            "AS advantage FROM scored JOIN g USING (sample_id)")
def r6_adv(spark, sf_dir):
    """As the ADVANTAGE job runs it: the SCORE output is written once
    (Parquet, shared folder) and read back, so the group statistics read two
    columns of it and nothing is scored twice."""
    from . import jobs
    written = jobs.score_job(TB.completions(spark, sf_dir), scratch_path(spark, "scored"), gold="answer")
    a = G.group_advantage(written.select(*KEY, "reward"))
    return a.select(*KEY, r6("reward").alias("reward"), r6("advantage").alias("advantage"))


@register("r6_group_advantage_mean_only", O.with_base(_ADV_SQL.replace("avg(", "count(reward) AS n, avg("))
          + f"SELECT sample_id, gen_idx, {O.r6('CASE WHEN n <= 1 THEN 0.0 ELSE CAST(reward AS DOUBLE) - m END')} "
            "AS advantage FROM scored JOIN g USING (sample_id)")
def r6_mean(spark, sf_dir):
    from . import jobs
    written = jobs.score_job(TB.completions(spark, sf_dir), scratch_path(spark, "scored"), gold="answer")
    a = G.group_advantage(written.select(*KEY, "reward"), scale_rewards=False)
    return a.select(*KEY, r6("advantage").alias("advantage"))


@register("r7_group_audit", O.with_base()
          + "SELECT sample_id, count(*) AS n_rows, count(DISTINCT gen_idx) AS n_gens, "
            f"{O.r6('min(CAST(reward AS DOUBLE))')} AS min_reward, {O.r6('max(CAST(reward AS DOUBLE))')} AS max_reward, "
            "CASE WHEN count(*) > count(DISTINCT gen_idx) THEN 'duplicate' WHEN count(DISTINCT gen_idx) < 6 THEN 'missing' "
            "WHEN count(DISTINCT gen_idx) > 6 THEN 'extra' WHEN min(reward) = max(reward) THEN 'flat' ELSE 'ok' END "
            "AS status FROM scored GROUP BY sample_id")
def r7(spark, sf_dir):
    a = G.group_audit(scored(spark, sf_dir))
    return a.select("sample_id", "n_rows", "n_gens", r6("min_reward").alias("min_reward"),
                    r6("max_reward").alias("max_reward"), "status")


@register("r7_missing_prompts", O.with_base(scored=False)
          + "SELECT sample_id FROM samples WHERE sample_id % 4 = 0")
def r7m(spark, sf_dir):
    """Every fourth prompt has no completion."""
    some = TB.completions(spark, sf_dir).where(F.col("sample_id") % 4 != 0)
    return G.missing_prompts(TB.samples(spark, sf_dir).select("sample_id"), some)


@register("r6_group_advantage_nulls", O.with_base(
    "b AS (SELECT CASE WHEN sample_id % 5 = 0 THEN NULL ELSE sample_id END AS sample_id, sample_id AS row_id, gen_idx, "
    "CASE WHEN gen_idx = sample_id % 7 THEN NULL ELSE CAST(reward AS DOUBLE) END AS reward FROM scored), "
    "g AS (SELECT sample_id, avg(reward) AS m, stddev_samp(reward) AS s FROM b WHERE sample_id IS NOT NULL GROUP BY sample_id)")
    + "SELECT b.sample_id, b.row_id, b.gen_idx, CASE WHEN b.sample_id IS NOT NULL AND reward IS NOT NULL THEN "
      f"{O.r6('CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE (reward - m) / (s + 1e-4) END')} END AS advantage "
      "FROM b LEFT JOIN g ON b.sample_id = g.sample_id")
def r6_nulls(spark, sf_dir):
    """A fifth of the rows without a key, others without a reward."""
    from . import jobs
    s = jobs.score_job(TB.completions(spark, sf_dir), scratch_path(spark, "scored"), gold="answer")
    rows = s.select(F.when(F.col("sample_id") % 5 != 0, F.col("sample_id")).alias("sample_id"), F.col("sample_id").alias("row_id"),
                    "gen_idx", F.when(F.col("gen_idx") != F.col("sample_id") % 7, F.col("reward").cast("double")).alias("reward"))
    return G.group_advantage(rows).select("sample_id", "row_id", "gen_idx", r6("advantage").alias("advantage"))


# ------------------------------------------------------------------ J2

_GOLD_SQL = ("gold AS (SELECT sample_id, answer AS gt_answer FROM samples "
             "WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = samples.sample_id))")


def _gold(spark, sf_dir) -> DataFrame:
    """Gold answers exist for the documents that carry labels."""
    s = TB.samples(spark, sf_dir)
    labelled = s.join(TB.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id")),
                      "sample_id", "left_semi")
    return J.gold_from_samples(labelled)


def _bare_completions(spark, sf_dir) -> DataFrame:
    return TB.completions(spark, sf_dir).drop("answer")


@register("j2_attach_gold", O.with_base(_GOLD_SQL, scored=False)
          + "SELECT c.sample_id, c.gen_idx, g.gt_answer FROM completions c JOIN gold g USING (sample_id)")
def j2(spark, sf_dir):
    return J.attach_gold(_bare_completions(spark, sf_dir), _gold(spark, sf_dir)) \
        .select(*KEY, "gt_answer")


@register("j2_unmatched_completions", O.with_base(_GOLD_SQL, scored=False)
          + "SELECT c.sample_id, c.gen_idx FROM completions c "
            "WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.sample_id = c.sample_id)")
def j2u(spark, sf_dir):
    return J.unmatched_completions(_bare_completions(spark, sf_dir), _gold(spark, sf_dir)).select(*KEY)


@register("j2_unmatched_gold", O.with_base(_GOLD_SQL, scored=False)
          + "SELECT g.sample_id, g.gt_answer FROM gold g WHERE NOT EXISTS "
            "(SELECT 1 FROM completions c WHERE c.sample_id = g.sample_id AND c.gen_idx < 6 AND c.sample_id % 3 <> 0)")
def j2g(spark, sf_dir):
    """Every third sample has no completion."""
    some = _bare_completions(spark, sf_dir).where(F.col("sample_id") % 3 != 0)
    return J.unmatched_gold(_gold(spark, sf_dir), some).select("sample_id", "gt_answer")


@register("j2_duplicate_gold", O.with_base(scored=False)
          + "SELECT image_id AS sample_id, count(*) AS n_gold FROM samples GROUP BY image_id HAVING count(DISTINCT answer) > 1")
def j2d(spark, sf_dir):
    """Gold by image: two samples share an image, and their answers mostly differ."""
    gold = TB.samples(spark, sf_dir).select(F.col("image_id").alias("sample_id"), F.col("answer").alias("gt_answer"))
    return J.duplicate_gold(gold)


@register("j2_eval_labelled", O.with_base(
    _GOLD_SQL,
    "paired AS (SELECT c.sample_id, c.image_id, c.question, c.gen_idx, c.completion, g.gt_answer AS answer "
    "FROM completions c JOIN gold g USING (sample_id))",
    O.scored_ctes("paired", prefix="q", out="lscored"), scored=False)
    + _rates_outer(f"SELECT {_RATES_SQL} FROM lscored"))
def j2e(spark, sf_dir):
    paired = J.attach_gold(_bare_completions(spark, sf_dir), _gold(spark, sf_dir))
    return _round_rates(E.accuracy_consistency(S.score_completions(paired, gold="gt_answer")))


# ------------------------------------------------------------------ A3, A4, A7, W7, P10, S4

def tagged(spark, sf_dir) -> DataFrame:
    """Each generation slot is evaluated as its own tagged run ('g0'..'g5')."""
    s = scored(spark, sf_dir)
    return s.select("*", F.concat(F.lit("g"), F.col("gen_idx").cast("string")).alias("tag"))


_TAGGED = "tagged AS (SELECT *, 'g' || CAST(gen_idx AS VARCHAR) AS tag FROM scored)"


@register("a3_shard_counters", O.with_base()
          + f"SELECT shard, {_RATES_SQL} FROM (SELECT *, CAST(((sample_id % 2) + 2) % 2 AS INTEGER) AS shard "
            "FROM scored) GROUP BY ROLLUP (shard)")
def a3(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("shard", F.pmod(F.col("sample_id"), F.lit(2)).cast("int"))
    return E.shard_counters(s)


@register("a4_eval_by_tag", O.with_base(_TAGGED)
          + _rates_outer(f"SELECT tag, {_RATES_SQL} FROM tagged GROUP BY tag", "tag"))
def a4(spark, sf_dir):
    return _round_rates(E.eval_by_tag(tagged(spark, sf_dir)))


def _delta(rate: str) -> str:
    return O.r6(f"{rate} - max(CASE WHEN model = 'g0' THEN {rate} END) OVER ()")


@register("a7_model_comparison", O.with_base(
    _TAGGED,
    f"c AS (SELECT tag AS model, {_RATES_SQL} FROM tagged GROUP BY tag)",
    "r AS (SELECT *, CASE WHEN n > 0 THEN n_correct / n ELSE 0.0 END AS accuracy, "
    "coalesce(n_consist / nullif(n_correct, 0), 0.0) AS consistency FROM c)")
    + f"SELECT model, n, n_correct, n_consist, {O.r6('accuracy')} AS accuracy, {O.r6('consistency')} AS consistency, "
      f"{_delta('accuracy')} AS accuracy_delta, "
      f"{_delta('consistency')} AS consistency_delta "
      "FROM r")
def a7(spark, sf_dir):
    t = tagged(spark, sf_dir).withColumnRenamed("tag", "model")
    c = E.model_comparison(t, "model", baseline="g0")
    return c.select("model", "n", "n_correct", "n_consist", r6("accuracy").alias("accuracy"),
                    r6("consistency").alias("consistency"), r6("accuracy_delta").alias("accuracy_delta"),
                    r6("consistency_delta").alias("consistency_delta"))


@register("w7_worst_samples", O.with_base(_TAGGED)
          + f"SELECT tag, CAST(rank AS INTEGER) AS rank, sample_id, gen_idx, {O.r6('reward')} AS reward "
            "FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY reward, sample_id, gen_idx) AS rank "
            "FROM tagged) WHERE rank <= 3")
def w7(spark, sf_dir):
    w = E.worst_samples(tagged(spark, sf_dir), k=3)
    return w.select("tag", "rank", *KEY, r6("reward").alias("reward"))


_RECORDS_SQL = ("SELECT image_id, chr(10) || '### Question:' || chr(10) || coalesce(question, '') AS instruction, "
                "answer AS gt_answer, completion AS prediction_raw, pred_think, pred_answer, is_correct, is_consist")


@register("p10_eval_records", O.with_base() + _RECORDS_SQL + " FROM scored")
def p10(spark, sf_dir):
    return E.eval_records(scored(spark, sf_dir))


@register("s4_write_eval_report", O.with_base(_TAGGED) + _RECORDS_SQL + ", tag FROM tagged")
def s4(spark, sf_dir):
    """Write the tagged report as JSON Lines under the shared folder, read it back."""
    path = scratch_path(spark, "eval-report")
    SK.write_eval_report(E.eval_records(tagged(spark, sf_dir), extra=("tag",)), path, compression="zstd")
    return SK.read_eval_report(spark, path)


# ------------------------------------------------------------------ S1, S2, S6, P1-P9, S3, J1

from ..operators import prompts as P  # noqa: E402
from ..sources import images as IM  # noqa: E402
from ..sources import samples as SM  # noqa: E402

IMAGE_DIR, TEST_IMAGE_DIR = "/data/images", "/data/test_images"

_RAW_SQL = """raw AS (SELECT doc_id AS sample_id, CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR) AS imageId,
CASE WHEN doc_id % 3 = 0 THEN 'Please answer based on the image content: ' || text END AS instruction,
CASE WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS question,
CASE WHEN doc_id % 10 = 9 THEN -1 WHEN doc_id % 10 = 7 THEN 0 ELSE 1 END AS n_cot,
CASE WHEN doc_id % 10 IN (7, 9) THEN '' ELSE coalesce(text, '') END AS first_cot,
CASE WHEN doc_id % 17 = 16 THEN NULL ELSE CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'left'
  WHEN 3 THEN 'right' WHEN 4 THEN 'Red' ELSE 'red car' END END AS answer,
CASE WHEN doc_id % 10 = 8 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END AS split
FROM documents)"""

# The files carry no id: a sample's id is its number in the order of splits and lines.
_FILE_SQL = """filed AS (SELECT * REPLACE (row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END,
sample_id) - 1 AS sample_id) FROM raw)"""

_TRIGGER_SQL = "chr(10) || '### Question:' || chr(10)"
_SYS_SQL = O.q(P.fixed.SYSTEM_PROMPT)
_PROMPT_SQL = f"""pr AS (SELECT *, coalesce(instruction, question, '') AS instruction_text,
coalesce(answer, '') AS answer_text,
CASE split WHEN 'test' THEN '{TEST_IMAGE_DIR}' ELSE '{IMAGE_DIR}' END || '/' || imageId || '.jpg' AS image_path FROM raw),
pr2 AS (SELECT *, {_TRIGGER_SQL} || instruction_text AS user_prompt,
CASE WHEN split IN ('train', 'val') THEN '<think>' || chr(10) || first_cot || chr(10) || '</think>' || chr(10)
  || '<answer>' || chr(10) || answer_text || chr(10) || '</answer>' END AS target_text FROM pr),
pr3 AS (SELECT *, 'system:text=' || {_SYS_SQL} || chr(10) || 'user:image=|text=' || user_prompt
  || CASE WHEN target_text IS NULL THEN '' ELSE chr(10) || 'assistant:text=' || target_text END AS messages_flat,
'<|im_start|>system' || chr(10) || {_SYS_SQL} || '<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || '<|vision_start|><|image_pad|><|vision_end|>' || user_prompt || '<|im_end|>' || chr(10)
  || CASE WHEN target_text IS NULL THEN '' ELSE '<|im_start|>assistant' || chr(10) || target_text || '<|im_end|>' || chr(10) END
  || CASE WHEN split = 'test' THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS chat_text FROM pr2)"""


def raw_samples(spark, sf_dir) -> DataFrame:
    d = TB.read_table(spark, sf_dir, "documents")
    return TB.dealt(SM.derive_raw_samples(d))


def prompts(spark, sf_dir) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    d = F.when(F.col("split") == "test", F.lit(TEST_IMAGE_DIR)).otherwise(F.lit(IMAGE_DIR))
    return P.build_prompts(raw.withColumn("image_dir", d))


def _jsonl_cfg(spark, sf_dir) -> dict:
    """Write the raw samples as JSON Lines split files; return the config."""
    base = scratch_path(spark, "samples-jsonl")
    files = SM.write_jsonl_splits(raw_samples(spark, sf_dir), base)
    return {"image_dir": IMAGE_DIR, "test_image_dir": TEST_IMAGE_DIR,
            "pipeline": {s: {f"{s}_file": files[s]} for s in SM.SPLITS}}


def _p_query(name: str, cols: str, spark_cols: list):
    register(name, O.with_base(_RAW_SQL, _PROMPT_SQL, scored=False) + f"SELECT sample_id, {cols} FROM pr3")(
        lambda spark, sf_dir: prompts(spark, sf_dir).select("sample_id", *spark_cols()))


_p_query("p1_instruction_fallback", "instruction_text", lambda: ["instruction_text"])
_p_query("p2_image_path", "image_path", lambda: ["image_path"])
_p_query("p3_first_cot", "first_cot", lambda: ["first_cot"])
_p_query("p4_answer_default", "answer_text", lambda: ["answer_text"])
_p_query("p5_target_text", "target_text", lambda: ["target_text"])
_p_query("p6_user_prompt", "user_prompt", lambda: ["user_prompt"])
_p_query("p7_messages", "messages_flat", lambda: [P.flatten_messages(F.col("messages")).alias("messages_flat")])
_p_query("p8_render_chat", "chat_text", lambda: ["chat_text"])


@register("s1_read_samples", O.with_base(_RAW_SQL, _FILE_SQL, scored=False)
          + "SELECT sample_id, imageId, instruction, question, n_cot, first_cot, answer, split FROM filed")
def s1(spark, sf_dir):
    df = SM.read_splits(spark, _jsonl_cfg(spark, sf_dir))
    n_cot = F.when(F.col("cot").isNull(), F.lit(-1)).otherwise(F.size("cot"))
    return df.select("sample_id", "imageId", "instruction", "question", n_cot.alias("n_cot"),
                     P.first_cot().alias("first_cot"), "answer", "split")


@register("s6_read_split", O.with_base(_RAW_SQL, _FILE_SQL, scored=False)
          + f"SELECT sample_id, split, CASE split WHEN 'test' THEN '{TEST_IMAGE_DIR}' ELSE '{IMAGE_DIR}' END "
            "AS image_dir FROM filed")
def s6(spark, sf_dir):
    return SM.read_splits(spark, _jsonl_cfg(spark, sf_dir)).select("sample_id", "split", "image_dir")


@register("s2_first_n", O.with_base(_RAW_SQL, _FILE_SQL, scored=False)
          + "SELECT sample_id, imageId FROM filed WHERE split = 'train' ORDER BY sample_id LIMIT 500")
def s2(spark, sf_dir):
    files = _jsonl_cfg(spark, sf_dir)["pipeline"]["train"]["train_file"]
    return SM.first_samples(spark, files, 500, split="train").select("sample_id", "imageId")


@register("p9_rollout_prompts", O.with_base(_RAW_SQL, _FILE_SQL, scored=False)
          + "SELECT sample_id, '<|im_start|>system' || chr(10) || " + _SYS_SQL + " || '<|im_end|>' || chr(10) "
            "|| '<|im_start|>user' || chr(10) || '<|vision_start|><|image_pad|><|vision_end|>' || "
            + _TRIGGER_SQL + " || coalesce(instruction, question, '') || '<|im_end|>' || chr(10) AS prompt, "
            f"'{IMAGE_DIR}/' || imageId || '.jpg' AS image, answer AS ground_truth_answer, "
            "CASE WHEN answer IS NULL THEN 'missing answer' END AS reject "
            "FROM filed WHERE split = 'train'")
def p9(spark, sf_dir):
    return P.rollout_prompts(SM.read_split(spark, _jsonl_cfg(spark, sf_dir), "train"), IMAGE_DIR)


_IMAGES_SQL = ("img AS (SELECT DISTINCT CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR) AS image_id "
               "FROM documents WHERE lang <> 'de')")


def _images(spark, sf_dir) -> DataFrame:
    """The images of non-German documents."""
    docs = TB.read_table(spark, sf_dir, "documents")
    return docs.where(F.col("lang") != "de").select(
        F.floor(F.col("doc_id") / 2).cast("bigint").cast("string").alias("image_id"))


def _manifest_table(spark, sf_dir) -> DataFrame:
    """A manifest as a table, which is how a store with many images lists them."""
    path = scratch_path(spark, "manifest")
    _images(spark, sf_dir).distinct().write.parquet(path)
    return spark.read.parquet(path)


def _manifest(spark, sf_dir) -> DataFrame:
    """Image files written by Spark, and listed again."""
    images = _images(spark, sf_dir)
    path = scratch_path(spark, "images")
    IM.write_image_files(images.select("image_id", F.concat(F.lit("img:"), "image_id").alias("content")), path)
    return IM.image_manifest(spark, path, glob="*.txt", id_pattern=IM.PARTITIONED_ID_PATTERN)


@register("s3_image_manifest", O.with_base(_IMAGES_SQL, scored=False)
          + "SELECT image_id, CAST(length('img:' || image_id) + 1 AS BIGINT) AS length FROM img")
def s3(spark, sf_dir):
    return _manifest(spark, sf_dir).select("image_id", "length")


@register("j1_with_image", O.with_base(_IMAGES_SQL, scored=False)
          + "SELECT sample_id, image_id FROM samples WHERE image_id IN (SELECT image_id FROM img)")
def j1(spark, sf_dir):
    return J.with_image(TB.samples(spark, sf_dir), _manifest_table(spark, sf_dir)).select("sample_id", "image_id")


@register("j1_missing_image", O.with_base(_IMAGES_SQL, scored=False)
          + "SELECT sample_id, image_id FROM samples WHERE image_id NOT IN (SELECT image_id FROM img)")
def j1m(spark, sf_dir):
    return J.missing_image(TB.samples(spark, sf_dir), _manifest_table(spark, sf_dir)).select("sample_id", "image_id")


# ------------------------------------------------------------------ W1-W6, A5, A6, S5

from ..operators import batches as B  # noqa: E402
from ..operators import runs as RU  # noqa: E402

_SHUF_SQL = ("shuf AS (SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' "
             "THEN md5('42:1:' || CAST(sample_id AS VARCHAR)) END, sample_id) AS pos FROM "
             "(SELECT sample_id, CASE sample_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM samples))")
_BATCH_SQL = "CAST(floor((pos - 1) / CASE split WHEN 'train' THEN 8 WHEN 'val' THEN 4 ELSE 2 END) AS BIGINT)"
BATCH_SIZES = {"train": 8, "val": 4, "test": 2}


def _shuffled(spark, sf_dir) -> DataFrame:
    s = TB.samples(spark, sf_dir).select("sample_id", SM.split_of(F.col("sample_id")).alias("split"))
    return B.seeded_shuffle(s, seed=42, epoch=1)


@register("w1_seeded_shuffle", O.with_base(_SHUF_SQL, scored=False) + "SELECT sample_id, split, pos FROM shuf")
def w1(spark, sf_dir):
    return _shuffled(spark, sf_dir)


@register("w2_batch_ids", O.with_base(_SHUF_SQL, scored=False)
          + f"SELECT sample_id, split, pos, {_BATCH_SQL} AS batch_id FROM shuf")
def w2(spark, sf_dir):
    return B.batch_ids(_shuffled(spark, sf_dir), BATCH_SIZES)


@register("w3_shard_ids", O.with_base(_SHUF_SQL, scored=False)
          + f"SELECT sample_id, split, {_BATCH_SQL} AS batch_id, CAST({_BATCH_SQL} % 2 AS INTEGER) AS shard FROM shuf")
def w3(spark, sf_dir):
    return B.shard_ids(B.batch_ids(_shuffled(spark, sf_dir), BATCH_SIZES), 2).select("sample_id", "split", "batch_id", "shard")


@register("s5_write_metrics", O.with_base(scored=False, metrics=True)
          + f"SELECT run_id, epoch, step, name, {O.r6('value')} AS value, ts FROM metrics")
def s5(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    SK.write_metrics(TB.metrics(spark, sf_dir), path)
    m = SK.read_metrics(spark, path)
    return m.select(F.col("run_id").cast("bigint").alias("run_id"), "epoch", "step", "name",
                    r6("value").alias("value"), "ts")


@register("a5_epoch_loss", O.with_base(scored=False, metrics=True)
          + f"SELECT run_id, epoch, {O.r6('avg(value)')} AS loss, count(*) AS n_steps FROM metrics "
            "WHERE name = 'train/batch_loss' GROUP BY run_id, epoch")
def a5(spark, sf_dir):
    e = RU.epoch_loss(TB.metrics(spark, sf_dir))
    return e.select("run_id", "epoch", r6("loss").alias("loss"), "n_steps")


@register("a6_reward_curve", O.with_base()
          + f"SELECT CAST(floor(sample_id / 10) AS BIGINT) AS block, {O.r6('avg(CAST(reward AS DOUBLE))')} AS mean_reward, "
            "count(*) AS n FROM scored GROUP BY 1")
def a6(spark, sf_dir):
    c = RU.reward_curve(scored(spark, sf_dir), "sample_id", 10)
    return c.select("block", r6("mean_reward").alias("mean_reward"), "n")


_PASS_SQL = ("p AS (SELECT run_id, epoch, arg_max(value, step) AS pass_rate FROM metrics "
             "WHERE name = 'test/pass_rate' GROUP BY run_id, epoch), "
             "e AS (SELECT *, max(epoch) OVER (PARTITION BY run_id) AS n_epochs FROM p)")


@register("w4_eval_schedule", O.with_base(_PASS_SQL, scored=False, metrics=True)
          + "SELECT run_id, epoch, CAST(epoch % 2 = 0 OR epoch = n_epochs AS INTEGER) AS should_eval FROM e")
def w4(spark, sf_dir):
    s = RU.eval_schedule(RU.pass_rates(TB.metrics(spark, sf_dir)), eval_freq=2)
    return s.select("run_id", "epoch", F.col("should_eval").cast("int").alias("should_eval"))


_BEST_SQL = ("c AS (SELECT * FROM e WHERE (epoch % 2 = 0 OR epoch = n_epochs) AND epoch % 2 = 0), "
             "w AS (SELECT *, max(pass_rate) OVER (PARTITION BY run_id ORDER BY epoch "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)")


@register("w5_best_checkpoints", O.with_base(_PASS_SQL + ", " + _BEST_SQL, scored=False, metrics=True)
          + f"SELECT run_id, epoch, {O.r6('pass_rate')} AS pass_rate FROM w WHERE prev IS NULL OR pass_rate > prev")
def w5(spark, sf_dir):
    b = RU.best_checkpoints(RU.pass_rates(TB.metrics(spark, sf_dir)), eval_freq=2, save_freq=2)
    return b.select("run_id", "epoch", r6("pass_rate").alias("pass_rate"))


@register("w5_pass_rates_from_outcomes", O.with_base(scored=False, metrics=True)
          + f"SELECT run_id, epoch, {O.r6('avg(value)')} AS pass_rate FROM metrics WHERE name = 'test/sample_ok' "
            "GROUP BY run_id, epoch")
def w5o(spark, sf_dir):
    p = RU.pass_rates_from_outcomes(TB.metrics(spark, sf_dir))
    return p.select("run_id", "epoch", r6("pass_rate").alias("pass_rate"))


@register("w6_checkpoint_name", O.with_base(
    _PASS_SQL + ", " + _BEST_SQL + ", l AS (SELECT run_id, epoch, avg(value) AS loss FROM metrics "
    "WHERE name = 'train/batch_loss' GROUP BY run_id, epoch)", scored=False, metrics=True)
    + f"SELECT w.run_id, w.epoch, {O.r6('w.pass_rate')} AS pass_rate, {O.r6('l.loss')} AS loss, "
      "printf('epoch_%d_loss_%.2f_pass_%.2f', w.epoch, l.loss, w.pass_rate) AS checkpoint "
      "FROM w LEFT JOIN l USING (run_id, epoch) WHERE prev IS NULL OR pass_rate > prev")
def w6(spark, sf_dir):
    n = RU.best_checkpoint_names(TB.metrics(spark, sf_dir), eval_freq=2, save_freq=2)
    return n.select("run_id", "epoch", r6("pass_rate").alias("pass_rate"), r6("loss").alias("loss"), "checkpoint")


# ------------------------------------------------------------------ Q1-Q4

from ..operators import sequences as Q  # noqa: E402

MAX_LEN = 2048

_SEQ_SQL = _PROMPT_SQL + f""",
pt AS (SELECT *, '<|im_start|>system' || chr(10) || {_SYS_SQL} || '<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || '<|vision_start|><|image_pad|><|vision_end|>' || user_prompt || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) AS prompt_text FROM pr3),
tk AS (SELECT sample_id, split, {O.tokens('chat_text')} AS toks, CAST(len({O.tokens('prompt_text')}) AS INTEGER) AS prompt_len FROM pt),
occ AS (SELECT sample_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM tk),
vocab AS (SELECT token, cnt AS count, row_number() OVER (ORDER BY cnt DESC, token) + 1 AS id
          FROM (SELECT token, count(*) AS cnt FROM occ GROUP BY token)),
whole AS (SELECT o.sample_id, list(v.id ORDER BY o.pos) AS ids FROM occ o JOIN vocab v USING (token) GROUP BY o.sample_id),
enc AS (SELECT sample_id, ids[1:{MAX_LEN}] AS ids FROM whole),
padded AS (SELECT *, CASE WHEN split IN ('val', 'test') THEN list_concat(list_transform(range(n_pad), lambda x: 0), ids)
                          ELSE list_concat(ids, list_transform(range(n_pad), lambda x: 0)) END AS padded_ids,
                     CASE WHEN split IN ('val', 'test') THEN list_concat(list_transform(range(n_pad), lambda x: 0), list_transform(ids, lambda x: 1))
                          ELSE list_concat(list_transform(ids, lambda x: 1), list_transform(range(n_pad), lambda x: 0)) END AS attention_mask,
                     CASE WHEN split IN ('val', 'test') THEN n_pad ELSE 0 END AS pad_left
           FROM (SELECT e.sample_id, k.split, k.prompt_len, e.ids, len(e.ids) AS n_real, {MAX_LEN} - len(e.ids) AS n_pad
                 FROM enc e JOIN tk k USING (sample_id)))"""


# Known tokens are those of train rows; the rest have id 1.
_TRAIN_SQL = _SEQ_SQL.replace("(SELECT token, count(*) AS cnt FROM occ GROUP BY token)",
                              "(SELECT token, count(*) AS cnt FROM occ JOIN tk USING (sample_id) WHERE split = 'train' GROUP BY token)") \
    .replace("list(v.id ORDER BY o.pos) AS ids FROM occ o JOIN vocab v", "list(coalesce(v.id, 1) ORDER BY o.pos) AS ids FROM occ o LEFT JOIN vocab v")


def _tokens(spark, sf_dir) -> DataFrame:
    return Q.tokenise(prompts(spark, sf_dir))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ids_str(c) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


@register("q1_token_lengths", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False)
          + f"SELECT sample_id, split, CAST(len({O.tokens('prompt_text')}) AS INTEGER) AS prompt_len, "
            f"CAST(len({O.tokens('chat_text')}) AS INTEGER) AS full_len, "
            f"CAST(len({O.tokens('chat_text')}) > {MAX_LEN} AS INTEGER) AS over_budget FROM pt")
def q1(spark, sf_dir):
    return Q.token_lengths(_tokens(spark, sf_dir), max_length=MAX_LEN) \
        .select("sample_id", "split", "prompt_len", "full_len", "over_budget")


@register("q1_length_summary", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False)
          + f"SELECT split, count(*) AS n, max(full_len) AS max_len, {O.r6('avg(full_len)')} AS avg_len, "
            f"CAST(sum(over_budget) AS BIGINT) AS n_over FROM (SELECT split, CAST(len({O.tokens('chat_text')}) AS INTEGER) "
            f"AS full_len, CAST(len({O.tokens('chat_text')}) > {MAX_LEN} AS INTEGER) AS over_budget FROM pt) GROUP BY split")
def q1s(spark, sf_dir):
    s = Q.length_summary(Q.token_lengths(_tokens(spark, sf_dir), max_length=MAX_LEN), by=("split",))
    return s.select("split", "n", "max_len", r6("avg_len").alias("avg_len"), F.col("n_over").cast("bigint"))


@register("q2_vocabulary", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False) + "SELECT token, count, id FROM vocab")
def q2v(spark, sf_dir):
    return Q.build_vocabulary(_tokens(spark, sf_dir)).select("token", "count", "id")


@register("q2_encode", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False)
          + "SELECT sample_id, array_to_string(ids, ' ') AS input_ids FROM whole")
def q2e(spark, sf_dir):
    coded = Q.code_tokens(_tokens(spark, sf_dir))
    return Q.encode_blocks(coded, Q.build_vocabulary_of(coded)).select("sample_id", _ids_str("input_ids").alias("input_ids"))


@register("q2_encode_unknown", O.with_base(_RAW_SQL, _TRAIN_SQL, scored=False)
          + "SELECT sample_id, array_to_string(ids, ' ') AS input_ids FROM whole")
def q2u(spark, sf_dir):
    """A vocabulary of the train split, as a user's own table without counts, for all splits."""
    t = _written(_tokens(spark, sf_dir), "tokens")
    vocab = Q.build_vocabulary(t.where("split = 'train'")).select("token", "id")
    return Q.encode(t, vocab).select("sample_id", _ids_str("input_ids").alias("input_ids"))


def _seq(spark, sf_dir, mode="default", train_vocab: bool = False) -> DataFrame:
    """As the SEQ job runs it: texts are tokenised once, into coded blocks;
    with a vocabulary of the train split, the token table is written and read twice."""
    if train_vocab:
        t = _written(_tokens(spark, sf_dir), "tokens")
        return Q.build_sequences(t, MAX_LEN, Q.build_vocabulary(t.where("split = 'train'")), mode=mode)
    coded = Q.code_tokens(_tokens(spark, sf_dir), carry=("split", "prompt_len"))
    return Q.pad_sequences(Q.encode_blocks(coded, Q.build_vocabulary_of(coded)), MAX_LEN, mode=mode)


@register("q3_truncate_pad", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False)
          + "SELECT sample_id, array_to_string(padded_ids, ' ') AS padded_ids, "
            "array_to_string(attention_mask, ' ') AS attention_mask FROM padded")
def q3(spark, sf_dir):
    return _seq(spark, sf_dir).select("sample_id", _ids_str("padded_ids").alias("padded_ids"),
                                      _ids_str("attention_mask").alias("attention_mask"))


_LABELS_SQL = ("SELECT sample_id, array_to_string(list_transform(padded_ids, lambda x, i: CASE WHEN split = 'test' THEN -100 "
               "WHEN i - 1 < pad_left THEN -100 WHEN i - 1 - pad_left < prompt_len THEN -100 "
               "WHEN i - 1 - pad_left >= n_real THEN -100 ELSE x END), ' ') AS labels FROM padded")
_COMPATIBLE_SQL = ("SELECT sample_id, array_to_string(list_transform(padded_ids, lambda x, i: CASE WHEN split = 'test' THEN -100 "
                   "WHEN i - 1 < prompt_len THEN -100 ELSE x END), ' ') AS labels FROM padded")


@register("q4_label_mask", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False) + _LABELS_SQL)
def q4(spark, sf_dir):
    return _seq(spark, sf_dir).select("sample_id", _ids_str("labels").alias("labels"))


@register("q4_label_mask_compatible", O.with_base(_RAW_SQL, _SEQ_SQL, scored=False) + _COMPATIBLE_SQL)
def q4c(spark, sf_dir):
    return _seq(spark, sf_dir, mode="compatible").select("sample_id", _ids_str("labels").alias("labels"))


@register("q4_label_mask_unknown", O.with_base(_RAW_SQL, _TRAIN_SQL, scored=False) + _LABELS_SQL)
def q4u(spark, sf_dir):
    return _seq(spark, sf_dir, train_vocab=True).select("sample_id", _ids_str("labels").alias("labels"))


@register("q4_label_mask_unknown_compatible", O.with_base(_RAW_SQL, _TRAIN_SQL, scored=False) + _COMPATIBLE_SQL)
def q4uc(spark, sf_dir):
    return _seq(spark, sf_dir, mode="compatible", train_vocab=True).select("sample_id", _ids_str("labels").alias("labels"))


# ------------------------------------------------------------------ X1-X4, R4, U1

from ..functions import rewards as RW  # noqa: E402
from ..streaming import appends as XA  # noqa: E402
from ..streaming import groups as XG  # noqa: E402
from ..streaming import streams as X  # noqa: E402


def _stream_source(spark, df: DataFrame, name: str, copies: int = 1):
    """Write ``df`` as parquet files (``copies`` deliveries) and open it as a
    file stream with the same schema."""
    src = scratch_path(spark, f"{name}-src")
    for _ in range(copies):
        df.write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).parquet(src)


@register("x1_score_stream", O.with_base()
          + f"SELECT sample_id, gen_idx, pred_think, pred_answer, is_correct, is_consist, {O.r6('reward')} AS reward "
            "FROM scored")
def x1(spark, sf_dir):
    sink = scratch_path(spark, "x1-sink")
    X.run_to_end(X.score_stream(_stream_source(spark, TB.completions(spark, sf_dir), "x1"), sink))
    return spark.read.parquet(sink).select(*KEY, "pred_think", "pred_answer", "is_correct", "is_consist",
                                           r6("reward").alias("reward"))


@register("x2_accuracy_stream", O.with_base(_TAGGED)
          + _rates_outer(f"SELECT tag, {_RATES_SQL} FROM tagged GROUP BY tag", "tag"))
def x2(spark, sf_dir):
    sink = scratch_path(spark, "x2-sink")
    comp = TB.completions(spark, sf_dir)
    comp = comp.withColumn("tag", F.concat(F.lit("g"), F.col("gen_idx").cast("string")))
    X.run_to_end(X.accuracy_stream(_stream_source(spark, comp, "x2"), sink))
    return _round_rates(X.latest_batch(spark, sink))


def _timed(comp: DataFrame) -> DataFrame:
    """Completions with an event time: one second a sample."""
    return comp.withColumn("ts", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                                  + F.make_dt_interval(secs=F.col("sample_id").cast("decimal(18,6)"))))


@register("x3_windowed_mean_stream", O.with_base()
          + "SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 5 MINUTE * CAST(floor(sample_id / 300) AS INTEGER) AS window_start, "
            "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 5 MINUTE * (CAST(floor(sample_id / 300) AS INTEGER) + 1) AS window_end, "
            f"{O.r6('avg(CAST(reward AS DOUBLE))')} AS mean_value, count(reward) AS n FROM scored WHERE reward IS NOT NULL GROUP BY floor(sample_id / 300)")
def x3(spark, sf_dir):
    """Mean reward of scored completions per five minutes of event time, the
    windows that are still open included."""
    sink = scratch_path(spark, "x3-sink")
    rows = _timed(scored(spark, sf_dir)).where("reward IS NOT NULL").select("ts", "reward")
    X.run_to_end(X.windowed_mean_updates(_stream_source(spark, rows, "x3"), sink, window="5 minutes"), allow_late=False)
    out = X.current_windows(spark, sink)
    return out.select(X.instant_to_ntz(F.col("window_start")).alias("window_start"),
                      X.instant_to_ntz(F.col("window_end")).alias("window_end"),
                      r6("mean_value").alias("mean_value"), "n")


@register("x4_dedup_stream", O.with_base()
          + f"SELECT sample_id, gen_idx, is_correct, is_consist, {O.r6('reward')} AS reward FROM scored")
def x4(spark, sf_dir):
    sink = scratch_path(spark, "x4-sink")
    comp = _timed(TB.completions(spark, sf_dir)).select(*KEY, "answer", "completion", "ts")
    X.run_to_end(X.dedup_score_stream(_stream_source(spark, comp, "x4", copies=2), sink,
                                      columns=["is_correct", "is_consist", "reward"]), allow_late=False)
    return X.scored_rows(spark, sink).select(*KEY, "is_correct", "is_consist", r6("reward").alias("reward"))


@register("s5_metrics_stream", O.with_base(scored=False, metrics=True)
          + f"SELECT run_id, epoch, step, name, {O.r6('value')} AS value, ts FROM metrics")
def s5_stream(spark, sf_dir):
    """Metrics appended in twelve micro-batches, parts merged four at a time."""
    src, path, rows = scratch_path(spark, "metrics-src"), scratch_path(spark, "metrics-sink"), TB.metrics(spark, sf_dir)
    rows.repartition(12).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    X.run_to_end(XA.append_stream(stream, path, every=4))
    return XA.appended(spark, path).select(F.col("run_id").cast("bigint").alias("run_id"), "epoch", "step", "name",
                                           r6("value").alias("value"), "ts")


_ARRIVING_SQL = "arriving AS (SELECT sample_id, gen_idx, CAST(reward AS DOUBLE) AS reward FROM scored WHERE NOT (sample_id % 7 = 3 AND gen_idx = 5))"


def _arriving(spark, sf_dir) -> str:
    """The sink of R6 and R7 over scored rows that arrive in three deliveries:
    generations 3 to 5, then 0 to 2, then 0 of every fifth sample again.  Every
    seventh group lacks a generation.  A last row long after the others lets the timers of all groups pass."""
    src, sink, days = scratch_path(spark, "groups-src"), scratch_path(spark, "groups-sink"), 400
    done = _written(scored(spark, sf_dir).select(*KEY, F.col("reward").cast("double")), "rewards")
    rows = _timed(done).where("NOT (sample_id % 7 = 3 AND gen_idx = 5)")
    for part in ("gen_idx >= 3", "gen_idx < 3", "gen_idx = 0 AND sample_id % 5 = 0"):
        rows.where(part).write.mode("append").parquet(src)
    last = spark.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[:-1]],
                                 F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    last.write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    X.run_to_end(XG.advantage_stream(stream, sink, delay_ms=days * 86_400_000), allow_late=False)
    return sink


@register("r6_advantage_stream", O.with_base(
    _ARRIVING_SQL, "g AS (SELECT sample_id, avg(reward) AS m, stddev_samp(reward) AS s FROM arriving GROUP BY sample_id)")
    + f"SELECT sample_id, gen_idx, {O.r6('reward')} AS reward, "
      f"{O.r6('CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE (reward - m) / (s + 1e-4) END')} AS advantage FROM arriving JOIN g USING (sample_id)")
def r6_stream(spark, sf_dir):
    rows = XG.advantages(spark, _arriving(spark, sf_dir)).where("sample_id IS NOT NULL")
    return rows.select(*KEY, r6("reward").alias("reward"), r6("advantage").alias("advantage"))


@register("r7_audit_stream", O.with_base(_ARRIVING_SQL)
          + "SELECT sample_id, count(*) + CAST(sample_id % 5 = 0 AS BIGINT) AS n_rows, count(DISTINCT gen_idx) AS n_gens, "
            f"{O.r6('min(reward)')} AS min_reward, {O.r6('max(reward)')} AS max_reward, "
            "CASE WHEN sample_id % 5 = 0 THEN 'duplicate' WHEN count(DISTINCT gen_idx) < 6 THEN 'missing' "
            "WHEN min(reward) = max(reward) THEN 'flat' ELSE 'ok' END AS status FROM arriving GROUP BY sample_id")
def r7_stream(spark, sf_dir):
    a = XG.audits(spark, _arriving(spark, sf_dir))
    return a.select("sample_id", "n_rows", "n_gens", r6("min_reward").alias("min_reward"), r6("max_reward").alias("max_reward"), "status")


@register("r4_reward_registry", O.with_base()
          + "SELECT sample_id, gen_idx, "
          + O.r6("CAST(CAST(0.0 AS DOUBLE) + format_reward * CAST(0.5 AS DOUBLE) + main_reward AS FLOAT)")
          + " AS total_reward FROM scored")
def r4(spark, sf_dir):
    reg = RW.default_registry()
    total = reg.total({"format": 0.5, "correctness_consistency": 1.0})
    return scored(spark, sf_dir).select(*KEY, r6(total).alias("total_reward"))


def mentions_gold(completions, ground_truth_answer, **_):
    """An example user reward in plain Python: 1.0 when the gold answer
    appears (case-insensitively) in the completion."""
    return [1.0 if g is not None and g.lower() in c.lower() else 0.0
            for c, g in zip(completions, ground_truth_answer)]


@register("u1_python_reward", O.with_base(scored=False)
          + "SELECT sample_id, gen_idx, CASE WHEN contains(lower(coalesce(completion, '')), lower(answer)) "
            "THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS user_reward FROM completions")
def u1(spark, sf_dir):
    c = TB.completions(spark, sf_dir)
    col = RW.python_reward(mentions_gold, "completion", ground_truth_answer="answer")
    return c.select(*KEY, r6(col).alias("user_reward"))


# ------------------------------------------------------------------ A1, A2 separately; Q1 percentiles

@register("a1_accuracy", O.with_base()
          + f"SELECT {O.r6('CASE WHEN count(is_correct) > 0 THEN sum(is_correct) / count(is_correct) ELSE 0.0 END')} "
            "AS accuracy FROM scored")
def a1(spark, sf_dir):
    return E.accuracy_consistency(scored(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


@register("a2_consistency", O.with_base()
          + f"SELECT {O.r6('coalesce(sum(is_consist) / nullif(sum(is_correct), 0), 0.0)')} AS consistency FROM scored")
def a2(spark, sf_dir):
    return E.accuracy_consistency(scored(spark, sf_dir)).select(r6("consistency").alias("consistency"))


_PCT_SQL = (f"fl AS (SELECT split, CAST(len({O.tokens('chat_text')}) AS INTEGER) AS full_len FROM pt), "
            "cd AS (SELECT split, full_len, count(*) OVER (PARTITION BY split ORDER BY full_len "
            "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY split) AS frac FROM fl)")


@register("q1_length_percentiles", O.with_base(_RAW_SQL, _SEQ_SQL + ", " + _PCT_SQL, scored=False)
          + "SELECT split, min(full_len) FILTER (WHERE frac >= 0.5) AS p50, min(full_len) FILTER (WHERE frac >= 0.9) AS p90, "
            "min(full_len) FILTER (WHERE frac >= 0.99) AS p99 FROM cd GROUP BY split")
def q1p(spark, sf_dir):
    lens = Q.token_lengths(_tokens(spark, sf_dir), max_length=MAX_LEN)
    return Q.length_percentiles(lens, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
