"""DuckDB SQL for the same rules, used as the correctness oracle.

DuckDB's regex engine (RE2) has an ASCII-only ``\\s``, so the whitespace
class lists Python's whitespace set explicitly.  Literals that must be
doubles are cast, since DuckDB reads ``0.2`` as a DECIMAL.
"""

from __future__ import annotations

from ..functions import fixed

WS = (r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def think(x: str) -> str:
    return strip(f"regexp_extract({x}, {q('(?is)' + fixed.THINK_PATTERN)}, 1)")


def answer(x: str) -> str:
    return strip(f"regexp_extract({x}, {q('(?is)' + fixed.ANSWER_PATTERN)}, 1)")


def strict_cot(x: str) -> str:
    pt, pa = q("(?s)" + fixed.STRICT_THINK_PATTERN), q("(?s)" + fixed.STRICT_ANSWER_PATTERN)
    return (f"CASE WHEN regexp_matches({x}, {pt}) THEN {strip(f'regexp_extract({x}, {pt}, 1)')} "
            f"WHEN regexp_matches({x}, {pa}) THEN '' ELSE {strip(x)} END")


def strict_answer(x: str) -> str:
    pa = q("(?s)" + fixed.STRICT_ANSWER_PATTERN)
    return f"CASE WHEN regexp_matches({x}, {pa}) THEN {strip(f'regexp_extract({x}, {pa}, 1)')} ELSE '' END"


def _lit_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def group_name(gc: str) -> str:
    parts = " ".join(f"WHEN list_contains({_lit_list(ws)}, {gc}) THEN {q(n)}"
                     for n, ws in fixed.SYNONYM_GROUPS.items())
    return f"CASE {parts} END"


def match(pc: str, pt: str, gc: str) -> str:
    parts = " ".join(f"WHEN list_contains({_lit_list(ws)}, {gc}) THEN list_has_any({pt}, {_lit_list(ws)})"
                     for ws in fixed.SYNONYM_GROUPS.values())
    return f"(CASE WHEN {pc} = {gc} THEN true {parts} ELSE list_contains({pt}, {gc}) END)"


def format_reward(x: str) -> str:
    terms = " + ".join(f"CASE WHEN contains({x}, {q(t)}) THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
                       for t in (fixed.THINK_OPEN, fixed.THINK_CLOSE, fixed.ANSWER_OPEN, fixed.ANSWER_CLOSE))
    return f"(CAST(0.0 AS DOUBLE) + {terms})"


def r6(x: str) -> str:
    """``x`` rounded to six digits as floor(x * 1e6 + 0.5) / 1e6, the form
    Spark computes too (``functions.numeric.round_half_up``), so six-digit
    values compare exactly."""
    d = f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN abs({d}) < 1e12 THEN floor({d} * 1e6 + 0.5) / 1e6 ELSE {d} END)"


# ------------------------------------------------------------ derivations

SAMPLES = """SELECT doc_id AS sample_id, CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR) AS image_id,
text AS question,
CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'left' WHEN 3 THEN 'right' WHEN 4 THEN 'Red' ELSE 'red car' END AS answer,
CASE WHEN doc_id % 10 = 9 THEN NULL ELSE text END AS cot_text FROM documents"""

COMPLETIONS = """SELECT sample_id, image_id, question, answer, gen_idx,
CASE k
WHEN 0 THEN '<think>' || chr(10) || 'I see ' || answer || ', ' || question || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || answer || '.' || chr(10) || '</answer>'
WHEN 1 THEN '<think>' || question || '</think><answer>purple</answer>'
WHEN 2 THEN '<think>xyzzy</think><answer>' || answer || '</answer>'
WHEN 3 THEN '<think>so ' || answer || '</think><answer>It must surely be ' || answer || '</answer>'
WHEN 4 THEN '<answer>' || answer || '</answer>'
WHEN 5 THEN '<think>so ' || answer || '</think><answer>' || answer || chr(10)
WHEN 6 THEN '<THINK>so ' || answer || '</THINK><ANSWER>' || upper(answer) || '</ANSWER>'
WHEN 7 THEN question
WHEN 8 THEN '<think>true, not west or east</think><answer>true, not west or east</answer>'
WHEN 9 THEN '<think>so ' || answer || '</think><answer> </answer>'
WHEN 10 THEN '<tool_call>x</tool_call><think>so ' || answer || '</think><answer>' || answer || '</answer>'
ELSE '<answer>' || answer || '</answer><answer>purple</answer>' END AS completion
FROM (SELECT *, (sample_id * 7 + gen_idx * 5) % 12 AS k
      FROM (SELECT sample_id, image_id, question, answer, CAST(unnest(range(6)) AS INTEGER) AS gen_idx FROM samples))"""

METRICS = """SELECT user_id % 5 AS run_id, 1 + event_id % 12 AS epoch, event_id AS step,
CASE event_type WHEN 'view' THEN 'train/batch_loss' WHEN 'click' THEN 'test/pass_rate' WHEN 'purchase' THEN 'train/epoch_loss'
  WHEN 'signup' THEN 'test/sample_ok' ELSE event_type END AS name,
CASE event_type WHEN 'click' THEN value / (value + 10) WHEN 'signup' THEN CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END ELSE value END AS value,
ts FROM events"""


def scored_ctes(source: str = "completions", gold: str = "answer", prefix: str = "p",
                out: str = "scored") -> str:
    """CTE chain that scores ``source`` into ``out`` (same stages as Spark)."""
    p = prefix
    return f"""{p}1 AS (SELECT *, coalesce(completion, '') AS txt FROM {source}),
{p}2 AS (SELECT *, {think('txt')} AS pred_think, {answer('txt')} AS pred_answer,
       {clean(gold)} AS gold_clean, {format_reward('txt')} AS format_reward FROM {p}1),
{p}3 AS (SELECT *, {clean('pred_answer')} AS ans_clean, {clean('pred_think')} AS think_clean,
       len({tokens('pred_answer')}) AS ans_words FROM {p}2),
{p}4 AS (SELECT *, {match('ans_clean', tokens('ans_clean'), 'gold_clean')} AS ans_ok,
       {match('think_clean', tokens('think_clean'), 'gold_clean')} AS think_ok FROM {p}3),
{p}5 AS (SELECT *, CAST(ans_ok AS INTEGER) AS is_correct,
       CASE WHEN {gold} IS NULL THEN NULL WHEN ans_ok THEN CAST(think_ok AS INTEGER) ELSE 0 END AS is_consist,
       CAST(ans_words <= 3 AS INTEGER) AS is_concise,
       CASE WHEN {gold} IS NULL THEN NULL
            WHEN pred_answer = '' THEN CAST(0.0 AS DOUBLE)
            WHEN NOT ans_ok THEN CAST(-1.0 AS DOUBLE)
            ELSE CAST(2.0 AS DOUBLE)
                 + CASE WHEN pred_think <> '' THEN CASE WHEN think_ok THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END ELSE CAST(0.0 AS DOUBLE) END
                 - CASE WHEN ans_words > 3 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END AS main_reward
       FROM {p}4),
{out} AS (SELECT *, CAST(format_reward + main_reward AS FLOAT) AS reward FROM {p}5)"""


def with_base(*extra_ctes: str, scored: bool = True, metrics: bool = False) -> str:
    ctes = [f"samples AS ({SAMPLES})", f"completions AS ({COMPLETIONS})"]
    if scored:
        ctes.append(scored_ctes())
    if metrics:
        ctes.append(f"metrics AS ({METRICS})")
    ctes.extend(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n"
