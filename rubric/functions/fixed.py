"""Fixed values.

These must equal the studied project's values for results to match; they are
stated plainly, in their natural order, and nothing else in the package
redefines them.
"""

# --- FIXED VALUES: answer synonym groups, in the order the groups are tried ---
SYNONYM_GROUPS: dict[str, list[str]] = {
    "no": ["no", "not", "false", "nope", "negative",
           "cannot", "cant", "incorrect", "couldnt",
           "doesnt", "didnt", "isnt", "arent",
           "wasnt", "werent", "dont", "never", "none", "nothing"],
    "yes": ["yes", "true", "correct", "yep", "positive", "is", "are"],
    "left": ["left", "west"],
    "right": ["right", "east"],
}

# --- FIXED VALUES: completion patterns (regex bodies; flags are added where used) ---
# tolerant: case-insensitive, dot matches newline
THINK_PATTERN = r"<think>\s*(.*?)\s*</think>"
ANSWER_PATTERN = r"<answer>(.*?)(?:</answer>|$)"
# strict (generation-time parser): case-sensitive, dot matches newline
STRICT_THINK_PATTERN = r"<think>\n?(.*?)\n?</think>"
STRICT_ANSWER_PATTERN = r"<answer>\n?(.*?)\n?</answer>"

# --- FIXED VALUES: completion tags ---
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
ANSWER_OPEN = "<answer>"
ANSWER_CLOSE = "</answer>"
TOOL_CALL_TAG = "<tool_call>"
ALLOWED_TAGS = ["think", "answer"]

# --- FIXED VALUES: reward weights ---
FORMAT_TAG_POINTS = 0.2          # per tag present, four tags
CORRECT_POINTS = 2.0
CONSISTENT_BONUS = 0.5
INCONSISTENT_PENALTY = 0.5
LONG_ANSWER_PENALTY = 0.5
LONG_ANSWER_WORDS = 3            # penalised when the answer has more words
WRONG_POINTS = -1.0
EMPTY_ANSWER_POINTS = 0.0

# --- FIXED VALUES: prompt text ---
QUESTION_TRIGGER = "\n### Question:\n"
SYSTEM_PROMPT = (
    "You are an expert visual reasoning assistant. "
    "You will be provided with an image and some questions related to its content. "
    "First, generate a detailed, step-by-step chain of thought, "
    "and enclose this reasoning process within <think> tags. "
    "After your reasoning, provide a concise final answer and enclose it within <answer> tags.\n"
    "Your reasoning may involve these operators:\n"
    "- SELECT(object): Focus on a specific object in the image.\n"
    "- RELATE(object, relationship): Find objects related to the main object.\n"
    "- QUERY(attribute): Query specific attributes of the object.\n\n"
    "Strict output requirements:\n"
    "1. Do NOT use <tool_call> or any tags other than <think> and <answer>.\n"
    "2. Always wrap your reasoning inside <think>...</think>.\n"
    "3. Always wrap your final answer inside <answer>...</answer>.\n"
    "4. Present all reasoning steps and the final answer in English.\n"
)
TARGET_FORMAT = "<think>\n{cot}\n</think>\n<answer>\n{answer}\n</answer>"
IMAGE_SUFFIX = ".jpg"

# --- FIXED VALUES: sequences, runs and groups ---
LABEL_PAD_ID = -100
GROUP_SIZE = 6                   # generations per prompt
RL_FIRST_N = 500                 # rows the RL stage reads
CHECKPOINT_NAME = "epoch_{epoch}_loss_{loss:.2f}_pass_{pass_rate:.2f}"
METRIC_BATCH_LOSS = "train/batch_loss"
METRIC_EPOCH_LOSS = "train/epoch_loss"
METRIC_PASS_RATE = "test/pass_rate"
METRIC_SAMPLE_OK = "test/sample_ok"      # our own: one 0/1 outcome per test sample
