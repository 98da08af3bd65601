"""SEQ job: rendered prompts -> token lengths, ids, padded sequences and
label masks (Q1-Q4).

The model tokenizer is an argument (a ``Column -> array<string>`` function);
the default splits on whitespace.  ``tokenise`` makes the token columns; a
job writes them once and the steps read them (``plans.jobs.sequences_job``).
The vocabulary is built by Spark: token counts (partial + final aggregate),
then ids by rank of (count desc, token) through the distributed
``global_index`` - no single-task sort - or given by the user.  Texts are
encoded in blocks with dictionaries of their own (``blocks``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens as whitespace_tokens
from ..session import scratch_path
from . import blocks
from .batches import global_index

Tokenizer = Callable[[Column], Column]
PAD_ID = 0
UNK_ID = 1          # tokens that the vocabulary lacks
FIRST_ID = 2        # ids of real tokens start here


def tokenise(df: DataFrame, prompt: str = "prompt_text", full: str = "chat_text",
             tokenizer: Tokenizer = whitespace_tokens, carry: tuple[str, ...] = ("sample_id", "split")) -> DataFrame:
    """Token arrays of the full text, and the prompt's number of tokens."""
    return df.select(*carry, tokenizer(F.col(full)).alias("tokens"), F.size(tokenizer(F.col(prompt))).alias("prompt_len"))


def token_lengths(tokens: DataFrame, max_length: int = 2048) -> DataFrame:
    """Q1: prompt and full lengths, and whether the full text is over budget."""
    s = tokens.select(*[c for c in tokens.columns if c != "tokens"], F.size("tokens").alias("full_len"))
    return s.select("*", (F.col("full_len") > F.lit(max_length)).cast("int").alias("over_budget"))


def length_summary(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Q1 summary."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max("full_len").alias("max_len"),
            F.avg("full_len").alias("avg_len"), F.sum("over_budget").alias("n_over")]
    return (lengths.groupBy(*by) if by else lengths.groupBy()).agg(*aggs)


def length_percentiles(lengths: DataFrame, fractions: dict[str, float], by: str = "split") -> DataFrame:
    """Q1: for each name the least length that the fraction of rows doesn't
    exceed - exact at any size: the rows are first counted per length, and
    the running sums are over distinct lengths."""
    counts = lengths.groupBy(by, "full_len").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    upto = F.sum("n").over(w.orderBy("full_len").rowsBetween(Window.unboundedPreceding, 0))
    share = counts.select(by, "full_len", (upto / F.sum("n").over(w)).alias("share"))
    return share.groupBy(by).agg(*[F.min(F.when(F.col("share") >= f, F.col("full_len"))).alias(name) for name, f in fractions.items()])


def build_vocabulary(tokens: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """Q2: (token, count, id) ranked by count desc, then token."""
    counts = (tokens.select(F.explode("tokens").alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    return rank_vocabulary(counts, first_id)


def rank_vocabulary(counts: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """Ids by rank.  The counts are written first: the sort samples them for
    its ranges and then reads them, and neither should count the corpus."""
    path = scratch_path(counts.sparkSession, "token-counts")
    counts.write.parquet(path)
    written = counts.sparkSession.read.parquet(path)
    return global_index(written, [F.col("count").desc(), F.col("token").asc()], name="id", base=first_id)


def code_tokens(tokens: DataFrame, key: str = "sample_id", max_length: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Q2: coded blocks (``blocks``) of whole texts, or of their first
    ``max_length`` tokens (Q3).  A NULL key stops the job: such a sequence
    belongs to no sample.  ``build_vocabulary_of`` and ``encode_blocks`` read
    them, so a job that needs both tokenises once."""
    toks = F.col("tokens") if max_length is None else F.slice("tokens", 1, max_length)
    known = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL {key}: a sequence needs the id of its sample"))) \
        .otherwise(F.col(key)).alias(key)
    return blocks.code_blocks(tokens.select(known, *carry, toks.alias("tokens")), carry=(key, *carry))


def build_vocabulary_of(coded: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """``build_vocabulary`` from coded blocks of whole texts."""
    return rank_vocabulary(blocks.token_counts(coded), first_id)


def encode_blocks(coded: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID) -> DataFrame:
    """Q2: the key, the carried columns and ``input_ids`` of coded blocks."""
    carry = tuple(c for c in coded.columns if c not in blocks.OWN)
    return blocks.decode_blocks(coded, blocks.block_ids(coded, vocab, unk_id), carry, unk_id)


def encode(tokens: DataFrame, vocab: DataFrame, key: str = "sample_id", max_length: int | None = None,
           carry: tuple[str, ...] = (), unk_id: int = UNK_ID) -> DataFrame:
    """Q2: token ids in text order, of whole texts unless ``max_length`` cuts
    them (Q3).  A token that ``vocab`` (token, id) lacks gets ``unk_id``, so
    positions stay.  A NULL key stops the job; rows that repeat a key stay
    apart.  ``carry`` columns ride along."""
    return encode_blocks(code_tokens(tokens, key, max_length, carry), vocab, unk_id)


def truncate_pad(ids: Column, max_length: int, left: Column, pad_id: int = PAD_ID) -> tuple[Column, Column]:
    """Q3: cut to ``max_length``, pad on the left (``left`` true: val/test)
    or right (train).  Returns (padded ids, attention mask)."""
    t = F.slice(ids, 1, max_length)
    n_pad = F.lit(max_length) - F.size(t)
    pads = F.array_repeat(F.lit(pad_id), n_pad)
    ones = F.array_repeat(F.lit(1), F.size(t))
    zeros = F.array_repeat(F.lit(0), n_pad)
    padded = F.when(left, F.concat(pads, t)).otherwise(F.concat(t, pads))
    mask = F.when(left, F.concat(zeros, ones)).otherwise(F.concat(ones, zeros))
    return padded, mask


def label_mask(padded: Column, n_real: Column, n_pad_left: Column, prompt_len: Column, no_labels: Column,
               mode: str = "default") -> Column:
    """Q4: training labels.

    default: -100 on the prompt where it really sits (after any left pads),
    on every pad, and everywhere when ``no_labels`` (test rows).
    compatible: the studied behaviour - the first ``prompt_len`` positions
    become -100 whatever the padding side, pads keep the pad id.
    """
    ign, n, zero = F.lit(fixed.LABEL_PAD_ID), F.size(padded), F.lit(0)
    if mode == "compatible":
        first, end = prompt_len, n
    elif mode == "default":
        first, end = F.greatest(n_pad_left, n_pad_left + prompt_len), n_pad_left + n_real
    else:
        raise ValueError(mode)
    # The labels are one run of the ids, with the ignored ones around it: no function of each place.
    first = F.least(F.greatest(first, zero), n)
    end = F.greatest(F.least(end, n), first)
    run = F.concat(F.array_repeat(ign, first), F.slice(padded, first + 1, end - first), F.array_repeat(ign, n - end))
    return F.when(no_labels, F.array_repeat(ign, n)).otherwise(run)


def build_sequences(tokens: DataFrame, max_length: int, vocab: DataFrame,
                    split: str = "split", mode: str = "default") -> DataFrame:
    """The SEQ job over token arrays (``tokenise``): ids, attention mask and
    labels per sample (train pads right, val/test pad left; test rows carry
    no labels)."""
    enc = encode(tokens, vocab, max_length=max_length, carry=(split, "prompt_len"))
    return pad_sequences(enc, max_length, split, mode)


def pad_sequences(enc: DataFrame, max_length: int, split: str = "split", mode: str = "default") -> DataFrame:
    """Q3 and Q4 of encoded rows (``input_ids``, the split and ``prompt_len``)."""
    enc = enc.withColumn("input_ids", F.slice("input_ids", 1, max_length))
    left = F.col(split).isin("val", "test")
    padded, mask = truncate_pad(F.col("input_ids"), max_length, left)
    s = enc.select("*", padded.alias("padded_ids"), mask.alias("attention_mask"),
                   F.size("input_ids").alias("n_real"))
    n_pad_left = F.when(left, F.lit(max_length) - F.col("n_real")).otherwise(F.lit(0))
    return s.select("*", label_mask(F.col("padded_ids"), F.col("n_real"), n_pad_left, F.col("prompt_len"),
                                    F.col(split) == "test", mode).alias("labels"))
