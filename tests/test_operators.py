"""Edge cases for groups, checkpoints, JSONL, sequences and plans
(FIXTURES.md section 3), on hand-made rows."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tables_at import SF_SMALL
from rubric.operators import batches as B
from rubric.operators import evaluation as E
from rubric.operators import groups as G
from rubric.operators import prompts as P
from rubric.operators import runs as RU
from rubric.operators import scoring as S
from rubric.operators import sequences as Q
from rubric.plans import catalog
from rubric.sources import images as IM
from rubric.sources import samples as SM


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ R6 / R7

def test_group_advantage_cases(spark):
    rows = [(1, 0, 2.0), (1, 1, 2.0),               # equal rewards -> 0
            (2, 0, 1.0),                            # one row -> 0
            (3, 0, 0.0), (3, 1, 1.0), (3, 2, 2.0)]  # spread
    df = spark.createDataFrame(rows, "sample_id long, gen_idx int, reward double")
    out = {(r.sample_id, r.gen_idx): r.advantage for r in G.group_advantage(df).collect()}
    assert out[(1, 0)] == 0.0 and out[(1, 1)] == 0.0 and out[(2, 0)] == 0.0
    assert out[(3, 0)] == pytest.approx(-1.0 / (1.0 + 1e-4))
    assert sum(v for k, v in out.items() if k[0] == 3) == pytest.approx(0.0, abs=1e-12)
    mean_only = {(r.sample_id, r.gen_idx): r.advantage
                 for r in G.group_advantage(df, scale_rewards=False).collect()}
    assert mean_only[(3, 2)] == 1.0 and mean_only[(2, 0)] == 0.0


def test_group_audit_statuses(spark):
    rows = [(1, g, float(g)) for g in range(6)]                     # ok
    rows += [(2, g, 1.0) for g in range(6)]                          # flat
    rows += [(3, g, float(g)) for g in range(5)]                     # missing
    rows += [(4, g, float(g)) for g in range(6)] + [(4, 0, 0.0)]     # duplicate
    df = spark.createDataFrame(rows, "sample_id long, gen_idx int, reward double")
    st = {r.sample_id: r.status for r in G.group_audit(df).collect()}
    assert st == {1: "ok", 2: "flat", 3: "missing", 4: "duplicate"}


def test_advantage_plan_pre_aggregates(spark):
    """R6 is a partial+final aggregate joined back, not a window."""
    df = catalog.QUERIES["r6_group_advantage"](spark, SF_SMALL)
    plan = _plan(df)
    assert "Window" not in plan
    assert "HashAggregate" in plan


# ------------------------------------------------------------------ W5 / W6

def test_best_checkpoint_cases(spark):
    # run 0: epoch 2 first saved (kept), epoch 4 ties (not kept), epoch 6 better (kept)
    # run 1: last epoch 5 is evaluated but not a save epoch
    rates = spark.createDataFrame(
        [(0, 1, 0.1), (0, 2, 0.5), (0, 3, 0.9), (0, 4, 0.5), (0, 6, 0.7),
         (1, 2, 0.3), (1, 5, 0.9)], "run_id long, epoch long, pass_rate double")
    best = sorted((r.run_id, r.epoch) for r in RU.best_checkpoints(rates, 2, 2).collect())
    assert best == [(0, 2), (0, 6), (1, 2)]
    sched = {(r.run_id, r.epoch): r.should_eval for r in RU.eval_schedule(rates, 2).collect()}
    assert sched[(1, 5)] is True and sched[(0, 3)] is False


def test_checkpoint_name_rounds_like_python(spark):
    df = spark.createDataFrame([(4, 0.125, 1.005), (6, 2.675, 0.135)], "epoch int, loss double, p double")
    names = [r.n for r in df.select(RU.checkpoint_name(F.col("epoch"), F.col("loss"), F.col("p")).alias("n"))
             .orderBy("epoch").collect()]
    assert names == ["epoch_4_loss_%.2f_pass_%.2f" % (0.125, 1.005),
                     "epoch_6_loss_%.2f_pass_%.2f" % (2.675, 0.135)]


# ------------------------------------------------------------------ S1 / S2

def test_jsonl_cases(spark):
    d = tempfile.mkdtemp(prefix="rubric-jsonl-")
    lines = [json.dumps({"sample_id": 1, "imageId": "a", "question": "q1", "answer": "yes"}),   # cot absent
             "",                                                                                # blank line
             json.dumps({"sample_id": 2, "imageId": "b", "question": "q2", "cot": [], "answer": "no"}),
             json.dumps({"sample_id": 3, "imageId": "c", "instruction": "i3", "question": "q3",
                         "cot": [{"text": "c3"}, {"text": "x"}]}),
             json.dumps({"sample_id": 4, "imageId": "d"})]                                      # neither key
    with open(os.path.join(d, "train.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")
    df = SM.read_samples(spark, d, split="train")
    out = df.select("sample_id", P.instruction().alias("ins"), P.first_cot().alias("cot"),
                    P.answer_or_empty().alias("ans")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.ins, r.cot, r.ans) for r in out] == [
        (1, "q1", "", "yes"), (2, "q2", "", "no"), (3, "i3", "c3", ""), (4, "", "", "")]
    first2 = [r.sample_id for r in SM.first_n(df, 2).collect()]
    assert first2 == [1, 2]


def test_jsonl_malformed_line(spark):
    d = tempfile.mkdtemp(prefix="rubric-jsonl-bad-")
    with open(os.path.join(d, "x.jsonl"), "w") as f:
        f.write('{"sample_id": 1}\n{not json\n')
    with pytest.raises(Exception):
        SM.read_samples(spark, d).collect()
    rows = SM.read_samples(spark, d, mode="PERMISSIVE").select("sample_id", "_corrupt_record").collect()
    assert sorted((r.sample_id, r._corrupt_record) for r in rows if r._corrupt_record) == [(None, "{not json")]


# ------------------------------------------------------------------ S3 / J1

def test_image_manifest_reads_no_content(spark):
    d = tempfile.mkdtemp(prefix="rubric-img-")
    for i in ("10", "11"):
        with open(os.path.join(d, f"{i}.jpg"), "wb") as f:
            f.write(b"\xff\xd8" + i.encode())
    m = IM.image_manifest(spark, d)
    assert sorted(r.image_id for r in m.collect()) == ["10", "11"]
    assert "content" not in _plan(m).split("ReadSchema")[-1].split("\n")[0]


# ------------------------------------------------------------------ Q3 / Q4

def test_truncate_pad_and_masks(spark):
    rows = [("train", [1, 2, 3], 1), ("val", [1, 2, 3], 1), ("train", [1, 2, 3, 4, 5, 6], 2),
            ("test", [1, 2], 2), ("train", [1, 2, 3], 7)]
    df = spark.createDataFrame(rows, "split string, ids array<int>, plen int")
    left = F.col("split").isin("val", "test")
    padded, mask = Q.truncate_pad(F.col("ids"), 5, left)
    s = df.select("*", padded.alias("p"), mask.alias("m"), F.size(F.slice("ids", 1, 5)).alias("n"))
    npl = F.when(left, F.lit(5) - F.col("n")).otherwise(F.lit(0))
    s = s.select("*", Q.label_mask(F.col("p"), F.col("n"), npl, F.col("plen"), F.col("split") == "test").alias("l"),
                 Q.label_mask(F.col("p"), F.col("n"), npl, F.col("plen"), F.col("split") == "test",
                              mode="compatible").alias("lc"))
    got = [(r.p, r.m, r.l, r.lc) for r in s.collect()]
    assert got[0] == ([1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [-100, 2, 3, -100, -100], [-100, 2, 3, 0, 0])
    assert got[1] == ([0, 0, 1, 2, 3], [0, 0, 1, 1, 1], [-100, -100, -100, 2, 3], [-100, 0, 1, 2, 3])
    assert got[2] == ([1, 2, 3, 4, 5], [1] * 5, [-100, -100, 3, 4, 5], [-100, -100, 3, 4, 5])
    assert got[3][2] == [-100] * 5
    assert got[4][2] == [-100] * 5          # prompt longer than the limit


# ------------------------------------------------------------------ W1 / W2

def test_unknown_tokens_keep_positions_and_labels(spark):
    """A user's vocabulary without counts; 'zz' isn't in it."""
    p = spark.createDataFrame([(1, "train", "zz q1 q2", "zz q1 q2 a b"), (2, "train", "", "")],
                              "sample_id long, split string, prompt_text string, chat_text string")
    vocab = spark.createDataFrame([("q1", 2), ("q2", 3), ("a", 4), ("b", 5)], "token string, id long")
    out = {r.sample_id: r for r in Q.build_sequences(Q.tokenise(p), 6, vocab).collect()}
    assert out[1].padded_ids == [1, 2, 3, 4, 5, 0] and out[1].labels == [-100, -100, -100, 4, 5, -100]
    assert out[2].padded_ids == [0] * 6 and out[2].labels == [-100] * 6


def test_null_keys_stop_the_encoding(spark):
    t = spark.createDataFrame([(None, "train", ["a"], 0)], "sample_id long, split string, tokens array<string>, prompt_len int")
    with pytest.raises(Exception, match="NULL sample_id"):
        Q.encode(t, spark.createDataFrame([("a", 2)], "token string, id long")).collect()


def test_null_keys_and_rewards_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (1, 0, 2.0), (1, 1, None), (2, 0, None), (3, 0, 1.0), (3, 1, 2.0)],
                               "sample_id long, gen_idx int, reward double")
    out = G.group_advantage(df, scale_rewards=False).collect()
    assert sorted((str(r.sample_id), r.gen_idx, r.advantage) for r in out) == [
        ("1", 0, 0.0), ("1", 1, None), ("2", 0, None), ("3", 0, -0.5), ("3", 1, 0.5), ("None", 0, None), ("None", 1, None)]


def test_files_without_ids_get_stable_ids(spark):
    d = tempfile.mkdtemp(prefix="rubric-noid-")
    for split, names in {"train": ("a", "b"), "val": ("c",), "test": ("d",)}.items():
        os.makedirs(f"{d}/{split}")
        for f in names:
            with open(f"{d}/{split}/{f}.jsonl", "w") as out:
                out.writelines(json.dumps({"imageId": f"{f}{i}", "question": "q" * (i % 50)}) + "\n" for i in range(200))
    cfg = {"pipeline": {s: {f"{s}_file": f"{d}/{s}"} for s in SM.SPLITS}}
    want = [f"{f}{i}" for f in "abcd" for i in range(200)]
    for size in ("128m", "2k"):  # whole files, and many splits of a file
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = SM.read_splits(spark, cfg).select("sample_id", "imageId").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [r.imageId for r in sorted(rows)] == want and [r.sample_id for r in sorted(rows)] == list(range(800))


def test_cli_prompts_then_sequences_on_files_without_ids(spark):
    from rubric.plans import cli
    d = tempfile.mkdtemp(prefix="rubric-cli-")
    with open(f"{d}/train.jsonl", "w") as f:
        f.writelines(json.dumps({"imageId": str(i), "question": f"what is {i}", "cot": [{"text": "so"}], "answer": "yes"}) + "\n"
                     for i in range(40))
    with open(f"{d}/cfg.json", "w") as f:
        json.dump({"image_dir": "/i", "pipeline": {"train": {"train_file": f"{d}/train.jsonl"}}}, f)
    cli.main(["prompts", "--samples-config", f"{d}/cfg.json", "--out", f"{d}/prompts"])
    cli.main(["sequences", "--prompts", f"{d}/prompts", "--out", f"{d}/seq", "--max-length", "512"])
    assert spark.read.parquet(f"{d}/seq/sequences").select("sample_id").distinct().count() == 40
    cli.main(["rollouts", "--samples-config", f"{d}/cfg.json", "--out", f"{d}/rollouts", "--generations", "3"])
    assert spark.read.parquet(f"{d}/rollouts").count() == 120


def test_gold_pairing_reports_both_sides(spark):
    from rubric.operators import joins as J
    gold = spark.createDataFrame([(1, "yes"), (1, "yes"), (2, "no"), (2, None), (3, "left"), (None, "x")], "sample_id long, gt_answer string")
    comp = spark.createDataFrame([(1, 0), (2, 0), (None, 0), (9, 0)], "sample_id long, gen_idx int")
    unique = J.unique_gold(gold)
    assert sorted(map(tuple, unique.collect())) == [(1, "yes"), (3, "left")]
    assert [tuple(r) for r in J.duplicate_gold(gold).collect()] == [(2, 2)]
    assert [tuple(r) for r in J.attach_gold(comp, unique).collect()] == [(1, 0, "yes")]
    assert sorted((str(r[0]) for r in J.unmatched_completions(comp, unique).collect())) == ["2", "9", "None"]
    assert sorted((str(r[0]) for r in J.unmatched_gold(gold, comp).collect())) == ["3", "None"]


def test_eval_job_on_rendered_instructions(spark):
    """The completion table as a generation job writes it: image, rendered instruction, completion, tag."""
    from rubric.plans import jobs
    from rubric.session import scratch_path
    comp = spark.createDataFrame([(1, "7", "\n### Question:\nis it?", "<answer>yes</answer>", "e1"), (5, "8", "x", "y", "e1")],
                                 "sample_id long, image_id string, instruction string, completion string, tag string")
    gold = spark.createDataFrame([(1, "yes"), (2, "no")], "sample_id long, gt_answer string")
    out = scratch_path(spark, "eval-rendered")
    res = jobs.eval_job(spark, comp, gold, out)
    assert [(r.n, r.n_correct) for r in res["rates"].collect()] == [(1, 1)]
    assert [r.sample_id for r in spark.read.parquet(f"{out}/unmatched").collect()] == [5]
    assert [r.sample_id for r in spark.read.parquet(f"{out}/unmatched_gold").collect()] == [2]
    report = spark.read.json(f"{out}/report").collect()
    assert [r.instruction for r in report] == ["\n### Question:\nis it?"]


def test_checkpoints_need_the_recorded_metrics(spark):
    m = spark.createDataFrame([(0, 2, 1, "other", 0.5)], "run_id long, epoch long, step long, name string, value double")
    with pytest.raises(ValueError, match="test/pass_rate"):
        RU.require_metrics(m, "test/pass_rate")
    rows = [(0, e, s, "test/pass_rate", v) for e, s, v in ((2, 1, 0.5), (4, 2, 0.5000003), (6, 3, 0.9), (6, 4, 0.2))]
    best = RU.best_checkpoints(RU.pass_rates(spark.createDataFrame(rows, m.schema)), 2, 2).collect()
    assert sorted((r.epoch, r.pass_rate) for r in best) == [(2, 0.5), (4, 0.5000003)]


def test_scratch_is_shared_and_cleared(spark):
    from rubric import session
    mark = session.scratch_mark()
    path = session.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark, mark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path)

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_global_index_is_distributed_and_dense(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "sample_id")
    idx = B.global_index(df.withColumn("k", F.md5(F.col("sample_id").cast("string"))), ["k", "sample_id"],
                         "pos", base=1)
    plan = _plan(idx)
    # the only single-partition step is the offsets window over the per-partition
    # row counts (one row per partition), never the data rows
    for seg in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[_pid" in seg.split("\n")[1]
    rows = idx.collect()
    assert sorted(r.pos for r in rows) == list(range(1, 1001))
    by_key = sorted(rows, key=lambda r: (r.k, r.sample_id))
    assert [r.pos for r in by_key] == list(range(1, 1001))


def test_seeded_shuffle_keeps_other_splits(spark):
    df = spark.createDataFrame([(i, "train" if i < 6 else "test") for i in range(10)], "sample_id long, split string")
    out = {r.sample_id: r.pos for r in B.seeded_shuffle(df, 42, 1).collect()}
    assert [out[i] for i in range(6, 10)] == [1, 2, 3, 4]
    assert sorted(out[i] for i in range(6)) == [1, 2, 3, 4, 5, 6]
    b = B.batch_ids(spark.createDataFrame([(i,) for i in range(1, 11)], "pos long"), 4)
    assert [r.batch_id for r in b.orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


# ------------------------------------------------------------------ W7, A7

def test_worst_samples_plan_limits_groups(spark):
    df = catalog.QUERIES["w7_worst_samples"](spark, SF_SMALL)
    assert "WindowGroupLimit" in _plan(df)


def test_model_comparison_delta(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 1), ("b", 1, 0)],
                               "model string, is_correct int, is_consist int")
    out = {r.model: r for r in E.model_comparison(df, "model", baseline="a").collect()}
    assert out["a"].accuracy_delta == 0.0
    assert out["b"].accuracy_delta == pytest.approx(0.5)
    assert out["b"].consistency_delta == pytest.approx(-0.5)


# ------------------------------------------------------------------ streams = batch

def test_score_stream_equals_batch(spark):
    got = sorted(tuple(r) for r in catalog.QUERIES["x1_score_stream"](spark, SF_SMALL).collect())
    batch = catalog.scored(spark, SF_SMALL).select(*catalog.KEY, "pred_think", "pred_answer", "is_correct",
                                                   "is_consist", catalog.r6("reward").alias("reward"))
    assert got == sorted(tuple(r) for r in batch.collect())


def test_own_synonyms(spark):
    df = spark.createDataFrame([("<answer>a crimson hat</answer>", "red"), ("<answer>yep</answer>", "yes")], "completion string, gt_answer string")
    own = {"red": ["red", "crimson"]}
    assert [r.is_correct for r in S.score_completions(df, groups=own).collect()] == [1, 0]
    assert [r.is_correct for r in S.score_completions(df).collect()] == [0, 1]
    assert [r.is_correct for r in S.score_completions(df, groups={}).collect()] == [0, 0]


def test_eval_job_plan(spark):
    """SCORE has no Python and no exchange; EVAL is one partial+final aggregate."""
    s = catalog.scored(spark, SF_SMALL)
    assert "Python" not in _plan(s)
    a = catalog.QUERIES["a1_a2_accuracy_consistency"](spark, SF_SMALL)
    assert _plan(a).count("HashAggregate") >= 2


def test_eval_and_advantage_jobs(spark):
    from rubric.plans import jobs
    from rubric.session import scratch_path
    comp = catalog._bare_completions(spark, SF_SMALL).withColumn(
        "tag", F.concat(F.lit("g"), F.col("gen_idx").cast("string")))
    gold = catalog._gold(spark, SF_SMALL)
    out = scratch_path(spark, "eval-job")
    res = jobs.eval_job(spark, comp, gold, out)
    n_labelled = catalog.QUERIES["j2_attach_gold"](spark, SF_SMALL).count()
    assert res["scored"].count() == n_labelled
    assert sum(r.n for r in res["rates"].collect()) == n_labelled
    adv = jobs.advantage_job(res["scored"], scratch_path(spark, "adv-job"))
    assert adv.count() == n_labelled


def test_cli_score_and_checkpoints(spark):
    from rubric.plans import cli
    from rubric.session import scratch_path
    comp = catalog._bare_completions(spark, SF_SMALL).join(catalog._gold(spark, SF_SMALL), "sample_id")
    src = scratch_path(spark, "cli-src")
    comp.write.parquet(src)
    out = scratch_path(spark, "cli-out")
    cli.main(["score", "--completions", src, "--out", out])
    assert spark.read.parquet(out).count() == comp.count()
    msrc = scratch_path(spark, "cli-metrics")
    from rubric.sources import tables as TB
    TB.metrics(spark, SF_SMALL).write.parquet(msrc)
    mout = scratch_path(spark, "cli-ckpt")
    cli.main(["checkpoints", "--metrics", msrc, "--out", mout, "--eval-freq", "2", "--save-freq", "2"])
    assert spark.read.parquet(mout).count() > 0


def test_advantage_reads_only_needed_columns(spark):
    """R6 runs on the written scored table: its scans read the key, the
    generation index and the reward, never the completion text."""
    df = catalog.QUERIES["r6_group_advantage"](spark, SF_SMALL)
    df.collect()
    scans = [line for line in _plan(df).split("== Initial Plan ==")[0].split("\n") if "FileScan" in line]
    assert scans
    for line in scans:
        schema = line.split("ReadSchema:")[1]
        assert "completion" not in schema and "pred_think" not in schema and "reward" in schema


def test_image_files_share_folders_and_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(IM, "FOLDERS", 2)
    d = tempfile.mkdtemp(prefix="rubric-img-")
    ids = [*map(str, range(95)), "a/b", None, "7"]
    rows = spark.createDataFrame([(i, f"img:{i}") for i in ids], "image_id string, content string")
    IM.write_image_files(rows, d, files=10)
    assert 1 < len(os.listdir(d)) <= 10  # not a folder for each image
    m = IM.image_manifest(spark, d, glob="*.txt", id_pattern=IM.PARTITIONED_ID_PATTERN)
    got = {r.image_id: r.length for r in m.collect()}
    assert m.count() == len(got) == 97 and got["a%2Fb"] == 8 and got["7"] == 6 and IM.NULL_ID in got
    with open(os.path.join(d, "1.txt"), "w") as f:
        f.write("beside the folders")
    assert IM.image_manifest(spark, d, glob="*.txt", id_pattern=IM.PARTITIONED_ID_PATTERN).count() == 98


def test_eval_report_is_compressed_and_written_without_a_sort(spark):
    from rubric.sources import sinks as SK
    conf, d = next(iter(SK.OPEN_FOLDERS)), tempfile.mkdtemp(prefix="rubric-report-")
    before = spark.conf.get(conf, None)
    rows = spark.createDataFrame([(f"{i}", None if i % 3 else "q", f"g{i % 6}") for i in range(60)], "image_id string, instruction string, tag string")
    SK.write_eval_report(rows, d + "/r")
    files = [f for _, _, some in os.walk(d) for f in some if f.startswith("part")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.conf.get(conf, None) == before
    assert sorted((r.image_id, r.instruction, r.tag) for r in SK.read_eval_report(spark, d + "/r").collect()) == sorted(tuple(r) for r in rows.collect())


def test_label_mask_is_a_run_of_ids_and_no_function_of_places(spark):
    import random
    rng, some = random.Random(5), lambda *v: rng.choice([None, *v])
    rows = [([*range(1, 9)][:rng.randrange(9)], some(0, 2, 5, 9), some(0, 1, 4), some(0, 3, 8, 12), some(True, False, False)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1, False)], "p array<long>, n_real int, n_left int, plen int, test boolean")

    def brute(p, n_real, n_left, plen, test, mode):
        if p is None:
            return None
        lt = lambda a, b: a is not None and b is not None and a < b
        if mode == "compatible":
            return [-100 if test or lt(i, plen) else x for i, x in enumerate(p)]
        return [-100 if test or lt(i, n_left) or (n_left is not None and (lt(i - n_left, plen) or (n_real is not None and i - n_left >= n_real))) else x
                for i, x in enumerate(p)]

    for mode in ("default", "compatible"):
        got = df.select("*", Q.label_mask(F.col("p"), F.col("n_real"), F.col("n_left"), F.col("plen"), F.col("test"), mode).alias("labels"))
        assert "lambda" not in _plan(got)
        for r in got.collect():
            assert r.labels == brute(r.p, r.n_real, r.n_left, r.plen, r.test, mode), r


def test_image_files_are_listed_once_and_in_parts_of_their_number(spark, monkeypatch):
    monkeypatch.setattr(IM, "FOLDERS", 2)
    monkeypatch.setattr(IM, "LISTED", 40, raising=False)
    d = tempfile.mkdtemp(prefix="rubric-img-")
    IM.write_image_files(spark.createDataFrame([(str(i), "x") for i in range(200)], "image_id string, content string"), d, files=10)
    for name in ("a.txt", "b.txt", "c.png"):
        with open(os.path.join(d, name), "w") as f:
            f.write("beside")  # Spark's readers skip empty files
    discovered = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = discovered.getCount()
    m = IM.image_manifest(spark, d, glob="*.txt", id_pattern=r"([^/]+)\.txt$")
    tables = len(m.inputFiles())
    # Each image file stands in one listing; appends and the result list the manifest's own files.
    assert discovered.getCount() - before <= 203 + tables
    assert sorted(r.image_id for r in m.collect()) == sorted([*(f"image_id={i}" for i in range(200)), "a", "b"])


def test_eval_report_finds_long_texts_again_with_zstd(spark):
    """A question of 60 KB stands twice in a row, further apart than gzip looks back; files are read whole, not split."""
    import random

    from rubric.session import set_conf
    from rubric.sources import sinks as SK
    rng, d = random.Random(3), tempfile.mkdtemp(prefix="rubric-report-")
    long = ["".join(rng.choices("abcdefghijklmnop", k=60_000)) for _ in range(12)]
    rows = spark.createDataFrame([(f"{i}", t, t, f"g{i % 2}") for i, t in enumerate(long)] + [("x", None, "", "g0"), ("y", "a\nb", "ä", None)],
                                 "image_id string, instruction string, prediction_raw string, tag string").coalesce(1)
    sizes = {}
    for kind in ("gzip", "zstd"):
        SK.write_eval_report(rows, f"{d}/{kind}", compression=kind)
        files = [os.path.join(at, f) for at, _, some in os.walk(f"{d}/{kind}") for f in some if f.startswith("part")]
        sizes[kind] = sum(map(os.path.getsize, files))
        with set_conf(spark, {"spark.sql.files.maxPartitionBytes": "10k", "spark.sql.files.openCostInBytes": "1"}):
            got = [(r.image_id, r.instruction, r.prediction_raw, r.tag) for r in SK.read_eval_report(spark, f"{d}/{kind}").collect()]
        assert sorted(got) == sorted(map(tuple, rows.collect()))
    assert all(f.endswith(".json.zstd") for f in files) and sizes["zstd"] < 0.7 * sizes["gzip"]
