"""The pipeline's stages, each on its own input, against brute force."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from llm import token_mix
from tests.llm.test_operators import ALNUM, FOLD, base_spans, linked, words


def corpus(spark, folder):
    r = random.Random(8)
    lexicon = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    leak = " ".join(f"leak{chr(97 + k)}" for k in range(14))
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(lexicon) for _ in range(r.randint(15, 90))]
        bad = i % 10 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zzidiot", "zzmoron", "vexq" + r.choice(["a", "an", "ib"])])
        if i % 25 == 3:
            w[5:5] = leak.split()
        if i % 9 == 4:
            w[3:3] = ["me@mail.example.com", "+1", "(555)", "123-4567"]
        docs.append([i, " ".join(w), "en", f"s{i % 4}", 0])
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, 1, int(bad)))
    for i in range(600, 640):  # copies and near copies
        text = docs[r.randrange(1, 600)][1]
        docs.append([i, text if i % 2 else text.replace("a", "A", 1), None, None, None])
    docs += [[700, None, None, None, None], [701, "", "en", "s1", 0], [702, "word " * 12_000, "en", "s0", 0]]
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "nothing like that")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i for i in range(0, 600, 10)}, leak


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    bad, leak = corpus(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        seen[name] = (before, after)
    before, after = seen["toxicity"]
    texts = {before[i]["text"] for i in bad}
    wrong = {i for i in before if (before[i]["text"] in texts) == (i in after)}
    assert len(wrong) <= 3
    before, after = seen["ngram_join"]
    groups = linked([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, n, c in groups if n == 0 or i == c} and all(after[i] == before[i] for i in after)
    before, after = seen["decontamination"]
    held = lambda t: any(" ".join(leak.split()[k : k + 10]) in " ".join(ALNUM.findall((t or "").translate(FOLD))) for k in range(5))
    assert set(after) == {i for i, r in before.items() if not held(r["text"])}
    before, after = seen["pii"]
    assert set(after) == set(before) and all(not base_spans(r["text"]) for r in after.values())
    assert all(after[i] == before[i] for i in before if not base_spans(before[i]["text"]) and "<" not in (after[i]["text"] or ""))
    before, after = seen["token_mix"]
    assert {i: r["size"] for i, r in after.items()} == {i: len(words(r["text"])) for i, r in before.items()}
    total = sum(r["size"] for r in after.values())
    assert abs(sum(r["taken"] for r in after.values()) - 1.5 * total) < 5
    assert docs.where(F.col("taken") > 2 * F.col("size")).count() == 0


def test_run_equals_its_stages(spark, tmp_path):
    d = str(tmp_path)
    corpus(spark, d)
    got = P.run(spark, d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"] and got.count() > 400
    assert got.where("text is null and size > 0 or n_chars <> length(text)").count() == 0


def test_run_leaves_only_its_result(spark, tmp_path):
    d = str(tmp_path / "in")
    corpus(spark, d)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    assert P.run(spark, d).count() > 400
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and next(iter(new)).startswith("pipeline-4-token_mix")


def test_mix_counts_off_rows_that_repeat(spark):
    rows = [(1, "a b c", "s")] * 3 + [(2, None, None), (None, "x y", "s"), (None, "x y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("mine"))
    got = token_mix.mix_documents(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in got) == sorted((str(i), str(t), str(s)) for i, t, s in rows)
    assert sum(r["taken"] for r in got) == round(1.5 * 13)


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    d = str(tmp_path)
    corpus(spark, d)
    some = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60")
    for name in ("_t", "_c", "_row", "_text", "spans", "base", "_nth", "nth0", "_gone", "score", "toxic", "key", "token", "size", "u", "bucket"):
        some = some.withColumn(name, F.lit(name))
    odd = some.unionByName(some.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some.where("doc_id = 8"))
    for name, stage in P.STAGES:
        for docs in (odd, some.limit(0)):
            out = stage(spark, docs, d)
            if name != "token_mix":
                assert out.columns == docs.columns
                assert out.where("score <> 'score' or spans <> 'spans' or nth0 <> 'nth0' or _row <> '_row'").count() == 0
            n = out.count()
            assert n == 0 if docs is not odd else n > 30
