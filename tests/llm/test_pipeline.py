"""The pipeline's rows against stages that compare everything with everything."""

import random

import corpus_pipeline
from photonflow.llm import packing, quality
from tests.llm.test_decontam import slow as slow_hits
from tests.llm.test_quality import slow_base
from tests.llm.test_simhash import slow_near
from tests.llm.test_substring import slow as slow_repeats


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    pool = ["".join(rng.choice(["ka", "to", "mi", "re", "su"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    item, passage = some(25), some(80)
    texts = {i: some(rng.randrange(90, 200)) for i in range(60)}
    for i in range(40, 45):
        texts[i] = [*texts[i - 40][:-1], "edit"]
    for i in range(45, 49):
        texts[i] = texts[i - 45][:30] + passage + texts[i]
    texts[50] = texts[50] + item + ["end"]
    texts[51] = ["few", "words"]
    texts[52] = ["again"] * 90
    texts[53] = [("#%&@!"[i % 5] * 7 + str(i)) for i in range(120)]
    rows = [(i, " ".join(w), "xx", "s", len(" ".join(w))) for i, w in texts.items()] + [(60, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.judge(read).collect()}
    for i, t, *_ in rows:
        n, _, _, _, again = slow_base(t)
        assert not (verdict[i] and (n < 20 or 100 * again > 30 * n))
    assert not verdict[53] and sum(not verdict[i] for i in range(50)) <= 1
    left = {i: t for i, t, *_ in rows if verdict[i]}
    parent = slow_near(left)
    left = {i: t for i, t in left.items() if parent[i] == i}
    assert not set(range(40, 45)) & set(left)
    totals = {}
    for key, n, gone, _ in slow_repeats(list(left.items())):
        if gone < n:
            totals[int(key)] = n - gone
    assert any(totals[i] < len(texts[i]) for i in range(45, 49) if i in totals)
    assert slow_hits(left[50], [(1, " ".join(item))])[1] == 25
    totals[50] -= 25
    sums = {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.bucket_tokens <= packing.MAX_TOKENS
    assert sums == totals


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, tmp_path):
    rng = random.Random(12)
    pool = ["".join(rng.choice(["ka", "to", "mi", "re", "su"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    texts = [" ".join(rng.choice(pool) for _ in range(120)) for _ in range(30)]
    rows = [(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)] + [(40, texts[0], "xx", None, None), (40, texts[0], "xx", None, None), (None, texts[1], None, "s", 1), (41, None, None, None, None)]
    names = ("_key", "key", "_new", "new", "found", "_id", "row", "raw", "_raw", "kept", "_kept", "lost", "_gone", "id", "fp", "hash")
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, " ".join(texts[2].split()[:15]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, some, str(tmp_path))
            assert after.columns == docs.columns
            found = after.collect()
            assert all(r[n] == n for r in found for n in names)
            some = spark.createDataFrame(found, docs.schema)
        assert {r.doc_id for r in found} <= {*range(30), None} and len(found) in (0, 31)
        packed = corpus_pipeline.STAGES[-1][1](spark, some, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in found}
