import hashlib
import random
import re

from photonflow.llm import exact
from photonflow.llm.common import shared_path


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def slow(docs):
    """For each row: id, id of the row that stays, rows of the group, digest."""
    groups = {}
    for k, t in docs:
        groups.setdefault(normal(t), []).append((-len(t or ""), k is None, k or 0))
    out = []
    for k, t in docs:
        best = min(groups[normal(t)])
        out.append((k, None if best[1] else best[2], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def some(rng, n):
    words = ["a", "b", " a", "b\n", "ä́", " ", "\x0b", "\U0001f600", "\x1f"]
    docs = [(rng.randrange(60), "".join(rng.choice(words) for _ in range(rng.randrange(4)))) for _ in range(n)]
    return [*docs, (None, "ab"), (None, None), (5, None), (6, ""), (7, " "), (8, "x" * 200_000), (9, "x" * 199_999 + " x"), (9, "x" * 199_999 + " x"), *[(100 + i, "hot  text") for i in range(200)]]


def test_deduplicate_equals_brute_force(spark):
    docs = some(random.Random(3), 150)
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, digest string")
    got = exact.deduplicate(d).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == slow(docs)
    for digest in {r.text_sha256 for r in got}:
        kept = [r for r in got if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id  # one row, repeated rows of its id too
    assert exact.deduplicate(d.where("false")).count() == 0
    named = exact.deduplicate(spark.createDataFrame([("b", "t"), ("a", "t")], "k string, v string"), id_col="k", text_col="v").collect()
    assert {(r.k, r.keep_id, r.kept) for r in named} == {("a", "a", True), ("b", "a", False)}


def test_index_takes_batches_and_outlives_a_session(spark):
    docs = some(random.Random(4), 120)
    docs = sorted(set(docs), key=str)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = shared_path(spark, "index")
    index = exact.DigestIndex(spark, path, buckets=3)
    parts = [d.where("doc_id % 3 = 0"), d.where("doc_id % 3 = 1"), d.where("doc_id is null or doc_id % 3 = 2")]
    for p in parts:
        exact.deduplicate(p, index).collect()
    held = {r.digest: r.keep_id for r in index.best().collect()}
    assert held == {h: k for _, k, _, h in slow(docs)}  # batches lead to what one batch gives
    before = index.rows().count()
    again = exact.deduplicate(parts[0], index).collect()
    assert index.rows().count() == before  # a batch that is run again appends nothing
    assert {(r.doc_id, r.keep_id) for r in again} == {(k, held[hashlib.sha256(normal(t).encode()).hexdigest()]) for k, t in docs if k is not None and k % 3 == 0}
    other = exact.DigestIndex(spark.newSession(), path)
    assert other.buckets == 3 and other.rows().count() == before
    small = index.compacted(shared_path(spark, "index"))
    assert small.rows().count() == len(held) and {r.digest: r.keep_id for r in small.best().collect()} == held


def test_the_index_is_not_moved(spark):
    index = exact.DigestIndex(spark, shared_path(spark, "index"), buckets=4)
    heads = spark.createDataFrame([(exact.hashlib.sha256(str(i).encode()).hexdigest(), 1, i) for i in range(50)], "digest string, n_chars long, id long")
    index.append(heads)
    plan = index.missing(heads.repartition(4, "digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
