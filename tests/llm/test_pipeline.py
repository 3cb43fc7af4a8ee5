"""The pipeline over the smallest tables, each stage against plain Python on its own input."""

from collections import Counter
from fractions import Fraction
from math import floor

import corpus_pipeline as cp
import pytest
from annalist.llm import pii
from annalist.llm.blocks import materialize
from tests.llm.test_operators import brute_components, brute_contamination, brute_targets, nearest_sum, spaced


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, f in cp.STAGES:
        docs.append(materialize(f(spark, docs[-1], sf_dir), name))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_toxicity_keeps_clean_documents(spark, sf_dir, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = {i for i, _ in rows(stages[0])}, {i for i, _ in rows(stages[1])}
    clean = [i for i in before if labels.get(i) == 0]
    assert after <= before and sum(i in after for i in clean) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    groups = brute_components(rows(stages[1]), 5, 80)
    want = Counter(c if n else d for d, n, c in {(c if n else d, n and 1, c) for d, n, c in groups})
    assert Counter(i for i, _ in rows(stages[2])) == want


def test_near_duplicates_at_the_stage_default(spark, sf_dir):
    """A copy with one-word edits every 50 words goes: under 0.9 of three-word shingles, over 0.8 of five-word ones."""
    words = [f"w{i}" for i in range(300)]
    near = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    far = [f"y{i}" if i % 30 == 15 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(i for i, _ in rows(dict(cp.STAGES)["near_duplicates"](spark, df, sf_dir))) == [1, 3]


def test_decontamination(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {k[0] for k in brute_contamination(rows(stages[2]), items, 10) if k[5]}
    assert sorted(rows(stages[3])) == sorted(r for r in rows(stages[2]) if r[0] not in bad)


def test_personal_data(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert before.keys() == after.keys()
    for i, t in before.items():
        spans = pii.seeds((t or "").encode(), 0, len((t or "").encode()))
        assert (t == after[i]) == (not spans)
        assert not pii.seeds(after[i].encode(), 0, len(after[i].encode()))


def test_mixing(stages):
    texts = {r.doc_id: (r.source, len(spaced(r.text))) for r in stages[4].collect()}
    size, taken = Counter(), Counter()
    for s, n in texts.values():
        size[s] += n
    goal = brute_targets(dict(size))
    for r in stages[5].collect():
        assert r.taken == r.repeats * texts[r.doc_id][1] and 0 < r.taken <= 2 * r["size"] and r.target == float(goal[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(40, 0.02 * goal[s]) for s in size)
    for s in size:  # no choice of takes comes nearer
        near = floor(goal[s] + Fraction(1, 2))
        assert abs(taken[s] - near) == nearest_sum(near, [n for x, n in texts.values() if x == s])


def test_run(spark, sf_dir, stages):
    """run() gives the last stage's rows."""
    assert Counter((r.doc_id, r.taken) for r in cp.run(spark, sf_dir).collect()) == Counter((r.doc_id, r.taken) for r in stages[5].collect())


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, names that stages use themselves, an empty table."""
    long = " ".join(f"word{i}" for i in range(60_000))
    clean = [(1, "the quick walk by a river in the morning sun", "en", "a", 44, "k"), (2, "a letter to ann@example.org about the garden gate", "en", None, 50, "k"), (3, long, None, "b", None, None)]
    odd = [(4, None, None, None, None, None), (5, "", "en", "a", 0, "x"), (6, None, "en", "b", 0, "x"), (None, "a row that has no id but many words of its own to tell", None, "a", 9, None)]
    df = spark.createDataFrame([*clean, clean[0], *odd], "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3)
    ids = {}
    for name, stage in cp.STAGES[:-1]:
        df = materialize(stage(spark, df, sf_dir), name)
        ids[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in df.select("doc_id").collect())
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    assert ids["toxicity"] == [-1, 1, 1, 2, 3, 4, 5, 6]
    assert ids["near_duplicates"] == ids["decontamination"] == ids["personal_data"] == [-1, 1, 2, 3, 4, 5, 6]
    texts = {r.doc_id: r.text for r in df.collect()}
    assert texts[3] == long and texts[4] is None and texts[5] == "" and texts[2] == "a letter to [EMAIL] about the garden gate"
    mixed = cp.STAGES[-1][1](spark, df, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= {None, 1, 2, 3} and all(r.taken == r.repeats * r["size"] for r in mixed)
    for _, stage in cp.STAGES:
        assert stage(spark, df.where("false"), sf_dir).count() == 0
