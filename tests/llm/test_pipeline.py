"""The pipeline's stages and registered queries on the smallest table."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def kept_by_all_pairs(rows):
    """The (id, text) that no pair of five-word sets of 4/5 or more reaches from a smaller id."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, place = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if place[a] != place[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                place = [place[b] if p == place[a] else p for p in list(place)]
    least = {}
    for (i, _), p in zip(rows, place):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((i, t) for (i, t), p in zip(rows, place) if i is None or i == least[p]), key=str)


def test_stages(spark):
    import corpus_pipeline
    from paceforge.llm import decontam
    from paceforge.llm.frames import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF))
        outs.append(docs)
        if name != "bpe_tokens":
            assert docs.columns == columns, name
    language, lines, near, clean, tokens = outs
    assert lines.count() == language.count() and lines.agg(F.sum("n_chars")).first()[0] < language.agg(F.sum("n_chars")).first()[0]
    texts = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == kept_by_all_pairs(texts) and near.count() < len(texts)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.report(near, benchmark).where("contaminated").count() > 0 == decontam.report(clean, benchmark).where("contaminated").count()
    assert tokens.count() == clean.count()


@pytest.mark.parametrize("texts", [[], [None, None], [None, "", "12 ½ !"]])
def test_stages_of_nothing(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= len(texts), name


def test_sets_with_one_hash_are_told_apart(spark):
    from paceforge.llm import nearcopies

    marked = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 9, 3)], "doc_id long, node long, second long")
    found = {r.doc_id: r.node for r in nearcopies.told_apart(marked).collect()}
    assert found[1] == found[2] != found[3] and found[4] == 9


@pytest.mark.parametrize("name", ["op1_language_id", "op2_warc", "op3_bpe", "op4_toxicity", "op5_quality", "op6_secrets", "op7_line_dedup", "op8_decontamination", "op9_simhash", "op10_tiff", "op12_fill_in_middle", "op13_language_model"])
def test_queries_give_a_row_per_input_row(spark, name):
    import __spark_entry__ as entry

    table = "pages" if name == "op2_warc" else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_near_dedup_finds_all_pairs_of_four_fifths(spark):
    import random

    import corpus_pipeline

    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(2000)]
    common = " ".join(words[:12])
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one three"), (7, common), (7, "seven alone")]
    for k in range(30):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        rows.append((100 * k + 100, " ".join(base) + " " + common))
        for c in range(1, 7):
            copy = list(base)
            for at in rnd.sample(range(len(base)), rnd.randint(1, max(1, len(base) // 40))):
                copy[at] = rnd.choice(words)
            rows.append((100 * k + 100 + c, " ".join(copy) + " " + common))
    group = [rnd.choice(words) for _ in range(150)]
    for c in range(80):
        rows.append((5000 + c, " ".join(rnd.choice(words) if rnd.random() < 0.01 else w for w in group)))

    expected = kept_by_all_pairs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str) == expected
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), SF).count() == 0


def test_parities_never_part_alike_sets():
    import numpy as np
    from paceforge.llm.nearcopies import PARITIES, alike, parities

    rnd = np.random.default_rng(3)
    assert parities(np.empty(0, np.uint64)).tolist() == [0] * len(PARITIES)
    kept = parted = 0
    for _ in range(3000):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 400), dtype=np.uint64))
        new = np.unique(rnd.integers(0, 1 << 63, rnd.integers(0, 1 + len(base) // 3), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rnd.integers(0, 1 + len(base) // 4) :], new]))
        differing = int(np.bitwise_count((parities(base) ^ parities(other)).view(np.uint64)).sum())
        passes = 9 * differing <= len(base) + len(other)
        assert passes or not alike(base, other)
        kept, parted = kept + passes, parted + (not passes)
    assert kept and parted


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    import random

    from paceforge.llm import nearcopies
    from paceforge.llm.simhash import majority

    monkeypatch.setattr(nearcopies, "_can_reach", lambda x, y: F.lit(False))  # what remains are the pairs of the SimHash index
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(500)]
    rows = []
    for k in range(3):
        base = [rnd.choice(words) for _ in range(250)]
        for c in range(20):
            copy = list(base)
            for at in rnd.sample(range(len(base)), rnd.randint(1, 4)):
                copy[at] = rnd.choice(words)
            rows.append((100 * k + c, " ".join(copy)))
    sets = [nearcopies.shingles(t) for _, t in rows]
    prints, place = [majority(s) for s in sets], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if place[a] != place[b] and (prints[a] ^ prints[b]).bit_count() <= 3 and nearcopies.alike(sets[a], sets[b]):
                place = [place[b] if p == place[a] else p for p in list(place)]
    expected = sorted(min(i for (i, _), q in zip(rows, place) if q == p) for p in set(place))
    assert 3 < len(expected) < len(rows) - 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == expected


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_components_of_a_short_list_need_no_rounds(spark):
    from paceforge.llm.components import connected_components

    chain = spark.range(1, 2001).selectExpr("id a", "id - 1 b")
    found, jobs = jobs_of(spark, "chain", lambda: {r.node: r.component for r in connected_components(chain).collect()})
    assert found == dict.fromkeys(range(2001), 0)
    assert jobs <= 10  # each round would bring its own


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_over_several_tasks(spark, monkeypatch, kind):
    import random

    from paceforge.llm import components

    monkeypatch.setattr(components, "PAIRS_PER_TASK", 40)  # several tasks, and trees that begin anew
    rnd = random.Random(5)
    pairs = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(400)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2200)] + [(5000, 5000), (None, 3)]
    if kind == "string":
        pairs = [tuple(None if x is None else f"{x:06d}" for x in p) for p in pairs]
    place = {x: x for p in pairs if None not in p for x in p}
    for _ in range(400):
        before = dict(place)
        for a, b in pairs:
            if None not in (a, b):
                place[a] = place[b] = min(place[a], place[b])
        if before == place:
            break
    found = components.connected_components(spark.createDataFrame(pairs, f"a {kind}, b {kind}").repartition(8)).collect()
    assert len(found) == len(place) and {r.node: r.component for r in found} == place


def test_near_dedup_of_a_small_table_takes_few_jobs(spark):
    from paceforge.llm import nearcopies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, jobs = jobs_of(spark, "near", lambda: sorted(((r.doc_id, r.text) for r in nearcopies.keep_one(docs).select("doc_id", "text").collect()), key=str))
    assert found == kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()])
    assert jobs <= 130  # the driver holds the plans and threads of each for a while
