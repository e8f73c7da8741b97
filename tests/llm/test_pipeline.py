"""Pipeline: each stage on its own input against what it has to drop and to keep."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F, types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def jaccard(a, b, n=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates(spark):
    import random

    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(40):
        text = [draw.choice(words) for _ in range(draw.choice([60, 200, 900]))]
        members = [" ".join(text)]
        for _ in range(draw.randint(1, 4)):
            other = list(text)
            for _ in range(max(1, len(text) // 100)):
                other[draw.randrange(len(other))] = draw.choice(words)
            members.append(" ".join(other))
        members.append(members[0].upper())
        groups.append(range(len(rows), len(rows) + len(members)))
        rows += [(len(rows) + i, m) for i, m in enumerate(members)]
    alone = [(len(rows) + i, " ".join(draw.choice(words) for _ in range(80))) for i in range(60)]
    rows += alone + [(9000, None), (9001, ""), (9002, " \n")] + [(9100, "one two three four five six")] * 3
    kept = Counter(r.doc_id for r in P.near_duplicates(spark, docs(spark, rows), "").collect())
    texts = dict(rows)
    for group in groups:
        for i in group:
            near = any(j != i and jaccard(texts[i], texts[j]) >= 0.85 for j in group)
            assert kept[i] == 0 or i == group[0] or not near
        assert kept[group[0]] == 1
    assert all(kept[i] == 1 for i, _ in alone)
    assert sum(kept[i] for i in (9000, 9001, 9002)) == 1 and kept[9100] == 1


def test_hot_shards_are_cut(spark):
    from lexquarry.llm import op10_simhash as S

    shared = " ".join(f"s{i}" for i in range(300))
    rows = [(i, shared + " " + " ".join(f"x{i}y{k}" for k in range(8 if i % 2 else 300))) for i in range(80)]
    from lexquarry.llm.op10_simhash import similar_links

    whole = {r.doc_id for r in S.one_of_each(docs(spark, rows)).collect()}
    assert whole == {1} | set(range(0, 80, 2))
    original = S.similar_links
    try:
        S.similar_links = lambda t, s: similar_links(t, s, tree_rows=6)
        assert {r.doc_id for r in S.one_of_each(docs(spark, rows)).collect()} == whole
    finally:
        S.similar_links = original


def test_other_stages(spark, folder):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(1, "before " + items[0] + " after"), (2, "clean text of no matter"), (3, None), (4, ""), (5, "the password=abcdefghijkl12 here")]
    left = {r.doc_id for r in P.decontaminated(spark, docs(spark, rows), folder).collect()}
    assert left == {2, 3, 4, 5}
    clean = {r.doc_id: r for r in P.without_secrets(spark, docs(spark, rows), folder).collect()}
    assert clean[5].text == "the [assign] here" and clean[5].n_chars == 17 and clean[2].text == rows[1][1] and clean[3].text is None
    packed = P.packed(spark, docs(spark, rows), folder).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5}


def test_run_keeps_columns_and_clean_documents(spark, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    frame = source
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.schema.names == source.schema.names and [f.dataType for f in frame.schema] == [f.dataType for f in source.schema], name
    kept = {r.doc_id for r in frame.select("doc_id").collect()}
    assert {r.doc_id for r in P.run(spark, folder).collect()} == kept
    assert len(kept) > 0.8 * source.count()


def test_empty_and_odd(spark, folder):
    wide = docs(spark, [(None, None), (1, "a b c"), (1, "a b c"), (2, "")]).withColumn("spans", F.lit("x")).withColumn("_row", F.lit(1))
    for name, stage in P.STAGES:
        assert stage(spark, docs(spark, []), folder).count() == 0, name
        if name != "packed":
            assert stage(spark, wide, folder).columns == wide.columns, name


def test_near_duplicates_are_decided_by_true_similarity(spark):
    """Pairs just below and at 0.8, on short and long texts; a sketch alone takes about half of either side for the other."""
    rows, expected = [], set()
    for g in range(60):
        n = (60, 400, 3000)[g % 3]  # distinct shingles of the first text
        words = [f"g{g}w{i}" for i in range(n + 4)]
        for share in (0.77, 0.79, 0.8, 0.81, 0.83):
            # a text that starts alike and ends otherwise shares k of 2 * n - k shingles
            k = next(k for k in range(n + 1) if k / (2 * n - k) >= share - 1e-12)
            other = [f"s{share}{w}" for w in words]
            place = len(rows)
            a, b = [f"p{share}{w}" for w in words], None
            b = a[:k + 4] + other[k + 4:]
            rows += [(place, " ".join(a)), (place + 1, " ".join(b))]
            assert (jaccard(rows[-2][1], rows[-1][1]) >= 0.8) == (share >= 0.8)
            expected |= {place} if share >= 0.8 else {place, place + 1}
    assert {r.doc_id for r in P.near_duplicates(spark, docs(spark, rows), "").collect()} == expected


def test_a_hot_shard_keeps_pairs_that_share_no_other_key(spark):
    import numpy as np
    from lexquarry.llm import op10_simhash as S

    n, count = 30, len(S.signature(np.arange(1, 9, dtype=np.uint64))[1])
    sketch = lambda i: (np.arange(1, S.BINS + 1) + 1000 * i).astype("<u2").tobytes()
    # all texts share key 0 and no other; texts 2i and 2i + 1 are alike
    rows = [(b"%02d" % i, 256, [7, *(100 * i + k for k in range(1, count))], sketch(i // 2)) for i in range(n)]
    texts = spark.createDataFrame(rows, "name binary, size long, keys array<long>, sketch binary").withColumn("simhash", F.lit(0).cast("long"))
    want = {frozenset((b"%02d" % i, b"%02d" % (i + 1))) for i in range(0, n, 2)}
    for tree_rows in (4, 20_000):
        assert {frozenset((bytes(r.a), bytes(r.b))) for r in S.similar_links(texts, 0.8, tree_rows=tree_rows).collect()} == want
