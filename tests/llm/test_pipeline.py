"""Each stage on the rows that the one before it kept, against plain versions."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_compact_windows import plain_shingles
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint
from test_tokens_packing_simple8b import check_packing

from tidetally.llm import compression_quality, mixing, registry, simhash
from tidetally.session import keep

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = registry.table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "stage")
        results.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in results[-1])
    good, single, cut, mixed, packed = results

    scores = compression_quality.quality_scores(
        registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    ).collect()
    assert {r.doc_id for r in good} == {r.doc_id for r in scores if r.predicted}
    assert all(tuple(r) == tuple(before[r.doc_id]) for r in good)

    own = sorted(good, key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text) for r in own])
    assert sorted(r.doc_id for r in single) == [own[i].doc_id for i in sorted(set(roots))]
    assert all(tuple(r) == tuple(before[r.doc_id]) for r in single)

    # No 50 words in a row are left that two documents share, and one keeps those that were.
    def owners(rows):
        out = {}
        for r in rows:
            words = plain_shingles(r.text)
            for i in range(len(words) - 45):
                out.setdefault(tuple(words[i : i + 46 : 5]), set()).add(r.doc_id)
        return out

    shared_before = {k for k, v in owners(single).items() if len(v) > 1}
    after = owners(cut)
    assert not [k for k, v in after.items() if len(v) > 1]
    assert len(shared_before) > 50
    assert {r.doc_id for r in cut} == {r.doc_id for r in single}
    touched = {d for v in owners(single).values() if len(v) > 1 for d in v}
    near = {r.doc_id for r, s in zip(sorted(cut), sorted(single)) if r.text != s.text}
    assert len(near - touched) <= 0.02 * len(single)

    sizes = {}
    for r in cut:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    target = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += len(r.text.encode().split())
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)

    used, least = check_packing(packed, [(r.doc_id, r.text) for r in mixed])
    assert used <= 1.03 * least + 1
    assert sorted(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sorted(
        r.length for r in packed
    )


def test_edge_rows(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = keep(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if number < 4:
            assert out.columns == docs.columns


CLASHING = ("row", "shuffled", "row_id", "doc", "place", "size", "words", "fp", "cut", "number", "hash", "quality")


def test_columns_of_the_user_stay(spark):
    """Extra columns whose names the stages use themselves come through with their values."""
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents")
    extra = {c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in CLASHING}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.withColumns(extra) if "row" not in docs.columns else docs
        columns = docs.columns
        docs = keep(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING), name
    assert stage is not corpus_pipeline.STAGES[-1][1]
    assert keep(corpus_pipeline.STAGES[-1][1](spark, docs, ""), "packed").count() >= len(rows)


def test_equal_rows_of_two_sources_keep_their_own(spark):
    """The same id and text in sources a and b: the words of each are delivered as its own."""
    rows = [(i, "w " * 40 + f"n{i}", "en", s, 0) for i in range(30) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("tag", F.concat("source", F.lit("!")))
    mixed = mixing.mixed_texts(docs).collect()
    assert all(r.tag == r.source + "!" for r in mixed)
    taken = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in "ab"}
    targets = plain_targets({"a": 30 * 41, "b": 30 * 41})
    assert all(abs(taken[s] - targets[s]) <= 1 for s in "ab")


def test_repeated_rows_and_one_of_each(spark):
    rows = [(1, "a b c d", "x")] * 3 + [(1, "a b c d", "y"), (2, "a b c d", "z"), (3, "q r s t", "w")] + [(3, "q r s t", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and {r.row for r in kept} <= {"x", "y", "w"}
