"""The pipeline's stages against what their operators decide row by row."""
import corpus_pipeline
import pytest
from conftest_llm import JSON, key
from test_tokens import check_packing

from tideline.llm import near_copies, packing, pii, quality_classifier, simhash, toxicity


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("edge_tables")
    docs.write.parquet(str(path / "documents.parquet"))
    labels.write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_follow_their_operators(spark, docs, labels, folder, tmp_path):
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.count() > 0
        before, left = now.collect(), after.collect()
        texts = [r["text"] for r in before]
        if name == "toxicity":
            model = toxicity.fit_toxicity(now, labels)
            want = [r for r, s in zip(before, scores(spark, toxicity.score_toxicity(now, model))) if s["predicted"] == 0]
            assert len(left) == len(want)
        elif name == "quality":
            model = quality_classifier.fit_quality(now, labels)
            odds = model.scores(quality_classifier.np.array([quality_classifier.features(t) for t in texts]))
            assert sorted(key(r["doc_id"]) for r in left) == sorted(key(r["doc_id"]) for r, s in zip(before, odds) if s >= 0.3)
        elif name == "near_copies":
            fps = {simhash.fingerprint(t) for t in texts}
            assert len(left) <= len(fps) and {simhash.fingerprint(r["text"]) for r in left} <= fps
        else:
            assert sorted(key(r["doc_id"], r["text"]) for r in left) == sorted(key(r["doc_id"], pii.redact(r["text"])) for r in before)
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in left)
        now = after
    rows = [tuple(r) for r in now.collect()]
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, folder).collect(), rows)


def scores(spark, scored):
    return scored.collect()


def test_run_equals_the_stages(spark, folder, docs, labels):
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
    want = packing.token_pieces(now, JSON).collect()
    got = corpus_pipeline.run(spark, folder).collect()
    pieces = lambda rows: sorted(key(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(got) == pieces(want)


def test_empty_tables(spark, no_docs, no_labels, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_copies_leave_one(spark, folder):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, base, "en", "s", len(base)) for i in (9, 4, 7)] + [(i, " ".join(f"other{i}x{k}" for k in range(60)), "en", "s", 1) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]


def test_near_copies_are_proposed_by_simhash_too(spark):
    """Bands of 2000 minima hardly ever agree, so the near copy is found through its fingerprint; whole sets decide."""
    words = [f"word{i}" for i in range(400)]
    copies = [" ".join([*words[:k], "odd", *words[k + 1:]]) for k in range(1, 400, 7)]
    close = next(t for t in copies if 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(" ".join(words))).bit_count() <= simhash.DISTANCE)
    rows = [(5, " ".join(words), "a"), (6, close, "b"), (1, " ".join(f"lone{i}" for i in range(50)), "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = near_copies.one_of_each_group(docs, bands=1, deep=2000)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 5]
