import hashlib
import os

import corpus_pipeline
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import words_of
from tests.llm.test_shingle_dedup import kept_ids
from waylace.llm import bpe, mixing, quality
from waylace.plans.scratch import cleared, materialize, shared_root


def test_stages_against_brute_force(spark, docs, labels, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    current, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in current.collect()]
        current = materialize(stage(spark, current, sf_dir))
        seen[name] = (before, current)
        if name != names[-1]:
            assert current.columns == docs.columns
    before, out = seen["quality classifier"]
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, *_ in before if i in good)
    before, out = seen["exact dedup"]
    last = {}
    for i, t, _ in before:
        last[t] = max(last.get(t, i), i)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(last.values())
    before, out = seen["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in out.collect()) == kept_ids([(i, t) for i, t, _ in before])
    before, out = seen["mixing sources to target weights"]
    sizes, texts = {}, {i: t for i, t, _ in before}
    for _, t, s in before:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    taken = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words_of(r["text"]))
        assert set(words_of(r["text"])) <= set(words_of(texts[r["doc_id"]]))
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 2 * mixing.BLOCK_WORDS
    before, out = seen["byte-level BPE encoding and decoding"]
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary_path()), bpe.default_pattern())
    want = sorted((i, encoder.encode(t), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in before)
    assert sorted((r["doc_id"], r["token_ids"], r["decoded_sha256"]) for r in out.collect()) == want


def test_odd_rows_and_empty(spark, odd, none, sf_dir):
    for df in (odd, none):
        current = df
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            current = materialize(stage(spark, current, sf_dir))
            if n < 4:
                assert current.columns == df.columns
        if df is none:
            assert current.count() == 0


def test_nothing_is_left_once_the_result_is_written(spark, sf_dir, tmp_path):
    folder = f"{shared_root(spark).removeprefix('file://')}/waylace"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with cleared(spark):
        corpus_pipeline.run(spark, sf_dir).write.parquet(str(tmp_path / "out"))
    assert set(os.listdir(folder)) <= before and spark.read.parquet(str(tmp_path / "out")).count() > 0
