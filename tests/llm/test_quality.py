import zlib

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from waylace.llm import quality, quality_rules
from waylace.llm.statistics import FEATURES, repeated_words, statistics


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def slow_counts(text):
    text = text or ""
    words = words_of(text)
    covered = set()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_slow_version(docs):
    texts = [r["text"] for r in docs.orderBy("n_chars").limit(120).collect()]
    texts += ["", None, "a b c d e a b c d e", "x\nx\n \nx", "a a a a a a a", "é漢 𝄞\x1cz #|", "one", "\n\n", "a b c d e f\na b c d e f"]
    for text in texts:
        counts, features = statistics(None if text is None else text.encode())
        assert tuple(counts) == slow_counts(text), text
        assert len(features) == len(FEATURES) and np.isfinite(features).all()


def test_long_texts_take_the_other_way(monkeypatch):
    from waylace.llm import statistics as module

    r = np.random.default_rng(3)
    for _ in range(40):
        words = [b"w%d" % k for k in r.integers(0, 3, 60)]
        want = repeated_words(words)
        with monkeypatch.context() as m:
            m.setattr(module, "_LONG", 0)
            assert repeated_words(words) == want


def test_isotonic():
    fit = quality.isotonic(np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0, 3.0]))
    assert fit.tolist() == [0.0, 0.5, 0.5, 1.0, 1.0]


@pytest.fixture(scope="module")
def many(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_scores_on_held_out_labels(many):
    docs, labels = many
    scores = quality.quality_scores(docs, labels).cache()
    assert scores.count() == docs.count()
    for r in scores.select("doc_id", "held_out", "score", "predicted").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3)
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) > 0.98


def test_held_out_labels_are_never_learned(many):
    docs, labels = many
    features = quality.document_features(docs)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(quality.labelled_rows(features, labels)), quality.fit_quality(quality.labelled_rows(features, flipped))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.values, b.values)


def test_quality_odd_rows(odd, none, labels):
    scored = quality.quality_scores(odd, labels)
    assert sorted(scored.columns) == ["doc_id", "held_out", "predicted", "score"] and scored.count() == len(odd_rows())
    assert quality.quality_scores(none, labels).count() == 0
    nothing = quality.quality_scores(odd, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(0.5, 1)}
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.keep_good(none, labels).count() == 0
    odd_labels = labels.sparkSession.createDataFrame([(None, 1), (2, None), (3, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    assert quality.quality_scores(odd, odd_labels).count() == len(odd_rows())


def test_keep_good_equals_scores(many):
    docs, labels = many
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}


def test_rules_are_found_in_order():
    r = np.random.default_rng(0)
    x = r.random((3000, len(FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.6) & (x[:, 5] < 0.2))
    rules = quality_rules.learn_list(x, 1.0 - bad)
    assert {rules[0][0].feature} == {FEATURES[2]} and len(rules) >= 2
    covered = np.zeros(len(x), dtype=bool)
    for rule in rules:
        covered |= quality_rules._covers(rule, x)
    assert (covered == bad).mean() > 0.97
    assert quality_rules.learn_list(x, np.ones(len(x))) == []


def test_verdicts(many):
    docs, labels = many
    rows = quality_rules.quality_verdicts(docs, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] is None)
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["kept"], quality_of[r["doc_id"]]) for r in rows if r["doc_id"] in quality_of and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.9
    assert all(k for k, q in judged if q) or sum(not k for k, q in judged if q) <= 1


def test_verdicts_odd_rows(odd, none, labels):
    rows = quality_rules.quality_verdicts(odd, labels).collect()
    assert sorted(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")) for r in rows) == sorted(slow_counts_short(r[1]) for r in odd_rows())
    assert quality_rules.quality_verdicts(none, labels).count() == 0
    bare = quality_rules.quality_verdicts(odd, labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in bare)


def slow_counts_short(text):
    text = text or ""
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup


def test_fit_against_dense_version(many):
    docs, labels = many
    labelled = quality.labelled_rows(quality.document_features(docs), labels)
    rows = labelled.collect()
    x, y, part = (np.array([r[c] for r in rows], dtype=float) for c in ("x", "y", "part"))
    fit = part != 1
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0)
    scale[scale < 1e-9] = 1.0
    rng, n = np.random.default_rng(quality.SEED), quality.N_FOURIER
    project, phase = rng.normal(size=(len(FEATURES), n)) / np.sqrt(len(FEATURES)), rng.uniform(0, 2 * np.pi, n)

    def waves(v):
        z = np.clip((v - mean) / scale, -quality.CLIP, quality.CLIP)
        return np.hstack([np.cos(z @ project + phase) * np.sqrt(2 / n), np.ones((len(v), 1))])

    z = waves(x[fit])
    whole = np.vstack([z, np.sqrt(quality.RIDGE * len(z) / n) * np.eye(n + 1)])  # ridge as least squares with further rows
    weights = np.linalg.lstsq(whole, np.concatenate([y[fit], np.zeros(n + 1)]), rcond=None)[0]
    model = quality.fit_quality(labelled)
    assert np.allclose(model.raw(x), waves(x) @ weights, atol=1e-6)
    at = np.clip(((model.raw(x[~fit]) + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(at)
    share, weight = np.array([y[~fit][at == b].mean() for b in used]), np.array([(at == b).sum() for b in used])
    mean_of = lambda j, k: np.average(share[j : k + 1], weights=weight[j : k + 1])
    slow = [max(min(mean_of(j, k) for k in range(i, len(used))) for j in range(i + 1)) for i in range(len(used))]
    assert np.allclose(model.values, slow)
    kernel = np.exp(-((np.clip((x[:40, None] - mean) / scale, -5, 5) - np.clip((x[None, :40] - mean) / scale, -5, 5)) ** 2).sum(axis=2) / 2 / len(FEATURES))
    assert np.abs(waves(x[:40])[:, :-1] @ waves(x[:40])[:, :-1].T - kernel).mean() < 0.08  # the features approximate that kernel


def test_rule_of_each_row(many):
    docs, labels = many
    rules = quality_rules.learn_rules(quality_rules.document_statistics(docs), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rules
    for r in quality_rules.quality_verdicts(docs, labels).collect():
        f = dict(zip(FEATURES, statistics(texts[r["doc_id"]].encode())[1], strict=True))
        holds = (rule for rule in rules if all(f[c.feature] >= c.cut if c.at_least else f[c.feature] <= c.cut for c in rule))
        assert r["rule"] == next((" and ".join(map(str, rule)) for rule in holds), None)
