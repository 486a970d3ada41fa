"""Toxicity, quality and the language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import lm, quality, toxicity

def bigger(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_toxicity_finds_categories(spark):
    """Two kinds of toxic words, in no list anywhere, are two links; both count as toxic."""
    rows = [(i, f"a plain text number {i} about gardens {'vorpal snickersnack' if i % 5 == 0 else ''} {'grumblewort' + str(i % 4) if i % 5 == 1 else ''}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 in (0, 1))) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert all(r["is_toxic"] == (i % 5 in (0, 1)) for i, r in got.items())
    kinds = {k: {c for c in toxicity.CATEGORIES if got[k]["toxicity"][c] > 0.5} for k in (5, 6, 7)}
    assert len(kinds[5]) == 1 and kinds[6] and not kinds[5] & kinds[6] and not kinds[7]


def chain_sample(n=240):
    """Rows of a toxic kind a, a toxic kind b, and others, with noise words."""
    rng = np.random.default_rng(4)
    names = [b"a1", b"a2", b"b1", b"b2", b"n1", b"n2"]
    kind = np.arange(n) % 4
    has = np.stack([(kind == k) & (rng.random(n) < 0.9) for k in (0, 0, 1, 1)] + [rng.random(n) < 0.5] * 2, axis=1)
    return toxicity.Sample(names, has, kind < 2)


def test_chain_uses_earlier_links():
    links = toxicity.fit(chain_sample())
    assert tuple(x.name for x in links) == toxicity.LINKS and [len(x.weights_before) for x in links] == [0, 1, 2, 3]
    assert any(w > 0 for w in links[-1].weights_before)
    changed = links[-1].intercept + sum(w * p for w, p in zip(links[-1].weights_before, (1, 0, 0)))
    other = links[-1].intercept + sum(w * p for w, p in zip(links[-1].weights_before, (0, 0, 1)))
    assert changed != other  # who is fed what matters


def test_chain_by_brute_force():
    """Probabilities of a text are those of plain arithmetic on its features; groups part the kinds."""
    sample = chain_sample()
    links = toxicity.fit(sample)
    known = {w for x in links for w in x.words}
    for row in sample.has[:40]:
        text = b" ".join(n for n, h in zip(sample.names, row) if h)
        p = []
        for x in links:
            z = x.intercept + sum(v for w, v in x.words.items() if w in text.split()) + sum(a * b for a, b in zip(x.weights_before, p))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert toxicity.score(text, links, known, [set()] * 3) == pytest.approx(p)
    group = toxicity.groups(sample.has[sample.toxic][:, :4], 2)
    kind = (np.arange(240) % 4)[sample.toxic]
    some = group >= 0
    assert len({(int(g), int(k)) for g, k in zip(group[some], kind[some])}) == 2


def test_link_is_at_its_minimum():
    """The gradient of the regularised loss vanishes at the fitted weights, computed row by row."""
    sample = chain_sample()
    chosen, w = toxicity._fit_link(sample.has, sample.toxic, np.zeros((240, 0), np.float32))
    g = [0.0] * len(w)
    for row, y in zip(sample.has, sample.toxic):
        x = [float(row[c]) for c in chosen] + [1.0]
        e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - y
        g = [a + e * b / 240 for a, b in zip(g, x)]
    g = [a + (1e-3 * b if i < len(w) - 1 else 0) for i, (a, b) in enumerate(zip(g, w))]
    assert max(map(abs, g)) < 2e-3


def test_toxicity_odd_tables(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs, none).where("is_toxic").count() == 0
    assert toxicity.classify(empty, none).count() == 0
    all_bad = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, all_bad).where("is_toxic").count() == docs.count()


def test_toxicity_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"{bigger(sf)}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    got = toxicity.classify(d, train).join(labels.where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").select("is_toxic", "toxic").toPandas()
    assert not (got["is_toxic"] & (got["toxic"] == 0)).any()
    assert got[got["toxic"] == 1]["is_toxic"].mean() >= 0.5  # a few dozen labels only


def test_quality_held_out(spark, sf):
    from tessitura.llm.queries import op6_quality

    got = op6_quality(spark, bigger(sf)).join(spark.read.parquet(f"{bigger(sf)}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.estimate_prior(p, np.r_[rng.normal(2, 1, 3000), n[:1000]]) - 0.75) < 0.06


def test_risk_is_not_negative():
    """The model separates although positives are among the unlabelled."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (800, len(quality.STATS))), rng.normal(3, 1, (200, len(quality.STATS)))
    m = quality.fit(good[:400], np.vstack([good[400:], bad]))
    assert quality.predict(good, m).mean() > 0.7 > 0.4 > quality.predict(bad, m).mean()


def test_risk_by_brute_force():
    """The fitted weights have a lower non-negative risk, summed row by row, than their neighbours and than zero."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (120, len(quality.STATS))), rng.normal(1.5, 1, (80, len(quality.STATS)))
    p, u = good[:60], np.vstack([good[60:], bad])
    m = quality.fit(p, u)
    xp, xu = (quality._binned(x, m.edges) for x in (p, u))

    def risk(w):
        loss = lambda row, sign: math.log1p(math.exp(-sign * (sum(row * w[:-1]) + w[-1])))
        plus, minus = sum(loss(r, 1) for r in xp) / len(xp), sum(loss(r, -1) for r in xp) / len(xp)
        return m.prior * plus + max(0.0, sum(loss(r, -1) for r in xu) / len(xu) - m.prior * minus) + 0.5e-3 * sum(w[:-1] ** 2)

    best = risk(m.weights)
    assert best < risk(np.zeros_like(m.weights)) - 0.05
    for k in range(5):
        assert best < risk(m.weights + rng.normal(0, 0.3, len(m.weights))) + 1e-6


def test_quality_odd_tables(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train(docs, none, F.col("quality") == 1)
    got = quality.score_documents(docs, m)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.score_documents(empty, quality.train(empty, none, F.col("quality") == 1)).count() == 0


@pytest.mark.parametrize("top", [5, 200_000])
def test_base_score(docs, top):
    d = docs.withColumn("n_known", F.lit("clash"))
    got = lm.score_documents(d, ~F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"), top=top, vocabulary=5).collect()
    counts = Counter()
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 or r["doc_id"] is None:
            counts.update(lm.words(r["text"].encode() if r["text"] else None))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r["doc_id"] or 0, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for r in docs.collect() for w in [lm.words(r["text"].encode() if r["text"] else None)])
    for g, w in zip(sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in got), want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9)
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def fitted(docs, **options):
    counts = lm.count_words(docs.select("text"))
    known = lm.lexicon(counts, options.pop("top", lm.TOP))
    tokens = lm.encode(docs, known, F.lit(True))
    return known, tokens, lm.start_model(counts, known, tokens, **options)


def test_encoding_keeps_every_word(docs):
    known, tokens, _ = fitted(docs, top=5, vocabulary=3)
    for r in tokens.collect():
        rare, words = iter(r["rare"]), []
        for i in np.frombuffer(r["ids"], np.int32).tolist():
            words.append(known.top[i] if i >= 0 else next(rare).encode())
        text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["__id"])
        assert words == lm.words(text.encode() if text else None) or r["__id"] == 2
    assert tokens.select("row").distinct().count() == docs.count()


def test_neighbour_counts(spark):
    docs = spark.createDataFrame([(1, "b a x a b"), (2, "a a a")], "doc_id long, text string")
    known, tokens, _ = fitted(docs)
    at = {w: i - 1 for i, w in enumerate(known.top)}
    got = lm.neighbour_counts(tokens, len(known.top) - 1)
    assert got[at[b"a"], at[b"b"]] == 2 and got[at[b"a"], at[b"a"]] == 4 and got[at[b"b"], at[b"x"]] == 1 and got[at[b"x"], at[b"x"]] == 0


def test_probabilities_sum_to_one(spark, sf):
    known, tokens, start = fitted(spark.read.parquet(f"{sf}/documents.parquet"), top=500, vocabulary=50)
    model = lm.train(tokens, start)
    s = lm.Scorer(model)
    first = tokens.select("ids", "rare").limit(1).toArrow()
    _, _, histories, _, _ = s.flat(first.column("ids").combine_chunks(), [w.encode() for w in first.column("rare").to_pylist()[0]])
    v = 50
    assert (model.slot_weights != 0).any() and (model.weights != 0).any()
    for h in histories.T[:30]:
        # of a history: all vocabulary words, and class OTHER as a whole, which is spelled
        at = np.repeat(h[:, None], v, axis=1)
        logs = s.log_class(at, model.classes[:v]) + s.log_slot(at, model.classes[:v], model.slots[:v]) + model.within[:v] * math.log(10)
        other = s.log_class(h[:, None], np.array([lm.OTHER]))
        assert np.exp(logs).sum() + np.exp(other).sum() == pytest.approx(1, abs=1e-4)
    words = [bytes([a, b]) for a in range(33, 127) for b in range(33, 127)] + [bytes([a]) for a in range(33, 127)]
    assert 0 < (10 ** lm.spell(words, model.spelling)).sum() < 1


def test_training_helps_on_other_texts(spark, sf):
    """Above the untrained model, which is a normalised unigram, on texts that were not learned from."""
    docs = spark.read.parquet(f"{bigger(sf)}/documents.parquet")
    held = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    counts = lm.count_words(docs.where(~held).select("text"))
    known = lm.lexicon(counts)
    tokens = lm.encode(docs, known, ~held)
    start = lm.start_model(counts, known, tokens)
    model = lm.train(tokens, start)
    some = tokens.where("not learn").toArrow()
    rare = some.column("rare").combine_chunks().flatten().cast("binary").to_pylist()
    before, after = (lm.Scorer(m).score(some.column("ids").combine_chunks(), rare)[3].sum() for m in (start, model))
    classes_only = lm.Scorer(model._replace(slot_weights=start.slot_weights)).score(some.column("ids").combine_chunks(), rare)[3].sum()
    assert after > classes_only > before


def test_gradient_by_brute_force():
    """An update equals the one of gradients summed token by token."""
    rng = np.random.default_rng(6)
    w, bias = rng.normal(0, 0.3, (16, 5)).astype(np.float32), rng.normal(0, 1, 5).astype(np.float32)
    features, y = rng.integers(0, 16, (lm.FEATURES, 40)), rng.integers(0, 5, 40)
    g, total = np.zeros(w.shape), 0.0
    for t in range(40):
        z = [math.exp(bias[k] + sum(float(w[f, k]) for f in features[:, t])) for k in range(5)]
        total += math.log(z[y[t]] / sum(z))
        for f in features[:, t]:
            for k in range(5):
                g[f, k] += z[k] / sum(z) - (k == y[t])
    assert lm.log_softmax(w, bias, features, y).sum() == pytest.approx(total, rel=1e-5)
    met = np.isin(np.arange(16), features)  # rows without a feature stay
    want = np.where(met[:, None], w - lm.RATE * g / np.sqrt(1e-2 + g * g), w)
    lm.gradient_step(w, np.full(w.shape, 1e-2, np.float32), bias, features, y)
    assert np.allclose(w, want, atol=1e-4)


def test_nothing_to_learn_from(docs, empty):
    got = lm.score_documents(docs, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(empty, F.lit(True)).count() == 0


def test_sums_over_stored_rows(spark, sf):
    """What is summed on executors is what the same rows give at hand, whatever their partitions."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(0, 1, (500, len(quality.STATS)))).astype(np.float32)
    half = np.arange(500) % 2
    table = spark.createDataFrame([(int(h), r.tolist()) for h, r in zip(half, x)], "half int, x array<float>").repartition(7)
    stored, rows = quality.Stored(table), quality.Rows(x)
    shares = np.linspace(0, 1, 9)
    assert (stored.quantiles(shares) == rows.quantiles(shares)).all()
    assert np.abs(rows.quantiles(shares) - np.quantile(x, shares, axis=0, method="lower").T).max() < 0.02
    edges = np.sort(rng.random((len(quality.STATS), quality.BINS - 1)) * 2, axis=1)
    for s in (stored, rows):
        s.bin(edges)
    models = [(k, rng.normal(0, 0.3, len(quality.STATS) * quality.BINS + 1)) for k in (0, 1, None)]
    a, b = stored.sums(models), rows.sums(models)
    assert np.allclose(a, b, rtol=1e-5, atol=1e-4) and a[:, 0].tolist() == [250, 250, 500]
    above = [(k, models[k][1], np.linspace(-2, 2, 5)) for k in (0, 1)]
    assert (stored.above(above) == rows.above(above)).all()
    z = [sum(models[2][1][i * quality.BINS + sum(e < v for e in edges[i])] for i, v in enumerate(r)) + models[2][1][-1] for r in x]
    assert a[2, 1] == pytest.approx(sum(math.log1p(math.exp(v)) for v in z), rel=1e-5)


def test_grid_keeps_the_order():
    x = np.sort(np.r_[np.random.default_rng(0).normal(0, 10, 300), 0.0, -0.0, 1e-30, 1e30, -1e30])
    g = quality._grid(x)
    assert (np.diff(g) >= 0).all() and (quality._value(g) <= x.astype(np.float32) + 1e-30).all() and (quality._grid(quality._value(g)) == g).all()


def test_quality_scores_by_plain_loops(spark, sf):
    """Every document's score in the query's result, from the model's cuts and weights, one statistic after another."""
    from tessitura.llm.queries import _remainder, op6_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), (F.col("quality") == 1) & (_remainder(4) != 2))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in op6_quality(spark, sf).collect():
        t = texts[r["doc_id"]].encode()
        w = t.split()
        x = [0.0] * len(quality.STATS)
        if w:
            lines, inside = [line for line in t.split(b"\n") if line.strip()], sum(len(v) for v in w)
            count = lambda chars: sum(b in chars for b in t)
            x = [
                math.log(len(w)), math.log(len(set(w))) / math.log(len(w)) if len(w) > 1 else 1.0, inside / len(w), count(b"#*$%&<>@^~=_{}[]") / len(w), count(bytes(range(65, 91))) / inside, count(b"0123456789") / inside,
                count(b".,;:!?") / len(w), 1 - len(set(lines)) / len(lines), max(w.count(v) for v in set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), t.count(b"!") / len(w), t.count(b"|") / len(w),
                len(w) / len(lines), 1 - sum(b < 128 and not chr(b).isalpha() for b in t) / len(t),
            ]
        z = m.weights[-1]
        for i, v in enumerate(x):
            z += m.weights[i * quality.BINS + sum(e < v for e in m.edges[i])]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), r["doc_id"]


def test_toxicity_scores_by_plain_loops(spark, sf):
    """Every document's probabilities in the query's result, from the links' words and weights, one after another."""
    import re

    from tessitura.llm.queries import op3_toxicity

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    links = toxicity.fit(toxicity.sample_labelled(docs, labels))
    texts = {r["doc_id"]: (r["text"] or "").encode().lower() for r in docs.collect()}
    for r in op3_toxicity(spark, sf).collect():
        found = set(re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r["doc_id"]]))
        p = []
        for link in links:
            z = link.intercept + sum(a * b for a, b in zip(link.weights_before, p))
            for f, v in link.words.items():
                if f in found or f.endswith(b"/") and any(w.startswith(f[:-1]) and len(w) > len(f) - 1 for w in found):
                    z += v
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
            assert r[f"p_{link.name}"] == pytest.approx(p[-1], abs=2e-6)
        assert r["toxic"] == (p[-1] >= toxicity.THRESHOLD)
