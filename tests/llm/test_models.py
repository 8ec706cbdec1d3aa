"""Near-duplicates against brute force, held-out accuracy of the trained models, and the pipeline."""

from collections import Counter, defaultdict

import numpy as np

from eqlake.llm import language, neardup, toxicity

from . import fixtures


def brute(rows):
    """Exact components: pairs that share one of a set's rarest shingles are compared on full sets."""
    sets = {i: s for i, t in rows if i is not None and (s := neardup.shingle_set((t or "").encode()))}
    count = Counter(x for s in sets.values() for x in s)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets, key=lambda k: len(sets[k])):
        s = sets[i]
        head = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-80 * len(s) // 100) + 1]
        for j in {j for x in head for j in seen[x]}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for x in head:
            seen[x].append(i)
    return {i: (len(sets.get(i, ())), top(i) if i in sets else i) for i, _ in rows if i is not None}


def test_near_duplicates(spark, sf_dir):
    own = fixtures.documents(spark).select((-1000 - F_id()).alias("doc_id"), "text")
    docs = own.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = docs.collect()
    want = brute([(r.doc_id, r.text) for r in rows])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def F_id():
    from pyspark.sql import functions as F

    return F.col("doc_id")


def test_estimate_is_near():
    import numpy as np

    rng = np.random.default_rng(5)
    for j in (0.6, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = neardup.sketch(x[:n]), neardup.sketch(x[n - both :])
        assert abs(neardup.likeliest(a, b, n, n) - j) < 0.1
        # merging sketches is the sketch of the union
        assert (np.maximum(a, b) == neardup.sketch(x)).all()


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    every = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    # what is found, and what is rejected wrongly, as the README says; few labels are of the last two languages
    for lang, found, wrong in (("en", 0.85, 0.01), ("fr", 0.9, 0.15), ("de", 0.75, 0.03), ("es", 0.1, 0.01)):
        rows = [r for r in every if r.lang == lang]
        toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
        print(lang, sum(r.predicted for r in toxic), len(toxic), sum(r.predicted for r in clean), len(clean))
        assert sum(r.predicted for r in toxic) / len(toxic) >= found, lang
        assert sum(r.predicted for r in clean) / len(clean) <= wrong, lang
    model = toxicity.train(docs, labels)
    # insults with a letter inserted at each place, which nothing but the kernel undoes, by the query's own model
    queried = toxicity.train(docs, labels.where(~toxicity.held_out()))
    bent = [w[:k] + c + w[k:] for w in ("idiot", "stupid", "pathetic") for k in range(1, len(w)) for c in "xbmleayt7"]
    assert np.mean(queried.text_scores([f"you {w} there".encode() for w in bent]) > 0.7) >= 0.9
    assert queried.text_scores([b"the weather is nice", b"an idyllic village", b"a stupendous view"]).max() < 0.7
    own = toxicity.score(fixtures.documents(spark), model).collect()
    assert len(own) == len(fixtures.TEXTS) and all(0 <= r.score <= 1 for r in own)
    assert toxicity.score(fixtures.empty(spark), model).count() == 0
    assert model.text_scores([b"you i.d.i.o.t", b"you i d i o t"]).min() > 0.7
    assert {r.predicted for r in toxicity.score(fixtures.documents(spark), toxicity.fit([], [])).collect()} == {0}


def test_margins_are_the_kernel_sums():
    """A collapsed model against sums over subsequences, with few letters (full table) and with 1,500 (sorted keys)."""
    rng = np.random.default_rng(3)
    for letters in ("abcdef", "".join(chr(0x4E00 + k) for k in range(1500))):
        words = ["".join(rng.choice(list(letters), rng.integers(1, 19))) for _ in range(200)]
        weights = {k: float(v) for k, v in zip((k for w in words[:80] for k in toxicity.subsequences(w)), rng.normal(size=100_000), strict=False)}
        model = toxicity.Model(weights, -0.25, 1.0, 0.0)
        assert (model.keys is None) == (len(letters) < 40)
        want = [sum(v * weights.get(k, 0.0) for k, v in toxicity.subsequences(w).items()) - 0.25 for w in words]
        assert np.allclose(model.word_margins([w.encode() for w in words]), want, atol=1e-4)


def test_training_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(k % 3, f"text number {k} you idiot") for k in range(600)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 0)) for k in range(3)] + [(None, 1)], "doc_id long, toxic int")
    rows = []
    stored, toxicity._fit_rows = toxicity._fit_rows, lambda batches: counted(batches)

    def counted(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([toxicity.Model({"abcd": float(n)}, 0.0, 1.0, 0.0).stored()], pa.binary())], names=["model"])

    try:
        rows = toxicity.train(docs, labels, 7, 11).learned
    finally:
        toxicity._fit_rows = stored
    assert rows == {"abcd": 18.0}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    own = {r.doc_id: r for r in language.languages(fixtures.documents(spark)).collect()}
    assert own[1].lang_pred == own[2].lang_pred == own[3].lang_pred == "und"
    assert language.languages(fixtures.empty(spark)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, sf_dir).columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()


def links(rows, size):
    """Exact components, every pair compared."""
    sets = [(i, s) for i, t in rows if (s := neardup.shingle_set((t or "").encode(), size))]
    low = {i: i for i, _ in rows}
    for k, (i, s) in enumerate(sets):
        for j, other in sets[:k]:
            if 100 * (both := len(s & other)) >= 80 * (len(s) + len(other) - both) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = {n: a if x == b else x for n, x in low.items()}
    return low


def test_near_duplicate_stage(spark):
    """The stage takes five words: one changed word in 20 is not near, one in 100 is."""
    import random

    import corpus_pipeline

    rng, rows = random.Random(3), []
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for version, every in enumerate((0, 20, 20, 100, 60)):
            own = list(words)
            for at in range(every - 1 - version if every else 200, 200, every or 200):
                own[at] = f"new{base}x{version}x{at}"
            rows.append((10 * base + version, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "few words"), (903, "few words"), (904, "Few  WORDS only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    five, two = links(rows, 5), links(rows, 2)
    assert five != two
    out = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == [i for i, low in five.items() if i == low]
    for size, want in ((5, five), (2, two)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size).collect()}
        assert got == {i: (len(neardup.shingle_set((t or "").encode(), size)), want[i]) for i, t in rows}


def test_toxic_sets_with_ties_and_repeats(spark):
    """Repeated rows and tied margins don't change what is learned; a text's score doesn't depend on its neighbours."""
    toxic, clean = [f"word{k} badword{'xy'[k % 2]} end".encode() for k in range(40)], [f"word{k} goodword end".encode() for k in range(80)]
    texts, labels = toxic + clean, [True] * 40 + [False] * 80
    one, two = toxicity.fit(texts, labels), toxicity.fit(texts * 3, labels * 3)
    probe = texts + [b"", b"word1", b"badwordx " * 9000]
    assert (one.text_scores(probe) == two.text_scores(probe)).all()
    alone = [float(one.text_scores([t])[0]) for t in probe]
    assert max(abs(a - b) for a, b in zip(alone, one.text_scores(probe), strict=True)) < 1e-6
    assert one.text_scores(toxic).min() > 0.7 > one.text_scores(clean).max()
