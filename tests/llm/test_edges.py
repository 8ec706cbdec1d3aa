"""Clashing names, many languages and sources, long texts, and brute force for what SQL can't express."""

import itertools
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqlake.llm import common, decontaminate, language, licenses, packing, quality, secrets, toxicity

from . import fixtures


def test_names_that_the_table_has(spark):
    docs = fixtures.documents(spark)
    for c in ("_spans", "_items", "_n_words", "_blob", "_kept", "__spans", "_salt"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame([(1, fixtures.PASSAGE), (2, "other words " * 3000)], "item_id long, text string")
    for size in (1 << 20, 2000):
        clean = decontaminate.keep_clean(docs, bench, block_bytes=size)
        assert clean.columns == docs.columns
        rows = clean.collect()
        assert {r.doc_id for r in rows}.isdisjoint({5, 6}) and len(rows) == docs.count() - 3 and rows[0]["_spans"] == "_spans"
    masked = secrets.redacted(docs)
    assert masked.columns == docs.columns and {r["_blob"] for r in masked.collect()} == {"_blob"}
    import corpus_pipeline

    near = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    assert near.columns == docs.columns and {r["_kept"] for r in near.collect()} == {"_kept"}


def test_long_and_repeated_items_are_cut(spark):
    """A benchmark of one long item, many times: the same hits whatever the size of blocks."""
    words = [f"w{k % 4001}x{k}" for k in range(20_000)]
    item = " ".join(words)
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(words[at : at + n])) for k, (at, n) in enumerate([(0, 13), (700, 40), (19_980, 20), (5, 12)])], "doc_id long, text string")
    want = [(0, 13, 2), (1, 40, 2), (2, 20, 2), (3, 0, 0)]
    for size in (1 << 22, 60_000):
        got = decontaminate.contamination(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == want


def test_more_copies_than_are_broadcast(spark, monkeypatch):
    docs = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("password=abcdef1")).otherwise(F.concat(F.lit("token: xxx"), F.col("id") % 50)).alias("text")).withColumnRenamed("id", "doc_id")
    key = lambda rows: sorted(tuple(r) for r in rows)
    want = key(secrets.secrets(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert key(secrets.secrets(docs).collect()) == want


def test_ledger_between_jobs(spark, sf_dir, tmp_path):
    """A second version scans only texts that the saved ledger hasn't, and gives what a scan of all gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    old = docs.where("path % 3 != 0")
    secrets.Ledger().scan(old).save(f"file://{tmp_path}/v1")
    first = secrets.Ledger.load(spark, f"file://{tmp_path}/v1")
    second = first.scan(docs)
    texts = {(r.path, r.text or "") for r in docs.collect()}
    new = {t for _, t in texts} - {t for p, t in texts if p % 3}
    assert second.table.count() - first.table.count() == len(new) * len(secrets.RULES)
    key = lambda ledger: sorted((r.blob, str(r.spans)) for r in ledger.findings().collect())
    assert key(second) == key(secrets.Ledger().scan(docs))


def test_rules_beyond_the_base(spark):
    cases = {1: ("x eyJabcdefgh.eyJijklmnop.qrstuvwxyz y", "jwt:2:36"), 2: ("ghp_" + "a1B2" * 9, "hub:0:40"), 3: ("xoxb-12345-abcdef!", "chat:0:17"), 4: ("eyJ.eyJ. gh_ xox", "")}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.secrets(docs).collect()} == {k: s for k, (_, s) in cases.items()}


def test_five_thousand_sources(spark):
    rows = [(k, f"text number {k}", f"s{k % 5000}") for k in range(6000)] + [(7000, "a", None), (7001, "b", "<null>"), (7002, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs).collect()
    source = {i: s for i, _, s in rows}
    assert {p.doc_id for p in pieces} == set(source) and all(p.source == source[p.doc_id] for p in pieces)
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_rounds_carry_deficits():
    """The closed form against counters: at each node of the tree of queues, what a round can't serve in whole cells is carried to the next."""
    for cells in ([5], [700, 300, 20], [1, 1, 1, 1, 1], [997, 500, 250, 125, 60, 30, 3]):
        rounds = packing.Rounds(cells, 16)
        carried: dict[tuple[int, int], int] = {}

        def serve(lo, hi, n, cells=cells, carried=carried):
            if hi - lo == 1:
                return [n]
            mid, whole = (lo + hi) // 2, sum(cells[lo:hi])
            credit = carried.get((lo, hi), 0) + n * sum(cells[lo : (lo + hi) // 2])
            carried[(lo, hi)] = credit % whole
            return serve(lo, mid, credit // whole) + serve(mid, hi, n - credit // whole)

        had, left, window = [0] * len(cells), sum(cells), 0
        while left:
            now = serve(0, len(cells), min(16, left))
            for q, n in enumerate(now):
                own = rounds.windows_of(q, np.arange(had[q], had[q] + n))
                assert (own == window).all()
                had[q] += n
            left -= sum(now)
            window += 1
        assert had == cells


def test_many_languages(spark):
    rows = [(k, f"wort{k % 700} der die das " * 20 + f"zeile {k}", f"l{k % 1100}") for k in range(2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert len(quality.quality(docs).collect()) == 2200
    got = language.languages(docs.limit(1200)).collect()
    assert len(got) == 1200 and all(0 <= r.score <= 1 for r in got)


def test_tables_without_lang_or_source(spark):
    docs = spark.createDataFrame([(1, "some text here"), (2, None), (2, None)], "doc_id long, text string")
    assert quality.quality(docs).count() == 3
    assert {r.lang_pred for r in language.languages(docs).collect()} == {"und"}
    assert {p.source for p in packing.pack(docs).collect()} == {None}


def test_pieces_of_a_long_text():
    text = "Ab cß" * 600_000
    whole = np.bincount(language.buckets(f" {text.lower()} "), minlength=1 << language.BITS)
    cut = sum(np.bincount(p, minlength=1 << language.BITS) for p in language.pieces(text))
    assert (whole == cut).all()


def test_bayes_by_dictionaries(spark):
    """Blocks of languages, and all at once, against sums of logarithms by hand."""
    train = [("aa bb aa", "x"), ("ab ab", "x"), ("cc dd", "y"), ("dd cc cc", "y"), ("aa cc", "z")]
    test = ["aa", "dd cc", "ab cc", "zz", "12", None, "aa aa dd"]
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(train)], "doc_id long, text string, lang string")
    counts, rows = defaultdict(Counter), Counter()
    for t, g in train:
        counts[g].update(language.buckets(f" {t} ").tolist())
        rows[g] += 1
    want = []
    for t in test:
        if not t or not any(map(str.isalpha, t)):
            want.append(("und", 0.0))
            continue
        logs = {}
        for g, c in sorted(counts.items()):
            total = sum(c.values()) + language.ALPHA * (1 << language.BITS)
            logs[g] = math.log(rows[g] / len(train)) + sum(math.log((c[b] + language.ALPHA) / total) for b in language.buckets(f" {t} ").tolist())
        best = max(logs, key=lambda g: (logs[g], [-ord(x) for x in g]))
        want.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(test)], "doc_id long, text string")
    for size in (1, 2, 256):
        language.BLOCK, old = size, language.BLOCK
        try:
            models = language.train(docs)
        finally:
            language.BLOCK = old
        assert len(models) == -(-3 // size)
        got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, models).collect()}
        for k, (g, s) in enumerate(want):
            assert got[k][0] == g and got[k][1] == pytest.approx(s, abs=1e-9)


def test_sample_is_the_smallest_hashes(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("lang"))
    hashed = docs.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()
    want = {(g, r.text) for g in "ab" for r in sorted((r for r in hashed if r.lang == g), key=lambda r: r.h)[:300]}
    assert {tuple(r) for r in language.sample(docs, 300).collect()} == want


def test_sample_is_bounded_whatever_ids_repeat(spark):
    rows = [(None, f"text {k}", "en") for k in range(500)] + [(7, f"other {k % 300}", "en") for k in range(600)] + [(k, "same words", "de") for k in range(5)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(df, 100).collect()
    assert sum(r.lang == "en" for r in got) == 100 and sum(r.lang == "de" for r in got) == 5


def test_kernel_by_every_subsequence():
    def brute(a, b):
        def weights(s):
            s = f"^{s}$"
            out = Counter()
            for at in itertools.combinations(range(len(s)), toxicity.ORDER):
                if at[-1] - at[0] < toxicity.SPAN:
                    out["".join(s[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] - toxicity.ORDER + 1)
            return out

        x, y = weights(a), weights(b)
        return sum(v * y[k] for k, v in x.items()) / toxicity.norm(len(a) + 2) / toxicity.norm(len(b) + 2)

    for a, b in (("idiot", "idxiot"), ("aaaa", "aa"), ("word", "words"), ("x", "y"), ("trash", "hsart")):
        assert toxicity.kernel(a, b) == pytest.approx(brute(a, b))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_numbers_and_other_licenses():
    find = licenses.NoticeFinder().scan
    for text in (b"Apache License, Version 1.1", b"Apache License Version 3", b"licensed under CC BY-ND", b"apache license version two"):
        assert find(text)["labels"] == ""
    assert find(b"licensed under the apache license version 1.0")["labels"] == "apache"
    assert find(b"apache licence version 2.0")["labels"] == "apache-2"


def test_licenses_by_dynamic_programming():
    """Labels and score against every span of whole words, on edited notices among words that resemble them."""
    import random

    rng = random.Random(8)
    finder, filler = licenses.NoticeFinder(), "the a mit cc by license version 2 gnu public use of under free to".split()
    for _ in range(150):
        words = [rng.choice(filler) for _ in range(rng.randrange(12))]
        phrase = list(rng.choice(licenses.NOTICES)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(phrase))
            phrase[at] = rng.choice(["", "q", phrase[at] + "s", " "])
        at = rng.randrange(len(words) + 1)
        words = (words[:at] + "".join(phrase).split() + words[at:]) or ["x"]
        labels, score = set(), 0.0
        for notice, label in licenses.NOTICES:
            k, m = licenses.edits_allowed(notice), notice.count(" ") + 1
            for a in range(len(words)):
                for n in range(max(1, m - k), m + k + 1):
                    span = " ".join(words[a : a + n])
                    if a + n <= len(words) and abs(len(span) - len(notice)) <= k and (d := distance(span, notice)) <= k:
                        if d == 0 or span not in licenses.OTHERS and licenses.numbers(span) == licenses.numbers(notice):
                            labels.add(label)
                            score = max(score, 1 - d / len(notice))
        got = finder.scan(" ".join(words).encode())
        assert (got["labels"], got["score"]) == (",".join(sorted(labels)), pytest.approx(score)), " ".join(words)


def test_many_notices_take_linear_time():
    def spent(n):
        begin = time.process_time()
        assert licenses.NoticeFinder().scan(b"under the mit license and " * n)["n_base"] == n
        return time.process_time() - begin

    spent(100)
    assert spent(16_000) < 40 * max(spent(1_000), 0.02)


def test_scratch_tables_can_go(spark):
    df = common.written(spark.range(10), "probe")
    assert df.count() == 10
    common.discard(df)
    with pytest.raises(Exception, match="(?i)path|file|exist"):
        common.spark_read = spark.read.parquet(df._eqlake_path).count()


def test_waiting_workers_keep_no_pieces_of_texts(spark):
    from eqlake.llm import packing

    path = packing.tokenizer_path()
    documents = spark.range(400).selectExpr("id doc_id", "concat('word', id, ' and letter', id * 7) text", "'s' source").repartition(4)
    assert packing.tokenized(documents, path).agg(F.sum("n")).first()[0] > 400

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            own = packing._ids.values()
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.chunks) for x in own)]), pa.array([sum("whole" in vars(x) for x in own)]), pa.array([len(own)])], names=["chunks", "whole", "loaded"])

    most = spark.range(0, 64, 1, 64).mapInArrow(held, "chunks bigint, whole bigint, loaded bigint").agg(F.max("chunks"), F.max("whole"), F.max("loaded")).first()
    assert tuple(most) == (0, 0, 1)


def test_special_token_in_a_text_brings_the_library(spark):
    from tokenizers import Tokenizer

    from eqlake.llm import packing

    path = packing.tokenizer_path()
    ids, whole = packing.Ids(path), Tokenizer.from_file(path)
    for text in ("plain words, and more", f"words {ids.special[0]} between" if ids.special else "words"):
        assert ids.of(text) == ids.pack([*whole.encode(text, add_special_tokens=False).ids, packing.END])
        assert ("whole" in vars(ids)) == any(s in text for s in ids.special)
