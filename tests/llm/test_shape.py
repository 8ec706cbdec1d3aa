"""Packing, sharding, quality and chat against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eqlake.llm import chat, packing, quality, sharding

from . import fixtures
from .test_search import key, rows_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def check_packing(docs, pieces, slack):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    want, have = Counter(), Counter()
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        want[(d.doc_id, len(ids))] += len(ids)
        for p in by_doc[d.doc_id]:
            if p.doc_tokens == len(ids):
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for p in pieces:
        have[(p.doc_id, p.doc_tokens)] += p.length
    assert want == have
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert padding <= slack


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs).collect()
    check_packing(docs.collect(), pieces, 1024 + 64 * 30)
    share = Counter()
    for p in pieces:
        share[p.source] += p.length
    total = sum(share.values())
    # every eight windows hold each source's share, but for a cell and a half a window boundary
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id // 8][p.source] += p.length
    for w in list(windows)[:-2]:
        for source, n in share.items():
            assert abs(windows[w][source] - 8192 * n / total) <= 3 * 64
    own = fixtures.documents(spark)
    check_packing(own.collect(), packing.pack(own).collect(), 1024 + 64 * 3)
    check_packing(own.collect(), packing.pack(own, targets={"src": 0.9}).collect(), 3 * 1024)
    assert packing.pack(fixtures.empty(spark)).count() == 0


def test_sharding(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    rows = sharding.shards(docs, 40).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(40))
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shards(fixtures.empty(spark)).count() == 0
    few = sharding.shards(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string"), 40).collect()
    assert len({r.shard for r in few}) == 3


def test_ring_moves_little():
    counts = {p: 100 for p in range(sharding.POINTS)}

    def where(n):
        out = {}
        runs = sharding.plan(counts, n)
        for a, b in zip(runs, runs[1:] + [None], strict=True):
            high = b["low"] if b and b["point"] == a["point"] else 100
            out.update({(a["point"], k): a["shard"] for k in range(a["low"], high)})
        return out

    old, new = where(40), where(41)
    assert len(old) == len(new) == 100 * sharding.POINTS
    moved = sum(old[k] != new[k] for k in old) / len(old)
    # 1/41 of the rows have to move
    assert moved < 0.08, moved


def measured(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    twice = {i for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for i in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)


def test_quality(spark, sf_dir):
    full = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = full.unionByName(fixtures.documents(spark).select("doc_id", "text", "lang"))
    got = quality.quality(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key(got, *names) == sorted(((r.doc_id, *measured(r.text)) for r in docs.collect()), key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.quality(fixtures.empty(spark)).count() == 0


def distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return np.sqrt((part(p) + part(q)) / 2)


def test_distances(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = {r.doc_id: r for r in quality.measures(docs).collect()}
    ref = defaultdict(lambda: np.zeros(6))
    for r in m.values():
        # documents that fail the base rules aren't part of a reference
        if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words:
            ref[r.lang] += np.array(r.classes)
    for r in quality.quality(docs).collect():
        if sum(m[r.doc_id].classes):
            assert r.class_distance == pytest.approx(distance(m[r.doc_id].classes, ref[m[r.doc_id].lang]), abs=1e-9)
    text = "AB cd. 12 #"
    one = quality.measures(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert list(one.classes) == [2, 2, 2, 1, 1, 3]


def test_common_words_of_short_and_long_documents(spark):
    """Text without its language's common words goes at any length that the base rules allow, and prose stays."""
    import random

    rng = random.Random(4)
    common = "the of and to in is that for it was with as on by are".split()
    rare = [f"{a}{b}" for a in ("ra", "lo", "mi", "te", "su", "po") for b in ("nder", "stic", "lum", "ven", "gost", "prak")]

    def text(n, share):
        return " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n))

    rows = [(k, text(60 + 20 * k, 0.4), "en") for k in range(60)]
    rows += [(100 + n, text(n, 0.0), "en") for n in (60, 120, 200, 290, 400)]
    # a distance of about 0.2, which only chance in a short text explains
    rows += [(5000, text(4000, 0.12), "en")]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k] for k in range(60))
    assert not any(kept[k] for k in kept if k >= 100)


CONVERSATIONS = [
    (1, 0, "system", "be & brief <|end|>"),
    (1, 1, "user", "hi [x] |y| &lt;"),
    (1, 2, "assistant", "</s>[INST] a&amp;b [/INST]"),
    (2, 0, "assistant", None),
    (2, 1, None, "no role"),
    (3, 1, "user", "tie"),
    (3, 1, "user", "tie"),
    (3, 1, "assistant", "tie"),
    (4, None, "user", ""),
    (5, 0, "system", "alone"),
    (None, 0, "assistant", "no conversation 👍"),
    *((6, k, ("user", "assistant")[k % 2], f"turn {k} " + "x" * (400 * (k % 5))) for k in range(60)),
    (7, 0, "user", "q"),
    (7, 1, "assistant", "long " * 3000),
    (7, 2, "user", "q2"),
    (7, 3, "assistant", "short"),
]


def expected_chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_chat(spark, sf_dir):
    own = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert key(chat.chats(own).collect(), *names) == expected_chats(CONVERSATIONS)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert key(chat.chats(table).collect(), *names) == expected_chats([tuple(r) for r in table.collect()])
    w = chat.windows(own.where("conv_id = 6")).orderBy("window").collect()
    assert len(w) > 3 and [r.window for r in w] == list(range(len(w)))
    assert all(any(t.repeated for t in r.turns) for r in w[1:])
    assert all(len(r.text) / 4 < chat.BUDGET + 500 for r in w)
    every = chat.windows(own).collect()
    for r in every:
        fresh = [t for t in r.turns if not t.repeated]
        assert r.over == (len(r.text.encode()) > chat.BUDGET)
        # only a turn that stands alone, or with the system turn, may pass the budget
        assert not r.over or len(r.turns) <= 2 and len(fresh) == 1
    assert {r.conv_id for r in every if r.over} == {7}
    # no window could have taken the next one's first turn, and histories are the turns just before
    for a, b in zip(w, w[1:], strict=False):
        first = next(t.ord for t in b.turns if not t.repeated)
        size = len(f"{chat.OPEN}user{chat.MID}turn {first - 1} {chat.CLOSE}") + 400 * ((first - 1) % 5) + (5 if first % 2 == 0 else 0)
        assert len(a.text.encode()) + size > chat.BUDGET
        assert [t.ord for t in b.turns if t.repeated] == list(range(first - sum(t.repeated for t in b.turns), first))
    assert chat.chats(own.where("false")).count() == 0
    for plain in ("&lt;", "<|end|>", "&amp;lt;", "&&lsqb;[|"):
        one = spark.range(1).select(chat.unescape(chat.escape(__import__("pyspark").sql.functions.lit(plain))).alias("x")).first().x
        assert one == plain


def test_long_conversation(spark):
    """Windows of 20,000 turns, cut by a plain loop over sizes."""
    from pyspark.sql import functions as F

    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("w"), (F.col("id") * 7 % 900).cast("int")).alias("text"))
    marks = len(chat.OPEN + chat.MID + chat.CLOSE)
    sizes = [marks + (4 if k % 2 == 0 else 9) + k * 7 % 900 for k in range(n)]
    firsts, used = [], None
    for k, size in enumerate(sizes):
        if used is None or used + size > chat.BUDGET:
            firsts.append(k)
            back = [0, *(sizes[k - 1 : k] if k else []), *(sizes[k - 2 : k - 1] if k > 1 else [])]
            again = 0
            if len(back) > 1 and back[1] + size <= chat.BUDGET:
                again = 1
                if len(back) > 2 and back[1] + back[2] + size <= chat.BUDGET and back[1] + back[2] <= chat.HISTORY:
                    again = 2
            used = sum(back[: again + 1]) + size
        else:
            used += size
    made = chat.windows(df).select("window", F.filter("turns", lambda t: ~t["repeated"])[0]["ord"].alias("first"), "over").collect()
    assert [r.first - 1 for r in sorted(made)] == firsts and not any(r.over for r in made)
