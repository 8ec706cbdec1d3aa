"""License, decontamination and secret scans against brute force."""

import hashlib
import re

from eqlake.llm import decontaminate, licenses, secrets

from . import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, sf_dir):
    own = fixtures.documents(spark)
    return own.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_licenses(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    expected = []
    for r in docs.collect():
        w = words(r.text)
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        expected.append((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.licenses(docs).collect()
    assert key(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in licenses.licenses(fixtures.documents(spark)).collect()}
    fuzzy = by_id[13]
    assert fuzzy.labels == "apache-2,cc-by-nc,mit" and fuzzy.base_labels == "cc-by-nc"
    text = dict(fixtures.TEXTS)[13]
    assert [text[s.start : s.end] for s in fuzzy.spans] == ["under the mitt license", "apache licence version 2", "cc by nc"]
    assert licenses.licenses(fixtures.empty(spark)).count() == 0


def test_every_bounded_edit_is_found():
    """Pigeonhole against plain dynamic programming: all one-edit variants of a notice are found."""
    finder = licenses.NoticeFinder((("cc by nc", "cc-by-nc"), ("under the mit license", "mit")))
    for phrase, label in finder.notices and [(n[0], n[1]) for n in finder.notices]:
        for i in range(len(phrase)):
            for variant in (phrase[:i] + phrase[i + 1 :], phrase[:i] + "q" + phrase[i + 1 :], phrase[:i] + "q" + phrase[i:]):
                line = f"before {variant} after"
                line = " ".join(line.split())
                assert label in {m[4] for m in finder.matches(line)}, variant


def test_another_license_is_no_misspelling():
    finder = licenses.NoticeFinder()
    for text in ("this is cc by nd here", "cc by nd", "the Apache License, Version 1.1 applies"):
        found = finder.scan(text.encode())
        assert (found["labels"], found["score"], found["spans"]) == ("", 0.0, [])
    assert finder.scan(b"cc by nd and cc by nc")["labels"] == finder.scan(b"cc by nq")["labels"] == "cc-by-nc"
    assert finder.scan(b"apache licence version 2")["labels"] == "apache-2"


def contaminated(docs, items):
    out = []
    patterns = {}
    for i, t in items:
        w = words(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            patterns.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths = sorted({len(p) for p in patterns})
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    own = [(100, fixtures.PASSAGE), (101, "end"), (102, None), (103, ""), (104, "Hello world"), (None, "control chars vertical"), (105, fixtures.PASSAGE)]
    bench = spark.createDataFrame(own, "item_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    expected = contaminated([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert key(decontaminate.contamination(docs, bench).collect(), *names) == expected
    # the same in blocks
    assert key(decontaminate.contamination(docs, bench, block_bytes=3000).collect(), *names) == expected
    assert decontaminate.contamination(fixtures.empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(fixtures.documents(spark), bench.where("false")).collect()} == {0}
    clean = decontaminate.keep_clean(fixtures.documents(spark), bench)
    assert clean.columns == fixtures.documents(spark).columns
    assert {r.doc_id for r in clean.collect()}.isdisjoint({5, 6})


def base_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    expected = []
    for r in docs.collect():
        s = base_spans(r.text)
        count = [sum(x[3] == k for x in s) for k in ("assign", "access", "hex")]
        expected.append((r.doc_id, *count, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in s))))
    got = secrets.secrets(docs).collect()
    assert key(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)
    assert secrets.secrets(fixtures.empty(spark)).count() == 0


def test_ledger_scans_unseen_pairs_only(spark):
    v1 = spark.createDataFrame([("a", "password=abcdef"), ("b", "password=abcdef"), ("c", "clean")], "path string, text string")
    first = secrets.Ledger().scan(v1, secrets.BASE)
    assert first.table.count() == 2 * len(secrets.BASE)
    v2 = spark.createDataFrame([("d", "password=abcdef"), ("c", "token=123456789")], "path string, text string")
    second = first.scan(v2, secrets.BASE)
    assert second.table.count() == 3 * len(secrets.BASE)
    newer = (secrets.Rule("assign", 2, "pass", 0, 1), *secrets.BASE[1:])
    third = second.scan(v2, newer)
    assert third.table.count() == second.table.count() + 2
    assert {tuple((s.start, s.end) for s in r.spans) for r in third.findings(newer).collect()} == {((0, 4),)}


def test_redaction(spark):
    docs = fixtures.documents(spark)
    out = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert secrets.redacted(docs).columns == docs.columns
    assert out[7].text == "[secret], [secret] token: short [secret]" and out[7].n_chars == len(out[7].text)
    assert out[1].text is None and out[9].text == fixtures.LONG


def test_redaction_of_whole_keys(spark):
    line = "MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7VJTUt9Us8cKj"
    body = "\n".join([line] * 2000 + ["Zm9v+/=="])  # 130 KB
    begin, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
    own, rsa = (begin.format(""), end.format("")), (begin.format("RSA "), end.format("RSA "))
    armor = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    cases = {
        1: (f"a {own[0]}\n{body}\n{own[1]} b", "a [secret] b"),
        2: (f"a {rsa[0]}\n{armor}{body}\n{rsa[1]}\nb", "a [secret]\nb"),
        # no footer, another footer, and another key in between
        3: (f"a {rsa[0]}\n{armor}{body}\nand so on", "a [secret]\nand so on"),
        4: (f"{rsa[0]}\n{line}\n{own[1]} b", f"[secret]\n{own[1]} b"),
        5: (f"{own[0]}\n{line}\nplain words\n{rsa[0]}\r\n{line}\r\n{rsa[1]}\n{own[1]}", f"[secret]\nplain words\n[secret]\n{own[1]}"),
        6: (f'"key": "{own[0]}\\n{line}\\n{line}"}}', '"key": "[secret]"}'),
        7: (f"{own[0]} {line} {line} Zm9vYmFyYmF6Zm9v= and so on", "[secret] and so on"),
        8: (f"the marker {own[0]} begins a key", "the marker [secret] begins a key"),
        9: (f"{own[0]}\n{line}\n{own[1]}{own[0]}\n{line}\n{own[1]}", "[secret][secret]"),
    }
    docs = spark.createDataFrame([(k, text) for k, (text, _) in cases.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redacted(docs).collect()} == {k: out for k, (_, out) in cases.items()}
    spans = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
    assert f"pem:2:{len(cases[1][0]) - 2}" in spans[1].split(",")
