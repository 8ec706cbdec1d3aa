"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two word fragments sums, over all subsequences of ORDER
characters that both hold within SPAN characters, a weight that decays with
the gaps; it is divided by the fragments' norms. A gap costs a factor, not the
match, so inserted characters and changed endings leave much of it. A fragment's
kernel against the landmarks, whitened, is its feature vector (Nystroem); a
squared-hinge support vector machine is trained on these. The sum over
landmarks is linear in the subsequences, so the trained decision collapses to
one weight a subsequence, which is how texts are scored.

Labels belong to whole texts, whose sentences are taken apart into fragments. Training
picks in turn the witnesses of each toxic text among its fragments (multiple-instance
learning); fragments of other texts are all negative. Obfuscated forms of witnesses, with
a character inserted or replaced, are virtual examples. A text passes by its worst
fragment, or by the mean of its two or three worst different ones where these
pass what no clean text among the labelled ones does.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, remainder, ship, text_bytes

ORDER, SPAN, DECAY = 4, 7, 0.6
#: Fragments longer than this are cut into overlapping ones.
LONGEST = 20
LANDMARKS = 192
#: The bounded training sample: texts of each label (smallest hash of doc_id), and bytes of a training text.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_BYTES = 2500, 5000, 8192
THRESHOLD = 0.7
ROUNDS = 4
#: Witnesses, and frequent clean fragments, whose obfuscated forms are trained on.
VIRTUAL = 300
#: Highest margins of different fragments of a text that count.
HIGHEST = 3
#: Toxic texts that must have been kept from training for the cut to be chosen by these alone.
LEAST_HELD = 5
#: How much recall counts against precision where the cut of the highest is chosen.
BETA = 0.5
#: Fragments that are scored at a time.
CHUNK = 1 << 15
#: Weights are looked up in a full table of all subsequences if it has no more entries than this, else among sorted keys.
TABLE = 1 << 22

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPELLED = re.compile(rb"(?<!\S)(?:(?:[\x21-\x7F]|[\xC2-\xDF][\x80-\xBF]) ){2,}(?:[\x21-\x7F]|[\xC2-\xDF][\x80-\xBF])(?!\S)")
_SENTENCE = re.compile(rb"[^.!?\n]+[.!?\n]*")
#: Places of a subsequence's further characters from its first, and its weight.
_GAPS = [(places, DECAY ** (places[-1] - ORDER + 1)) for places in combinations(range(1, SPAN), ORDER - 1)]


def fragments(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation, and the joined form of letters that stand apart."""
    plain = text.translate(LOWER_BYTES, _PUNCTUATION)
    return plain.split() + [m.replace(b" ", b"") for m in _SPELLED.findall(plain)]


def cuts(word: bytes) -> list[str]:
    text = word.decode("utf-8", "replace")
    if len(text) <= LONGEST:
        return [text]
    return [text[k : k + LONGEST] for k in range(0, len(text) - LONGEST // 2, LONGEST // 2)]


def norm(size: int) -> float:
    """Length of the vector of a fragment of ``size`` characters, edges included, if none of its subsequences repeats."""
    return max(sum(w * w * max(0, size - places[-1]) for places, w in _GAPS), 1e-9) ** 0.5


def subsequences(fragment: str) -> dict[str, float]:
    """Weight of each subsequence of ORDER characters, over the norm; edges of the word are characters too."""
    s = f"^{fragment}$"
    n, out = len(s), {}
    for i in range(n - ORDER + 1):
        for places, w in _GAPS:
            if i + places[-1] < n:
                key = s[i] + "".join(s[i + k] for k in places)
                out[key] = out.get(key, 0.0) + w
    size = norm(n)
    return {k: v / size for k, v in out.items()}


def kernel(a: str, b: str) -> float:
    x, y = subsequences(a), subsequences(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


class Nystroem:
    """Features of fragments against landmark fragments."""

    def __init__(self, landmarks: list[str]):
        maps = [subsequences(x) for x in landmarks]
        self.index = {k: i for i, k in enumerate(dict.fromkeys(k for m in maps for k in m))}
        self.columns = np.zeros((len(self.index), len(landmarks)))
        for j, m in enumerate(maps):
            for k, v in m.items():
                self.columns[self.index[k], j] = v
        values, vectors = np.linalg.eigh(self.columns.T @ self.columns)
        keep = values > 1e-6
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, words: list[str]) -> np.ndarray:
        against = np.zeros((len(words), self.columns.shape[1]))
        for r, word in enumerate(words):
            pairs = [(self.index[k], v) for k, v in subsequences(word).items() if k in self.index]
            if pairs:
                at, v = zip(*pairs, strict=True)
                against[r] = np.array(v) @ self.columns[list(at)]
        return against @ self.whiten

    def collapse(self, weights: np.ndarray) -> dict[str, float]:
        per = self.columns @ (self.whiten @ weights)
        return {k: float(per[i]) for k, i in self.index.items()}


def variants(word: str) -> list[str]:
    """A fragment with one character inserted between any two, or one of the inner ones replaced: virtual examples of obfuscation."""
    strange = "xqz*vkj#w"
    out = [word[:k] + strange[k % len(strange)] + word[k:] for k in range(1, len(word))]
    return out + [word[:k] + strange[(k + 3) % len(strange)] + word[k + 1 :] for k in range(1, len(word) - 1)]


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge machine, by Newton steps on the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(x), bool)
    for _ in range(30):
        xa = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Model:
    """Weight of each subsequence, bias, what the means of a text's highest margins have to pass, and the sigmoid from that to a score."""

    def __init__(self, weights: dict[str, float], bias: float, slope: float, offset: float):
        self.bias, self.slope, self.offset = bias, slope, offset
        #: of the highest margin, the mean of the two highest and so on; by default the highest alone counts
        self.cuts = np.r_[0.0, np.full(HIGHEST - 1, np.inf)]
        letters = sorted({c for k in weights for c in k} | {"^", "$"})
        self.size = len(letters) + 1
        #: number of each character among those that have a weight; 0 for others
        self.number = np.zeros(0x110000, np.uint8 if self.size < 256 else np.uint32)
        for i, c in enumerate(letters):
            self.number[ord(c)] = i + 1
        keys = np.zeros(len(weights), np.int64)
        for place in range(ORDER):
            keys = keys * self.size + np.array([self.number[ord(k[place])] for k in weights], np.int64)
        values = np.array(list(weights.values()), np.float32)
        if self.size**ORDER <= TABLE:
            self.keys, self.weight = None, np.zeros(self.size**ORDER, np.float32)
            self.weight[keys] = values
        else:  # as many entries as there are weights, whatever the letters
            order = np.argsort(keys)
            self.keys, self.weight = np.append(keys[order], -1), np.append(values[order], np.float32(0))
        self.norms = np.array([norm(n) for n in range(LONGEST + 3)])
        self.learned = weights

    def stored(self) -> bytes:
        """What the model has learned, as JSON."""
        return json.dumps([self.learned, self.bias, self.slope, self.offset, [None if np.isinf(c) else c for c in self.cuts.tolist()]]).encode()

    @staticmethod
    def restored(data: bytes) -> Model:
        *learned, cuts = json.loads(data)
        model = Model(*learned)
        model.cuts = np.array([np.inf if c is None else c for c in cuts])
        return model

    def word_margins(self, words: list[bytes]) -> np.ndarray:
        """Margins of fragments of any length, CHUNK of them at once."""
        if len(words) > CHUNK:
            return np.concatenate([self.word_margins(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)])
        points = np.frombuffer(("^" + b"$^".join(words).decode("utf-8", "replace") + "$").encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(points == 94)
        sizes = np.diff(np.append(starts, len(points)))
        last = np.repeat(starts + sizes - 1, sizes).astype(np.int32)
        code = self.number[points].astype(np.int32 if self.keys is None else np.int64)
        total = np.zeros(len(points), np.float32)
        place = np.arange(len(points), dtype=np.int32)
        begun: dict[tuple, np.ndarray] = {(): code}  # codes of the first characters, by their places
        for places, w in _GAPS:
            n = len(code) - places[-1]
            if n <= 0:
                continue
            for k in range(1, ORDER):
                if places[:k] not in begun:
                    before, at = begun[places[: k - 1]], places[k - 1]
                    begun[places[:k]] = before[: len(code) - at] * self.size + code[at:]
            value = self.looked_up(begun.pop(places))
            value *= place[:n] + places[-1] <= last[:n]
            total[:n] += np.float32(w) * value
        out = np.add.reduceat(total, starts) / self.norms[np.minimum(sizes, LONGEST + 2)] + self.bias
        for k in np.flatnonzero(sizes > LONGEST + 2):
            out[k] = self.word_margins([c.encode() for c in cuts(words[k])]).max()
        return out

    def looked_up(self, codes: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.weight[codes]
        at = np.searchsorted(self.keys[:-1], codes)
        return np.where(self.keys[at] == codes, self.weight[at], np.float32(0))

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """Of each text its worst fragment's margin, the mean of the two worst different ones and so on, up to HIGHEST; low where there are fewer."""
        out = np.full((len(texts), HIGHEST), min(self.bias, -1.0))
        held: list[bytes] = []
        spans: list[tuple[int, int, int]] = []

        def flush():
            if held:
                numbers: dict[bytes, int] = {}
                at = [numbers.setdefault(w, len(numbers)) for w in held]
                margins = self.word_margins(list(numbers))[at]
                for k, low, high in spans:
                    both = np.concatenate([out[k], margins[low:high]])
                    out[k] = np.sort(np.partition(both, len(both) - HIGHEST)[-HIGHEST:])[::-1]
                held.clear(), spans.clear()

        for k, text in enumerate(texts):
            words = list(dict.fromkeys(fragments(text)))
            for at in range(0, len(words), CHUNK):
                part = words[at : at + CHUNK]
                spans.append((k, len(held), len(held) + len(part)))
                held += part
                if len(held) >= CHUNK:
                    flush()
        flush()
        return np.cumsum(out, 1) / np.arange(1, HIGHEST + 1)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """By how much a text passes the easiest of its cuts."""
        return (self.highest(texts) - self.cuts).max(1)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        return self.scores(self.margins(texts))

    def worst_sentence(self, text: bytes) -> bytes:
        sentences = _SENTENCE.findall(text)
        return sentences[int(np.argmax(self.margins(sentences)))].strip() if sentences else b""


def cut(margins: np.ndarray, toxic: np.ndarray, beta: float) -> float:
    """The middle of the gap where labels are told apart best by F-beta; nearer to the clean side where it is wide."""
    order = np.argsort(-margins, kind="stable")
    m, y = margins[order], toxic[order]
    hit = np.cumsum(y)
    value = (1 + beta**2) * hit / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    value[:-1][m[:-1] == m[1:]] = -1
    k = int(np.argmax(value))
    low = m[k + 1] if k + 1 < len(m) else m[k] - 0.5
    # at most 0.35 below the lowest toxic margin
    return float(max((m[k] + low) / 2, m[k] - 0.35))


def text_cuts(means: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each column a cut that toxic texts pass: for the highest margin by F-beta; for means of more the median of toxic texts that come where no clean one of those left does."""
    out = np.full(means.shape[1], np.inf)
    out[0] = cut(means[:, 0], toxic, BETA)
    passed = means[:, 0] >= out[0]
    for j in range(1, means.shape[1]):
        clean, rest = means[~passed & ~toxic, j], means[~passed & toxic, j]
        above = rest[rest > clean.max(initial=-np.inf)]
        if len(above) and len(clean):
            out[j] = np.median(above)
            passed = passed | (means[:, j] >= out[j])
    return out


def fit(texts: list[bytes], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """Train on labelled texts; without both labels nothing is learned and every score is low."""
    order = sorted({t: y for t, y in zip(texts, toxic, strict=True)}.items(), key=lambda x: hash_of(x[0]))
    if not any(y for _, y in order) or all(y for _, y in order):
        return Model({}, -1.0, 1.0, -3.0)
    bags = [(sorted({c for w in set(fragments(t)) for c in cuts(w) if len(c) >= 2}), y) for t, y in order]
    # every fourth text of either label is kept from training, for the sigmoid
    rank = Counter()
    train, calibrate = [], []
    for bag in bags:
        rank[bag[1]] += 1
        (calibrate if rank[bag[1]] % 4 == 0 else train).append(bag)
    clean = Counter(w for words, y in train if not y for w in words)
    open_bags = [[w for w in words if w not in clean] for words, y in train if y]
    open_bags = [b for b in open_bags if b]
    negatives = [w for w, _ in clean.most_common(1500)]
    rest = sorted(set(clean) - set(negatives), key=lambda w: hash_of(w.encode()))
    negatives += rest[:3500]
    every, hard = sorted(clean), []
    candidates = sorted({w for b in open_bags for w in b})
    if not candidates:
        return Model({}, -1.0, 1.0, -3.0)
    # at first, fragments count by their own odds or those of their three most telling subsequences
    among: Counter = Counter()
    for b in open_bags:
        among.update({k for c in b for k in subsequences(c)})
    against = dict.fromkeys(among, 0)
    for word, n in clean.items():
        for k in subsequences(word):
            if k in against:
                against[k] += n
    clean_texts = sum(not y for _, y in train)
    odds = {k: (n + 0.5) / (len(open_bags) + 1) * (clean_texts + 1) / (against[k] + 0.5) for k, n in among.items()}
    del among, against
    bags_with = Counter(c for b in open_bags for c in b)
    whole = np.log((clean_texts + 1) / 0.5 / (len(open_bags) + 1))
    share = {c: max(np.mean(sorted(np.log(odds[k]) for k in subsequences(c))[-3:]), whole + np.log(bags_with[c] + 0.5)) for c in candidates}
    floor = whole + np.log(2.5)
    share = {c: max(0.05, float(v - floor)) ** 2 for c, v in share.items()}
    # and each toxic text spreads one unit over its own
    weight: dict[str, float] = {}
    for b in open_bags:
        unit = sum(share[c] for c in b)
        for c in b:
            weight[c] = weight.get(c, 0.0) + share[c] / unit
    best: tuple[dict[str, float], float] = ({}, -1.0)
    for turn in range(rounds):
        chosen = sorted(weight, key=lambda w: (-weight[w], w))[: 1500 if turn else 3000]
        half = landmarks // 2
        space = Nystroem(spread(chosen[: 8 * half], half) + spread(negatives[: 8 * half], half))
        # from the third round on, when witnesses are known, their obfuscations count like them, and those of clean fragments like these
        near = [w for w in chosen if len(w) >= 4][:VIRTUAL] if turn > 1 else []
        changed = [(v, weight[w] / len(variants(w))) for w in near for v in variants(w)]
        bent = [v for w in negatives[:VIRTUAL] if len(w) >= 4 for v in variants(w)[:: max(1, len(w) // 3)]] if changed else []
        x = space.features(chosen + [v for v, _ in changed] + negatives + hard + bent)
        y = np.r_[np.ones(len(chosen) + len(changed)), -np.ones(len(negatives) + len(hard) + len(bent))]
        mass = np.array([weight[w] for w in chosen] + [m for _, m in changed])
        cost = np.r_[mass / mass.sum(), np.full(len(negatives), 1 / len(negatives)), np.full(len(hard), 2 / len(negatives)), np.full(len(bent), 1 / max(1, len(negatives)))] * 400
        w = machine(x, y, cost)
        best = (space.collapse(w[:-1]), float(w[-1]))
        model = Model(*best, 1.0, 0.0)
        margins = dict(zip(candidates, model.word_margins([c.encode() for c in candidates]), strict=True))
        # the clean fragments that score highest count from now on
        against_all = model.word_margins([c.encode() for c in every])
        hard = sorted({*hard, *(every[k] for k in np.argsort(-against_all, kind="stable")[:400])})
        # the witness of each toxic text, and what scores nearly as high there
        weight = {}
        for b in open_bags:
            top = max(margins[c] for c in b)
            for c in b:
                if margins[c] >= max(0.6 * top, 0.3) or margins[c] == top:
                    weight[c] = weight.get(c, 0.0) + 1.0
    model = Model(*best, 1.0, 0.0)
    # a cut can't be told by very few toxic texts; then those that were trained on count too
    held = calibrate if sum(y for _, y in calibrate) >= LEAST_HELD and not all(y for _, y in calibrate) else calibrate + train
    y = np.array([y for _, y in held])
    # one insult is enough where its margin is high; where margins are lower, several different ones are
    means = model.highest([" ".join(words).encode() for words, _ in held])
    model.cuts = text_cuts(means, y)
    model.slope, model.offset = 8.0, float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return model


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def spread(words: list[str], count: int) -> list[str]:
    """The first ``count`` words that aren't nearly the same to the kernel as one before."""
    picked, maps = [], []
    for word in words:
        x = subsequences(word)
        if all(sum(v * m.get(k, 0.0) for k, v in x.items()) < 0.9 for m in maps):
            picked.append(word)
            maps.append(x)
            if len(picked) == count:
                break
    return picked


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows: of each label those with the smallest hash of doc_id, ties by text.

    Rows are counted, so a doc_id that many rows share doesn't break the bound. Several labels of one document count as toxic if
    one does; null labels and null texts are left out, and so are texts over ``train_bytes``, in which a
    witness is hard to tell.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    limits = ((True, toxic_rows), (False, clean_rows))
    # at most as many ids as rows go to every task, so that no text is shuffled
    ids = [known.where(F.col("toxic") == toxic).orderBy(*order).limit(n) for toxic, n in limits]
    rows = documents.select("doc_id", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    parts = [rows.where(F.col("toxic") == toxic).orderBy(*order, "text").limit(n) for toxic, n in limits]
    sample = parts[0].unionByName(parts[1]).select("text", "toxic").coalesce(1)
    ship(documents.sparkSession)
    found = sample.mapInArrow(_fit_rows, "model binary").head()
    return Model.restored(found.model) if found else fit([], [])


def _fit_rows(batches):
    """The whole sample, which is bounded, in one task: a lost executor fits again, and the driver holds the model alone."""
    import pyarrow as pa

    texts, toxic = [], []
    for batch in batches:
        texts += text_bytes(batch.column(0))
        toxic += batch.column(1).to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([fit(texts, toxic).stored()], pa.binary())], names=["model"])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, sentence`` of every row from its whole text alone.

    ``sentence`` is the worst sentence where the score reaches the threshold,
    else null. Null and empty texts get the low score of a text without
    fragments; repeated rows repeat; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select("doc_id", "text")
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            scores = sent.value.text_scores(texts)
            worst = [sent.value.worst_sentence(t).decode("utf-8", "replace") if s >= threshold else None for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(worst, pa.string())],
                names=["doc_id", "score", "predicted", "sentence"],
            )

    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("sentence", T.StringType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score is below the threshold."""
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(sent.value.text_scores(text_bytes(batch.column(at))) < threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out():
    return remainder(F.col("doc_id"), 3) == 1


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels of rows that aren't held out, score all."""
    model = train(documents, labels.where(~held_out()))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "sentence")
