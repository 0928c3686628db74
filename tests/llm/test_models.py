import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.conftest import SF_MID
from tests.llm.data import ODD, frame, prose
from veilscan.llm import langid, lm_score, quality
from veilscan.llm.queries import QUERIES
from veilscan.session import read_table


def in_fold(doc_id, folds, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


# --- quality ---------------------------------------------------------------------------------


def offsets_of(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def brute_quality(net, text):
    """The network chunk by chunk over one whole text."""
    padded = text + bytes(-len(text) % quality.STEP or (0 if text else quality.STEP)) + bytes(quality.STEP)
    chunks = [padded[i : i + 2 * quality.STEP] for i in range(0, len(padded) - quality.STEP, quality.STEP)]
    most = np.max([net.embedding[list(c)].reshape(-1) @ net.filters for c in chunks], axis=0)
    z = np.maximum(most + net.bias, 0) @ net.weights + net.offset
    return 1 / (1 + math.exp(-z))


def test_network_sees_every_chunk_of_a_text():
    net = quality.ByteNet.fresh(4, 8, 0.5, 1)
    texts = [b"", b"a", b"x" * 15, b"y" * 16, b"z" * 17, bytes(range(65, 91)) * 40]
    got = net.score(*offsets_of(texts))
    for text, score in zip(texts, got, strict=True):
        assert score == pytest.approx(brute_quality(net, text), rel=1e-4)


def test_quality_scores_are_those_of_brute_force(spark):
    good = [(i, "The plan was read aloud and " + prose(i, 30)) for i in range(60)]
    bad = [(i, "$$$ BUY!!! " * (i % 9) + "#" * i) for i in range(60, 120)]
    rows = [*good, *bad, (200, None), (201, ""), (None, prose(9, 3000))]
    docs = frame(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    net = quality.fit_sample(docs, labels, "doc_id", "quality", 2000, 1 << 16)
    got = {r.doc_id: r.found for r in quality.quality_scores(docs, labels, out="found").collect()}
    assert got == pytest.approx({i: brute_quality(net, (t or "").encode()) for i, t in rows}, rel=1e-3, abs=1e-6)
    held = [i for i in range(120) if in_fold(i, 4, 2)]
    assert sum((got[i] >= 0.5) == (i < 60) for i in held) >= 0.9 * len(held)


def test_quality_of_held_out_rows(spark):
    found = QUERIES["op6_byte_quality"](spark, SF_MID)
    rows = found.join(read_table(spark, SF_MID, "labels"), "doc_id").where("held_out").collect()
    # a few hundred labels only at this size; 0.99 at ten times that
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > 0.85
    clean = [r.predicted for r in rows if r.quality == 1]
    assert sum(clean) / len(clean) > 0.95
    assert found.count() == read_table(spark, SF_MID, "documents").count()
    for r in found.collect():
        assert r.held_out == in_fold(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, ODD, extra=True)
    out = quality.quality_scores(docs, labels)
    assert out.count() == len(ODD) and set(out.columns) == set(docs.columns)
    assert out.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.quality_scores(frame(spark, []), labels).collect() == []
    none = quality.quality_scores(docs, labels.limit(0))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}


# --- language --------------------------------------------------------------------------------


def test_filters_return_all_languages_of_a_gram():
    rng = np.random.default_rng(2)
    sets = {f"l{k:02d}": rng.integers(0, 1 << 32, 500).astype(np.uint32) for k in range(11)}
    built = langid.LanguageFilter.build(sets)
    for k, name in enumerate(built.names):
        assert ((built.languages(sets[name]) >> built.rows.dtype.type(k)) & 1).all()
    other = rng.integers(0, 1 << 32, 50000).astype(np.uint32)
    wrong = (built.languages(other) & 1).mean()
    assert wrong == pytest.approx(built.fill[0] ** len(langid.HASHES), abs=2e-3)
    with pytest.raises(ValueError):
        langid.LanguageFilter.build({str(k): sets["l00"] for k in range(65)})


def test_grams_stay_in_their_text():
    texts = [b"", b"abc", b"abcd", b"Ab  cde f", "über".encode(), b"xyzw1"]
    code, counts = langid.grams(*offsets_of(texts))
    want = []
    for text in texts:
        folded = bytes(langid._FOLD[b] for b in text)
        grams = [folded[i : i + 4] for i in range(len(folded) - 3)]
        want.append([int.from_bytes(g, "big") for g in grams if b"  " not in g])
    assert counts.tolist() == [len(w) for w in want] and code.tolist() == sum(want, [])


def test_language_of_held_out_rows(spark):
    found = QUERIES["op7_language_filters"](spark, SF_MID)
    rows = found.join(read_table(spark, SF_MID, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == in_fold(r.doc_id, 5, 0) for r in rows)


def test_language_of_odd_tables(spark):
    rows = [*ODD, (7, "123 456 !"), (8, "7 ñ")] + [(i, "der und die das " * 5, None, "de") for i in range(20, 40)]
    found = {r.doc_id: r for r in langid.predict_language(frame(spark, rows, extra=True)).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == found[7].lang_pred == "und"
    assert found[7].score == 0 and found[8].lang_pred == "de" and found[30].score > 0.5
    assert {r.lang_pred for r in langid.predict_language(frame(spark, ODD)).collect()} == {"und"}
    assert langid.predict_language(frame(spark, [])).collect() == []


def brute_grams4(text):
    """All runs of four letters or single spaces of a text."""
    raw = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
    return [raw[i : i + 4] for i in range(len(raw) - 3) if b"  " not in raw[i : i + 4]]


def test_languages_are_those_of_brute_force(spark):
    """Sets of 4-grams kept whole and without hashing, in place of the filter's bits."""
    rng = random.Random(8)
    stems = {"aa": "der die und das nicht", "bb": "the of and that not", "cc": "le la et les pas", "é": "ñandú él más über"}
    rows = []
    for i in range(160):
        lang = rng.choice(list(stems))
        words = rng.choices(stems[lang].split(), k=30) + rng.choices(prose(i, 20).split(), k=8)
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words).title(), None, lang))
    rows += [(500 + i, prose(i, 5), None, None) for i in range(20)]
    counts = {lang: Counter() for lang in stems}
    for i, text, _, lang in rows:
        if lang and not in_fold(i, langid.FOLDS, langid.HELD_OUT):
            counts[lang].update(brute_grams4(text))
    sets = {}
    for lang, seen in counts.items():
        total, before, sets[lang] = sum(seen.values()), 0, set()
        for gram, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            if before >= langid.COVERED * total:
                break
            sets[lang].add(gram)
            before += n
    found = {r.doc_id: r for r in langid.predict_language(frame(spark, rows, extra=True)).collect()}
    for i, text, _, _ in rows:
        grams = brute_grams4(text)
        shares = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        assert found[i].score == pytest.approx(max(shares.values()), abs=0.01)
        if sorted(shares.values())[-2] < max(shares.values()) - 0.02:
            assert found[i].lang_pred == max(sorted(shares), key=shares.get)


def test_any_number_of_languages_and_long_texts(spark):
    words = {f"l{k:03d}": prose(1000 + k, 12) for k in range(100)}
    rows = [(i, words[lang], None, lang) for i, lang in enumerate(sorted(words) * 4)]
    rows += [(i, "zzyzx qwrty plmnk " * 8000, None, "long") for i in range(1000, 1010)]
    found = {r.doc_id: r.lang_pred for r in langid.predict_language(frame(spark, rows)).collect()}
    learned = {lang for i, _, _, lang in rows if not in_fold(i, 5, 0)}
    assert len(learned) == 101
    assert all(found[i] == lang for i, _, _, lang in rows)


# --- language model --------------------------------------------------------------------------


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


class BruteTree:
    """One recursion over contexts for each prefix of a byte's bits."""

    def __init__(self, grams: Counter, depth: int):
        self.depth, self.count = depth, Counter()
        for gram, n in grams.items():
            for d in range(depth + 1):
                for bit in range(8):
                    prefix, one = gram[-1] >> (8 - bit), gram[-1] >> (7 - bit) & 1
                    self.count[gram[depth - d : depth], bit, prefix, one] += n

    def node(self, context, bit, prefix):
        return self.count[context, bit, prefix, 0], self.count[context, bit, prefix, 1]

    def weighted(self, context, bit, prefix):
        own = kt(*self.node(context, bit, prefix))
        if len(context) == self.depth:
            return own
        below = sum(
            self.weighted(bytes([b]) + context, bit, prefix)
            for b in range(256)
            if sum(self.node(bytes([b]) + context, bit, prefix))
        )
        return math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))

    def log10(self, gram):
        total = 0.0
        for bit in range(8):
            prefix, one = gram[-1] >> (8 - bit), gram[-1] >> (7 - bit) & 1
            p, left, last = 0.0, 1.0, 0.5
            for d in range(self.depth + 1):
                context = gram[self.depth - d : self.depth]
                zeros, ones = self.node(context, bit, prefix)
                if not zeros + ones:
                    break
                last = (ones + 0.5) / (zeros + ones + 1)
                w = 1.0 if d == self.depth else math.exp(math.log(0.5) + kt(zeros, ones) - self.weighted(context, bit, prefix))
                p += left * w * last
                left *= 1 - w
            p += left * last
            total += math.log10(p if one else 1 - p)
        return total


def brute_grams(texts, depth):
    out = Counter()
    for text in texts:
        raw = bytes([lm_score.START]) * depth + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
        raw += bytes([lm_score.END])
        out.update(raw[i : i + depth + 1] for i in range(len(raw) - depth))
    return out


def as_code(gram):
    return int.from_bytes(gram, "big")


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_context_tree_is_that_of_the_recursion(depth):
    grams = brute_grams(["abracadabra", "Abba", "", "cab"], depth)
    codes = np.array([as_code(g) for g in grams], np.uint64)
    tree = lm_score.ContextTree(codes, np.array(list(grams.values()), float), depth)
    brute = BruteTree(grams, depth)
    asked = list(grams) + [bytes(x) for x in product(b"abz", repeat=depth + 1)]
    got = tree.log10(np.array([as_code(g) for g in asked], np.uint64))
    assert got == pytest.approx([brute.log10(g) for g in asked], rel=1e-3)
    for context in ({g[:depth] for g in asked}):
        every = np.array([as_code(context + bytes([b])) for b in range(256)], np.uint64)
        assert (10 ** tree.log10(every)).sum() == pytest.approx(1, rel=1e-4)


def test_scores_are_those_of_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([prose(i, 12), f"The Cat {i}", "a\tB c\n", None, "", "é ñ"])) for i in range(60)]
    rows += [(5, "again and again")] * 3 + [(None, "none")]
    found = lm_score.lm_scores(frame(spark, rows, extra=True), depth=2, batch_bytes=600).collect()
    training = [t for i, t in rows if not in_fold(i, 7, 2)]

    def tokens(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w] + [None]

    counts = Counter(w for t in training for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    brute = BruteTree(brute_grams(training, 2), 2)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        score = sum(n * brute.log10(g) for g, n in brute_grams([text], 2).items())
        want.append((str(i), in_fold(i, 7, 2), len(own), sum(counts[w] > 0 for w in own), total, base, score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    key = lambda x: (x[0], x[2], round(x[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-3)


def whole_tree(rows, depth):
    """The tree of the training texts in one piece."""
    codes, _ = lm_score.byte_grams(*offsets_of([t.encode() for i, t in rows if not in_fold(i, 7, 2)]), depth)
    grams, n = np.unique(codes, return_counts=True)
    return lm_score.ContextTree(grams, n.astype(float), depth)


def test_counts_by_one_sort():
    rng = np.random.default_rng(1)
    grams, trained = rng.integers(0, 50, 999).astype(np.uint64), rng.random(999) < 0.5
    found, n = lm_score._counted(grams, trained)
    assert found.tolist() == sorted(set(grams.tolist())) and n.tolist() == [int((trained & (grams == g)).sum()) for g in found]
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in lm_score._counted(none, none.astype(bool))] == [0, 0] == [len(x) for x in lm_score._merged([], [])[:2]]


def test_deepest_and_many_short_texts(spark):
    # 7 bytes leave 8 bits for a document's number in its slice
    rows = [(i, f"row {i % 9} of {i % 7}") for i in range(700)]
    for depth in (5, 6):
        whole = whole_tree(rows, depth)
        got = {r.doc_id: r.score for r in lm_score.lm_scores(frame(spark, rows), depth=depth).collect()}
        for i, text in rows:
            code, _ = lm_score.byte_grams(*offsets_of([text.encode()]), depth)
            assert got[i] == pytest.approx(whole.log10(code).sum(), rel=1e-5)
    with pytest.raises(ValueError, match="depth"):
        lm_score.lm_scores(frame(spark, rows), depth=7)


def test_parts_of_the_tree_score_like_the_tree_in_one_piece(spark):
    rows = [(i, prose(i, 40)) for i in range(80)]
    docs = frame(spark, rows)
    whole = whole_tree(rows, 5)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs, batch_bytes=9000).collect()}
    for i, text in rows:
        code, _ = lm_score.byte_grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 5)
        assert got[i] == pytest.approx(whole.log10(code).sum(), rel=1e-5)


def test_depth_is_the_same_at_every_size(spark):
    # 2.2 M distinct strings of 6 bytes, each of them 4 times
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    rows = [(i, letters[rng.integers(0, 26, 30000)].tobytes().decode() * 4) for i in range(94)]
    seen, held = (next(i for i, _ in rows if in_fold(i, 7, 2) is x) for x in (False, True))
    rows[held] = (held, rows[seen][1])
    shallower = whole_tree(rows, 3)
    asked, _ = lm_score.byte_grams(*offsets_of([rows[held][1].encode()]), shallower.depth)
    found = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    assert found[held].score > 0.9 * shallower.log10(asked).sum()


def test_scores_of_odd_tables(spark):
    assert lm_score.lm_scores(frame(spark, [])).collect() == []
    assert len(lm_score.lm_scores(frame(spark, ODD)).collect()) == len(ODD)
    held = next(i for i in range(50) if in_fold(i, 7, 2))
    (row,) = lm_score.lm_scores(frame(spark, [(held, "ab")])).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(3 * math.log10(1 / 256))


def test_code_length_of_held_out_rows(spark):
    rows = QUERIES["op9_context_tree_scores"](spark, SF_MID).where("held_out").collect()
    assert -sum(r.score for r in rows) * math.log2(10) / sum(r.n_bytes for r in rows) < 2.5
    assert all(r.n_known <= r.n_tokens and r.base_score < 0 for r in rows)
