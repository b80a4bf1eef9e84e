"""Pure Python parts of the operators against brute force, without a session."""

import hashlib
import random
from collections import Counter
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import langid, media, piece_bpe, simhash, toxicity, weighted_sampling
from lodestone.llm.queries import tokenizer_path

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    w = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBé \n\t\x0b\x85　z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_nothing():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def groups(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(int(a))] = find(int(b))
    return [min(j for j in range(n) if find(j) == find(i)) for i in range(n)]


def test_block_links_span_what_brute_force_links():
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 63, 20, np.uint64)
    items = {int(x) for x in near}
    for x in near:
        for _ in range(15):
            y = int(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                y ^= 1 << int(b)
            items.add(y)
    a = np.array(sorted(items), np.uint64)
    brute = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3) if i < j]
    found = simhash.block_links(a)
    assert groups(len(a), found) == groups(len(a), brute) and len(found) < len(a)
    x, y = simhash.small_links(np.zeros(len(a), np.int64), a, simhash.pivot_table(a, simhash.pivots()), 3)
    assert len(x) == len(brute) and (np.bitwise_count(x ^ y) <= 3).all()


def test_dealings_lose_no_pair():
    rng = random.Random(5)
    for depth in (1, 2, 3):
        masks = [simhash._mask(d) & (1 << 64) - 1 for d in simhash._dealings(3, depth)]
        for _ in range(200):
            diff = 0
            for b in rng.sample(range(64), rng.randrange(4)):
                diff |= 1 << b
            assert any(diff & m == 0 for m in masks)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = tokenizer_path()
    return piece_bpe.PieceBPE(piece_bpe.model_bytes(path)), sentencepiece.SentencePieceProcessor(model_file=path)


CASES = ["", " ", "  ", "a", "\n", "  a  b   ", "▁a▁▁b", "日本語 text  ", "<s> </s> <unk> <0x0A>", "é́   x\t\ty", "     " * 50 + "word", "a" * 3000, "の" * 50 + "🎉🎉", "'s don't", "²³ x²y", "\u0000"]


@pytest.mark.parametrize("text", CASES)
def test_pieces(pieces, text):
    own, sp = pieces
    ids = sp.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == sp.decode(ids)
    assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abtheing  \n▁éß日🎉12._=!-²"), max_size=40))
def test_pieces_at_random(pieces, text):
    own, sp = pieces
    assert own.encode(text) == sp.encode(text)


def test_pieces_without_a_cache_give_the_same(pieces):
    own, sp = pieces
    text = "The quick brown fox, jumps over 13 lazy dogs. " * 20
    own.words.clear(), own.older.clear(), own.whole.clear(), own.whole_older.clear(), own.pairs.clear()
    assert own.encode(text) == sp.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(data):
    payload = media.padded(data)
    png = media.encode_png(payload)
    assert len(payload) % 576 == 0 and payload and media.decode_png(png).tobytes() == payload
    n, size, digest, tail, stored, _, feature = media.describe(len(data), png)
    assert (n, size, digest, tail, stored) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png)) and len(feature) == 16


def filtered(rows, kind):
    """Scan lines of the given filter, by its definition."""
    out = []
    for y, row in enumerate(rows.tolist()):
        up = rows[y - 1].tolist() if y else [0] * len(row)
        line = [kind]
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, up[x], up[x - 1] if x else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (5, 40), np.uint8)
    assert (media._unfilter(filtered(rows, kind)) == rows).all()


def test_damaged_images_are_errors():
    png = bytearray(media.encode_png(media.padded(b"x" * 2000)))
    for at in (0, 20, 60, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(bytes(png[:-6]))


def test_weighted_sampling_estimates_generalised_jaccard():
    rng, sampler = random.Random(1), weighted_sampling.Sampler(2048)
    for share in (0.2, 0.5, 0.9):
        words = [f"w{i}" for i in range(120)]
        a = [rng.choice(words) for _ in range(400)]
        b = [x if rng.random() < share else f"v{rng.randrange(120)}" for x in a]
        ca, cb = Counter(a), Counter(b)
        want = sum((ca & cb).values()) / sum((ca | cb).values())
        got = weighted_sampling.likeness(*(sampler.sketch(*weighted_sampling.weighted_terms(" ".join(x))) for x in (a, b)))
        assert abs(got - want) < 0.05


def test_gamma_quantiles():
    q = weighted_sampling.gamma_quantiles(10)
    p = (np.arange(1024) + 0.5) / 1024
    assert np.abs(1 - (1 + q) * np.exp(-q) - p).max() < 1e-9 and (np.diff(q) > 0).all()


def test_edited():
    assert weighted_sampling.edited("abcdef", "xyz") == "abcxyz" and weighted_sampling.edited("abcdef", "x") == "abcx" and weighted_sampling.edited("abc", "xyz") == "abx" and weighted_sampling.edited("", "q") == ""


def parting(positive, unlabelled):
    """Features whose document frequencies differ by four standard errors."""
    held = [Counter(int(x) for fs in side for x in fs) for side in (positive, unlabelled)]
    out, n, m = [], len(positive), len(unlabelled)
    for f in sorted(held[0] | held[1]):
        p, u = held[0][f], held[1][f]
        pooled = (p + u + 0.5) / (n + m + 1)
        if max(p, u) >= 3 and abs(p / n - u / m) / (pooled * (1 - pooled) * (1 / n + 1 / m)) ** 0.5 >= 4:
            out.append(f)
    return np.array(out, np.int64)


def test_pu_learning_finds_the_words_of_the_confirmed():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = lambda: " ".join(word() for _ in range(40))
    toxic = lambda: clean() + " zzzidiot " + rng.choice(("zzzscum", "zzztrash"))
    f = lambda t: toxicity.text_features(t, 18)
    positive, unlabelled = [f(toxic()) for _ in range(100)], [f(toxic() if k % 10 == 0 else clean()) for k in range(600)]
    model = toxicity.fit_nnpu(positive, unlabelled, 0.1, parting(positive, unlabelled))
    assert np.mean([model.score(f(toxic())) >= 0.5 for _ in range(100)]) > 0.95
    assert np.mean([model.score(f(clean())) >= 0.5 for _ in range(100)]) < 0.05
    few = lambda: toxicity.fit_nnpu([f("x zzzidiot")] * 5, [f("y")] * 5, 0.1, f("x zzzidiot y"))
    assert few().score(f("")) == few().score(f(""))
    assert toxicity.fit_nnpu([], [], 0.1, np.zeros(0, np.int64)).score(f("anything")) == 0.0


def test_chosen_features_by_plain_counts(spark):
    rng = random.Random(4)
    positive, unlabelled = ([np.array(sorted(rng.sample(range(60), 10) + [60 + k % 2] * side), np.int32) for k in range(n)] for side, n in ((1, 40), (0, 90)))
    positive, unlabelled = [np.unique(x) for x in positive], [np.unique(x) for x in unlabelled]
    counts = [(f, sum(f in x for x in positive), sum(f in x for x in unlabelled)) for f in range(62)]
    got = sorted(r["f"] for r in toxicity.select_features(spark.createDataFrame(counts, "f int, p long, u long"), 40, 90).collect())
    assert got == parting(positive, unlabelled).tolist() and {60, 61} <= set(got)


def test_features_are_those_of_whole_words():
    a, b = toxicity.text_features("Alpha, beta!", 18), toxicity.text_features("beta alpha", 18)
    assert (a == b).all() and len(toxicity.text_features(None, 18)) == len(toxicity.text_features("...", 18)) == 0
    assert len(toxicity.text_features("abcdef", 18)) == 3


@pytest.mark.parametrize("text", ["", "123 !?", "a", "Hello, World", "日本", "é1é"])
def test_grams_by_brute_force(text):
    """As many n-grams as the cleaned text has: letters alone, then every window of two and three."""
    bare = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    bare = " " + " ".join(bare.split()) + " "
    letters = sum(c.isalpha() for c in bare)
    want = 0 if not letters else letters + max(0, len(bare) - 1) + max(0, len(bare) - 2)
    assert len(langid.grams(text)) == want


def test_the_decoded_text_comes_from_the_ids(pieces, monkeypatch):
    own, _ = pieces
    clear = lambda: [c.clear() for c in (own.words, own.older, own.whole, own.whole_older)]
    right, segment = own.digest("one two"), own.segment
    clear()
    monkeypatch.setattr(own, "segment", lambda word: [own.ids["▁wrong"]] if word == "▁two" else segment(word))
    wrong = own.digest("one two")
    clear()
    assert wrong[1] != right[1] and wrong[2] == hashlib.sha256(b"one wrong").hexdigest()
