"""Plain second versions of what the operators do with arrays, and cases that once went wrong."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import quality, toxicity
from glossa.llm.common import raw, shingle_set, span_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_thue_morse_words_have_hashes_of_their_own():
    """Equal under any polynomial hash modulo a power of two."""
    bits = "0"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("01", "10"))
    for n in (64, 128, 2048, 4096):
        a = bits[:n].translate(str.maketrans("01", "ab"))
        b = bits[:n].translate(str.maketrans("01", "ba"))
        assert not set(shingle_set(f"one two {a} three four five").tolist()) & set(shingle_set(f"one two {b} three four five").tolist())


def test_span_hashes_depend_on_bytes_alone():
    rng = random.Random(7)
    spans = [bytes(rng.choices(b"ab\x00", k=rng.randint(0, 300))) for _ in range(400)] + [b"", b"\x00", b"\x00\x00", b"a" * 128, b"a" * 129]
    data, starts, ends = b"", [], []
    for s in spans * 2:
        data += bytes([rng.randrange(256)])
        starts.append(len(data))
        data += s
        ends.append(len(data))
    h = span_hashes(np.frombuffer(data, np.uint8), np.array(starts), np.array(ends)).tolist()
    assert h[: len(spans)] == h[len(spans) :] and len(set(h)) == len(set(spans))


# --- toxicity: the network word by word ---------------------------------------------------------------------------------------


def naive_score(net, text):
    """The worst window's probability, one token, one direction and one number at a time."""
    words = re.findall(rb"[a-z\x80-\xff]+", text.translate(LOWER).encode())
    size = toxicity.WINDOW
    begins = [0]
    while begins[-1] + size < len(words):
        begins.append(min(begins[-1] + toxicity.STRIDE, len(words) - size))
    number = lambda b: int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    def vector(word):
        edged = b"^" + word + b"$"
        grams = [edged[i : i + min(n, len(edged))] for n in toxicity.SIZES for i in range(len(edged) - min(n, len(edged)) + 1)]
        total = sum(net.grams[number(g) % toxicity.GRAMS].astype(float) for g in grams)
        return net.words[number(word) % toxicity.WORDS] + total / math.sqrt(len(grams))

    sigma = lambda x: 1 / (1 + math.exp(-x))
    H, p, worst = toxicity.HIDDEN, net.p, None
    for b in begins:
        part = [vector(w) for w in words[b : b + size]]
        if part:
            states = [[None, None] for _ in part]
            for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                h = [0.0] * H
                for i in order:
                    x = part[i] @ p["wx"][:, 3 * H * d : 3 * H * (d + 1)] + p["bx"][3 * H * d : 3 * H * (d + 1)]
                    m = np.array(h) @ p["u"][d]
                    z, r = [sigma(x[k] + m[k]) for k in range(H)], [sigma(x[H + k] + m[H + k]) for k in range(H)]
                    c = [math.tanh(x[2 * H + k] + r[k] * m[2 * H + k]) for k in range(H)]
                    h = [(1 - z[k]) * h[k] + z[k] * c[k] for k in range(H)]
                    states[i][d] = h
            whole = [np.array(s[0] + s[1]) for s in states]
            weight = [math.exp(float(np.tanh(s @ p["wa"] + p["ba"]) @ p["va"])) for s in whole]
            pooled = sum(w * s for w, s in zip(weight, whole, strict=True)) / sum(weight)
        else:
            pooled = np.zeros(2 * H)
        out = float(pooled @ p["wo"] + p["bo"][0])
        worst = out if worst is None else max(worst, out)
    return sigma(worst)


def test_toxicity_by_the_network_word_by_word():
    rng = random.Random(5)
    words = ["ok", "Élan", "rotten", "a", "WORD", "x1y", "tree", "mündlich", "extraordinarily"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 5, 31, 32, 33, 49, 150)]
    net = toxicity.fit([t + (" vile" if i % 2 else "") for i, t in enumerate(texts * 8)], np.arange(len(texts) * 8) % 2)
    got = net.text_scores(*raw(pa.array(texts)))
    assert np.allclose(got, [naive_score(net, t) for t in texts], atol=2e-4)


def test_toxicity_learns_from_whole_texts():
    """The one bad word stands at the very start or end of long texts."""
    rng = random.Random(1)
    clean = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    texts = [clean(5000) if k % 40 == 0 else clean(60) for k in range(1200)]
    y = np.arange(1200) % 4 == 0
    texts = [(f"zyx {t}" if k % 80 else f"{t} zyx") if y[k] else t for k, t in enumerate(texts)]
    net = toxicity.fit(texts, y.astype(int))
    found = net.text_scores(*raw(pa.array([clean(50), f"{clean(3000)} zyx {clean(3000)}", "zyx", clean(4000)])))
    assert (found >= 0.5).tolist() == [False, True, True, False]


@pytest.mark.parametrize("n", [2, 6, 40])
def test_toxicity_takes_few_labels_by_the_same_rule(n):
    net = toxicity.fit(["bad word here" if i % 2 else "good text there" for i in range(n)], np.arange(n) % 2)
    assert net.constant is None and ((net.text_scores(*raw(pa.array(["bad", "good"]))) >= 0) & (net.words[:, 0].any())).all()


# --- quality: the statistics by counting --------------------------------------------------------------------------------------


def naive_features(text):
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * quality.N_FEATURES
    kind = lambda b: (
        8 if b == 10 else 1 if b in b" \t\x0b\x0c\r" else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 7 if b > 127
        else 6 if chr(b) in ".,:;?" else 5 if 32 < b < 127 else 0
    )
    kinds = [kind(b) for b in data]
    share = [kinds.count(k) / n for k in range(9)]
    out = [math.log1p(n), *share[1:9], share[3] / max(share[2] + share[3] + share[7], 1e-9)]
    lines = [x for x in text.encode().split(b"\n")]
    spans = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] else [])
    parts, at = [], 0
    for s in spans:
        parts.append(kinds[at : at + s])
        at += s
    odd, loud = [p.count(5) / len(p) for p in parts], [p.count(3) / len(p) for p in parts]
    wide = [len(p) / n for p in parts]
    out += [max(odd), max(loud), sum(o * w for o, w in zip(odd, wide, strict=True)), sum(w for o, w in zip(odd, wide, strict=True) if o > 0.04), sum(w for o, w in zip(loud, wide, strict=True) if o > 0.3), sum(spans) / len(spans)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return out + [0.0] * 10
    low = [w.decode("latin-1").translate(LOWER) for w in words]
    m, counts = len(words), {w: low.count(w) for w in set(low)}
    pairs = list(zip(low, low[1:], strict=False))
    return [
        *out, math.log1p(m), sum(map(len, words)) / m, len(counts) / m, len(counts) / math.sqrt(m), max(counts.values()) / m,
        sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0, sum(kind(w[-1]) == 5 for w in words) / m, sum(kind(w[0]) == 5 for w in words) / m,
        sum(len(w) == 1 for w in words) / m, len(set(pairs)) / max(m - 1, 1),
    ]


def test_quality_statistics_by_counting():
    rng = random.Random(2)
    texts = ["", " \n\t", "One two.\nONE two;\n\n$x é 42", "a", "\n", *("".join(rng.choices("aB c.\n$9é", k=rng.randint(1, 300))) for _ in range(60))]
    found = quality.document_features(*raw(pa.array(texts)))
    assert np.allclose(found, [naive_features(t) for t in texts], atol=1e-4)
