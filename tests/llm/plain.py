"""The models once more in plain Python, one word and one number at a time, to hold the operators against."""

import itertools
import math
import re

import xxhash

M64 = (1 << 64) - 1
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(x):
    x = ((x ^ (x >> 32)) * M1) & M64
    return x ^ (x >> 29)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def coded(word):
    core = word.rstrip(".,;:!?\"')")
    marks = sum(c in "#*$%&|<>~^=+_{}[]\\/@" for c in word)
    head = core[:1] if core[:1].isascii() else ""
    letters = [c for c in core if c.isascii() and c.isalpha()]
    shape = [
        len(core.encode()) > 1 and bool(letters) and all(c.isupper() for c in letters), head.isalpha() and not head.islower(), any("0" <= c <= "9" for c in core),
        marks > 0, marks > 1, any(c in "!?" for c in word[len(core) :]), len(word) - len(core) > 1, not core or marks == len(core.encode()),
    ]
    return xxhash.xxh64_intdigest(ascii_lower(core).encode()) & ~0xFF | sum(bit << k for k, bit in enumerate(shape))


def features(text, bits, chars=0):
    """index -> value."""
    codes = [coded(w) for w in WORD.findall(text or "")]
    out = [mixed(c * M1 & M64) for c in codes] + [mixed(((c & 255) * M3 + M2) & M64) for c in codes]
    for a, b in itertools.pairwise(codes):
        same = int(a >> 8 == b >> 8)
        out.append(mixed((mixed(a) * M2 + b) & M64))
        out.append(mixed((((a & 255) << 9) + ((b & 255) << 1) + same + M1) & M64))
        out.append(mixed((same * M2 + M3) & M64))
    points = [ord(c) for c in text or ""]
    for k in range(len(points) - chars + 1) if chars else ():
        code = 0
        for p in points[k : k + chars]:
            code = (code * M3 + p) & M64
        out.append(mixed((code + M3) * M2 & M64))
    counts = {}
    for x in out:
        counts[x >> (64 - bits)] = counts.get(x >> (64 - bits), 0) + 1
    values = {k: math.log1p(n) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values())) or 1
    return {k: v / length for k, v in values.items()}


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35, min(35, x))))


def ftrl(rows, order, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
    """Weights and bias after the examples (label, features) in the given order."""
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    bias = lambda: -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
    for at in order:
        label, found = rows[at]
        w = {k: weight(k) for k in found}
        b = bias()
        p = sigmoid(sum(w[k] * v for k, v in found.items()) + b)
        for k, v in found.items():
            g = (p - label) * v
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
            n[k] = n.get(k, 0.0) + g * g
        g = p - label
        bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
        bias_n += g * g
    return {k: weight(k) for k in z}, bias()


# ---------------------------------------------------------------- languages
def trigram_names(word):
    edged = ["\0", *word, "\0"]
    return [tuple(map(ord, edged[k : k + 3])) for k in range(len(word))]


def bucket(trigram, bits):
    a, b, c = trigram
    x = (a * M1 & M64) ^ (b * M2 & M64) ^ (c * M3 & M64)
    return ((x ^ (x >> 31)) * M1 & M64) >> (64 - bits)


def words_of(text):
    return ["".join(g) for letter, g in itertools.groupby((text or "").lower(), str.isalpha) if letter]


def mixture(words, chosen, steps=3_000):
    """Log-likelihood and proportions of a set of languages, by plain expectation-maximisation."""
    share = [1 / len(chosen)] * len(chosen)
    tops = [max(w[j] for j in chosen) for w in words]
    p = [[math.exp(w[j] - t) for j in chosen] for w, t in zip(words, tops)]
    for _ in range(steps if len(chosen) > 1 else 1):
        held = [0.0] * len(chosen)
        for row in p:
            both = sum(s * x for s, x in zip(share, row))
            for k, (s, x) in enumerate(zip(share, row)):
                held[k] += s * x / both
        new = [h / len(p) for h in held]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-7
        share = new
        if done:
            break
    return sum(math.log(sum(s * x for s, x in zip(share, row))) + t for row, t in zip(p, tops)), share


def best_set(words, languages):
    """The set of greatest penalised likelihood, of all sets; with its proportions."""
    price = math.log(len(words) + 1)
    best = None
    for m in range(1, languages + 1):
        for chosen in itertools.combinations(range(languages), m):
            loglik, share = mixture(words, chosen)
            if best is None or loglik - price * (m - 1) > best[0] + 1e-9:
                best = loglik - price * (m - 1), chosen, share, loglik
    return best
