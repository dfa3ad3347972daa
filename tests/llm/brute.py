"""Plain statements of the rules, one text at a time."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "a b c a b c a b c",
    "Line one\nLine one\n\nline two\nLine one",
    "é ü 日本語 text with ünïcode é ü 日本語 text",
    "x" * 5000,
    "# * $ % & | < > symbols",
    "tab\tsep\x0bvt\x0cff\rcr\x1cfs\xa0nbsp",
    "word " * 3000,
    "mail a.b@example.com now 10.0.0.1 4111 1111 1111 1111 +1 (202) 555-0143",
    "<|endoftext|> <s> hi </s> ▁x",
    "😀 emoji 😀 emoji 😀",
]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            hit.update((k, k + 1, k + 2))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        repeated += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit), failed


def contaminated(text, items):
    """n_words, n_hit, sorted item ids."""
    words = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        other = ITEM_WORD.findall((body or "").translate(LOWER))
        n = min(10, len(other))
        if n:
            windows = {tuple(other[k : k + n]) for k in range(len(other) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def fingerprint(text):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=2):
    """Smallest index linked to each fingerprint."""
    parent = list(range(len(fingerprints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= radius:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(fingerprints))]


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(text):
    total = 0
    for k, c in enumerate(reversed([c for c in text if c in "0123456789"])):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = sum(c in "0123456789" for c in m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m=m, d=digits: 14 <= d <= 19 and luhn(m[0]),
                "phone": lambda d=digits: 10 <= d <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))
