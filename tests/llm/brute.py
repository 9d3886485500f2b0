"""The contracts in plain Python, slow and literal."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def personal(text):
    text = text or ""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    tests = [
        ("email", email, lambda v: True),
        ("ip", ip, lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", card, lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", phone, lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [
        (kind, m.start(), m.end()) for kind, rx, ok in tests for m in rx.finditer(text) if ok(m[0])
    ]


def secret(text):
    text = text or ""
    assign = re.compile(
        r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.ASCII,
    )
    found = []
    for rank, (kind, rx, ok) in enumerate(
        [
            ("assign", assign, lambda m: len(m[1]) >= 12),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
        ]
    ):
        found += [(m.start(), rank, kind, m.end()) for m in rx.finditer(text) if ok(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def label(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    n, repeat = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeat,
        "base_failed": n < 20 or 100 * repeat > 30 * n,
    }


def shingle_set(text, width):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(docs, width, percent):
    """{doc_id: (set size, smallest reachable doc_id)}"""
    sets = {i: shingle_set(t, width) for i, t in docs}
    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in lists[g] if j < i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
