"""Plain Python versions of the queries' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def op1(rows):
    """{doc_id: (n_shingles, component_id)}."""
    sets = [(i, shingles(t)) for i, t in rows]
    home = {i: i for i, _ in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    index = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        seen = Counter(m for x in s for m in index[x])
        for m, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both):
                a, b = sorted((root(i), root(sets[m][0])))
                home[b] = a
        for x in s:
            index[x].append(n)
    return {i: (len(s), root(i)) for i, s in sets}


def op3_jump(key: int, shards: int) -> int:
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def op3(rows):
    return {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), op3_jump(i, 8), op3_jump(i, 9)) for i, t in rows}


def op4_targets(sizes: dict):
    """{source: target} by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), [s for s in names if sizes[s]], {s: 0.0 for s in names}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * each > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * each for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def op7(text):
    out = []
    for kind, p in PII:
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    n = Counter(x.split(":")[0] for x in out)
    return (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(out))), out


def op8(rows, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = defaultdict(set)
    for name, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(name))
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def op9(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    again = len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w)


def op10(rows):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    n = Counter(tuple(w[p : p + 35]) for _, w in words for p in range(len(w) - 34))
    out = {}
    for i, w in words:
        gone = {j for p in range(len(w) - 34) if n[tuple(w[p : p + 35])] > 1 for j in range(p, p + 35)}
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out
