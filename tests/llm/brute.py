"""Plain versions of the operators' results, one document at a time."""

import hashlib
import re
import zlib
from collections import Counter


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def groups(rows, size=5):
    """component of each doc_id, from (doc_id, text)."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                a_, b_ = sorted((top(a), top(b)))
                up[b_] = a_
    return {i: top(i) for i in up}


def contamination(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    words = find(text)
    hit, names = set(), set()
    for item, t in items:
        w = find(t)
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                names.add(item)
    listed = sorted(str(x) for x in names if x is not None)
    return len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal_data(text):
    return [(k, m.start(), m.end()) for k, (r, ok) in PII.items() for m in re.finditer(r, text or "") if ok(m[0])]


def base_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, on = Counter(threes), set()
    for i, t in enumerate(threes):
        if count[t] > 1:
            on.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(on)


def token_pieces(tokenizer, text, capacity=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    out = []
    for a in range(0, len(ids), capacity):
        cut = ids[a : a + capacity]
        out.append((a // capacity, a, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))))
    return out
