"""Plain single-process twins of the contract queries, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m.group())]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_duplicates(docs: dict, percent=85):
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def repeats(docs: dict, width=35):
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    seen = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), sha(kept.encode()))
    return out


def embedding_links(rows, least=0.93):
    good = {}
    for i, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.asarray(v, np.float64)
        if v is not None and label is not None and np.isfinite(v).all() and v.any():
            good[i] = (v / np.linalg.norm(v), label)
    groups = defaultdict(list)
    for i, (_, label) in good.items():
        groups[label].append(i)
    return [(a, b) for ids in groups.values() for k, a in enumerate(ids) for b in ids[k + 1 :] if float(good[a][0] @ good[b][0]) >= least]


def gumbel_ok(rows, share=0.5):
    k = math.ceil(share * len(rows))
    kept = [r["draw"] for r in rows if r["kept"]]
    lost = [r["draw"] for r in rows if not r["kept"]]
    return len(kept) == k and (not kept or not lost or min(kept) >= max(lost))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
