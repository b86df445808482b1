"""Plain-Python versions of the corpus operators, for comparison on small inputs."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def ascii_lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def secrets(text):
    kinds = (("assign", r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    found, counts = [], []
    for k, (name, pattern, group, least) in enumerate(kinds):
        hits = [m for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
        counts.append(len(hits))
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in hits]
    return (*counts, sha(",".join(x for *_, x in sorted(found))), [x for *_, x in sorted(found)])


def repeats(docs, window=50):
    """docs: {id: text}"""
    first = {}
    for d in sorted(docs):
        t = (docs[d] or "").encode()
        for k in range(len(t) - window + 1):
            first.setdefault(t[k : k + window], d)
    out = {}
    for d, text in docs.items():
        t = (text or "").encode()
        gone = np.zeros(len(t) + 2, dtype=bool)
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < d:
                gone[k + 1 : k + 1 + window] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[1:-1]]) if t else b""
        out[d] = (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(kept))
    return out


def fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, max_bits=2):
    """fps: {id: fingerprint}"""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def quality(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {p + o for ps in places.values() if len(ps) > 1 for p in ps for o in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(ascii_lower(t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= found
        out.append((d, len(w), len(hit), len(named), sha(",".join(sorted(named))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def lines(docs, min_docs=10):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for _, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or count[key(x)] < min_docs]
        out.append((d, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return out
