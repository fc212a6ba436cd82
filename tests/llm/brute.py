"""The contracts computed plainly, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    w = words(text)
    where = defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i:i + 5])].append(i)
    again = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    n, r = len(w), len(again)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*(sum(k == i for _, k, _ in out) for i in range(3)), sha(joined))


def substring(docs):
    """docs: (doc_id, text)."""
    first = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffixes(docs, size=400):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for i in range(len(b) - size + 1):
            seen[hash(b[i:i + size])] += 1
    out = {}
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[hash(b[i:i + size])] > 1:
                gone[i:i + size] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[d] = (len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def shingles(text):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near(docs):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        both = len(x & y)
        if 100 * both >= 75 * (len(x) + len(y) - both) and (r := root(a)) != (q := root(b)):
            up[max(r, q)] = min(r, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def spelling(docs):
    """(word, form, root, n, n_near, form_n) of every word, near pairs by trying every edit."""
    seen = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if c >= 2 and len(w) >= 7}
    near = defaultdict(set)
    holes = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def collocations(docs, top=2000):
    """docs: (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[i:i + size]) for i in range(len(w) - size + 1))
    rows = defaultdict(list)
    inside = Counter()
    for (lang, *w), a in f.items():
        if len(w) == 3 and a >= 10:
            for part in (w[:2], w[1:]):
                inside[(lang, *part)] = max(inside[(lang, *part)], a)
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= 10 and not 100 * inside[(lang, *w)] >= 50 * a:
            cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, every in rows.items()
            for i, (s, a, p, x, y) in enumerate(sorted(every)[:top], 1)}


def edited(docs):
    """docs: (doc_id, text), ids distinct: doc_id -> (n_chars, edited text, next doc_id)."""
    order = sorted(docs, reverse=True)
    out = {}
    for (d, text), (after, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        out[d] = (len(text), text[:len(text) - half] + other[:half], after)
    return out
