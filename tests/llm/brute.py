"""Plain versions of the contracts, row by row, to hold the operators against."""

import hashlib
import re
from collections import Counter, defaultdict


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def base_secrets(text):
    text, out = text or "", []
    for kind, pattern, least in (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
                                 ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text, re.A) if len(m[1]) >= least]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_personal(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, good in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, width=10):
    pattern = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, text in items:
        w = re.findall(pattern, lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(i)
    out = []
    for d, text in docs:
        w, hit, found = re.findall(pattern, lower(text)), set(), set()
        for n in range(1, width + 1):
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), bool(hit)))
    return out


def near(docs, k, percent):
    sets = []
    for _, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    by, root = defaultdict(list), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def repeats(docs, length):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def fingerprints(docs, k=3):
    import xxhash
    out = []
    for _, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    return out


def close(docs, prints, radius=3):
    """Smallest reachable id of every row, by comparing all pairs of distinct fingerprints."""
    import numpy as np
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ p) <= radius):
            root[find(i)] = find(int(j))
    at = {int(p): find(i) for i, p in enumerate(distinct)}
    least = {}
    for (d, _), p in zip(docs, prints):
        if d is not None:
            least[at[p]] = min(d, least.get(at[p], d))
    return [least.get(at[p]) for p in prints]


def codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, codebooks) of (vec_id, label, vector) rows, with plain Python integers."""
    import math
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    wide = len(kept[0][2]) // parts
    cut = [[v[p * wide:(p + 1) * wide] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        members = defaultdict(list)
        for c, got in zip(cut, assign()):
            for p, (_, e) in enumerate(got):
                members[p, e].append(c[p])
        for (p, e), xs in members.items():
            books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    total = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors):
        total[lab] += e
    listed = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, "".join(f"{e:02x}" for _, e in g), err, total[lab], listed) for (i, lab, _), g, err in zip(kept, got, errors)]


def with_repeats(docs):
    import zlib
    out = []
    for d, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        if d is not None and (h := zlib.crc32(str(d).encode())) % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append((d, w))
    return out


def runs(w, least=24, repeats=3):
    """Runs (start, length, period) of a word list, by comparing it with itself at every distance."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        k = 0
        while k < n - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            e = k
            while e < n - q and w[e] == w[e + q]:
                e += 1
            size = e - k + q
            if size >= max(least, repeats * q) and not any(all(w[x] == w[x + p] for x in range(k, k + size - p)) for p in range(1, q)):
                out.append((k, size, q))
            k = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(d, w):
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    from fractions import Fraction
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (d, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
