"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def line_dedup(texts, min_docs=10):
    keys = [[lowered(line.strip(WHITE)) for line in (t or "").split("\n")] for t in texts]
    seen = Counter(k for own in keys for k in set(own) if k)
    out = []
    for text, own in zip(texts, keys):
        rows = (text or "").split("\n")
        kept = [r for r, k in zip(rows, own) if seen[k] < min_docs]
        out.append(("\n".join(kept), len(rows), len(rows) - len(kept)))
    return out


def fingerprint(text):
    w = words(lowered(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, threshold=2):
    """{id: (fingerprint, component)} of {id: text}."""
    ids = sorted(docs)
    prints = {i: fingerprint(docs[i]) for i in ids}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= threshold]
    component = least_reachable(ids, links)
    return {i: (prints[i], component[i]) for i in ids}


def quality(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    rows = [r for r in (text or "").split("\n") if words(r)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        folded = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(folded) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def personal(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def vectors(rows, threshold=0.98):
    """{id: (links, component)} of (id, vector, label)."""
    good = [(i, np.array(v, float), l) for i, v, l in rows
            if v is not None and l is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = []
    for n, (a, v, l) in enumerate(good):
        for b, w, m in good[n + 1:]:
            if l == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links.append((a, b))
    count = Counter(x for pair in links for x in pair)
    component = least_reachable([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], component[r[0]]) for r in rows}


def prefix_trie(rows):
    """Sorted rows of the trie of rebuilt conversations, of (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [t[3] for t in sorted(own)] for c, own in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    leaves, saved, out = Counter(), Counter(), []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode())
            children[p[:-1]].add(p)
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                    sha(",".join(map(str, ends[p])))))
    return sorted(out, key=str)


def whitening(vectors, components=16):
    """(n, deviations, whitened, explained) of finite vectors, exact up to the eigenvectors."""
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    z = (n * fit - sums).astype(object)
    cov = np.array([[float(Fraction(int(v), n ** 3)) for v in row] for row in z.T.dot(z)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    apart = n * x - sums
    return n, (apart ** 2).sum(1), apart / n @ axes / np.sqrt(values), values / np.trace(cov)
