"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def embedding_links(rows):
    """{vec_id: (links, component)} of distinct ids."""
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and unit[a] @ unit[b] >= 0.9]
    n, of = Counter(x for p in links for x in p), components([i for i, _ in rows], links)
    return {i: (n[i], of[i]) for i, _ in rows}


def judged_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fits = [r for r in rules if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def recurring_lines(docs, minimum=10, share=0.7, leading=3):
    """{doc_id: (lines, dropped lines, text left)} of distinct ids."""
    lines = []
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip():
                tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in line.strip().split())
                lines.append((i, pos, (len(tokens), tokens[:leading]), tokens))
    of_leaf = Counter(x[2] for x in lines)
    lines = [x for x in lines if of_leaf[x[2]] >= minimum]
    with_docs = defaultdict(set)
    for i, _, _, tokens in lines:
        with_docs[tokens].add(i)
    count = Counter()
    for tokens, ids in with_docs.items():
        if leading < len(tokens):
            for at, w in enumerate(tokens):
                count[len(tokens), tokens[:leading], at, w] += len(ids)

    def template(tokens):
        if len(tokens) <= leading or len(with_docs[tokens]) >= minimum:
            return tokens
        constant = [count[len(tokens), tokens[:leading], at, w] >= minimum for at, w in enumerate(tokens)]
        return tuple(w if c else "<*>" for w, c in zip(tokens, constant)) if sum(constant) / len(tokens) >= share else tokens

    places = defaultdict(list)
    for i, pos, _, tokens in lines:
        places[template(tokens)].append((i, pos))
    drop = defaultdict(set)
    for found in places.values():
        if len({i for i, _ in found}) >= minimum:
            for i, pos in sorted(found)[1:]:
                drop[i].add(pos)
    out = {}
    for i, t in docs:
        all_lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(all_lines) if k not in drop[i])
        out[i] = (sum(bool(x.strip()) for x in all_lines), len(drop[i]), left)
    return out


def nearest_part(pattern, text):
    """Least edit distance of ``pattern`` to any part of ``text``."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return row[-1]


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def without_repeats(texts, length=400):
    """[(bytes, removed, runs, digest)] per text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(hash(b[s : s + length]) for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[hash(b[s : s + length])] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        runs = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(covered.sum()), runs, sha(bytes(c for c, g in zip(b, covered) if not g))))
    return out


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(docs):
    """{doc_id: (shingles, component)} of distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [p for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    of = components(sets, links)
    return {i: (len(s), of[i]) for i, s in sets.items()}
