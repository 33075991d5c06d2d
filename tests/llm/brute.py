"""Plain Python versions of the training-data queries, written from their contracts alone."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def substring_dedup(docs, length=13):
    """docs: (doc_id, text) pairs; rows (doc_id, n_words, n_removed, sha256)."""
    first = {}
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in at[g] if j < i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def line_frequency(docs, min_docs=20, max_share=0.02):
    """docs: (doc_id, source, text); rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    normal = lambda x: " ".join(words(x.translate(low)))
    hosts = Counter(s for s, _ in {(s, t or "") for _, s, t in docs})  # copies of a text are one document
    holds, first = defaultdict(set), {}
    for i, s, t in docs:
        for x in {normal(x) for x in (t or "").split("\n") if words(x)}:
            holds[s, x].add(t or "")
            if i is not None:
                first[s, x] = min(first.get((s, x), i), i)
    out = []
    for i, s, t in docs:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lost = 0
        for x in lines:
            n = len(holds[s, normal(x)])
            if n > min_docs and n > max_share * hosts[s] and first.get((s, normal(x))) != i:
                lost += len(words(x))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        left = len(w) - lost
        kept = not failed and left >= 10 and left >= 0.2 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), failed, kept))
    return out


def base_score(docs):
    """docs: (doc_id, text); rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = lambda t: [*words(ascii_lower(t)), None]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    c = Counter(x for (_, t), h in zip(docs, held, strict=True) if not h for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(docs, held, strict=True):
        w = tokens(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
}


def base_pii(docs):
    """rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256)."""
    out = []
    for i, t in docs:
        found = {k: [m for m in re.finditer(p, t or "", re.A) if ok(m[0])] for k, (p, ok) in PII.items()}
        said = ",".join(f"{k}:{m.start()}:{m.end()}" for k in PII for m in found[k])
        out.append((i, *[len(found[k]) for k in PII], hashlib.sha256(said.encode()).hexdigest()))
    return out


def top_k(rows, is_query, k=10):
    """rows: (id, vector); set of (query_id, rank, id, score)."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out
