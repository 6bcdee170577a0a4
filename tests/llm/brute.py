"""The operators' results by their definitions, on small tables, without the library's code where that is possible."""

import math
from collections import Counter

import numpy as np
import xxhash

from tessera.llm.extraction import blocks
from tessera.llm.langid import BINS, _bins


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        edge = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), kept))
    return out


def brute_knn(data, is_query, k=5):
    """Lists of (score, id) by query row, in Python's integers."""
    sound = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(sound):
        if is_query(i):
            found = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(sound) if a != b and len(w) == len(v))
            out[i, tuple((j, -s) for s, j in found[:k])] += 1
    return out


def brute_overlap(doc, item):
    """Longest overlap over all shifts and spans, by trying each."""
    least, fits = min(13, len(item)), []
    for shift in range(-len(item) + 1, len(doc)):
        a, z = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(a, z)]
        if len(item) < 12:
            fits += [(len(item), len(item))] if len(same) == len(item) and all(same) else []
            continue
        spans = [(j - i, sum(same[i:j])) for i in range(len(same)) for j in range(i + least, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i) and (j - i == least or same[i] and same[j - 1])]
        fits += [max(spans)] if spans else []
    return max(fits, default=None)


def brute_extract(pages, length=40):
    """Texts by the definition: words of open blocks that no repeated string of another page of the host covers."""
    streams = {}
    for i, url, page in pages:
        streams[i] = [(k, t) for k, t in blocks(page) if k != b"m"]
    seen = {}
    for i, url, _ in pages:
        s = "\n".join(t for _, t in streams[i]).encode()
        for j in range(len(s) - length + 1):
            seen.setdefault((url, s[j : j + length]), set()).add(i)
    out = {}
    for i, url, page in pages:
        s = "\n".join(t for _, t in streams[i]).encode()
        cover = np.zeros(len(s) + 1, dtype=bool)
        for j in range(len(s) - length + 1):
            if len(seen[url, s[j : j + length]]) > 1:
                cover[j : j + length] = True
        at, kept = 0, []
        for k, t in blocks(page):
            if k == b"m":
                kept.append(t)
                continue
            size = len(t.encode())
            mine = cover[at : at + size].copy()
            edge = np.flatnonzero(np.diff(mine.astype(int), prepend=0, append=0)).reshape(-1, 2)
            for a, z in edge.tolist():
                if z - a < min(length, size):
                    mine[a:z] = False
            at += size + 1
            if k == b"o":
                left, w0 = [], 0
                for w in t.split(" "):
                    n = len(w.encode())
                    left += [] if mine[w0 : w0 + n].any() else [w]
                    w0 += n + 1
                kept += [" ".join(left)] if left else []
        out[i] = " ".join(kept)
    return out


def brute_clause(tokens):
    """Weight of a clause of (kind, weight): each match by what stands before it, and one for a target anywhere."""
    total, target, matched, paired = 0.0, False, False, False
    for i, (kind, w) in enumerate(tokens):
        if kind in ("insult", "threat"):
            if any(k == "negation" for k, _ in tokens[max(0, i - 3) : i]):
                w -= 1.5
            if any(k == "report" for k, _ in tokens[:i]):
                w -= 0.7
            if target and not matched:
                w += 0.5
                paired = True
            matched = True
            total += max(w, 0.1)
        elif kind == "target":
            target = True
            if matched and not paired:
                total += 0.5
                paired = True
    return total


def brute_model(docs, held, weights):
    """Log10 probability of each text with the given weights by bucket; and the summed evidence of the training tokens."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in docs]
    train = [ts for (i, _), ts in zip(docs, tokens) if not held(i)]
    word = Counter(t for ts in train for t in ts)
    pair = Counter(p for ts in train for p in zip(["begin", *ts], ts))
    context = Counter(c for ts in train for c in ["begin", *ts[:-1]])
    # a text's end is never a context; words are contexts wherever they stand
    context = Counter({c: (len(train) if c == "begin" else word[c]) for c in set(context) | set(word)})
    n, v = sum(word.values()), len(word)
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    scores = []
    for ts in tokens:
        s = 0.0
        for c, t in zip(["begin", *ts], ts):
            w = weights[bucket(context[c])]
            s += math.log10(w[0] * (pair[c, t] / context[c] if context[c] else 0) + w[1] * word[t] / max(n, 1) + w[2] / (v + 1))
        scores.append(s)
    two = one = 0.0
    for ts in train:
        for c, t in zip(["begin", *ts], ts):
            two += (pair[c, t] - 1) / (context[c] - 1) * (v + 1) if context[c] > 1 else 0
            one += (word[t] - 1) / max(n - 1, 1) * (v + 1)
    return scores, n, two, one


def brute_language(rows, confidence=0.5):
    """(language, accepted) of rows (text, declared, host), by tables of every count."""
    clean = lambda x: x.strip(" ").lower() if x is not None and x.strip(" ") else None
    grams = lambda t: [int(_bins(np.frombuffer(t[i : i + 3], dtype=np.uint8))[0]) for i in range(len(t) - 2) if not blank(t[i : i + 3])]
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128
    blank = lambda g: not (letter(g[0]) or letter(g[1])) or not (letter(g[1]) or letter(g[2]))
    read = [(grams((t or "").encode()), clean(d), clean(h)) for t, d, h in rows]
    model = {}
    for g, d, _ in read:
        if d and g:
            model.setdefault(d, Counter()).update(g)
    langs = sorted(model)
    if not langs:
        return [(None, False)] * len(rows)

    def alone(g):
        k = min(1.0, 40 / max(len(g), 1))
        return {x: k * sum(math.log((model[x][b] + 0.5) / (sum(model[x].values()) + 0.5 * BINS)) for b in g) for x in langs}

    text = [alone(g) for g, _, _ in read]
    top = [max(langs, key=lambda x: (s[x], [-ord(c) for c in x])) if g else None for s, (g, _, _) in zip(text, read)]
    corpus = Counter(t for t in top if t)
    base = {x: (corpus[x] + 1) / (sum(corpus.values()) + len(langs)) for x in langs}
    said = Counter((d, t) for (_, d, _), t in zip(read, top) if t and d in langs)

    def prior(h):
        p = dict(base)
        if not any(t and h == h2 for (_, _, h2), t in zip(read, top)):
            return p
        names = [of for k in (1, 2) if (of := ".".join(h.split(".")[-k:])) != h] + [h]
        for k, name in zip((1, 2, 99), names) if len(names) == 3 else zip((1, 99) if len(names) == 2 else (99,), names):
            here = Counter(t for (_, _, h2), t in zip(read, top) if t and h2 and ".".join(h2.split(".")[-k:]) == name)
            p = {x: (here[x] + 10 * p[x]) / (sum(here.values()) + 10) for x in langs}
        return p

    out = []
    for s, (g, d, h) in zip(text, read):
        p = prior(h) if h else base
        total = {x: s[x] + math.log(p[x]) for x in langs}
        if d in langs:
            for x in langs:
                total[x] += math.log((said[d, x] + 1) / (sum(said[y, x] for y in langs) + len(langs)))
        best = max(langs, key=lambda x: total[x])
        sure = 1 / sum(math.exp(total[x] - total[best]) for x in langs)
        out.append((best, bool(g) and sure >= confidence))
    return out


def components(keys, linked):
    """Number of each key's component: the position of its first member."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]
