"""Plain Python versions of the contracts, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def top_k(rows, k=20, scale=64):
    good = {i: [math.floor(scale * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, a in good.items():
        if q % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def repeats(docs, length=13):
    starts = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - length + 1):
            starts[tuple(w[k:k + length])].add(i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if min(starts[tuple(w[k:k + length])]) < i:
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def components(docs, n, num, den=100):
    sets = {}
    for i, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mix_targets(sizes, repeats=3):
    """Targets by code point with weights 1, 2, 3, …, refilled until none is above repeats times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        capped = {s for s in open_ if left * weight[s] / total > repeats * sizes[s] + 1e-9}
        if not capped:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in capped:
            out[s] = repeats * sizes[s]
        left -= sum(out[s] for s in capped)
        open_ -= capped
    return out


def mix_place(doc_id):
    """A document's place in the mix's shuffled order, in plain integers."""
    t = (doc_id % 2147483647 + 8_000_024) % 2147483647
    t = (t * 1103515245 + 12345) % 2147483647
    t ^= t >> 13
    t = (t * 1812433253) % 2147483647
    return (t ^ t >> 11) % 2147483647


def mixed(docs, repeats=3):
    """How often the mix takes each of docs (doc_id, source, size): all items in one list, sorted by finish time, cut at the budget."""
    sizes = defaultdict(int)
    for _, source, n in docs:
        sizes[source] += n
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    ahead, items = defaultdict(int), []
    for place, i, n, source in sorted(((mix_place(i), i, n, s) for i, s, n in docs), key=lambda x: x[:3]):
        ahead[source] += n
        rank = names.index(source)
        items += [((e * sizes[source] + ahead[source]) / (rank % 3 + 1), rank, place, i, n) for e in range(repeats)]
    left, out = sum(sizes.values()), defaultdict(int)
    for *_, i, n in sorted(items):
        left -= n
        if left < 0:
            break
        out[i] += 1
    return dict(out)


def quality_features(text):
    """The classifier's surface features of one text, word by word."""
    w = [x.encode() for x in words(text)]
    if not w:
        return [0.0] * 14
    symbols = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"}
    raw = text.encode().strip(b" \t\n\v\f\r")
    share = lambda of, data: sum(map(of, data))
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 128
    odd = [x[-1] in symbols for x in w]
    same = [k > 0 and x == w[k - 1] for k, x in enumerate(w)]
    m, size = len(w), len(raw)
    worst = [0.0, 0.0, 0.0]
    for a in [*range(0, max(1, m - 31), 16), max(0, m - 32)]:
        part = w[a:a + 32]
        found = (share(upper, b"".join(part)) / (share(letter, b"".join(part)) + 8), sum(odd[a:a + 32]) / (len(part) + 4), sum(same[a:a + 32]) / (len(part) + 4))
        worst = [max(x) for x in zip(worst, found, strict=True)]
    return [math.log1p(m), share(upper, raw) / (share(letter, raw) + 1), share(symbols.__contains__, raw) / size, sum(odd) / m, w.count(b"|") / m, len(set(w)) / m,
            sum(same) / m, share(b"0123456789".__contains__, raw) / size, min(size / m, 40), share(b".,;:".__contains__, raw) / m, share(b" \t\n\v\f\r".__contains__, raw) / size, *worst]


def site_posteriors(rows):
    """(host posterior, path posterior, probability) of each of rows (host, path, log odds), by loops over all rows."""
    sigmoid, logit = lambda x: 1 / (1 + math.exp(-x)), lambda p: math.log(p / (1 - p))
    inside = lambda p: min(max(p, 1e-3), 1 - 1e-3)

    def shrunk(groups, above):
        """Each group's share of good rows, drawn towards above[group]."""
        n, s = {g: len(x) for g, x in groups.items()}, {g: sum(x) for g, x in groups.items()}
        total = sum(n.values())
        spread = sum(n[g] * (s[g] / n[g] - above[g]) ** 2 - above[g] * (1 - above[g]) for g in groups) / total
        k = min(max(sum(n[g] * above[g] * (1 - above[g]) for g in groups) / total / max(spread, 1e-9) - 1, 2.0), 1e6)
        return {g: (s[g] + k * above[g]) / (n[g] + k) for g in groups}

    good = [round(sigmoid(o), 6) for *_, o in rows]
    share = inside(sum(good) / len(good))
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p, _), x in zip(rows, good, strict=True):
        hosts[h].append(x)
        paths[h, p].append(x)
    of_host = shrunk(hosts, {h: share for h in hosts})
    of_path = shrunk(paths, {g: of_host[g[0]] for g in paths})
    return [(of_host[h], of_path[h, p], sigmoid(o + logit(inside(of_path[h, p])) - logit(share))) for h, p, o in rows]


def resample(docs, target, seed=2024, percent=10, least=20, buckets=10_000, order=1):
    """docs: (doc_id, text); target: texts. (doc_id, n_features, weight, score, rank) by doc_id."""
    def features(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    many_s, many_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (many_s + buckets) / ((s[b] + 1) * (many_t + buckets))))
    out, pool = {}, []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(f), weight, score)
        if n >= least:
            pool.append((-score, i))
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(pool)[:len(pool) * percent // 100])}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the contract's rows, with null ids first and rows of one id by leaf."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: _levels([leaf(r) for r in groups[g]]) for g in names}
    top = _levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, siblings = leaf((*r[:3], r[3] + 1, r[4]) if changed else r), ""
            for levels, k in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    other = level[k ^ 1] if k ^ 1 < len(level) else ""
                    siblings += other
                    now = sha(other + now if k & 1 else now + other)
                    k >>= 1
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]))
    return out


def unigram(docs, parts=7, part=2):
    """docs: (doc_id, text). ({doc_id: (held_out, n_tokens, n_known, base_score)}, N)."""
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % parts == part for i, _ in docs}
    c = Counter()
    for i, t in docs:
        if not held[i]:
            c.update([*low(t), None])
    whole = sum(c.values()) + len(c) + 1
    return {i: (held[i], len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), None]), sum(math.log10((c[w] + 1) / whole) for w in [*low(t), None])) for i, t in docs}, sum(c.values())
