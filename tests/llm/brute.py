"""Plain restatements of what the corpus operators return."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {c: c + 32 for c in range(65, 91)}


def exact_groups(rows, largest=True):
    """rows: (id, text). Returns {id: (keep, size, kept, digest)} for distinct ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = {}
    for t, ids in groups.items():
        keep = (max if largest else min)(ids)
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())
    return out


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = len(covered)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, failed)


def sizes(text):
    data = (text or "").encode()
    return len(data) + 1, zlib.crc32(data)


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def near_classes(rows, similarity=0.8):
    """rows: (id, text). {id: smallest id of its class}, from all pairs that share a shingle."""
    bags, where = {}, defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        for s in bags[i] or [None]:
            where[s].add(i)
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tried = set()
    for ids in where.values():
        ids = sorted(ids)
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                pair = (ids[a], ids[b])
                if pair in tried or find(pair[0]) == find(pair[1]):
                    continue
                tried.add(pair)
                x, y = bags[pair[0]], bags[pair[1]]
                both = sum((x & y).values())
                total = x.total() + y.total() - both
                if total == 0 or both >= similarity * total:
                    a0, b0 = find(pair[0]), find(pair[1])
                    root[max(a0, b0)] = min(a0, b0)
    return {i: find(i) for i in bags}


def context_tree_scores(train, texts, depth):
    """log10 probabilities of texts by the recursive definition, contexts and decisions in plain dictionaries."""
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(text):
        data = b"\0" * depth + (text or "").encode().lower() + b"\0"
        for i in range(depth, len(data)):
            yield data[i], [data[i - d : i] for d in range(depth + 1)]

    for t in train:
        for byte, contexts in steps(t):
            for c in contexts:
                if c:
                    below[c[1:]].add(c)
                for k in range(8):
                    counts[c, k, byte >> (8 - k)][byte >> (7 - k) & 1] += 1

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    known = {}

    def weighted(c, k, prefix):
        node = (c, k, prefix)
        if node not in counts:
            return 0.0
        if node not in known:
            own = kt(*counts[node])
            if len(c) < depth:
                rest = sum(weighted(longer, k, prefix) for longer in below[c])
                own, rest = max(own, rest), min(own, rest)
                own += math.log1p(math.exp(rest - own)) - math.log(2)
            known[node] = own
        return known[node]

    out = []
    for t in texts:
        total = 0.0
        for byte, contexts in steps(t):
            for k in range(8):
                mixed, left, last = 0.0, 1.0, 0.5
                for c in contexts:
                    node = (c, k, byte >> (8 - k))
                    if node not in counts:
                        break
                    zeros, ones = counts[node]
                    last = (ones + 0.5) / (zeros + ones + 1)
                    stop = 1.0 if len(c) == depth else math.exp(kt(zeros, ones) - math.log(2) - weighted(*node))
                    mixed, left = mixed + left * stop * last, left * (1 - stop)
                one = mixed + left * last
                total += math.log10(one if byte >> (7 - k) & 1 else 1 - one)
        out.append(total)
    return out


def host_verdicts(rows):
    """rows: (text, host). [(kept, host_rate)] in their order."""
    failed, hosts = [rules(t)[5] for t, _ in rows], defaultdict(lambda: [0, 0])
    for bad, (_, host) in zip(failed, rows):
        hosts[host][0] += 1
        hosts[host][1] += bad
    mean = sum(failed) / len(rows)
    rates = [bad / n for n, bad in hosts.values()]
    var = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    strength = min(1e4, max(2.0, mean * (1 - mean) / var - 1)) if var > 0 else 2.0
    verdict = {}
    for host, (n, bad) in hosts.items():
        rate = (bad + mean * strength) / (n + strength)
        verdict[host] = rate, rate - 2 * math.sqrt(rate * (1 - rate) / (n + strength + 1)) > min(0.6, max(0.2, 4 * mean))
    return [(not bad and not verdict[host][1], verdict[host][0]) for bad, (_, host) in zip(failed, rows)]


TOKEN = re.compile("[A-Za-z0-9+/_=-]+")


def markov_spans(texts, drawn):
    """All spans (start, kind, end) of each text; ``drawn`` are the random strings that join training."""
    symbols = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", None]

    def steps(token):
        return zip([None, *token], [*token, None])

    ordinary, values, random = Counter(), Counter(), Counter()
    for t in drawn:
        random.update(steps(t))
    for t in texts:
        own = [x for a, _, b in base_spans(t) for x in TOKEN.findall(t or "", a, b) if len(x) >= 8]
        for x in own:
            values.update(steps(x))
        for x in TOKEN.findall(t or ""):
            if len(x) >= 4 and x not in own:
                ordinary.update(steps(x))
    share = min(1.0, random.total() / values.total()) if values else 0.0
    model = [{}, {}]
    for k, count in enumerate((lambda a, b: ordinary[a, b], lambda a, b: random[a, b] + share * values[a, b])):
        for a in symbols:
            row = sum(count(a, b) + 0.5 for b in symbols)
            for b in symbols:
                model[k][a, b] = math.log((count(a, b) + 0.5) / row)
    out = []
    for t in texts:
        base = base_spans(t)
        more = []
        for m in TOKEN.finditer(t or ""):
            n = len(m[0])
            if n >= 20 and all(b <= m.start() or a >= m.end() for a, _, b in base):
                if sum(model[1][s] - model[0][s] for s in steps(m[0])) >= max(12.0, 0.5 * n):
                    more.append((m.start(), 3, m.end()))
        out.append(sorted([*base, *more]))
    return out


def chain_means(emissions, transitions):
    """Mean label probabilities of a linear chain by forward-backward in plain loops; a uniform start."""
    labels, n = range(len(transitions)), len(emissions)
    step = [[math.exp(transitions[a][b]) for b in labels] for a in labels]
    here = [[math.exp(x - max(e)) for x in e] for e in emissions]
    ahead, behind = [], [[1.0 for _ in labels] for _ in range(n)]
    last = [1 / len(transitions) for _ in labels]
    for e in here:
        last = [sum(last[a] * step[a][b] for a in labels) * e[b] for b in labels]
        total = sum(last)
        last = [x / total for x in last]
        ahead.append(last)
    for k in range(n - 2, -1, -1):
        own = [sum(step[a][b] * here[k + 1][b] * behind[k + 1][b] for b in labels) for a in labels]
        behind[k] = [x / sum(own) for x in own]
    means = [0.0 for _ in labels]
    for f, b in zip(ahead, behind):
        total = sum(x * y for x, y in zip(f, b))
        means = [m + x * y / total / n for m, x, y in zip(means, f, b)]
    return means
