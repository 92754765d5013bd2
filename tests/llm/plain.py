"""Plain versions of the corpus operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def repeated_bytes(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if times[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def shingles(text: str | None) -> frozenset:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str) -> tuple[int, int, int, str]:
    kinds = (
        [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    )
    form = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(kinds, [])))
    return (*map(len, kinds), sha(form))


def markov_ratios(samples: list[tuple[str, bool]], alphabet: str) -> dict[tuple[str, str], float]:
    """Log-likelihood ratio of each character after another ('' at the start), half a count added to each."""
    count: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, kind in samples:
        count[kind].update((text[i - 1] if i else "", c) for i, c in enumerate(text) if c in alphabet)
    known = ["", *alphabet]
    out = {}
    for p in known:
        total = {k: sum(count[k][p, c] + 0.5 for c in alphabet) for k in count}
        for c in alphabet:
            out[p, c] = math.log((count[True][p, c] + 0.5) / total[True]) - math.log((count[False][p, c] + 0.5) / total[False])
    return out


def all_spans(text: str, ratios: dict[tuple[str, str], float], least: float = 10.0) -> tuple[str, int]:
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= 20 and not any(s < m.end() and m.start() < e for s, _, e in base):
            if sum(ratios[p, c] for p, c in zip(["", *m[0]], m[0], strict=False)) > least:
                found.append((m.start(), 3, m.end()))
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in sorted(base + found)), len(found)


def source_targets(sizes: dict[str | None, int], share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Resharing the excess by weight, round by round."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = sum(sizes.values()) * share, set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def language_posteriors(records: list[tuple], ll: list[list[float]]) -> list[list[float]]:
    """Posteriors of (declared, host, suffix) records with log-likelihoods ll, by plain sums over dictionaries."""
    n = len(ll[0])

    def normal(x: list[float]) -> list[float]:
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]

    own = [[round(p * 1_000_000) / 1_000_000 for p in normal(x)] for x in ll]
    out = []
    for k, (declared, host, suffix) in enumerate(records):
        def counts(same) -> list[float]:
            """Posteriors of all other records of the kind, summed."""
            return [sum(o[i] for j, (o, r) in enumerate(zip(own, records, strict=True)) if j != k and same(r)) for i in range(n)]

        def smoothed(c: list[float], parent: list[float], weight: float) -> list[float]:
            return [(x + weight * p) / (sum(c) + weight) for x, p in zip(c, parent, strict=True)]

        general = [sum(o[i] for o in own) for i in range(n)]
        p_all = smoothed(general, [1 / n] * n, 1.0)
        p_suffix = smoothed(counts(lambda r: suffix is not None and r[2] == suffix), p_all, 20.0)
        p_host = smoothed(counts(lambda r: host is not None and r[1] == host and r[2] == suffix), p_suffix, 5.0)
        said = smoothed(counts(lambda r: declared is not None and r[0] == declared), p_all, 1.0)
        out.append(normal([a + math.log(h) + math.log(d / p) for a, h, d, p in zip(ll[k], p_host, said, p_all, strict=True)]))
    return out


def weak_labels(votes: list[tuple[bool, ...]], rounds: int = 200) -> dict[tuple[bool, ...], float]:
    """EM over single documents: posterior of good for each pattern of votes."""
    n = len(votes[0])
    share, objects = 0.9, {False: [0.3] * n, True: [0.01] * n}
    post = {v: 1.0 for v in votes}
    for _ in range(rounds):
        new = {}
        for v in post:
            like = {}
            for good, prior in ((False, 1 - share), (True, share)):
                like[good] = prior
                for said, rate in zip(v, objects[good], strict=True):
                    like[good] *= rate if said else 1 - rate
            new[v] = like[True] / (like[True] + like[False])
        done = max(abs(new[v] - post[v]) for v in post) < 1e-9
        post = new
        share = min(max(sum(post[v] for v in votes) / len(votes), 1e-4), 1 - 1e-4)
        for good, start in ((False, 0.3), (True, 0.01)):
            weight = [post[v] if good else 1 - post[v] for v in votes]
            objects[good] = [(sum(w for w, v in zip(weight, votes, strict=True) if v[k]) + start) / (sum(weight) + 1) for k in range(n)]
        if done:
            break
    return post


def scorer_weights(rows: list[dict], posterior: dict[int, float], rounds: int, rate: float = 2.0) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, one row and feature at a time."""
    w: dict[int, float] = {}
    seen: dict[int, float] = {}
    bias, bias_seen = 0.0, 1e-8
    for _ in range(rounds):
        gradient: dict[int, float] = {}
        whole = 0.0
        for r in rows:
            z = bias + sum(w.get(f, 0.0) * math.sqrt(s) for f, s in zip(r["feature"], r["share"], strict=True))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - posterior[r["pattern"]]) / len(rows)
            whole += error
            for f, s in zip(r["feature"], r["share"], strict=True):
                gradient[f] = gradient.get(f, 0.0) + error * math.sqrt(s)
        for f, g in gradient.items():
            g += 1e-6 * w.get(f, 0.0)
            seen[f] = seen.get(f, 1e-8) + g * g
            w[f] = w.get(f, 0.0) - rate * 0.05 * g / math.sqrt(seen[f])
        bias_seen += whole * whole
        bias -= rate * 0.05 * whole / math.sqrt(bias_seen)
    return w, bias
