"""The operators once more, in plain Python over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

M = (1 << 64) - 1
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal(text):
    return re.sub(r"[ \t\n\r\f]+", " ", text.lower()).strip(" ")


def exact_kept(rows):
    """Of (id, text) rows those that stay; None as an identifier is last."""
    best, out = {}, []
    for i, t in rows:
        if t is None:
            out.append((i, t))
        elif (n := normal(t)) not in best or (i is not None and (best[n] is None or i < best[n])):
            best[n] = i
    return out + [(i, n) for n, i in best.items()]


def shingles(text, size=4):
    w = WORD.findall((text or "").lower().encode())
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


class Joined:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def near_groups(rows, threshold=0.7):
    """[(kept identifier, all identifiers)] of (id, text) rows; identifiers are distinct here."""
    at = defaultdict(list)
    for i, t in rows:
        if s := shingles(t):
            at[s].append(i)
    sets = sorted(at, key=lambda s: min(at[s]))
    has = defaultdict(list)
    for j, s in enumerate(sets):
        for x in s:
            has[x].append(j)
    same, held = Joined(), []
    for j, a in enumerate(sets):
        same.root(j)
        common = defaultdict(int)
        for x in a:
            for k in has[x]:
                if k < j:
                    common[k] += 1
        for k, both in common.items():
            b = sets[k]
            less, more = sorted((len(a), len(b)))
            if both >= threshold * more - 1e-9:
                same.join(j, k)
            elif both >= threshold * less - 1e-9:
                held.append((j, k, both / less) if len(a) < len(b) else (k, j, both / less))
    crowds = defaultdict(list)
    for j in range(len(sets)):
        crowds[same.root(j)].append(j)
    chief = {r: min(js, key=lambda j: min(at[sets[j]])) for r, js in crowds.items()}  # the set of the document that would stay
    first = {r: min(at[sets[j]]) for r, j in chief.items()}
    best = {}
    for small, large, share in held:
        x, y = same.root(small), same.root(large)
        if x != y and small == chief[x]:
            best[x] = min(best.get(x, (0,)), (-share, -len(sets[large]), first[y], y))
    tree = Joined()
    for x, way in best.items():
        tree.join(x, way[-1])
    groups = defaultdict(list)
    for r in crowds:
        groups[tree.root(r)].append(r)
    out = []
    for rs in groups.values():
        ids = [i for r in rs for j in crowds[r] for i in at[sets[j]]]
        if len(ids) > 1:
            head = min(rs, key=lambda r: (r in best, -len(sets[chief[r]]) if r in best else 0, first[r]))
            out.append((first[head], sorted(ids)))
    return out


def poured(pot, children):
    """Shares of pot by name for children {name: (cap, weight)}."""
    got, left = {}, dict(children)
    while left:
        line = Fraction(pot - sum(got.values())) / sum(w for _, w in left.values())
        full = {k: c for k, (c, w) in left.items() if c <= line * w}
        if not full:
            return got | {k: line * w for k, (_, w) in left.items()}
        got |= full
        left = {k: v for k, v in left.items() if k not in full}
    return got


def mixed(rows, mix):
    """{(id, lang, source): epochs} of (id, text, lang, source) rows with distinct identifiers."""
    docs = defaultdict(list)
    for i, t, lang, source in rows:
        if t:
            n = re.search("([0-9]{1,9})$", source or "")
            docs["d%d" % (int(n[1]) % 4 if n else 0), lang or "(none)", source or "(none)"].append((i, -(-len(t.encode()) // 4)))
    tokens = {k: sum(n for _, n in v) for k, v in docs.items()}

    def down(pot, path):
        if len(path) == 3:
            return {path: pot}
        level = ("domain", "lang", "source")[len(path)]
        names = {k[len(path)] for k in docs if k[: len(path)] == path}
        cap = lambda n: mix.epochs * sum(v for k, v in tokens.items() if k[: len(path) + 1] == (*path, n))
        out = {}
        for n, p in poured(pot, {n: (cap(n), mix.weights.get(level, {}).get(n, 1)) for n in names}).items():
            out |= down(p, (*path, n))
        return out

    out = {}
    for leaf, pot in down(math.floor(sum(tokens.values()) * mix.budget), ()).items():
        full, rest = divmod(math.floor(pot), tokens[leaf])
        done = 0
        for i, n in sorted(docs[leaf], key=lambda d: hashlib.md5(f"{mix.seed}:{full + 1}:{d[0]}".encode()).hexdigest()):
            done += n
            if full + (done <= rest):
                out[i] = full + (done <= rest)
    return out


def quality_features(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 11
    n = len(raw)
    share = lambda chars: sum(b in chars for b in raw) / n
    stop, space = set(b".,;:'\"?-"), {9, 10, 13, 32}
    upper, digit = set(range(65, 91)), set(range(48, 58))
    rest = set(range(128)) - stop - space - upper - digit - set(range(97, 123))
    f = [share(upper), share(digit), share(space), share(stop), share(rest)]
    w = WORD.findall(raw)
    if not w:
        return [*f, 0, 0, 0, 0, share({10}), 0]
    c = len(w)
    return [*f, sum(a == b for a, b in zip(w, w[1:])) / c, math.log1p(len(set(w))) / math.log1p(c), sum(map(len, w)) / c / 10, sum(len(x) > 12 for x in w) / c, share({10}), math.log1p(c) / 10]


def mix64(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M
    return x ^ (x >> 32)


def _toss(x, before):
    d = x ^ before
    place = (d & -d).bit_length() - 1
    return 2 * place + (x >> place & 1)


def phrases(text, levels=5, seed=5):
    """[(name as a signed integer, first byte)]."""
    row = [(b, i) for i, b in enumerate(text.encode())]
    for level in range(levels):
        runs = []
        for name, start in row:
            if runs and runs[-1][0] == name:
                runs[-1][2] += 1
            else:
                runs.append([name, start, 1])
        row = [(x if n == 1 else mix64((x * 0x9E3779B97F4A7C15 + n) & M), s) for x, s, n in runs]
        lab = [x for x, _ in row]
        for _ in range(4):
            lab = [_toss(x, lab[i - 1] if i else x ^ 1) for i, x in enumerate(lab)]
        for c in (5, 4, 3):
            lab = [min({0, 1, 2} - set(lab[max(0, i - 1) : i] + lab[i + 1 : i + 2])) if x == c else x for i, x in enumerate(lab)]
        wide = [3, *lab, 3]
        top = [wide[i] < x > wide[i + 2] for i, x in enumerate(lab)]
        low = [wide[i] > x < wide[i + 2] for i, x in enumerate(lab)]
        begin = [i == 0 or top[i] or (low[i] and not top[i - 1] and not (i + 1 < len(top) and top[i + 1])) for i in range(len(lab))]
        out = []
        for i, (name, start) in enumerate(row):
            if begin[i]:
                out.append([0, start, 0])
            out[-1][2] += 1
            out[-1][0] = (out[-1][0] + mix64((name + out[-1][2] * 0xC2B2AE3D27D4EB4F + seed * 1000 + level) & M)) & M
        row = [(mix64(x), s) for x, s, _ in out]
    return [(x - (1 << 64) if x >> 63 else x, s) for x, s in row]


def shards(rows, number):
    """[(id, shard, size)] of (id, text) rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups["" if t is None else hashlib.md5(t.encode()).hexdigest()].append((i, len((t or "").encode())))
    head = {k: min((i for i, _ in v if i is not None), default=math.inf) for k, v in groups.items()}
    order = sorted(groups, key=lambda k: (head[k], k))
    sizes = [sum(n for _, n in groups[k]) for k in order]
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    best = [0] + [math.inf] * len(sizes)  # the least largest shard over the first groups
    for _ in range(number):
        best = [0] + [min(max(best[i], upto[j] - upto[i]) for i in range(j)) for j in range(1, len(upto))]
    shard, here, out = 0, 0, []
    for k, n in zip(order, sizes):
        if here + n > best[-1]:
            shard, here = shard + 1, 0
        here += n
        out += [(i, shard, m) for i, m in groups[k]]
    return out
