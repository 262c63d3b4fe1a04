"""Plain Python versions of what the operators' queries return."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def spans_hash(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def licence(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, int]]:
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [
        (m.start(), 1, m.end())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
        if all(int(x) <= 255 for x in m.group().split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORDS.findall(t)
    seen: dict[tuple, list[int]] = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def quality_features(text: str | None) -> list[float]:
    """What op4 judges a text by, counted anew."""
    n_words, chars, symbols, dup_lines, repeats, _ = quality(text)
    t = text or ""
    lines = len([x for x in t.split("\n") if WORDS.search(x)])
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    marks = sum(unicodedata.category(c)[0] not in "LN" and c not in " \t\n\r\f\v#*$%&|<>" for c in t)
    share = lambda a, b, extra: (a / (b + extra)) ** 0.5
    return [
        math.log((chars + 150) / (n_words + 30)), share(symbols, chars, 150), share(upper, chars, 150), share(marks, chars, 150),
        share(dup_lines, lines, 5), share(repeats, n_words, 30),
    ]


def robust_distances(x: np.ndarray, floors: np.ndarray, consistency: float, starts: int = 200, seed: int = 1) -> np.ndarray:
    """Squared distances from the half of lowest determinant that many random starts lead to."""
    r = np.random.default_rng(seed)
    half = -(-len(x) // 2)

    def estimate(rows):
        return rows.mean(axis=0), consistency * np.cov(rows.T, bias=True) + np.diag(floors**2)

    def squared(mean, cov):
        d = x - mean
        return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)

    best = (np.inf, None)
    for _ in range(starts):
        mean, cov = estimate(x[r.choice(len(x), x.shape[1] + 1, replace=False)])
        before = np.inf
        while (now := np.linalg.slogdet(cov)[1]) < before - 1e-9 or before == np.inf:
            before = now
            mean, cov = estimate(x[np.argsort(squared(mean, cov), kind="stable")[:half]])
        best = min(best, (now, squared(mean, cov)), key=lambda b: b[0])
    return best[1]


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def shingles(text: str | None, size: int) -> frozenset:
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(docs: dict[int, str | None], size: int, percent: int) -> dict[int, int]:
    sets = {d: shingles(t, size) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in docs if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


# ---- op6 ----


def leak_tokens(text: str | None, units: frozenset) -> list[tuple[str, str, bool]]:
    """(kind, lower-cased token, whether it opens a sentence) of a text's tokens."""
    unspaced = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f"
    out, opens = [], True
    for m in re.finditer(rf"\d+(?:[.,:]\d+)*|[{unspaced}]|[^\W\d_{unspaced}]+|[.!?\n]", text or ""):
        x = m.group()
        if x in ".!?\n":
            opens = True
            continue
        if x[0].isdigit():
            kind = "number"
        elif x[0].isupper() and len(x) > 1 and not x.isupper():
            kind = "name"
        elif x.lower() in units and out and out[-1][0] == "number" and not opens:
            kind = "unit"
        else:
            kind = "word"
        out.append((kind, x.lower(), opens))
        opens = False
    return out


def leak_views(tokens: list) -> list[list[str]]:
    """The four ways a token sequence is seen."""
    mark = lambda kinds, t: f"<{t[0]}>" if t[0] in kinds else t[1]
    return [
        [t[1] if t[0] == "name" and t[2] else mark(("number", "unit", "name"), t) for t in tokens],
        [mark(("number", "unit", "name"), t) for t in tokens],
        [mark(("number", "unit"), t) for t in tokens],
        [t[1] for t in tokens],
    ]


def leaks(docs: list, items: list, units: frozenset, window: int, share: float, run: int, consistent: float) -> set:
    """(doc_id, item_id) by comparing every window of every document with every window of every item."""
    found = set()
    seen_docs = [(d, t, leak_views(t)) for d, t in ((d, leak_tokens(x, units)) for d, x in docs)]
    for item_id, item_text in items:
        item = leak_tokens(item_text, units)
        if not item:
            continue
        size, n = min(window, len(item)), len(item)
        views = leak_views(item)
        least = min(size, max(2, math.ceil(3 / 8 * size)))
        for doc_id, doc, doc_views in seen_docs:
            places = set()
            for a in range(len(doc) - size + 1):
                for b in range(n - size + 1):
                    for way, (x, y) in enumerate(zip(doc_views, views, strict=True)):
                        w = y[b : b + size]
                        if x[a : a + size] == w and (way == 3 or sum(not (t.startswith("<")) for t in w) >= least):
                            places.add((a - b, b))
            covered, long = set(), False
            for diagonal in {d for d, _ in places}:
                at = sorted(b for d, b in places if d == diagonal)
                runs = [[at[0]]]
                for b in at[1:]:
                    if b > runs[-1][-1] + size:
                        runs.append([b])
                    else:
                        runs[-1].append(b)
                for r in runs:
                    span = range(r[0], r[-1] + size)
                    slots = []
                    for k in span:
                        kind, word, opens = item[k]
                        if views[1][k].startswith("<") and (views[0][k].startswith("<") or word != doc[k + diagonal][1]):
                            slots.append((word, doc[k + diagonal][1]))
                    best: dict = {}
                    for pair in set(slots):
                        best[pair[0]] = max(best.get(pair[0], 0), slots.count(pair))
                    if slots and sum(best.values()) < consistent * len(slots):
                        continue
                    covered |= set(span)
                    told = sum(item[k][1] == doc[k + diagonal][1] and item[k][0] not in ("number", "unit") for k in span)
                    long |= len(span) >= run and 2 * told >= len(span)
            if covered and (long or len(covered) / n >= share):
                found.add((doc_id, item_id))
    return found


# ---- op5 ----


def randomness(token: str, alphabet: str, ordinary: dict, random_spread: dict, regular: tuple, most: float) -> float:
    """The p-value of a token against ordinary ones, from its statistics taken the long way."""
    order = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"
    body = token.rstrip("=")
    n = len(body)
    pairs = [(body[i], body[j]) for i in range(n) for j in range(n) if i != j]
    places = np.array([order.index(c) for c in body], float)
    d = places - places.mean()
    kinds = "".join(map(kind, body))
    steps = [kinds[k : k + 3] for k in range(n - 1) if "-" not in kinds[k : k + 2]]
    differ = lambda x: x[0] != x[1] and x[:2] != "Aa" and x != "aAa"
    letters = [kind(c) for c in alphabet if kind(c) != "-"]
    share = [(k, letters.count(k) / len(letters)) for k in "aA0"]
    value = {
        "collisions": sum(a == b for a, b in pairs) / len(pairs), "changes": sum(map(differ, steps)) / max(1, len(steps)),
        "serial": (d[:-1] * d[1:]).sum() / (d * d).sum() if (d * d).sum() else 1.0,
    }
    expected = {
        "collisions": 1 / len(alphabet), "serial": -1 / n,
        "changes": sum(differ(a + b + c) * x * y * z for a, x in share for b, y in share for c, z in share),
    }
    z, total = 0.0, 0.0
    for name, (usual, spread) in ordinary.items():
        sign = 1 if expected[name] > usual else -1
        beyond = max(0.0, sign * (value[name] - expected[name]) - regular[0] * random_spread[name] / n**0.5)
        weight = abs(expected[name] - usual) / spread
        z += weight * min(most, (sign * (value[name] - usual) - regular[1] * beyond) * n**0.5 / spread)
        total += weight**2
    return 0.5 * math.erfc(z / (2 * total) ** 0.5)


def discovered(p_values: dict, rate: float) -> set:
    """Benjamini-Hochberg."""
    ranked = sorted(p_values, key=p_values.get)
    passed = [k for k, x in enumerate(ranked, 1) if p_values[x] <= rate * k / len(ranked)]
    return set(ranked[: max(passed, default=0)])
