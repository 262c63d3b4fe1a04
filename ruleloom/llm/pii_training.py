"""Labelled texts for the PII classifier, made by rule, and gradient boosting of small trees.

Training happens on the driver over the candidates of TEXTS made-up sentences (a fixed bound); the
corpus itself is never used.
"""

from __future__ import annotations

import math
import random

import numpy as np

#: Made-up sentences that train and calibrate the classifier.
TEXTS = 2400
SEED = 91
TREES, DEPTH, RATE, LEAF_L2 = 32, 3, 0.35, 1.0
#: Share of accepted candidates that must be right on the calibration part.
PRECISION = 0.95

FIRST = "Maria John Ahmed Chen Olga Pedro Anna Louis Fatima Erik Nadia Paul Ingrid Carlos Yuki David Laura Ivan Grace Omar".split()
LAST = "Miller Garcia Novak Schmidt Rossi Tanaka Dubois Larsen Kowalski Silva Ibrahim Petrov Nguyen Weber Martin Lopez".split()
STREETS = "Oak Maple Church Station Park Mill River Hill Garden Bridge King Queen".split()
KINDS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Way Court Ct Square".split()
WORDS = (
    "the report shows that sales rose while costs fell in most regions during last quarter and teams expect more growth after new"
    " products arrive at stores near you with better prices for all members who ask about them"
).split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _fill(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def sentence(r: random.Random) -> tuple[str, tuple[int, int] | None]:
    """A text, and the place of the personal datum in it if it has one."""
    d = lambda n: _digits(r, n)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    name = f"{r.choice(FIRST)} {r.choice(LAST)}"
    local = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    date = r.choice([f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/19{d(2)}", f"19{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"])
    iban = r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]) + d(2) + " " + " ".join(d(4) for _ in range(4)) + " " + d(2)
    good = [
        (r.choice(["call me at ", "phone: ", "my mobile is ", "tel. ", "fax ", "reach us on ", "Telefon ", "teléfono "]), local),
        (r.choice(["ssn ", "social security number ", "SSN: "]), f"{d(3)}-{d(2)}-{d(4)}"),
        (r.choice(["iban ", "transfer to account ", "IBAN: "]), iban),
        (r.choice(["born on ", "date of birth: ", "dob ", "birthday "]), date),
        (r.choice(["device ", "mac address ", "host "]), ":".join(hexes(2) for _ in range(6))),
        (r.choice(["address ", "host ", "from "]), ":".join(hexes(4) for _ in range(8))),
        (r.choice(["write to ", "contact ", "mail "]), f"{r.choice(FIRST).lower()}{r.choice([' at ', ' [at] ', '(at)'])}example{r.choice([' dot ', ' [dot] ', '.'])}{r.choice(['com', 'org', 'net'])}"),
        (r.choice(["said ", "regards ", "by ", "", "from "]), f"{r.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Herr', 'Frau', 'Sra.', 'Mme'])} {name}"),
        (r.choice(["lives at ", "address: ", "ship to ", "at "]), f"{d(r.randint(1, 4)).lstrip('0') or '7'} {r.choice(STREETS)} {r.choice(KINDS)}"),
        (r.choice(["passport ", "passport no. ", "license number "]), f"{r.choice('ABCDEFGHKLMNPRTX')}{d(r.randint(7, 8))}"),
        (r.choice(["open ", "login ", "see "]), f"https://{r.choice(FIRST).lower()}:{hexes(8)}@example.com"),
    ]
    bad = [
        (r.choice(["order ", "invoice ", "ticket ", "case ", "item no. "]), r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)}.{d(3)}.{d(3)}"])),
        (r.choice(["isbn ", "ISBN: "]), f"978-{d(1)}-{d(3)}-{d(4)}-{d(1)}"),
        (r.choice(["version ", "release ", "build "]), f"{d(2)}.{d(2)}.{d(3)}"),
        (r.choice(["on ", "published ", "updated ", "since ", "until "]), date),
        (r.choice(["total ", "price ", "about ", "population "]), f"{d(3)} {d(3)} {d(3)}"),
        (r.choice(["pages ", "rows ", "score ", "ratio "]), f"{d(3)}-{d(3)} {d(3)}-{d(3)}"),
        (r.choice(["part ", "model ", "sku ", "flight "]), f"{r.choice('ABCDEFGHKLMNPRTX')}{d(r.randint(6, 9))}"),
        (r.choice(["time ", "at ", "duration ", "clip "]), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
        (r.choice(["commit ", "digest ", "colour "]), ":".join(hexes(2) for _ in range(6)) if r.random() < 0.2 else f"{d(2)}:{d(2)}:{d(2)}"),
        (r.choice(["see ", "took ", "built "]), f"{d(2)} {r.choice(['Great Way', 'New Drive', 'Long Road'])}" if r.random() < 0.3 else f"{d(2)} {r.choice(STREETS)} trees"),
        (r.choice(["we met ", "look "]), r.choice(["at example dot points", "at home dot com era"])),
        (r.choice(["code ", "ref ", "key "]), f"{r.choice('ABCDEFGH')}{r.choice('ABCDEFGH')}{d(2)} {d(4)} {d(4)} {d(2)}"),
        (r.choice(["numbers ", "values ", "draw "]), " ".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 5)))),
    ]
    before, after = _fill(r, r.randint(0, 9)), _fill(r, r.randint(0, 9))
    personal = r.random() < 0.5
    lead, datum = r.choice(good if personal else bad)
    head = (before + " " if before else "") + lead
    text = head + datum + (r.choice([" ", ", ", ". "]) + after if after else "")
    return text, (len(head), len(head) + len(datum)) if personal else None


def sentences() -> list[tuple[int, str, int, int]]:
    """(number, text, start, end); start is -1 without a personal datum."""
    r = random.Random(SEED)
    out = []
    for k in range(TEXTS):
        text, place = sentence(r)
        out.append((k, text, *(place or (-1, -1))))
    return out


# ---- boosting ---------------------------------------------------------------------------------


def fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
    """A regression tree on gradients: {feature, at, low, high} or {leaf}."""

    def leaf() -> dict:
        return {"leaf": float(-RATE * g.sum() / (h.sum() + LEAF_L2))}

    if depth == 0 or len(g) < 16:
        return leaf()
    base, best = g.sum() ** 2 / (h.sum() + LEAF_L2), (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[:-1] + values[1:]) / 2 if len(values) <= 12 else np.quantile(x[:, f], np.linspace(0.05, 0.95, 12)):
            low = x[:, f] <= at
            if 8 <= low.sum() <= len(g) - 8:
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + LEAF_L2) + (g.sum() - gl) ** 2 / (h.sum() - hl + LEAF_L2) - base
                if gain > best[0]:
                    best = (gain, f, float(at))
    if best[1] < 0:
        return leaf()
    low = x[:, best[1]] <= best[2]
    return {
        "feature": best[1], "at": best[2], "low": fit_tree(x[low], g[low], h[low], depth - 1),
        "high": fit_tree(x[~low], g[~low], h[~low], depth - 1),
    }


def predict(tree: dict, x: np.ndarray) -> np.ndarray:
    if "leaf" in tree:
        return np.full(len(x), tree["leaf"])
    low = x[:, tree["feature"]] <= tree["at"]
    out = np.empty(len(x))
    out[low], out[~low] = predict(tree["low"], x[low]), predict(tree["high"], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[dict], float]:
    share = (y.sum() + 1) / (len(y) + 2)
    start = math.log(share / (1 - share))
    z, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(fit_tree(x, p - y, p * (1 - p), DEPTH))
        z += predict(trees[-1], x)
    return trees, start


def fit(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> tuple[list[dict], float, dict[int, float]]:
    """Trees, their start, and for each generator the margin from which its candidates are accepted.

    Every third row calibrates: the lowest margin at which PRECISION of those above it are right.
    """
    held = np.arange(len(y)) % 3 == 0
    trees, start = boost(x[~held], y[~held])
    z = start + sum(predict(t, x[held]) for t in trees)
    margins = {}
    for k in np.unique(kind).tolist():
        own = kind[held] == k
        order = np.argsort(-z[own], kind="stable")
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        enough = np.flatnonzero(right >= PRECISION)
        if len(enough):
            # half way to the next candidate below, or even odds if there is none
            sorted_z = z[own][order]
            last = enough[-1]
            margins[k] = max(0.0, float(sorted_z[last : last + 2].mean())) if last + 1 < len(sorted_z) else 0.0
    return trees, start, margins
