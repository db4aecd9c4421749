"""Plain statements of what the operators have to give, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def spaced(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def least_of_components(ids: list, linked) -> list:  # noqa: ANN001
    """For each position the least id of its component; ``linked(i, j)`` tells links."""
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for r, id_ in zip(root, ids, strict=True):
        if id_ is not None:
            least[r] = min(least.get(r, id_), id_)
    return [least.get(r) for r in root]


def shingles(text: str | None) -> frozenset:
    words = spaced((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_components(docs: list[tuple]) -> list[tuple]:
    sets = [shingles(text) for _, text in docs]

    def linked(i: int, j: int) -> bool:
        shared = len(sets[i] & sets[j])
        return shared > 0 and 100 * shared >= 75 * len(sets[i] | sets[j])

    roots = least_of_components([id_ for id_, _ in docs], linked)
    return [(id_, len(s), root) for (id_, _), s, root in zip(docs, sets, roots, strict=True)]


def without_repeats(docs: list[tuple], window: int) -> list[tuple]:
    words = [spaced(text) for _, text in docs]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (id_, _), w in zip(docs, words, strict=True):
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((id_, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    def words(text: str | None) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    windows: dict[tuple, set] = {}
    for id_, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(id_)
    out = []
    for id_, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x] - {None}
        out.append((id_, len(w), len(hit), sorted(map(str, found))))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def entities(text: str | None) -> list[str]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if fine:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]
