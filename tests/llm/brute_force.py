"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def shingles(own, size=5):
    size = min(size, len(own))
    return [tuple(own[k : k + size]) for k in range(len(own) - size + 1)] if own else []


def items_in(texts, items):
    """(text, item) -> best weighted similarity of 0.8 or more over all windows of the item's length."""
    own_items = [words(item) for item in items]
    counts = [Counter(shingles(own)) for own in own_items]
    holders = defaultdict(set)
    for k, count in enumerate(counts):
        for one in count:
            holders[one].add(k)
    found = {}
    for t, text in enumerate(texts):
        own = words(text)
        near = {k for one in set(shingles(own)) | {tuple(own)} for k in holders.get(one, ())}
        near |= {k for k in range(len(items)) if 0 < len(own_items[k]) < 5}
        for k in near:
            size, best = len(own_items[k]), 0.0
            for at in range(max(1, len(own) - size + 1)):
                window = Counter(shingles(own[at : at + size]))
                shared = sum((window & counts[k]).values())
                total = sum(window.values()) + sum(counts[k].values()) - shared
                best = max(best, shared / total)
            if best >= 0.8:
                found[t, k] = best
    return found


def jaccard_classes(texts, threshold=0.8):
    """id -> (class_id, n_links, copy_of, n_copies) for texts by id."""
    sets = {id: frozenset(shingles(words(text))) for id, text in texts.items()}
    copies = defaultdict(list)
    for id, own in sets.items():
        if own:
            copies[own].append(id)
    keys = list(copies)
    holders = defaultdict(list)
    for k, own in enumerate(keys):
        for one in own:
            holders[one].append(k)
    shared = Counter()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] += 1
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for (a, b), n in shared.items():
        if n >= threshold * (len(keys[a]) + len(keys[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for k, own in enumerate(keys):
        first[find(k)] = min(first.get(find(k), min(copies[own])), min(copies[own]))
    out = {id: (id, 0, id, 1) for id in texts}
    for k, own in enumerate(keys):
        for id in copies[own]:
            out[id] = (first[find(k)], links[k], min(copies[own]), len(copies[own]))
    return out


BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    """kind:start:end of the base kinds, straight from their patterns."""
    found = []
    for kind, pattern in BASE_PATTERNS.items():
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip":
                ok = all(int(part) <= 255 for part in match[0].split("."))
            elif kind == "card":
                doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
                luhn = sum(d if d < 10 else d - 9 for d in doubled) % 10 == 0
                ok = 16 <= len(digits) <= 19 and luhn
            elif kind == "phone":
                ok = 8 <= len(digits) <= 15
            else:
                ok = True
            if ok:
                found.append(f"{kind}:{match.start()}:{match.end()}")
    return ",".join(found)
