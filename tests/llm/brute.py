"""Plain loops that say what the operators should return, and small tables to try them on."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None, pattern: re.Pattern = WORD) -> list[str]:
    return pattern.findall(lower(text))


def shingles(found: list[str], size: int = 5) -> set[tuple[str, ...]]:
    size = min(size, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id: (number of shingles, least doc_id reachable), comparing all pairs."""
    sets = {k: shingles(words(v)) for k, v in texts.items()}
    parent = {k: k for k in texts}

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def contamination(text: str | None, items: list[tuple[int, str | None]], size: int = 13) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of one document."""
    found = words(text, ALNUM)
    hit, names = set(), set()
    for item, value in items:
        own = words(value, ALNUM)
        length = min(size, len(own))
        for at in range(len(own) - length + 1 if own else 0):
            for place in range(len(found) - length + 1):
                if found[place : place + length] == own[at : at + length]:
                    hit |= set(range(place, place + length))
                    names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(found), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(found)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    out = []
    for _ in range(n):
        out.append("w" + str(rng.randrange(vocabulary)) + rng.choice(["", "", "", ".", ",", "\n"]))
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Unrelated texts, exact and near copies in chains, a shared passage, and odd values."""
    rng = random.Random(seed)
    rows: list[tuple[int, str | None]] = [(i, prose(rng, rng.randrange(20, 120), 4000)) for i in range(n)]
    passage = prose(rng, 60, 4000)
    for i in range(n, n + 12):
        rows.append((i, prose(rng, 40, 4000) + "\n" + passage + "\n" + prose(rng, 40, 4000)))
    base = prose(rng, 80, 4000).split(" ")
    for i in range(n + 12, n + 40):
        edited = list(base)
        for _ in range(rng.randrange(0, 4)):
            edited[rng.randrange(len(edited))] = "x" + str(rng.randrange(10**6))
        rows.append((i, " ".join(edited)))
        if i % 3 == 0:
            base = edited
    rows += [(n + 40 + i, rows[i][1]) for i in range(5)]
    odd = [None, "", " \n\t ", "one", "two words", "a b c d", "a b c d e", "A B C D", "é ß ñ 漢字 x", "\x00 \x01", "..!?", None]
    rows += [(n + 50 + i, value) for i, value in enumerate(odd)]
    rows.append((n + 70, "long " * 30_000))
    rows.append((n + 71, "y" * 300_000))
    return rows
