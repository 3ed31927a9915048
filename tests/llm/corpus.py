"""Small corpora and brute-force versions for the tests of this folder."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words long, mark string"


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """Nulls, empty, blank, very long and repeated rows; columns with names operators use."""
    line = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, line, "en", "src0"), (2, line, "en", "src0"), (2, line, "en", "src0"),
        (3, None, "en", None), (4, "", None, "src1"), (5, " \t\n\x0b\x0c\r ", "xx", "src1"),
        (6, "one two", "en", "src1"), (7, "ONE Two", "en", "src1"), (None, line + " end", None, None),
        (8, "x" * 700_000 + " tail", "de", "src2"), (9, "a b " * 60_000, "en", "src2"),
        (10, "éÉ \U0001f600 " * 40, "fr", "a/test/b"), (11, "\x00 nul\x1c byte\x85   wide", "en", ""),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "m") for r in rows], COLUMNS)


def base_counts(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    fives = Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if fives[tuple(found[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered))


def shingles(text):
    found = words((text or "").translate(LOWER))
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def near_components(texts, percent=85):
    """doc_id -> smallest reachable doc_id, by an inverted index over all shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def cut_repeats(texts, window=35):
    """(words kept, words removed) of each text of a list."""
    found = [words(t) for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in found for i in range(len(w) - window + 1))
    out = []
    for w in found:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append(([x for i, x in enumerate(w) if i not in gone], len(gone)))
    return out
