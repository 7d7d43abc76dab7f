"""Small inputs and plain Python versions that the operators are compared with."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PLAIN = "The quick fox sees a lazy dog. It runs home, then sleeps until noon. Nobody minds."
# names that the operators use themselves
CLASHING = ["size", "score", "kept", "host", "features", "shard", "rank", "n", "key", "uid", "hash", "key_root"]

EDGE_ROWS = [
    (1, PLAIN, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n \x0b ", "en", "b"),
    (5, PLAIN, "en", "b"), (5, PLAIN, "en", "b"), (None, PLAIN + " More.", "de", None), (6, LONG, "en", "a"),
    (7, "one", None, "c"), (8, "Two Words", "fr", "c"), (9, "É\u00a0ß <|endoftext|> it's 12 ***\n\nx", "fr", "a"),
    (10, "a a a a\na a a a\n" * 40, "en", "a"), (None, None, None, None)]


def edge_documents(spark, rows=EDGE_ROWS):
    wide = [(*r, len(r[1] or ""), *[str(i) for i in range(len(CLASHING))]) for r in rows]
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def words(text):
    return WORD.findall((text or "").translate(CAPITALS))


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(texts, size, percent):
    """Smallest reachable id of every id, all pairs compared."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 100 * low >= percent * high:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (low + high - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}
