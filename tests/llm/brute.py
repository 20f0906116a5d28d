"""Plain versions of the operators, for small inputs."""

from collections import defaultdict


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def exact_repeats(rows, least=46, size=5):
    """doc_id -> word positions in runs of least shingles or more that an earlier document has in the same order."""
    seen, out = defaultdict(list), {}
    for doc, text in sorted(rows):
        w = words(text)
        s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
        covered, run = set(), {}
        for i, x in enumerate(s):
            now = {}
            for d, p in seen[x]:
                now[d, p] = run.get((d, p - 1), 0) + 1
                if now[d, p] >= least:
                    covered.update(range(i - now[d, p] + 1, i + size))
            run = now
        if covered:
            out[doc] = covered
        for i, x in enumerate(s):
            seen[x].append((doc, i))
    return out


def best_similarity(rows, doc, least=46, size=5):
    """Of a document, the largest share of a window of least shingles that any one earlier document holds."""
    sets = {d: {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} for d, t in rows if d < doc for w in [words(t)]}
    w = words(dict(rows)[doc])
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    best = 0
    for other in sets.values():
        hit = [x in other for x in s]
        k = sum(hit[:least])
        best = max(best, k)
        for i in range(least, len(s)):
            k += hit[i] - hit[i - least]
            best = max(best, k)
    return best / least
