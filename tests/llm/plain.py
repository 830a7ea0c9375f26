"""Plain versions of what operators promise, written without their code."""

import re
from collections import Counter


def runs_left(texts, n=50):
    """Documents that hold a run of ``n`` words of an earlier one."""
    seen, bad = set(), set()
    for i, t in texts:
        w = t.split()
        own = {" ".join(w[j : j + n]) for j in range(len(w) - n + 1)}
        if own & seen:
            bad.add(i)
        seen |= own
    return bad


def order(texts):
    """Distinct ``(id, text)``, by id, nulls last."""
    return sorted({(i, t) for i, t in texts if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def without_runs(texts, n=50):
    """Each ``(id, text)`` to the text without later occurrences of runs of ``n`` words, and whether any went; the white space after what goes
    goes too, but a line's rest leaves the line's break."""
    seen, out = {}, {}
    for i, t in order(texts):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        gone = [False] * len(words)
        for j in range(len(words) - n + 1):
            key = tuple(w.group() for w in words[j : j + n])
            if seen.setdefault(key, (i, t, j)) != (i, t, j):
                gone[j : j + n] = [True] * n
        left = t[: words[0].start()] if words else t
        for j, (w, g) in enumerate(zip(words, gone)):
            gap = t[w.end() : words[j + 1].start() if j + 1 < len(words) else len(t)]
            if not g:
                left += w.group() + gap
            elif "\n" in gap and not (j + 1 < len(words) and gone[j + 1]):
                first = max((k + 1 for k in range(j) if not gone[k]), default=0)
                if first and "\n" not in t[words[first - 1].end() : words[first].start()]:
                    left += gap
        out[i, t] = (left if t.endswith("\n") or not any(gone) else left.rstrip()), any(gone)
    return out


def lines(text):
    """The words of each line; a line ends at a line break or after a sentence's last mark; blank ones are left out."""
    return [tuple(x.split()) for x in re.split(r"\n|(?<=[.!?])[ \t]+", text) if x.split()]


def chunk_bounds(texts):
    """Of each ``(id, text)`` the lines that must go, those that may, and all. Two or three lines in a row that stand at an earlier place may go if two
    neighbours among them have ten words; three must if any two have."""
    found, out = {}, {}
    for i, t in order(texts):
        ls, must, may = lines(t), set(), set()
        for n in (2, 3):
            for j in range(len(ls) - n + 1):
                key = tuple(ls[j : j + n])
                if found.setdefault(key, (i, t, j)) != (i, t, j):
                    long = [len(a) + len(b) >= 10 for a, b in zip(key, key[1:])]
                    must.update(range(j, j + n) if n == 3 and all(long) else ())
                    may.update(range(j, j + n) if any(long) else ())
        out[i, t] = Counter(ls[j] for j in must), Counter(ls[j] for j in may), Counter(ls)
    return out
