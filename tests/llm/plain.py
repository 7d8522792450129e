"""Plain versions of operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lowered(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets):
    """id -> smallest id that links of 75 % reach."""
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in sets}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def without_lines(rows):
    """id -> text without lines that stand before, or within two edits of one before (20 characters or more); and the near ones."""
    first = {}
    for i in sorted(rows):
        for k, line in enumerate((rows[i] or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, k))
    long_ = [x for x in first if 20 <= len(x) < 1000]
    late = {x for x in long_ for y in long_ if first[y] < first[x] and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, k) and x not in late)) for i, t in rows.items()}, late
